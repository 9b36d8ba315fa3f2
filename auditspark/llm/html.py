"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text that lies in them outside menus, adverts and the like; from the best one a
page climbs until no text but links is left outside. The path of where it stops, tags and classes from the root without
digits, is the page's vote. Spark counts votes by host; paths with at least SHARE of a host's votes win, so each of its
layouts has its path and a page that was misread alone has none. Each page is extracted again from the containers at its
host's winning paths. Its own container decides only where no winner is on the page or where the winners hold less than half
of the text in its own that isn't links: then the page isn't of the host's kind.

Inside an article only containers whose names call them adverts, menus, notices, sidebars or reader comments are dropped, not
single paragraphs or tables; outside more names lead away from it. Pages are read twice, once for the vote and once for the
text; work and memory grow with a page's length, however deep its elements are nested and however broken its tags.

Nulls and odd input: a null or empty page has an empty text; a null or odd url votes in a host of its own kind; unclosed and
stray tags are repaired as browsers do in the usual cases; an unclosed comment, script or style runs to the end; from a tag
on whose quotes or whose end are never closed, tags end at the next ``>`` whatever quotes say, and what follows the last one
is text; rows with equal ids are extracted each; very long pages are read whole; an empty table gives an empty result; more
columns are kept, whatever their names, and those named host or main_text replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded, cut

#: Share of its host's votes from which a path wins.
SHARE = 0.1

# Possessive throughout: a tag that doesn't end is found out in one pass. An attribute's name is tried from its first letter.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"</?[a-zA-Z]")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_END_OF_RAW = {}
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_SPACE = re.compile(r"\s+")

# Elements of HTML by how they behave.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "article", "section", "main", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "form", "nav", "aside", "header", "footer", "menu", "dialog", "center", "hgroup", "search"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
SINGLE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "figcaption", "summary"}
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
LISTS = ("ul", "ol", "dl", "table", "div", "section", "article", "body")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Words in the class or id of elements that hold no article: parts of names outside of articles; inside, names
# of containers that are such a word or, for some, begin with it.
_NAMES = "ads?|adverts?|advert[a-z]*|adsense|sponsor[a-z]*|promo[a-z]*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|notices?|alert|popup|newsletter|subscribe|comments?|commentlist|disqus|respond|reply|replies"
_OUTSIDE = "banner|side|modal|overlay|subscription|share|sharing|social|related|recommended|widget|login|signup|signin|search|form|toolbar|pagination|pager|skip|copyright|legal|disclaimer"
_AWAY = re.compile(r"(?:^| )(?:(?:ads?|adverts?|advert[a-z]*|adsense|sponsor[a-z]*|promo[a-z]*|cookies?|consent|gdpr|newsletter|subscribe|comments?|commentlist|disqus|respond|sidebar)(?:[-_][^ ]*)?|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|notices?|alert|popup|reply|replies)(?: |$)")
_AWAY_OUTSIDE = re.compile(rf"(?:^|[-_ ])(?:{_NAMES}|{_OUTSIDE})(?:[-_ ]|$)")
_HEAD = re.compile(r"(?:^|[-_ ])(?:header|topbar|top)(?:[-_ ]|$)")
_GOOD = re.compile(r"(?:^|[-_ ])(?:content|article|post|entry|main|story|body|text)(?:[-_ ]|$)")


def _tokens(source: str):
    """(text before a tag, whether it closes, its name, its attributes) of each tag outside comments and raw elements; the
    last text has no tag."""
    at, begin, end, match = 0, 0, len(source), _TAG.match
    while (i := source.find("<", at)) >= 0:
        if m := match(source, i):
            closes, tag, attributes = m.groups()
            tag = tag.lower()
            yield source[begin:i], closes, tag, attributes
            at = begin = m.end()
            if tag in RAW and not closes and not attributes.rstrip().endswith("/"):
                raw = _END_OF_RAW.setdefault(tag, re.compile(rf"</{tag}\b", re.I)).search(source, at)
                close = source.find(">", raw.end()) if raw else -1
                at = begin = close + 1 if close >= 0 else end
        elif _NAME.match(source, i):
            if match == _PLAIN_TAG.match:
                break  # no > follows
            match = _PLAIN_TAG.match  # it ran to the end of the page: no tag is read so again
        elif source.startswith("<!--", i):
            close = source.find("-->", i + 4)
            yield source[begin:i], False, "", ""
            at = begin = close + 3 if close >= 0 else end
        elif source.startswith(("<!", "<?"), i):
            close = source.find(">", i)
            if close < 0:
                break
            yield source[begin:i], False, "", ""
            at = begin = close + 1
        else:
            at = i + 1
    yield source[begin:], False, "", ""


class Page:
    """Nodes by number, parents first: parent, path (a number: equal for equal tags and classes from the root on), step (the
    last tag and its classes); blocks: (node, text, length of its links) outside what is dropped."""

    def __init__(self, source: str):
        self.parent, self.path, self.step, self.good, self.blocks = [-1], [0], [""], [False], []
        self._tags, self._dropped, self._inside = ["#"], [False], [False]
        self._paths, self._open_now = {}, Counter()
        self._stack, self._parts, self._linked, self._links = [0], [], 0, 0
        for text, close, tag, attributes in _tokens(source):
            self._text(text)
            if close:
                self._close(tag)
            elif tag:
                self._open(tag, attributes)
        self._flush()

    def _text(self, text: str) -> None:
        if text and not self._dropped[self._stack[-1]]:
            text = _html.unescape(text) if "&" in text else text
            self._parts.append(text)
            if self._linked:
                self._links += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                self.blocks.append((self._stack[-1], text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _pop(self, place: int) -> None:
        self._flush()
        self._open_now.subtract(self._tags[i] for i in self._stack[place:])
        del self._stack[place:]

    def _last_open(self, tags, until=()) -> int | None:
        """Place on the stack of the innermost open element of tags, if none of until is further in."""
        if any(self._open_now[x] for x in tags):
            for i in range(len(self._stack) - 1, 0, -1):
                tag = self._tags[self._stack[i]]
                if tag in tags:
                    return i
                if tag in until:
                    break
        return None

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._parts.append(" ")
        elif tag == "hr":
            self._flush()
        elif tag == "a":
            self._linked += 1
        if tag not in BLOCK and tag not in DROPPED:
            return
        self._flush()
        if tag not in ("button", "label") and (i := self._last_open(("p",))) is not None:
            self._pop(i)
        elif tag in CLOSES:
            while (i := self._last_open(CLOSES[tag], LISTS)) is not None:
                row = self._tags[self._stack[i]] == "tr"
                self._pop(i)
                if tag != "tr" or row:
                    break
        values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        names = f"{values.get('class', '')} {values.get('id', '')}".lower().strip()
        above = self._stack[-1]
        good = tag in ("article", "main") or bool(names) and bool(_GOOD.search(names))
        inside = self._inside[above] or good and tag in CONTAINERS
        away = tag in DROPPED or values.get("role", "").lower() in ROLES or "hidden" in values.get("class", "").lower().split() or "hidden" in attributes and bool(_HIDDEN.search(_QUOTED.sub("", attributes)))
        if not away and tag not in ("html", "body", "article", "main"):
            away = bool(names) and bool(tag not in SINGLE and _AWAY.search(names) if inside else _AWAY_OUTSIDE.search(names)) or not inside and (tag == "header" or bool(names) and bool(_HEAD.search(names)))
        kinds = ".".join(sorted({re.sub(r"\d+", "", x) for x in values.get("class", "").lower().split()} - {""}))
        node = len(self.parent)
        self.parent.append(above)
        step = tag + f".{kinds}".replace(">", "_") * bool(kinds)
        self.step.append(step)
        self.path.append(self._paths.setdefault((self.path[above], step), len(self._paths) + 1))
        self.good.append(good)
        self._tags.append(tag)
        self._dropped.append(self._dropped[above] or away)
        self._inside.append(inside)
        self._stack.append(node)
        self._open_now[tag] += 1

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._linked = max(0, self._linked - 1)
        elif tag in BLOCK or tag in DROPPED:
            if (i := self._last_open((tag,))) is not None:
                self._pop(i)

    def above(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]

    def best(self) -> int | None:
        """The container with the highest score, text of its blocks, a fifth less with each container further up, or the
        first one above it that holds all text but links; none if only the page itself does."""
        n = len(self.parent)
        score, text, seen = [0.0] * n, [0] * n, [False] * n
        for node, block, links in self.blocks:
            score[node] += max(0, len(block) - 2 * links) + 1e-3
            text[node] += not self._mostly_links(block, links)
            seen[node] = True
        all_text, best = sum(text), None
        for i in range(n - 1, 0, -1):  # children come after their parents
            container = self._tags[i] in CONTAINERS
            if seen[i] and container and (best is None or score[i] * (1.5 if self.good[i] else 1.0) >= most):
                best, most = i, score[i] * (1.5 if self.good[i] else 1.0)
            above = self.parent[i]
            score[above] += score[i] * (0.8 if container else 1.0)
            text[above] += text[i]
            seen[above] |= seen[i]
        if best is None:
            return None
        return next((i for i in self.above(best) if text[i] == all_text and self._tags[i] in CONTAINERS), None)

    @staticmethod
    def _mostly_links(text: str, links: int) -> bool:
        return 2 * links > len(text)

    def named(self, node: int) -> str:
        """The path of a node as text, the same on every page."""
        return "".join(f">{self.step[i]}" for i in list(self.above(node))[::-1])

    def at(self, paths) -> set[int]:
        """Nodes at the paths, which are texts as named() gives them."""
        wanted = set()
        for path in paths:
            at = 0
            for step in path.split(">")[1:]:
                at = self._paths.get((at, step), -1)
            wanted.add(at)
        return {i for i, at in enumerate(self.path) if i and at in wanted}

    def under(self, nodes: set[int]) -> list[int]:
        """Places of the blocks in nodes."""
        inside = [False] * len(self.parent)
        for i in range(1, len(inside)):
            inside[i] = i in nodes or inside[self.parent[i]]
        return [k for k, (node, *_) in enumerate(self.blocks) if inside[node]]


def main_text(source: str | None, winners: list[str] | None) -> str:
    """The page's main text, blocks parted by an empty line."""
    page = Page(source or "")
    own = page.best()
    mine = set(page.under({own}) if own is not None else range(len(page.blocks)))
    taken = set(page.under(page.at(winners or ())))
    size = lambda some: sum(len(page.blocks[k][1]) for k in some if not page._mostly_links(*page.blocks[k][1:]))
    if not size(taken) or 2 * size(taken & mine) < size(mine):
        taken = mine if size(mine) else mine | taken
    return "\n\n".join(page.blocks[k][1] for k in sorted(taken))


@F.arrow_udf(StringType())
def _vote(pages: pa.Array) -> pa.Array:
    out = []
    for source in pages:
        page = Page(source.as_py() or "")
        best = page.best()
        out.append(page.named(best) if best is not None else None)
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def _extract(pages: pa.Array, winners: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py(), w.as_py()) for p, w in zip(pages, winners)], pa.string())


def host_paths(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, winners): of each host the paths with the most votes. pages has a column host."""
    votes = pages.select("host", _vote(html_col).alias("path")).filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    ranked = votes.withColumn("all", F.sum("votes").over(Window.partitionBy("host"))).filter(F.col("votes") >= SHARE * F.col("all"))
    return ranked.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("winners"))


def extract(pages: DataFrame, *, html_col="html", url_col="url") -> DataFrame:
    """All columns of pages, with host and main_text."""
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.struct(*[x for x in pages.columns if x not in ("host", "main_text")]).alias("row"), host.alias("host"))
    winners = cut(host_paths(rows, f"row.{html_col}"), "html-hosts")
    winners = winners.select(F.col("host").alias("of"), "winners")
    joined = rows.join(bounded(winners, winners.count()), F.col("host") == F.col("of"), "left")
    return joined.select("row.*", "host", _extract(f"row.{html_col}", "winners").alias("main_text"))
