"""Where a value stands: staged search of a document's pages, whose text knows which item each of its characters is of.

A page is one row: the keys of its words (and lines) joined without separators, where each begins, and their centres. A
value split or joined differently by whoever read the page is still found, as a run of characters; the items that it spans
follow from where they begin. Needles are one row each and go through the stages

* ``value``: any printed form of the values, page by page from the cited one outwards,
* ``row``: the other terms of its row, on the cited page only, where they confirm but don't choose a page,
* ``anchor``: the clause that it was read from, page by page;

on a page by exact runs of words, then of lines (numbers aren't looked for in lines), then an amount by its whole digits, then
the run with most of the words of a long phrase. Of several places the one nearest to the clause counts. A needle meets each
of its pages once, in a join for all stages: what a row or clause has there is kept until no later page has the value. A needle
whose value is found has no page to join any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_digits, bind, nfkc, value_digits
from .locate import PAGES, scan_order

# Letters that are one letter, marks that are dropped, answers that stand on no page, punctuation at edges.
LETTERS_FROM, LETTERS_TO = "کیأإآٱ", "كياااا"
PLACE_MARKS = "[ـً-ْٰ]"
NOT_PRINTED = ("yes", "no", "true", "false", "n/a", "na", "none", "unknown")
EDGES = "،,.:;()[]{}«»\"'“”‘’-—…"
#: Words between two of a phrase, the least digits of an amount, and the length from which a run needs no boundary.
GAP, AMOUNT_DIGITS, LONG = 2, 4, 4
STAGES = ["value", "row", "anchor"]
_VALUE, _PART = "\x01", "\x02"


def place_key(v: Column) -> Column:
    """What a place is compared by: no white space, thousands separators, marks and case; one form of digits and letters."""
    t = F.translate(ascii_digits(v), "٬٫", ",.")
    t = nfkc(F.regexp_replace(t, r"(?U)(?<=[0-9])[,\s](?=[0-9]{3}(?![0-9]))", ""))
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(t, LETTERS_FROM, LETTERS_TO), PLACE_MARKS, ""), r"(?U)\s+", ""))


def page_index(words: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, words, lines) of items (doc_id, page, idx, content, x, y): of each kind text, starts, idx, x, y, tokens."""
    item = lambda df, kind: df.select("doc_id", "page", "idx", place_key(F.col("content")).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(kind).alias("kind"))
    items = item(words, "w").unionByName(item(lines, "l")).repartition("doc_id", "page")  # the window and the aggregate share it
    before = Window.partitionBy("doc_id", "page", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("start", F.coalesce(F.sum(F.length("key")).over(before), F.lit(0)).cast("int"))
    one = F.struct("idx", "start", "key", "x", "y")
    sides = {name: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, one))) for name, kind in (("words", "w"), ("lines", "l"))}
    rows = items.groupBy("doc_id", "page").agg(*[v.alias(k) for k, v in sides.items()])
    part = lambda name, field: F.transform(name, lambda i: i[field])

    def side(name: str) -> Column:
        tokens = F.transform(name, lambda i: F.btrim(i["key"], F.lit(EDGES)))
        return F.struct(F.array_join(part(name, "key"), "").alias("text"), part(name, "start").alias("starts"), part(name, "idx").alias("idx"), part(name, "x").alias("x"), part(name, "y").alias("y"), tokens.alias("tokens")).alias(name)

    return rows.select("doc_id", "page", side("words"), side("lines"))


def search_terms(values: Column) -> Column:
    """Of an array of values: forms (keys in order of preference), digits of amounts, words of phrases, whether any is printed."""
    values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
    percent = F.transform(values, lambda v: F.regexp_extract(v, r"^\s*(\d+(?:[.,]\d+)?)\s*%\s*$", 1))
    given = F.concat(values, F.transform(F.filter(percent, lambda p: p != ""), lambda p: F.concat(F.lit("%"), p)))
    decimal = lambda v: v.rlike(r"\d\.\d") & ~v.rlike(r"\d\.\d{3}(?!\d)")
    comma = F.transform(F.filter(given, decimal), lambda v: F.regexp_replace(v, r"(?<=\d)\.(?=\d)", ","))
    keys = lambda array: F.split(place_key(F.array_join(array, _VALUE)), _VALUE, -1)
    split = F.transform(values, lambda v: F.regexp_replace(v, r"(?U)\s+", _PART))
    tokens = F.transform(keys(split), lambda v: F.filter(F.transform(F.split(v, _PART, -1), lambda t: F.btrim(t, F.lit(EDGES))), lambda t: F.length(t) >= 2))
    return F.struct(
        F.filter(F.array_distinct(keys(F.concat(given, comma))), lambda f: f != "").alias("forms"),
        F.filter(F.transform(values, value_digits), lambda d: F.length(d) >= AMOUNT_DIGITS).alias("digits"),
        F.filter(tokens, lambda t: F.size(t) >= 3).alias("phrases"),
        F.exists(keys(values), lambda k: (k != "") & ~k.isin(*NOT_PRINTED)).alias("printed"),
    )


def positions(text: Column, needle: Column) -> Column:
    """Where needle begins in text, from 0, places that overlap included."""
    n = F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")))
    none = F.array().cast("array<int>")
    step = lambda found, _: F.concat(found, F.array(F.position(needle, text, F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(-1)) + 2) - 1))
    return F.when((needle != "") & F.contains(text, needle), F.aggregate(F.sequence(F.lit(1), n), none, step)).otherwise(none)


def is_number(needle: Column) -> Column:
    return needle.rlike(r"^[0-9.,:/%()\-]+$") & needle.rlike("[0-9]")


def runs(side: Column, needle: Column, amount: bool = False) -> Column:
    """Every place of needle in a side of a page, as (first, last) item. A short needle must be whole words, a number the whole
    printed number; the digits of an amount may go on with a fraction."""
    text, starts = side["text"], side["starts"]
    char = lambda k: F.substr(text, k + 1, F.lit(1))
    joined = lambda k: ~F.array_contains(starts, k)  # noqa: E731  # of the same item as the character before it
    digit, dot, letter = (lambda c, p=p: c.rlike(p) for p in ("[0-9]", "[./]", r"[\p{L}\p{N}]"))
    end, n = (lambda i: i + F.length(needle)), F.length(text)
    after = lambda i: (end(i) < n) & joined(end(i))
    glued = lambda i: (i > 0) & joined(i) & letter(char(i - 1)) | after(i) & letter(char(end(i)))
    goes_on = lambda i: F.lit(False) if amount else dot(char(end(i))) & (end(i) + 1 < n) & joined(end(i) + 1) & digit(char(end(i) + 1))
    before = lambda i: (i > 0) & joined(i) & (digit(char(i - 1)) | dot(char(i - 1)) & (i > 1) & joined(i - 1) & digit(char(i - 2)))
    inside = lambda i: before(i) | after(i) & (digit(char(end(i))) | goes_on(i))
    number = F.lit(True) if amount else is_number(needle)
    short = F.lit(False) if amount else F.length(needle) < LONG
    kept = F.filter(positions(text, needle), lambda i: ~(short & glued(i)) & ~(number & inside(i)))
    owner = lambda i: F.size(F.filter(starts, lambda s: s <= i)) - 1
    return F.transform(kept, lambda i: F.struct(owner(i).alias("first"), owner(end(i) - 1).alias("last")))


def phrase_run(tokens: Column, phrases: Column, gap: int = GAP) -> Column:
    """The run of items with most different words of the first phrase that has enough of them (4, or 3 that are 60 %)."""
    none, no_words = F.lit(-1), F.array().cast("array<string>")
    best = lambda s, n, b, e: F.struct(n.alias("n"), b.alias("first"), e.alias("last"))
    state = lambda start, seen, last, gaps, top: F.struct(start.alias("start"), seen.alias("seen"), last.alias("last"), gaps.alias("gaps"), top.alias("top"))
    ended = lambda s: F.when((s["start"] >= 0) & (F.size(s["seen"]) > s["top"]["n"]), best(s, F.size(s["seen"]), s["start"], s["last"])).otherwise(s["top"])

    def item(words: Column):
        def step(s: Column, i: Column) -> Column:
            t = F.get(tokens, i)
            here = state(F.when(s["start"] < 0, i).otherwise(s["start"]), F.array_union(s["seen"], F.array(t)), i, F.lit(0), s["top"])
            out = state(none, no_words, none, F.lit(0), ended(s))
            wait = state(s["start"], s["seen"], s["last"], s["gaps"] + 1, s["top"])
            return F.when(F.array_contains(words, t), here).when(s["start"] < 0, s).when(s["gaps"] + 1 > gap, out).otherwise(wait)

        return step

    def phrase(found: Column, words: Column) -> Column:
        run = F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), state(none, no_words, none, F.lit(0), found["top"]), item(words), ended)
        enough = lambda top: (top["n"] >= 4) | (top["n"] >= 3) & (top["n"] >= 0.6 * F.size(F.array_distinct(words)))
        new = bind(lambda r: F.struct(r["top"].alias("top"), enough(r["top"]).alias("done")), top=run)
        return F.when(found["done"], found).otherwise(new)

    start = F.struct(best(None, F.lit(0), none, none).alias("top"), F.lit(False).alias("done"))
    found = F.aggregate(phrases, start, phrase)
    return F.when((F.size(tokens) > 0) & (F.size(phrases) > 0), bind(lambda r: F.when(r["hit"]["done"], F.struct(r["hit"]["top"]["first"].alias("first"), r["hit"]["top"]["last"].alias("last"))), hit=found))


def _centre(side: Column, run: Column) -> Column:
    mean = lambda v: F.aggregate(F.slice(v, run["first"] + 1, run["last"] - run["first"] + 1), F.lit(0.0), lambda a, x: a + x) / (run["last"] - run["first"] + 1)
    return F.struct(mean(side["x"]).alias("x"), mean(side["y"]).alias("y"))


def _first(options: Column) -> Column:
    return F.get(F.filter(options, lambda x: x.isNotNull()), F.lit(0))


def anchor_centre(page: Column, terms: Column) -> Column:
    """The centre of the clause's place: its first exact run in words or lines, else the run of most of its words."""
    first = lambda side, n: bind(lambda r: F.when(F.size(r["o"]) > 0, _centre(side, r["o"][0])), o=runs(side, n))
    exact = lambda n: F.coalesce(first(page["words"], n), first(page["lines"], n))
    loose = bind(lambda r: F.when(r["o"].isNotNull(), _centre(page["words"], r["o"])), o=phrase_run(page["words"]["tokens"], terms["phrases"]))
    return F.coalesce(_first(F.transform(terms["forms"], exact)), loose)


def _nearest(side: Column, found: Column, anchor: Column) -> Column:
    """Of several runs the one nearest to the anchor, the first of equals; the first if there is no anchor."""

    def away(run: Column) -> Column:
        return bind(lambda r: (r["c"]["x"] - r["a"]["x"]) * (r["c"]["x"] - r["a"]["x"]) + (r["c"]["y"] - r["a"]["y"]) * (r["c"]["y"] - r["a"]["y"]), c=_centre(side, run), a=anchor)

    ranked = F.array_min(F.transform(found, lambda run, i: F.struct(F.coalesce(away(run), F.lit(0.0)).alias("d"), i.alias("i"), run.alias("run"))))["run"]
    return F.when(F.size(found) > 1, ranked).otherwise(F.get(found, F.lit(0)))


def place_on_page(page: Column, terms: Column, anchor: Column) -> Column:
    """(kind, how, first, last) of the terms on a page, or null; first and last are numbers of words or lines."""
    place = lambda kind, how, run: F.when(run.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(how).alias("how"), F.get(page[kind]["idx"], run["first"]).alias("first"), F.get(page[kind]["idx"], run["last"]).alias("last")))
    on = lambda kind, n, how, amount=False: bind(lambda r: place(kind, how, _nearest(page[kind], r["o"], anchor)), o=runs(page[kind], n, amount))
    exact = lambda n: F.coalesce(on("words", n, "exact"), F.when(~is_number(n), on("lines", n, "exact")))
    return F.coalesce(
        _first(F.transform(terms["forms"], exact)),
        _first(F.transform(terms["digits"], lambda d: on("words", d, "amount", True))),
        bind(lambda r: place("words", "phrase", r["o"]), o=phrase_run(page["words"]["tokens"], terms["phrases"])),
    )


def locate_values(pages: DataFrame, needles: DataFrame, documents: DataFrame, budget: int = PAGES) -> DataFrame:
    """needle_id, doc_id, stage, page, kind, how, first, last, looked: each needle's place (nulls if it has none, with the page
    cited) and at how many pages was looked for it.

    pages: page_index(); needles (needle_id, doc_id, page, values, row_terms, anchors): arrays; documents (doc_id, pages).
    """
    rows = needles.join(documents, "doc_id", "left").withColumn("order", scan_order(F.col("page"), F.coalesce("pages", F.lit(1)), budget))
    rows = rows.select("needle_id", "doc_id", "order", search_terms(F.col("values")).alias("value"), search_terms(F.col("row_terms")).alias("row"), search_terms(F.col("anchors")).alias("anchor"))
    names = {"stage": "string", "page": "int", "kind": "string", "how": "string", "first": "int", "last": "int"}
    none = F.lit(None).cast("struct<" + ", ".join(f"{x}: {t}" for x, t in names.items()) + ">")
    counts = [f"looked_{x}" for x in STAGES]
    rows = rows.withColumns({"hit": none} | {x: F.lit(0) for x in counts})
    right = pages.select(F.col("doc_id").alias("page_doc"), F.col("page").cast("int").alias("page_no"), F.struct("words", "lines").alias("p"))
    there = F.col("page_no").isNotNull()
    of = F.coalesce(F.col("hit.stage"), F.lit(""))
    asks = lambda stage: F.col(stage)["printed"] & (F.size(F.col(stage)["forms"]) > 0)

    def found(step: Column) -> Column:
        clause = F.when((step["stage"] == "value") & (F.size("anchor.forms") > 0), anchor_centre(F.col("p"), F.col("anchor")))
        place = bind(lambda r: place_on_page(F.col("p"), step["terms"], r["clause"]), clause=clause)
        full = lambda r: F.struct(*[{"stage": step["stage"], "page": F.col("want")}.get(x, r["hit"][x] if x in ("kind", "how", "first", "last") else None).cast(t).alias(x) for x, t in names.items()])
        return bind(lambda r: F.when(r["hit"].isNotNull(), full(r)), hit=place)

    # A page serves all stages that may want it in one join; a value on a later page goes before a row or clause on this one.
    for at in range(budget):
        ask = {"value": (of != "value") & asks("value"), "row": F.col("hit").isNull() & asks("row") if at == 0 else F.lit(False), "anchor": F.col("hit").isNull() & asks("anchor")}
        wanted = rows.withColumns({f"ask_{x}": F.coalesce(c, F.lit(False)) for x, c in ask.items()})
        wanted = wanted.withColumn("want", F.when(F.col("ask_value") | F.col("ask_row") | F.col("ask_anchor"), F.get("order", F.lit(at))))
        joined = wanted.join(right, (F.col("doc_id") == F.col("page_doc")) & (F.col("want") == F.col("page_no")), "left")
        steps = F.array(*[F.struct(F.lit(x).alias("stage"), F.col(x).alias("terms"), F.col(f"ask_{x}").alias("asked")) for x in STAGES])
        here = F.when(there, F.aggregate(steps, none, lambda hit, step: F.when(hit.isNotNull() | ~step["asked"], hit).otherwise(found(step))))
        joined = joined.withColumn("here", here)
        now = F.coalesce(F.col("here.stage"), F.lit(""))
        passed = {"value": F.lit(True), "row": now != "value", "anchor": ~now.isin("value", "row")}
        looked = [(F.col(f"looked_{x}") + (there & F.col(f"ask_{x}") & passed[x]).cast("int")).alias(f"looked_{x}") for x in STAGES]
        rows = joined.select("needle_id", "doc_id", "order", *STAGES, F.when(now == "value", F.col("here")).otherwise(F.coalesce("hit", "here")).alias("hit"), *looked)
    looked = F.col("looked_value") + F.when(of == "value", 0).otherwise(F.col("looked_row") + F.when(of == "row", 0).otherwise(F.col("looked_anchor")))
    return rows.select("needle_id", "doc_id", F.col("hit.stage").alias("stage"), F.coalesce("hit.page", F.get("order", F.lit(0))).alias("page"), "hit.kind", "hit.how", "hit.first", "hit.last", looked.alias("looked"))
