"""Places of values against a plain search over random pages, and how often pages are looked at."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from auditspark.operators import places
from auditspark.operators.locate import PAGES

EDGE = places.EDGES


def key(v):
    v = (v or "").translate(str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬٫", "01234567890123456789,."))
    v = unicodedata.normalize("NFKC", re.sub(r"(?<=\d)[,\s](?=\d{3}(?!\d))", "", v)).translate(str.maketrans("کیأإآٱ", "كياااا"))
    return re.sub(r"\s+", "", re.sub("[ـً-ْٰ]", "", v)).lower()


def forms(values):
    out = list(values) + [f"%{m[1]}" for v in values if (m := re.fullmatch(r"\s*(\d+(?:[.,]\d+)?)\s*%\s*", v))]
    out += [re.sub(r"(?<=\d)\.(?=\d)", ",", v) for v in list(out) if re.search(r"\d\.\d", v) and not re.search(r"\d\.\d{3}(?!\d)", v)]
    return list(dict.fromkeys(k for k in map(key, out) if k))


def number(n):
    return bool(re.fullmatch(r"[\d.,:/%\-()]+", n)) and any(c.isdigit() for c in n)


def spans(items, needle, amount=False):
    """By a text with a bar between items: nothing reaches over a bar but the needle itself."""
    text, owners = "", []
    for i, (content, *_) in enumerate(items):
        for c in key(content):
            text, owners = text + c, owners + [i]
    of = lambda k: owners[k] if 0 <= k < len(owners) else None
    out = []
    for at in range(len(text) - len(needle) + 1):
        end = at + len(needle)
        if text[at:end] != needle:
            continue
        left = "".join(text[k] for k in range(max(0, at - 2), at) if of(k) == of(at))
        right = "".join(text[k] for k in range(end, min(len(text), end + 2)) if of(k) == of(end - 1))
        if not amount and len(needle) < 4 and (left[-1:].isalnum() or right[:1].isalnum()):
            continue
        if (amount or number(needle)) and (re.search(r"\d[./]?$", left) or re.match(r"\d" if amount else r"[./]?\d", right)):
            continue
        out.append((owners[at], owners[end - 1]))
    return out


def phrase(items, values):
    best = (0, -1, -1)
    for v in values:
        words = [t for t in (key(w).strip(EDGE) for w in re.split(r"\s+", v)) if len(t) >= 2]
        if len(words) < 3:
            continue
        hits = [i for i, (c, *_) in enumerate(items) if key(c).strip(EDGE) in words]
        groups = []
        for i in hits:
            if groups and i - groups[-1][-1] <= 3:
                groups[-1].append(i)
            else:
                groups.append([i])
        for g in groups:
            n = len({key(items[i][0]).strip(EDGE) for i in g})
            if n > best[0]:
                best = (n, g[0], g[-1])
        if best[0] >= 4 or best[0] >= 3 and best[0] >= 0.6 * len(set(words)):
            return best[1:]
    return None


def centre(items, run):
    some = items[run[0] : run[1] + 1]
    return sum(i[1] for i in some) / len(some), sum(i[2] for i in some) / len(some)


def clause(page, anchors):
    for n in forms(anchors):
        for side in ("words", "lines"):
            if s := spans(page[side], n):
                return centre(page[side], s[0])
    run = phrase(page["words"], anchors)
    return centre(page["words"], run) if run else None


def amount_digits(v):
    rest = re.sub(r"[\d\s.,/:%٬٫\-()]+", "", re.sub(r"\b(sar|usd|eur|gbp|aed|ريال|درهم|دولار|يورو)\b", "", v, flags=re.I))
    m = re.search(r"\d[\d,\s٬٫.]*", key(v))
    return re.split(r"[.٫/]", m[0])[0].lstrip("0") if m and len(rest) <= 2 else ""


def on_page(page, values, near):
    def pick(kind, how, some):
        if near and len(some) > 1:
            some = sorted(some, key=lambda s: sum((a - b) ** 2 for a, b in zip(centre(page[kind], s), near)))
        return kind, how, *some[0]

    for n in forms(values):
        if s := spans(page["words"], n):
            return pick("words", "exact", s)
        if not number(n) and (s := spans(page["lines"], n)):
            return pick("lines", "exact", s)
    for d in map(amount_digits, values):
        if len(d) >= 4 and (s := spans(page["words"], d, True)):
            return pick("words", "amount", s)
    run = phrase(page["words"], values)
    return ("words", "phrase", *run) if run else None


def ladder(pages, doc, cited, total, values, row, anchors):
    order = sorted(range(1, max(total, 1) + 1), key=lambda p: (abs(p - min(max(cited, 1), max(total, 1))), p > cited))[:PAGES]
    looked = 0
    for stage, terms, where in (("value", values, order), ("row", row, order[:1]), ("anchor", anchors, order)):
        if all(key(t) in places.NOT_PRINTED for t in terms if t.strip()) or not forms(terms):
            continue
        for p in where:
            page = pages.get((doc, p))
            if page:
                looked += 1
                near = clause(page, anchors) if stage == "value" and anchors else None
                if found := on_page(page, terms, near):
                    return stage, p, *found, looked
    return None, order[0], None, None, None, None, looked


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma,", "delta", "eps", "a", "of", "(zeta)", "12", "3.2", "2.14", "2.14.1", "7,017,614.10", "٧٬٠١٧٬٦١٤٫١٠", "7017614/10", "28", "%28", "2,50%", "1,500", "500", "عقد", "كتاب", "کتاب", "yes", "no", "-", "ﬁne", "12/2024", "189.9", "89.9"]
    pages, words, lines = {}, [], []
    for doc in range(25):
        for p in range(1, rng.randint(1, 6) + 1):
            if rng.random() < 0.1:
                continue
            w = [(rng.choice(vocabulary), round(rng.random() * 9, 2), round(rng.random() * 9, 2)) for _ in range(rng.randint(0, 30))]
            l = [(" ".join(x[0] for x in w[i : i + 6]), float(i), 0.5) for i in range(0, len(w), 6)]
            l += [("only in a line", 1.0, 1.0)] * (rng.random() < 0.3)
            if w or l:
                pages[doc, p] = {"words": w, "lines": l}
            words += [(doc, p, i, *x) for i, x in enumerate(w)]
            lines += [(doc, p, i, *x) for i, x in enumerate(l)]

    def term():
        kind = rng.random()
        if kind < 0.35 and words:
            at = rng.randrange(len(words))
            return rng.choice([" ", "", "  "]).join(x[3] for x in words[at : at + rng.randint(1, 6)])
        if kind < 0.5:
            return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 8)))
        return rng.choice(["SAR 7,017,614.10", "28%", " 28 %", "2.50%", "2.14", "89.9", "yes", "N/A", "", " ", "1500", "1.500", "unknown words", "in a line", "n", "of", "fine", "12", "7017614.10", "about 7,017,614"])

    needles = []
    for i in range(220):
        lists = [[term() for _ in range(rng.choice(sizes))] for sizes in ((1, 1, 2, 3, 0), (0, 1, 2), (0, 1, 1, 2))]
        needles.append((i, rng.randrange(26), rng.choice([0, 1, 2, 3, 9]), *lists))
    return pages, words, lines, needles


def test_ladder_against_a_plain_search(spark):
    stages = set()
    for seed in (1, 2):
        pages, words, lines, needles = random_case(seed)
        item = "doc_id int, page int, idx int, content string, x double, y double"
        index = places.page_index(spark.createDataFrame(words, item), spark.createDataFrame(lines, item))
        total = {d: max([p for e, p in pages if e == d], default=1) for d in range(25)}
        frame = spark.createDataFrame(needles, "needle_id int, doc_id int, page int, values array<string>, row_terms array<string>, anchors array<string>")
        documents = spark.createDataFrame(list(total.items()), "doc_id int, pages int")
        got = {r["needle_id"]: tuple(r)[2:] for r in places.locate_values(index, frame, documents).collect()}
        assert len(got) == len(needles)
        for n, doc, cited, *terms in needles:
            want = ladder(pages, doc, cited, total.get(doc, 1), *terms)
            assert got[n] == want, (n, doc, cited, terms)
            stages.add((want[0], want[2], want[3]))
    assert {("value", "words", "exact"), ("value", "lines", "exact"), ("value", "words", "amount"), ("value", "words", "phrase"), ("row", "words", "exact"), ("anchor", "words", "exact"), (None, None, None)} <= stages


def test_overlapping_positions(spark):
    rows = [("aaaa", "aa"), ("abcabc", "bc"), ("x", "xy"), ("a.a.a", "a.a"), (r"q\Eq\E", r"q\E"), ("", "a"), ("abc", "")]
    got = spark.createDataFrame(rows, "t string, n string").select(places.positions(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got] == [[0, 1, 2], [1, 4], [], [0, 2], [0, 3], [], []]


def test_empty_tables(spark):
    item = spark.createDataFrame([], "doc_id int, page int, idx int, content string, x double, y double")
    needles = spark.createDataFrame([(1, 1, 1, ["a"], None, [None]), (2, 1, None, None, [], [])], "needle_id int, doc_id int, page int, values array<string>, row_terms array<string>, anchors array<string>")
    documents = spark.createDataFrame([(1, 2)], "doc_id int, pages int")
    got = places.locate_values(places.page_index(item, item), needles, documents).collect()
    assert len(got) == 2 and all(r["stage"] is None and r["looked"] == 0 for r in got)


def test_one_join_a_page(spark):
    """Values, rows and clauses of a page are looked for in the same join: one for each page and one for the documents."""
    item = spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.0)], "doc_id int, page int, idx int, content string, x double, y double")
    needles = spark.createDataFrame([(1, 1, 1, ["a"], ["b"], ["c"])], "needle_id int, doc_id int, page int, values array<string>, row_terms array<string>, anchors array<string>")
    documents = spark.createDataFrame([(1, 2)], "doc_id int, pages int")
    plan = places.locate_values(places.page_index(item, item), needles, documents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == places.PAGES + 1
