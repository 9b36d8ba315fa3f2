"""Alignment as joins and windows against a line-by-line reading that compares everything."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import align

BOQ = "claim_id string, pos int, item_code string, description string, unit_price double"


def strength(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    n = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    short = min(len(a), len(b))
    return max(2 * n / (len(a) + len(b)), min(n / short, 0.95) if short >= 15 else 0)


def canon(c):
    a, dot, b = c.strip().lower().partition(".")
    return f"{int(a)}.{b.rstrip('0') or '0'}" if dot and a.isdigit() and b.isdigit() else c.strip().lower()


def best(text, price, rows, exclude):
    wording, priced = {}, set()
    for code, t, p in rows:
        if code != exclude:
            wording[code] = max(wording.get(code, 0), strength(text, t))
            if price and abs(p - price) <= 0.01:
                priced.add(code)
    if not text or not wording:
        return None
    score = {c: s + 0.05 * (c in priced) for c, s in wording.items()}
    top = max(score, key=score.get)
    rest = max((v for c, v in score.items() if c != top), default=0)
    return top if score[top] >= 0.9 and rest <= score[top] - 0.04 or priced == {top} and wording[top] >= 0.45 else None


def one_document(lines, rows):
    own = {c: (t, p) for c, t, p in rows}
    taken, out = {x[1] for x in lines}, []
    for pos, code, text, price, amount in lines:
        if amount < 0:
            continue
        if code in own:
            if not text or price and abs(own[code][1] - price) <= 0.01:
                continue
            target = best(text, price, rows, code)
            if target and max(strength(text, t) + 0.05 * bool(price and abs(p - price) <= 0.01) for c, t, p in rows if c == target) < strength(text, own[code][0]) + 0.1:
                target = None
        else:
            alike = {c for c in own if canon(c) == canon(code)} if code.strip() else set()
            target = alike.pop() if len(alike) == 1 else best(text, price, rows, None)
        if target and target != code and target not in taken:
            taken.add(target)
            out.append((pos, code, target))
    return out


def random_claims(seed, n):
    rng = random.Random(seed)
    words = "supply of steel doors painting inner walls glass partitions in offices tiles floor works cable".split()
    claims = {}
    for c in range(n):
        rows = [(f"{i}.10" if rng.random() < 0.5 else str(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 7))), float(rng.randint(1, 6) * 10)) for i in range(1, rng.randint(2, 9))]
        docs = {}
        for doc in ("invoice", "receipt"):
            lines = []
            for pos in range(1, rng.randint(1, 8)):
                code, text, price = rng.choice(rows)
                text = rng.choice([text, text, text + " " + rng.choice(words), " ".join(text.split()[:-1]), "", "something else"])
                code = rng.choice([code, rng.choice(rows)[0], "", "x9", code.removesuffix("0"), f"{rng.randint(1, 9)}"])
                lines.append((pos, code, text, rng.choice([price, price, 0.0, 999.0]) if doc == "invoice" else 0.0, -1.0 if doc == "invoice" and rng.random() < 0.1 else 1.0))
            docs[doc] = lines
        claims[f"c{c}"] = (rows, docs)
    return claims


@pytest.fixture(scope="module")
def tables(spark):
    claims = random_claims(3, 250)
    boq = spark.createDataFrame([(c, i, *r) for c, (rows, _) in claims.items() for i, r in enumerate(rows)], BOQ)
    line = lambda doc: [(c, *x[:4], 1.0, x[4]) for c, (_, docs) in claims.items() for x in docs[doc]]
    invoices, receipts = (spark.createDataFrame(line(d), BOQ + ", quantity double, amount double").repartition(3) for d in ("invoice", "receipt"))
    return claims, boq, invoices, receipts


def test_both_documents_line_by_line(tables):
    claims, boq, invoices, receipts = tables
    got = sorted((r["claim_id"], r["doc"], r["pos"], r["item_code"], r["new_code"]) for r in align.align_documents(invoices, receipts, boq).collect())
    want = sorted((c, doc, *x) for c, (rows, docs) in claims.items() for doc, lines in docs.items() for x in one_document(lines, rows))
    assert got == want and len(want) > 100 and {x[1] for x in want} == {"invoice", "receipt"}


def test_bounds_and_what_is_compared(tables):
    """Bounds are never below the measure; matches are those of comparing all; few pairs are compared."""
    claims, boq, invoices, _ = tables
    pairs = align.compared(invoices, boq).collect()
    assert all(strength(r["line_text"], r["boq_text"]) <= r["most"] for r in pairs)
    assert all(r["strength"] is None or r["strength"] == pytest.approx(strength(r["line_text"], r["boq_text"])) for r in pairs)
    assert sum(r["strength"] is not None for r in pairs) < 0.6 * len(pairs)
    got = sorted((r["claim_id"], r["pos"], r["target"]) for r in align.best_matches(align.scores(invoices, boq)).collect())
    own = {c: {x[0] for x in rows} for c, (rows, _) in claims.items()}
    want = [(c, pos, t) for c, (rows, docs) in claims.items() for pos, code, text, price, amount in docs["invoice"] if amount >= 0 and (t := best(text, price, rows, code if code in own[c] else None))]
    assert got == sorted(want)


def test_needs(spark, tables):
    claims, boq, invoices, _ = tables
    ends = ["2026-01-31", "5 months from signing", "", None]
    rows = [(c, ends[i % 4], [None, "", "2026-01-01"][: i % 4]) for i, c in enumerate(claims)] + [("none", "12 months", ["2026-01-01"])]
    got = {r["claim_id"]: (r["codes"], r["date"]) for r in align.needs(invoices, boq, spark.createDataFrame(rows, "claim_id string, end_date string, anchors array<string>")).collect()}
    for c, end, anchors in rows:
        bill, docs = claims.get(c, ([], {"invoice": []}))
        own = {x: (t, p) for x, t, p in bill}
        fits = lambda code, text, price: code in own and (not text or bool(price and abs(own[code][1] - price) <= 0.01) or strength(text, own[code][0]) >= 0.75)
        codes = any(not fits(*x[1:4]) for x in docs["invoice"] if x[4] >= 0)
        assert got[c] == (codes, end == "5 months from signing" and any(anchors) or c == "none")


def test_patch(spark):
    boq = spark.createDataFrame([("c", 1, "a", "", 1.0), ("c", 2, "b", "", 1.0)], BOQ)
    mine = spark.createDataFrame([("c", 1, "1", "", 1.0), ("c", 2, "2", "", 1.0)], BOQ)
    patch = spark.createDataFrame([("c", 9, 1, "b"), ("c", 2, 2, "b"), ("c", 1, 3, "b")], "claim_id string, pos int, ord int, new_code string")
    assert sorted(r["item_code"] for r in align.apply_patch(mine, patch, boq).collect()) == ["1", "b"]
    dates = [("12 months", "2026-03-01T00:00"), ("2026-01-01", "2026-03-01"), (None, "2026-03-01"), ("12 months", "soon"), ("", None)]
    frame = spark.createDataFrame(dates, "old string, new string").select(align.patch_end_date(F.col("old"), F.col("new")).alias("d"))
    assert [r["d"] for r in frame.collect()] == ["2026-03-01", "2026-01-01", "2026-03-01", "12 months", ""]


def test_matches_are_those_of_every_pair(spark, tables, monkeypatch):
    """Also with a claim's lines in several parts, with near copies, empty and repeated codes, and prices that one row has."""
    claims, boq, invoices, _ = tables
    copies = [("near", i, f"{i // 2}.1" if i % 5 else "", f"steel doors of the inner walls model {10_000 + i * i}", float(i % 3 * 10) if i else 77.0) for i in range(40)] + [("near", 50, None, "steel doors", 1.0), ("near", 51, "x", None, None)]
    bill = boq.unionByName(spark.createDataFrame(copies, BOQ))
    asked = [("near", i, ["", "3.1", None, "none"][i % 4], f"steel doors of the inner walls model {10_000 + (i % 45) * (i % 45)}", [0.0, 10.0, 77.0, None][i // 4 % 4], 1.0, 1.0) for i in range(60)]
    lines = invoices.unionByName(spark.createDataFrame(asked, BOQ + ", quantity double, amount double"))
    scored = align.scores(lines, bill)
    own = scored.filter("code = item_code").select("claim_id", "pos", F.col("strength").alias("own"))
    want = sorted((r["claim_id"], r["pos"], r["target"], r["score"], r["row_score"], r["own"]) for r in align.best_matches(scored).join(own, ["claim_id", "pos"], "left").collect())
    monkeypatch.setattr(align, "PART", 7)
    found = align.matches(lines, bill)
    assert sorted((r["claim_id"], r["pos"], r["target"], r["score"], r["row_score"], r["own"]) for r in found.collect()) == want and len(want) > 100
    assert {"near"} < {x[0] for x in want}


def test_pairs_are_not_shuffled(spark):
    """Rows that leave the tasks grow with lines, not with pairs: no exchange stands above the comparison."""
    mine = spark.range(300).selectExpr("'c' AS claim_id", "int(id) AS pos", "'' AS item_code", "concat('steel door ', id) AS description", "1.0D AS unit_price", "1.0D AS quantity", "1.0D AS amount")
    boq = mine.selectExpr("claim_id", "pos", "string(pos) AS item_code", "description", "unit_price")
    plan = align.matches(mine, boq)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert "Exchange" not in above and "Window" not in above
