"""Layout answers: every part gives a row, and what is left can be searched."""

import json
import re

from auditspark.operators import places
from auditspark.sources import layout


def shredded(spark, *raws):
    return layout.shred(spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string"))


def test_bad_answers(spark):
    got = shredded(spark, None, " ", "{", "null", "[1]", "{}", '{"contents": 5}', '{"contents": [{}, 3]}', '{"contents": [{"pages": []}]}')
    rows = sorted((r["doc_id"], r["kind"], r["error"]) for r in got.collect())
    assert rows == [(i, "answer", e) for i, e in enumerate(["empty", "empty", "not JSON"] + ["no pages"] * 6)]


def test_bad_pages_and_items(spark):
    word = lambda c, s: {"content": c, "source": s}
    answer = {"contents": [{"pages": [
        {"pageNumber": 4, "width": 8, "height": 16.0, "words": [word("a", "D(4,2,4,4,4,4,8,2,8)"), word(None, "D(4,1,1)"), word("c", "D(4,1,x)"), word("d", None), 5, word("f", "D(4)")], "lines": [word("a b", "D(4,0,0,8,16)")]},
        {"width": "wide", "height": -1, "words": [word("g", "D(2,1,2)")], "lines": "none"},
        7]}, {"pages": [{"pageNumber": 9, "width": 1, "height": 1}]}]}
    rows = shredded(spark, json.dumps(answer)).collect()
    plain = sorted(((r["page"], r["kind"], r["idx"], r["content"], r["x"], r["y"], r["left"], r["top"], r["error"]) for r in rows), key=str)
    n = None
    assert plain == sorted([
        (4, "page", n, n, n, n, n, n, n), (4, "word", 0, "a", 3.0, 6.0, 0.25, 0.25, n), (4, "word", 1, "", 1.0, 1.0, 0.125, 0.0625, n),
        (4, "word", 2, "c", n, n, n, n, "no polygon"), (4, "word", 3, "d", n, n, n, n, "no polygon"), (4, "word", 4, "", n, n, n, n, "no polygon"), (4, "word", 5, "f", n, n, n, n, "no polygon"),
        (4, "line", 0, "a b", 4.0, 8.0, 0.0, 0.0, n),
        (2, "page", n, n, n, n, n, n, "no size"), (2, "word", 0, "g", 1.0, 2.0, n, n, n), (3, "page", n, n, n, n, n, n, "no size"), (9, "page", n, n, n, n, n, n, n)], key=str)
    assert layout.errors(shredded(spark, json.dumps(answer))).count() == 6


def test_empty_table_and_names(spark):
    more = spark.createDataFrame([(1, "{}", 1, 2, 3)], "doc_id long, raw string, v int, p int, nth int")
    assert [r["error"] for r in layout.shred(more).collect()] == ["no pages"]
    assert layout.shred(more.limit(0)).collect() == []


def test_long_answer_and_search(spark):
    words = [{"content": f"w{i}", "source": f"D(1,{i % 50},{i // 50},{i % 50},{i // 50})"} for i in range(30000)]
    rows = shredded(spark, json.dumps({"contents": [{"pages": [{"width": 50, "height": 600, "words": words}]}]}))
    kept = layout.items(rows, "word")
    assert kept.count() == 30000
    index = places.page_index(kept, layout.items(rows, "line"))
    page = index.first()
    assert (len(page["words"]["idx"]), page["words"]["x"][149], page["words"]["y"][149]) == (30000, 49.0, 2.0)


def test_items_are_not_variants(spark):
    """Odd items keep their places, and no variant is made for each item, which would carry all names of the answer."""
    raw = '{"contents": [{"pages": [{"width": 1, "height": 1, "words": [5, null, "x", [1], {"content": 7, "source": 8}, {"content": {"a": 1}}, {"source": "D(1,2,3)"}]}]}]}'
    rows = layout.shred(spark.createDataFrame([(1, raw)], "doc_id int, raw string"))
    got = sorted((r["idx"], r["content"], r["error"]) for r in rows.filter("kind = 'word'").collect())
    assert got == [(0, "", "no polygon"), (1, "", "no polygon"), (2, "", "no polygon"), (3, "", "no polygon"), (4, "7", "no polygon"), (5, '{"a":1}', "no polygon"), (6, "", None)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "$.content," not in plan and "$.source" not in plan


def test_rows_carry_no_answer(spark):
    """Rows of pages carry nothing of their answer and rows of items nothing of their page: work grows with items, not with pages times answer."""
    plan = shredded(spark, "{}")._jdf.queryExecution().executedPlan().toString()
    carried = [re.findall(r"(\w+)#", x) for x in re.findall(r"Generate .*\), \[([^\]]*)\], (?:true|false), \[", plan)]
    assert carried == [["doc_id", "no_page", "page", "width", "height", "n_words"], ["doc_id", "no_page"]]


def test_polygons_of_any_size(spark):
    """Points and centre are the same with and without a lambda function, up to four points and above, and a page's number that fits no int spoils nothing."""
    numbers = [[i * i % 7 + i / 8 for i in range(2 * n)] for n in range(8)]
    words = [{"content": "w", "source": f"D({','.join(map(str, [page, *xs]))}{',5' * more})"} for page in (1, 99999999999) for xs in numbers for more in (0, 1)]
    rows = shredded(spark, json.dumps({"contents": [{"pages": [{"width": 2, "height": 4, "words": words}]}]})).filter("kind = 'word'").orderBy("idx").collect()
    expected = [(xs[0::2], xs[1::2]) for _ in range(2) for xs in numbers for _ in range(2)]
    assert len(rows) == len(expected) == 32
    for row, (x, y) in zip(rows, expected):
        if not x:
            assert (row["polygon"], row["x"], row["y"], row["left"], row["error"]) == (None, None, None, None, "no polygon")
        else:
            assert [tuple(p) for p in row["polygon"]] == list(zip(x, y)) and row["error"] is None
            assert (row["x"], row["y"], row["left"], row["top"]) == (sum(x) / len(x), sum(y) / len(y), x[0] / 2, y[0] / 4)


def test_documents_are_dealt_out(spark):
    """A table of one row group, one task as it is read, is shredded in many."""
    from auditspark.plans import queries

    plan = queries.QUERIES["layout_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_extract_all") < plan.index("Exchange hashpartitioning(doc_id")
