"""Operators over small tables."""

import datetime

from pyspark.sql import functions as F

from auditspark.operators import align, evidence, lines, locate, merge
from auditspark.plans import queries
from auditspark.sources import store
from auditspark.streaming import gates


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_vote_and_merge(spark):
    reads = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "b"), ("m", 1, None), ("m", 2, "x"), ("n", 1, None)], "key string, ord int, value string")
    assert rows(merge.majority_vote(reads, ["key"]), "key", "value") == [("k", "b"), ("m", "x")]
    reads = spark.createDataFrame([("k", 1, "", 0), ("k", 2, "b", 5), ("k", 3, "c", 7)], "key string, ord int, t string, n int")
    assert rows(merge.first_filled(reads, ["key"], ["t", "n"]), "key", "t", "n") == [("k", "b", 5)]


def test_dedupe(spark):
    r = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "pos int, v string, page int")
    assert rows(merge.drop_repeated(r, "pos", ["page"]), "v", "pos", "page") == [("a", 1, 1), ("b", 3, 1)]
    r = spark.createDataFrame([("c", 1, "٥", "", 1.0), ("c", 2, "5", "x", 2.0), ("c", 3, "5", "y", 3.0)], "claim_id string, pos int, item_code string, description string, unit_price double")
    assert rows(merge.best_of_code(r, ["claim_id"]), "pos", "first_pos", "description") == [(2, 1, "x")]


def test_three_valued_and(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    got = spark.range(1).select(merge.consistent(n, n).alias("a"), merge.consistent(t, n).alias("b"), merge.consistent(t, ~t).alias("c")).first()
    assert tuple(got) == (None, True, False)


BOQ = "claim_id string, pos int, item_code string, description string, unit_price double"
LINE = BOQ + ", quantity double, amount double"


def test_align(spark):
    boq = spark.createDataFrame([("c", 1, "9.1", "supply of steel doors", 10.0), ("c", 2, "35", "painting of inner walls", 20.0), ("c", 3, "5", "glass partitions in offices", 30.0)], BOQ)
    mine = spark.createDataFrame([("c", 1, "9.10", "", 10.0, 1.0, 10.0), ("c", 2, "", "painting of inner walls", 20.0, 1.0, 20.0), ("c", 3, "x", "something else altogether", 1.0, 1.0, 1.0), ("c", 4, "", "painting of inner walls", 20.0, 1.0, 20.0)], LINE)
    assert rows(align.align_codes(mine, boq), "pos", "new_code") == [(1, "9.1"), (2, "35")]
    serial = spark.createDataFrame([("c", 1, "9.1", "glass partitions in offices", 30.0, 1.0, 30.0), ("c", 2, "35", "painting of inner walls", 20.0, 1.0, 20.0)], LINE)
    assert rows(align.align_codes(serial, boq), "pos", "new_code") == [(1, "5")]


def test_align_queries_take_the_whole_table(spark, tmp_path):
    parts = [(k, "steel part", "Brand#1", "SMALL", k % 2, float(k)) for k in range(3_950, 4_070)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    for df in queries._described(spark, str(tmp_path)):
        assert sorted(r["unit_price"] for r in df.collect()) == [x[5] for x in parts]
    pairs = align.scores(*queries._described(spark, str(tmp_path)))
    assert rows(pairs.groupBy("claim_id").count(), "count") == [(3_600,), (3_600,)]


def test_digit_runs_of_a_long_text(spark, tmp_path):
    text = " ".join(map(str, range(2_500)))
    spark.createDataFrame([(1, text, "s", 7)], "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.digit_runs(spark, str(tmp_path)).first()["runs"] == "7," + text.replace(" ", ",")


def test_patch_codes(spark):
    boq = spark.createDataFrame([("c", 1, "a", "", 1.0), ("c", 2, "b", "", 1.0)], BOQ)
    mine = spark.createDataFrame([("c", 1, "1", "", 1.0, 1.0, 1.0), ("c", 2, "2", "", 1.0, 1.0, 1.0)], LINE)
    patch = spark.createDataFrame([("c", 1, 1, "a"), ("c", 2, 2, "a"), ("c", 9, 3, "b"), ("c", 2, 4, "z")], "claim_id string, pos int, ord int, new_code string")
    assert rows(align.apply_patch(mine, patch, boq), "pos", "item_code") == [(1, "a"), (2, "2")]


def test_pairing(spark):
    boq = spark.createDataFrame([("c", 1, "a", 1.0, 1.0), ("c", 2, "a", 2.0, 1.0), ("c", 3, "", 1.0, 1.0)], "claim_id string, pos int, item_code string, unit_price double, quantity double")
    mine = spark.createDataFrame([("c", 1, "a", 1.0, 1.0, 1.0), ("c", 2, "", 1.0, 1.0, 1.0), ("c", 3, "a", 5.0, -1.0, -5.0)], "claim_id string, pos int, item_code string, unit_price double, quantity double, amount double")
    got = lines.pair_lines(mine, boq)
    assert sorted((r["line_pos"] or 0, r["boq_pos"] or 0, r["status"]) for r in got.collect()) == [(0, 2, "not billed"), (0, 3, "not billed"), (1, 1, "price matches"), (2, 0, "not in BoQ")]


def test_scan_order(spark):
    got = lambda p, n: spark.range(1).select(locate.scan_order(F.lit(p), F.lit(n)).alias("v")).first()["v"]
    assert got(37, 76) == [37, 36, 38] and got(1, 76) == [1, 2, 3] and got(9, 3) == [3, 2, 1] and got(0, 5) == [1, 2, 3]


def test_locate(spark):
    pages = {1: "the total is 1,150.00 SAR", 2: "invoice number INV-7 of the vendor", 3: "vendor name and invoice total"}
    words = spark.createDataFrame([("d", p, i, w) for p, t in pages.items() for i, w in enumerate(t.split())], "doc_id string, page int, idx int, content string")
    needles = spark.createDataFrame([("n", "d", 1, ["INV-7", "of"]), ("m", "d", 3, ["invoice", "vendor", "whatever"]), ("o", "d", 1, ["nowhere"])], "needle_id string, doc_id string, page int, tokens array<string>")
    docs = spark.createDataFrame([("d", 3)], "doc_id string, pages int")
    assert rows(locate.locate(words, needles, docs), "needle_id", "step", "page", "first") == [("m", 2, 3, 0), ("n", 1, 2, 2)]


def test_evidence(spark):
    e = spark.createDataFrame([(1, '{"b": {"c": [1, {"d": 2}]}, "e": "x"}'), (2, "not json"), (3, "{}")], "id int, j string")
    assert rows(evidence.flatten_json(e, "j"), "id", "path", "value") == [(1, "b.c.0", "1"), (1, "b.c.1.d", "2"), (1, "e", "x")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), {"runs": "id string, verdict string"})
    assert s.read("runs").count() == 0
    day = lambda n: datetime.datetime(2026, 1, n)
    s.upsert("runs", spark.createDataFrame([("a", "approve"), ("b", "reject")], "id string, verdict string"), day(1))
    s.upsert("runs", spark.createDataFrame([("a", "reject")], "id string, verdict string"), day(2))
    assert rows(s.read("runs"), "id", "verdict", "created") == [("a", "reject", day(1)), ("b", "reject", day(1))]
    assert rows(s.get("runs", "a"), "id", "verdict") == [("a", "reject")]


def test_export_and_files(spark):
    f = spark.createDataFrame([("c", 1, "other", "a.pdf"), ("c", 2, "invoice", "a.pdf"), ("c", 3, "contract_boq", "k.pdf"), ("c", 4, "what", "a.pdf")], "id string, pos int, doc_type string, name string")
    assert rows(store.export_manifest(f), "at", "entry") == [(1, "c_a.pdf"), (2, "k.pdf"), (3, "c_a_2.pdf"), (4, "c_a_3.pdf")]
    files = spark.createDataFrame([("c", "coc", "x"), ("c", "invoice", "y")], "id string, slot string, path string")
    new = spark.createDataFrame([("c", "delivery_note", "z")], "id string, slot string, path string")
    assert rows(store.replace_files(files, new), "slot", "path") == [("delivery_note", "z"), ("invoice", "y")]


def test_stream(spark, tmp_path):
    from auditspark.schema import CLAIM
    from auditspark.sources import claims as source

    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"id": "a", "payment_no": 1}\n')
    stream = source.with_defaults(spark.readStream.schema(CLAIM).json(str(path)))
    s = store.Store(spark, str(tmp_path / "store"), {"runs": "id string, verdict string, rationale string", "progress": "id string, step int"})
    q = gates.run_gates(stream, s, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert rows(s.read("runs"), "id", "verdict") == [("a", "reject")] and rows(s.read("progress"), "id", "step") == [("a", 5)]


def test_evidence_of_any_depth(spark):
    deep = '{"a": ' * 9 + '["x{[", {"b": "\\\\"}]' + "}" * 9
    e = spark.createDataFrame([(1, deep), (2, "3"), (3, None), (4, "not json ["), (5, "[]")], "id int, j string")
    got = rows(evidence.flatten_json(e, "j"), "id", "path", "value")
    at = ".".join("a" * 9)
    assert got == [(1, f"{at}.0", "x{["), (1, f"{at}.1.b", "\\")]
    assert evidence.flatten_json(e.limit(0), "j").count() == 0


def test_similarity_measures_by_definition():
    """Whole batches against the definition pair by pair."""
    import difflib
    import random

    import pyarrow as pa

    from auditspark.functions.similarity import strengths

    rng = random.Random(2)
    words = ["supply", "of", "steel", "pipes", "and", "works", "شبكة", "مياه", "dn200"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(40)] + [None, ""]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)]
    for (a, b), got in zip(pairs, strengths(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))):
        if not a or not b:
            assert got == 0
            continue
        blocks = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        n, short = len(a) + len(b), min(len(a), len(b))
        want = 1 if a == b else max(2 * blocks / n, min(0.95, blocks / short) if short >= 15 else 0)
        assert abs(got - want) < 1e-12


def test_gates_run_as_far_as_documents_allow(spark, tmp_path):
    from auditspark.operators import engine
    from auditspark.schema import CLAIM
    from auditspark.sources import claims as source

    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"id": "a", "payment_no": 1}\n{"id": "b", "payment_no": 1}\n')
    table = source.with_defaults(spark.read.schema(CLAIM).json(str(path)))
    stream = source.with_defaults(spark.readStream.schema(CLAIM).json(str(path)))
    s = store.Store(spark, str(tmp_path / "store"), {"runs": "id string, verdict string, rationale string", "progress": "id string, step int"})
    q = gates.run_gates(stream, s, str(tmp_path / "cp"), lambda batch: batch.withColumn("step", F.when(F.col("id") == "a", 1).otherwise(5)))
    q.processAllAvailable()
    q.stop()
    want = {x: engine.roll_up(table.filter(F.col("id") == x), g).first()["rationale"] for x, g in (("a", ["intake"]), ("b", None))}
    assert dict(rows(s.read("runs"), "id", "rationale")) == want and want["a"] != want["b"]
    assert rows(s.read("progress"), "id", "step") == [("a", 1), ("b", 5)]


def test_validate_read_at_any_depth(spark):
    from auditspark.operators import reads
    from auditspark.schema import CLAIM

    kind = spark.createDataFrame([], CLAIM).select("documents").schema
    docs = {"invoice": {"invoice_date": "5/3/2026", "lines": [{"item_code": "4.0", "page": 2}], "page": 0}, "coc": None, "boq": [{"item_code": "1.10", "description_ar": "x", "unit_price": 1.0, "page": 1}, {"item_code": "9"}], "contract": {"end_date": "31.12.2026", "value_base": 115.0, "value_with_vat": 115.0, "penalty_terms": [{"text_ar": "1% per week", "basis": "", "per": ""}]}, "attachments": ["a"]}
    got = reads.validate_read(spark.createDataFrame([(docs,), (None,)], kind), offset=F.lit(4)).collect()
    d = next(r["documents"] for r in got if r["documents"])
    assert (d["invoice"]["invoice_date"], d["invoice"]["lines"][0]["item_code"], d["invoice"]["lines"][0]["page"], d["invoice"]["page"]) == ("2026-03-05", "4", 6, 0)
    assert [b["item_code"] for b in d["boq"]] == ["1.10"] and d["coc"] is None and d["attachments"] is None
    assert d["contract"]["value_base"] == 100.0 and d["contract"]["end_date"] == "2026-12-31" and d["contract"]["penalty_terms"][0]["per"] == "week"
    left = spark.createDataFrame([(docs,)], kind)
    dropped = left.select(reads.without_key_fields(F.col("documents"), kind["documents"].dataType).alias("d")).schema["d"].dataType
    assert "invoice_no" not in dropped["invoice"].dataType.names and "lines" in dropped["invoice"].dataType.names
