"""Sliced tables: lookups that read one slice, versions folded in, and which of two origins counts."""

import glob

from pyspark.sql import functions as F

from auditspark.sources.store import SlicedStore, resolve

SCHEMA = "id string, step int, note string"


def filled(spark, root, slices=8):
    kept = SlicedStore(spark, str(root), {"progress": SCHEMA}, slices=slices)
    ids = [f"VRM-{i}" for i in range(200)]
    kept.upsert("progress", spark.createDataFrame([(i, 1, "a") for i in ids] + [(None, 7, None)], SCHEMA), "2024-01-01 00:00:00")
    kept.upsert("progress", spark.createDataFrame([(i, 2, None) for i in ids[::2]], SCHEMA), "2024-01-02 00:00:00")
    return kept, ids


def rows(df):
    return sorted(((r["id"], r["step"], r["note"], str(r["created"]), str(r["updated"])) for r in df.collect()), key=str)


def files_read(df):
    """Number of files that each scan of df read, from its metrics."""
    df.collect()
    open_, found = [df._jdf.queryExecution().executedPlan()], []
    while open_:
        plan = open_.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(plan.plan())
        elif kind == "FileSourceScanExec":
            found.append(plan.metrics().apply("numFiles").value())
        else:
            children = plan.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return found


def test_values_before_and_after_folding(spark, tmp_path):
    kept, ids = filled(spark, tmp_path)
    one, two = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    want = sorted([(i, 2, None, one, two) if n % 2 == 0 else (i, 1, "a", one, one) for n, i in enumerate(ids)] + [(None, 7, None, one, one)], key=str)
    assert rows(kept.read("progress")) == want
    assert kept.fold("progress") == 8
    assert rows(kept.read("progress")) == want
    assert kept.fold("progress") == 0
    kept.upsert("progress", spark.createDataFrame([("VRM-3", 9, "b")], SCHEMA), "2024-01-03 00:00:00")
    kept.upsert("progress", spark.createDataFrame([("VRM-3", 9, "b")], SCHEMA), "2024-01-03 00:00:00")  # repeated
    assert rows(kept.get("progress", "VRM-3")) == [("VRM-3", 9, "b", one, "2024-01-03 00:00:00")]
    assert kept.fold("progress") == 1  # only the slice that was written to
    assert rows(kept.get("progress", "VRM-3")) == [("VRM-3", 9, "b", one, "2024-01-03 00:00:00")]
    assert rows(kept.read("progress")) == sorted([w for w in want if w[0] != "VRM-3"] + [("VRM-3", 9, "b", one, "2024-01-03 00:00:00")], key=str)


def test_a_lookup_reads_its_slice(spark, tmp_path):
    kept, _ = filled(spark, tmp_path)
    per_slice = {f: len(glob.glob(f + "/*.parquet")) for f in glob.glob(str(tmp_path / "progress" / "slice=*"))}
    assert len(per_slice) == 8 and max(per_slice.values()) == 2
    assert files_read(kept.get("progress", "VRM-8")) == [2]
    kept.fold("progress")
    assert files_read(kept.get("progress", "VRM-8")) == [1]
    assert rows(kept.get("progress", "VRM-8")) == [("VRM-8", 2, None, "2024-01-01 00:00:00", "2024-01-02 00:00:00")]
    assert rows(kept.get("progress", None)) == [(None, 7, None, "2024-01-01 00:00:00", "2024-01-01 00:00:00")]
    assert kept.get("progress", "none").collect() == []


def test_many_keys(spark, tmp_path):
    kept, ids = filled(spark, tmp_path)
    asked = spark.createDataFrame([("VRM-8",), ("VRM-8",), ("none",), (None,)], "id string")
    assert [(r[0], r[1]) for r in rows(kept.get_many("progress", asked))] == [("VRM-8", 2), (None, 7)]
    assert kept.get_many("progress", spark.createDataFrame([(i,) for i in ids], "id string")).count() == 200
    assert kept.get_many("progress", asked.limit(0)).count() == 0


def test_no_table_yet_empty_and_extra_columns(spark, tmp_path):
    kept = SlicedStore(spark, str(tmp_path), {"progress": SCHEMA}, slices=4)
    assert kept.read("progress").count() == 0 and kept.get("progress", "x").count() == 0 and kept.fold("progress") == 0
    kept.upsert("progress", spark.createDataFrame([], SCHEMA), "2024-01-01")
    assert kept.read("progress").count() == 0
    clash = spark.createDataFrame([("x", 1, "a", "s", "c")], SCHEMA + ", slice string, created string")
    kept.upsert("progress", clash, "2024-01-01")
    assert [r[:3] for r in rows(kept.read("progress"))] == [("x", 1, "a")]


def test_a_hot_key_is_reduced_before_it_is_written(spark, tmp_path):
    kept = SlicedStore(spark, str(tmp_path), {"progress": SCHEMA}, slices=4)
    many = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").cast("int").alias("step"), F.lit("x").alias("note"))
    kept.upsert("progress", many, F.timestamp_seconds("step"))
    assert kept.versions("progress").filter("id = 'hot'").count() == 1
    assert kept.get("progress", "hot").first()["step"] == 29997


def test_a_submission_hides_a_source_claim(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    mine = spark.createDataFrame([("a", "mine"), ("b", None)], "id string, title string")
    theirs = spark.createDataFrame([("b", "theirs"), ("c", "theirs"), ("z", "theirs")], "id string, title string")
    out = resolve(ids, mine, theirs, spark.createDataFrame([("a", 3)], "id string, step int"), spark.createDataFrame([("c", "fail")], "id string, verdict string"))
    assert sorted(map(tuple, out.collect()), key=str) == [("a", "submitted", "mine", 3, None), ("b", "submitted", None, 0, None), ("c", "erp", "theirs", 0, "fail"), ("d", None, None, 0, None)]
