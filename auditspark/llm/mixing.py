"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id and text. A source's mix is: each document ``full`` times, and once more if its
hash is below the source's threshold; of the rows that have the threshold's hash, all equal, as many as come nearest. The threshold is found from sums of sizes by hash bucket: the bucket in which the
budget ends is split again, and only the rows of the last such bucket are looked at one hash at a time. Nothing is sorted
as a whole, and a larger budget always keeps what a smaller one took.

Nulls and odd input: a null text has size 0; a null source is a source of its own, last in order; rows with equal ids and
texts share a hash, and where the budget ends among them some are taken, which ones being all the same; others of one id, or
of none, each have their own; a very long text counts like any other, and the mix may miss its target by half of the last
document's size; an empty table gives an empty result; more columns,
whatever their names, are ignored, and kept by take_mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, cut

BITS, LEVEL = 60, 10


def _hash(id_col: str, text_col: str) -> Column:
    """60 bits of md5, the same in any SQL engine."""
    of = F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit("null")))
    return F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target: share of all sizes by weight, none above most times its source's size.

    One row per source, so the ordered window holds as many rows as there are sources. Capping sources in order of
    cap/weight, the level that the uncapped ones reach rises while capping is needed and falls after it: the level wanted
    is the largest.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w.cast("double"))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy(F.col("cap") / F.col("w"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("budget", share * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    before_cap, before_w = F.sum("cap").over(up) - F.col("cap"), F.sum("w").over(up) - F.col("w")
    ranked = ranked.withColumn("level", F.max((F.col("budget") - before_cap) / (F.col("all_w") - before_w)).over(every))
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.col("level")).alias("target"))


def _narrow(sums: DataFrame, part) -> DataFrame:
    """(source, rest, b, s) -> the bucket of each source in which rest ends, with what is still to take inside it."""
    by = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("s").over(by)).withColumn("before", F.col("upto") - F.col("s"))
    ends = ends.filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    return ends.select("source", part.alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"))


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, *, id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id, source, size, h; the plan by source: source_size, target, full, threshold)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _hash(id_col, text_col).alias("h"))
    rows = cut(rows, "mix")
    shift = BITS - LEVEL
    hist = cut(rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s")), "mix-hist")
    plan = source_targets(hist.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(plan.withColumn("full", full).withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0))), "mix-plan")
    edge = cut(_narrow(with_source(hist, plan.filter("rest > 0").select("source", "rest")), F.col("b")), "mix-edge")
    inside = with_source(rows, edge).filter(F.shiftright("h", shift) == F.col("prefix"))
    shift -= LEVEL
    sums = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"))
    edge = cut(_narrow(sums, F.col("b")), "mix-edge")
    # The last bucket holds about one row in 2^20 of its source: sum it hash by hash, and end nearest to the budget.
    inside = with_source(rows, edge).filter(F.shiftright("h", shift) == F.col("prefix"))
    by = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.groupBy("source", "rest", "h").agg(F.sum("size").alias("s"), F.count("*").alias("alike")).withColumn("upto", F.sum("s").over(by))
    left = F.col("rest") - (F.col("upto") - F.col("s"))
    some = F.when(F.col("upto") < F.col("rest"), F.col("alike")).otherwise(F.floor(left / (F.col("s") / F.col("alike")) + 0.5))
    ends = last.filter(left > 0).groupBy("source").agg(F.max(F.struct(F.col("h").alias("threshold"), some.alias("fit"), "alike")).alias("x"))
    ends = ends.select(F.col("source").alias("of"), "x.*")
    return rows, cut(plan.drop("rest").join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-plan")


def with_source(df: DataFrame, plan: DataFrame) -> DataFrame:
    """df with the columns that plan, one row a source, has for its source."""
    plan = bounded(plan.withColumnRenamed("source", "of"), plan.count())
    return df.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, h, ...) with what plan has for their source and copies: how often the mix takes each."""
    rows = with_source(rows, plan)
    more = lambda c: (F.col("full") + F.when(c, 1).otherwise(0)).cast("long")
    at_end = F.col("h") == F.col("threshold")
    if plan.filter("fit between 1 and alike - 1").isEmpty():
        return rows.withColumn("copies", more((F.col("h") < F.col("threshold")) | at_end & (F.col("fit") > 0)))
    # Equal rows are numbered within the parts in which they were written, each part from where the one before it ends.
    ends = cut(rows.filter(at_end).withColumn("at", F.monotonically_increasing_id()), "mix-ends")
    part = F.shiftright("at", 33).alias("part")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ends.groupBy("source", part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "before")
    numbered = ends.withColumn("part", part).withColumn("i", F.row_number().over(Window.partitionBy("source", "part").orderBy("at")))
    numbered = numbered.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    chosen = numbered.withColumn("copies", more(F.col("before") + F.col("i") <= F.col("fit"))).select(*rows.columns, "copies")
    return rows.filter(~F.coalesce(at_end, F.lit(False))).withColumn("copies", more(F.col("h") < F.col("threshold"))).unionByName(chosen)


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), copies (how often the mix takes it)."""
    out = with_copies(*mix_plan(docs, weights, share, most))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: docs, each as often as it is taken."""
    _, plan = mix_plan(docs, weights, share, most)
    rows = docs.select(F.struct("*").alias("row"), "source", _hash("doc_id", "text").alias("h"))  # a struct, for names may clash
    return with_copies(rows, plan).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
