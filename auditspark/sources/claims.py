"""Claims from JSON, and which of them can be worked on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CLAIM, DEFAULTS


def read_claims(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested claims of JSON files (an array, or one object a line). Unknown keys are dropped, absent ones get defaults,
    of a repeated id the last counts."""
    raw = spark.read.schema(CLAIM).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return last_of_id(with_defaults(raw.withColumn("_order", F.monotonically_increasing_id())), "_order").drop("_order")


def with_defaults(claims: DataFrame) -> DataFrame:
    """Null header fields as the values that stand for missing ones."""
    kinds = dict(claims.dtypes)
    fill = {}
    for name, kind in kinds.items():
        if kind in ("string", "double", "int") and name != "id":
            fill[name] = F.coalesce(F.col(name), F.lit(DEFAULTS.get(name, "" if kind == "string" else 0)).cast(kind))
    return claims.withColumns(fill)


def last_of_id(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_i = 1").drop("_i")


def empty_claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CLAIM)


def available(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims all of whose source files are among files (path)."""
    needed = claims.select("id", F.explode("source_files.path").alias("path"))
    return claims.join(needed.join(files, "path", "left_anti").select("id").distinct(), "id", "left_anti")


SOURCES = {"none": lambda spark, path: empty_claims(spark), "json": read_claims}


def claim_source(kind: str):
    """The reader of a kind; kinds can be added to SOURCES."""
    if kind not in SOURCES:
        raise NotImplementedError(f"no source of kind {kind!r}; known: {', '.join(SOURCES)}")
    return SOURCES[kind]
