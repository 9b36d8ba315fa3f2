"""Values a slip apart, found by equality of keys instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import near, slip_keys


def near_values(rows: DataFrame, by: list[str], value: str, others: DataFrame | None = None) -> DataFrame:
    """(by, value, near): the different values of rows with those of others (of rows itself if there are none) that are a slip
    away within by; nulls in by are equal, null values have no neighbours.

    Each value of n characters has at most n + 2 keys; pairs with a key in common are few, and are compared. Repeated values
    are reduced before the shuffle.
    """
    keyed = lambda df, name: df.filter(F.col(value).isNotNull()).select(*[F.col(x).alias(f"{name}_{x}") for x in by], F.col(value).alias(name)).distinct().withColumn("key", F.explode(slip_keys(F.col(name))))
    left, right = keyed(rows, "l"), keyed(rows if others is None else others, "r")
    same = F.lit(True)
    for x in by:
        same = same & F.col(f"l_{x}").eqNullSafe(F.col(f"r_{x}"))
    pairs = left.join(right.withColumnRenamed("key", "r_key"), (F.col("key") == F.col("r_key")) & same).filter(near(F.col("l"), F.col("r")))
    return pairs.select(*[F.col(f"l_{x}").alias(x) for x in by], F.col("l").alias(value), F.col("r").alias("near")).distinct()
