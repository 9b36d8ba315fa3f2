"""Claims that arrive over time: gates run for each batch, and the last run of a claim counts. An extension of the batch engine."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import engine
from ..operators.rules import GATES
from ..sources.store import Store


def run_gates(claims: DataFrame, store: Store, checkpoint: str, steps: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query over a stream of claims. Each batch appends verdicts and progress to the store, with the batch's number
    as version time, so a repeated batch changes nothing. steps may narrow a batch down to the claims that are ready, and add
    a column step: how many gates a claim's documents allow so far (all without it). A claim at step k has gates 1 to k run."""

    def each(batch: DataFrame, number: int) -> None:
        claims = steps(batch) if steps else batch
        version = F.timestamp_seconds(F.lit(number))
        if "step" not in claims.columns:
            claims = claims.withColumn("step", F.lit(len(GATES)))
        runs = [engine.roll_up(claims.filter(F.col("step") == k), cumulative_gates(k)) for k in range(1, len(GATES) + 1)]
        store.upsert("runs", functools.reduce(DataFrame.unionByName, runs).withColumnRenamed("claim_id", "id"), version)
        store.upsert("progress", claims.select("id", F.col("step").cast("int").alias("step")), version)

    return claims.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def cumulative_gates(step: int) -> list[str]:
    """Gates of the first steps: the k-th step runs gates 1 to k."""
    if not 0 <= step <= len(GATES) + 1:
        raise ValueError(f"step {step} is not within 0 and {len(GATES) + 1}")
    return list(GATES[:step])


def repeated_payments(payments: DataFrame, delay: str = "30 days") -> DataFrame:
    """payments (contract, payment_no, at): each payment once within the delay."""
    return payments.withWatermark("at", delay).dropDuplicatesWithinWatermark(["contract", "payment_no"])


def event_windows(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling windows; the same for tables and streams."""
    kept = events.withWatermark("ts", delay) if events.isStreaming else events
    out = kept.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of events (ts, user_id) that are less than gap apart."""
    kept = events.withWatermark("ts", delay) if events.isStreaming else events
    out = kept.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
