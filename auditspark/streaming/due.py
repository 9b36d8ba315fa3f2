"""Which gates a document makes due: over a table by windows, over a stream by state of each claim.

A gate needs one of the kinds of documents that it names; a claim has come as far as the gates from the first on that have
theirs. A document that is new, or replaces another of its kind, makes the gates from its own on due, as far as the claim has
come; a document that came again as it was makes none due, and so does one of an unknown kind. Gates that wait for a document
of an earlier gate are due when that arrives. Arrivals without an id or a time count as none. The stream's state is one row for each
kind of document of a claim, and goes when the watermark is past a claim's last arrival by the time given; a claim that is
heard of later begins anew.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import engine
from ..operators.rules import GATES
from ..sources.store import Store

# Kinds of documents, of which a gate needs one; the last two need no more.
NEEDS = (("invoice",), ("contract_boq",), ("coc", "delivery_note"), (), ())
DUE = "id string, at timestamp, slot string, path string, step int, first_gate int, last_gate int"


def gates_due(arrivals: DataFrame, needs=NEEDS) -> DataFrame:
    """arrivals (id, at, slot, path) that make gates due, with step, how far the claim has come, and the first and last gate due
    (from 1). In order of at, then slot, then path; equal arrivals count once. One shuffle, by claim: both windows share it."""
    rows = arrivals.filter("id IS NOT NULL AND at IS NOT NULL").select("id", "at", "slot", "path").distinct().repartition("id")
    order = ["at", "slot", "path"]
    before = Window.partitionBy("id", "slot").orderBy(*order)
    so_far = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    there = [F.max(F.coalesce(F.col("slot").isin(*kinds), F.lit(False))).over(so_far) if kinds else F.lit(True) for kinds in needs]
    first = functools.reduce(lambda rest, i: F.when(F.col("slot").isin(*needs[i]), i + 1).otherwise(rest), [i for i in reversed(range(len(needs))) if needs[i]], F.lit(None).cast("int"))
    marked = rows.withColumns({f"_g{i}": t for i, t in enumerate(there)})
    step = functools.reduce(lambda rest, i: F.when(F.col(f"_g{i}"), rest).otherwise(i), reversed(range(len(needs))), F.lit(len(needs)))
    marked = marked.withColumns({"same": (F.row_number().over(before) > 1) & F.lag("path").over(before).eqNullSafe(F.col("path")), "step": step.cast("int"), "first_gate": first})
    due = marked.filter(~F.col("same") & (F.col("first_gate") <= F.col("step")))
    return due.select(*rows.columns, "step", "first_gate", F.col("step").alias("last_gate"))


class DueGates(StatefulProcessor):
    """The same for a claim's arrivals of a micro-batch, given what came before: the last path of each kind."""

    def __init__(self, needs=NEEDS, keep_ms: int = 30 * 86_400_000):
        self.needs, self.keep_ms = needs, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "slot string", "path string")

    def _step(self, slots) -> int:
        missing = (i for i, kinds in enumerate(self.needs) if kinds and not slots.intersection(kinds))
        return next(missing, len(self.needs))

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).drop_duplicates().sort_values(["at", "slot", "path"], na_position="first")
        paths = {k[0]: v[0] for k, v in self.paths.iterator()}
        out = []
        for at, slot, path in zip(new["at"], new["slot"], new["path"]):
            slot, path = (None if pd.isna(slot) else slot), (None if pd.isna(path) else path)
            first = next((i + 1 for i, kinds in enumerate(self.needs) if slot in kinds), None)
            if first is None or (slot in paths and paths[slot] == path):
                continue
            paths[slot] = path
            self.paths.updateValue((slot,), (path,))
            step = self._step(set(paths))
            if first <= step:
                out.append((key[0], at, slot, path, step, first, step))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max(new["at"].max().value // 1_000_000, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(last + self.keep_ms)
        yield pd.DataFrame(out, columns=["id", "at", "slot", "path", "step", "first_gate", "last_gate"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.paths.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_gates_due(arrivals: DataFrame, needs=NEEDS, delay: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """gates_due over a stream of arrivals, taken in the order in which micro-batches bring them; those later than delay are left
    out. State needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    rows = arrivals.filter("id IS NOT NULL AND at IS NOT NULL").select("id", "at", "slot", "path").withWatermark("at", delay)
    processor = DueGates(needs, keep_ms)
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=DUE, outputMode="Append", timeMode="EventTime")


def run_due(due: DataFrame, claims: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, **trigger):
    """Start a query that runs the gates that are due, and no others. claims gives the claims of a table of ids; findings of a
    gate go to the table gate_runs with the key 'id/gate', progress to progress, at the batch's number as version time."""

    def each(batch: DataFrame, number: int) -> None:
        merged = batch.groupBy("id").agg(F.min("first_gate").alias("first_gate"), F.max("last_gate").alias("last_gate"))
        merged = merged.persist()
        try:
            version = F.timestamp_seconds(F.lit(number))
            ranges = [(r[0], r[1]) for r in merged.select("first_gate", "last_gate").distinct().collect()]  # at most 15
            for first, last in sorted(ranges):
                ids = merged.filter((F.col("first_gate") == first) & (F.col("last_gate") == last)).select("id")
                runs = engine.gate_roll_up(claims(ids), list(GATES[first - 1 : last]))
                store.upsert("gate_runs", runs.select(F.concat_ws("/", "claim_id", "gate").alias("id"), "claim_id", "gate", "severity"), version)
            store.upsert("progress", merged.select("id", F.col("last_gate").alias("step")), version)
        finally:
            merged.unpersist()

    return due.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
