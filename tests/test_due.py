"""Gates that documents make due: brute force over arrivals, the stream against the table, and gates run by a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from auditspark.sources.store import Store
from auditspark.streaming import due

ARRIVAL = "id string, at timestamp, slot string, path string"
SLOTS = ["invoice", "contract_boq", "coc", "delivery_note", "other", None]
START = datetime.datetime(2024, 1, 1)


def arrivals(n, claims, seed=3):
    draw = random.Random(seed)
    return [(f"c{draw.randrange(claims)}", START + datetime.timedelta(minutes=i), draw.choice(SLOTS), draw.choice(["a", "b"])) for i in range(n)]


def brute(rows):
    seen, out = {}, []
    for id_, at, slot, path in rows:
        mine = seen.setdefault(id_, {})
        gate = {"invoice": 1, "contract_boq": 2, "coc": 3, "delivery_note": 3}.get(slot)
        if gate is None or mine.get(slot) == path:
            continue
        mine[slot] = path
        step = 0
        if "invoice" in mine:
            step = 1
            if "contract_boq" in mine:
                step = 5 if "coc" in mine or "delivery_note" in mine else 2
        if gate <= step:
            out.append((id_, at, slot, path, step, gate, step))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.select("id", "at", "slot", "path", "step", "first_gate", "last_gate").collect()), key=str)


def test_table_against_brute_force(spark):
    rows = arrivals(600, 40)
    assert plain(due.gates_due(spark.createDataFrame(rows, ARRIVAL))) == brute(rows)


def test_nulls_ties_repeats_empty_and_clashing_names(spark):
    rows = [(None, START, "invoice", "a"), ("x", START, "invoice", None), ("x", None, "invoice", "z"), ("x", START, "contract_boq", "b"), ("x", START, "coc", "c"), ("x", START, "coc", "c"), ("y", START, None, "a")]
    more = spark.createDataFrame(rows, ARRIVAL).withColumns({"_g0": F.lit(1), "same": F.lit(2), "step": F.lit(3)})
    # in order of kinds, as times are equal: coc (waits), contract (waits), invoice
    assert plain(due.gates_due(more)) == [("x", START, "invoice", None, 5, 1, 5)]
    assert plain(due.gates_due(more.limit(0))) == []


@pytest.fixture
def rocks(spark):
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    yield
    spark.conf.set(name, before)


def test_stream_equals_table(spark, rocks, tmp_path):
    rows = arrivals(240, 12)
    source, out = tmp_path / "in", tmp_path / "out"
    for i in range(3):  # one batch after another, so that state is read again, and a restart between them
        spark.createDataFrame(rows[i * 80 : (i + 1) * 80], ARRIVAL).coalesce(1).write.mode("append").parquet(str(source))
        stream = due.stream_gates_due(spark.readStream.schema(ARRIVAL).parquet(str(source)))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(60)
        assert plain(spark.read.schema(due.DUE).parquet(str(out))) == brute(rows[: (i + 1) * 80])


def test_state_goes_after_the_time_given(spark, rocks, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    days = lambda n: START + datetime.timedelta(days=n)
    rows = [("x", days(0), "invoice", "a"), ("y", days(9), "invoice", "a"), ("x", days(10), "invoice", "a"), ("y", days(10), "invoice", "a")]
    for row in rows:  # x comes again as it was after its state went, y while it is kept
        spark.createDataFrame([row], ARRIVAL).coalesce(1).write.mode("append").parquet(str(source))
        stream = due.stream_gates_due(spark.readStream.schema(ARRIVAL).parquet(str(source)), keep_ms=3 * 86_400_000)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(60)
    assert [r[:2] for r in plain(spark.read.schema(due.DUE).parquet(str(out)))] == [("x", days(0)), ("x", days(10)), ("y", days(9))]


def test_only_due_gates_run(spark, tmp_path):
    from auditspark.schema import CLAIM
    from auditspark.sources import claims as source

    ran = []
    path = tmp_path / "due"
    schema = due.DUE
    batches = [[("a", START, "invoice", "p", 1, 1, 1), ("b", START, "invoice", "p", 1, 1, 1)], [("a", START, "contract_boq", "p", 2, 2, 2), ("a", START, "coc", "p", 3, 3, 3)]]
    store = Store(spark, str(tmp_path / "store"), {"gate_runs": "id string, claim_id string, gate string, severity string", "progress": "id string, step int"})

    def claims(ids):
        ran.append(sorted(r[0] for r in ids.collect()))
        return source.with_defaults(spark.createDataFrame([], CLAIM).select("*").drop("id").join(ids, how="right", on=F.lit(True)).select(*spark.createDataFrame([], CLAIM).columns))

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
        q = due.run_due(spark.readStream.schema(schema).parquet(str(path)), claims, store, str(tmp_path / "cp"), availableNow=True)
        assert q.awaitTermination(60)
    assert ran == [["a", "b"], ["a"]]  # one run of both gates that a batch made due
    runs = store.versions("gate_runs").groupBy("claim_id", "gate").count().collect()
    assert {(r[0], r[1]): r[2] for r in runs} == {("a", "intake"): 1, ("b", "intake"): 1, ("a", "boq_match"): 1, ("a", "three_way_match"): 1}
    assert {r["id"]: r["step"] for r in store.read("progress").collect()} == {"a": 3, "b": 1}
