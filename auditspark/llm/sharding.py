"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document starts in a shard by its hash; the documents of one text that start
in the same shard form a cell. In each round every cell looks at the shards of the other cells of its text and asks to move
to the one that holds most of them; moves are granted, by thresholds on hash buckets, as far as others come back the other
way or the shard they lead to has room within its share of all bytes. Documents without links then fill the
shards up, at whole-document precision. Texts larger than a shard stay split. The law is ``bytes``: shard sizes are equal
but for about the size of one document.

Nulls and odd input: a null text counts as empty, as to size, checksum and links; null and repeated ids are rows like any
other; an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bucket, text_of

#: Hash buckets of the tables that are broadcast: at most shards * shards * MOVE_BUCKETS or shards * SLOT_BUCKETS rows.
MOVE_BUCKETS, SLOT_BUCKETS, POOL_BUCKETS = 256, 1024, 4096
#: A text with at least one in so many rows is hot: there can't be more than HOT of them, so their cells may be broadcast.
HOT = 1000


def _up(*by, order):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _propagate(cells: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """cells (g, start, n, bytes, shard) of linked texts, with shard moved towards the shard of most of the text's rows."""
    for k in range(rounds):
        held = cells.groupBy("g", "shard").agg(F.sum("n").alias("rows"))
        best = held.groupBy("g").agg(F.max(F.struct("rows", F.pmod(F.xxhash64("g", "shard"), F.lit(997)).alias("tie"), F.col("shard").alias("to"))).alias("best"))
        asked = cells.join(best.select("g", F.col("best.to").alias("to")), "g").withColumn("bucket", hash_bucket(F.concat_ws(":", "g", "start", F.lit(k)), MOVE_BUCKETS))
        asked = cut(asked, "shard-asked")
        wish = asked.groupBy("shard", "to").agg(F.sum("bytes").cast("double").alias("b")).collect()  # a row for each pair of shards
        flow = {(r["shard"], r["to"]): r["b"] for r in wish}
        into = [sum(flow.get((s, t), 0.0) for s in range(shards) if s != t) for t in range(shards)]
        free = [max(0.0, capacity - sum(flow.get((t, u), 0.0) for u in range(shards))) for t in range(shards)]
        # As much as comes back the other way, and a share of what is free.
        quota = [min(flow.get((s, t), 0.0), flow.get((t, s), 0.0)) + free[t] * flow.get((s, t), 0.0) / max(into[t], 1.0) for s in range(shards) for t in range(shards)]
        most = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") * shards + F.col("to") + 1)
        sums = asked.filter("shard != to").groupBy("shard", "to", "bucket").agg(F.sum("bytes").alias("b"))
        granted = sums.withColumn("upto", F.sum("b").over(_up("shard", "to", order=["bucket"]))).filter(F.col("upto") <= most).select("shard", "to", "bucket", F.lit(True).alias("go"))
        moved = asked.join(F.broadcast(granted), ["shard", "to", "bucket"], "left").withColumn("go", F.coalesce("go", F.lit(False)) & (F.col("shard") != F.col("to")))
        moved = cut(moved.withColumn("shard", F.when(F.col("go"), F.col("to")).otherwise(F.col("shard"))), "shard-cells")
        went = moved.filter("go").limit(1).count()
        cells = moved.select("g", "start", "n", "bytes", "shard")
        if not went:
            break
    return cells


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 8, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), linked (whether another row has its text)."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("g"))
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()), "shard-rows").withColumn("start", hash_bucket(F.col("rid"), shards))
    cells = cut(rows.groupBy("g", "start").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-start")
    groups = cells.groupBy("g").agg(F.sum("n").alias("all_n"))
    total = cells.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    capacity, n = (total["bytes"] or 0) / shards, total["n"] or 0
    linked = cells.join(groups.filter("all_n > 1"), "g").select("g", "start", "n", "bytes", F.col("start").alias("shard"))
    cells = cut(_propagate(cut(linked, "shard-linked"), shards, capacity, rounds), "shard-moved")
    # Cells of hot texts are few and reach the rows by broadcast; the rest by a shuffled join without hot keys.
    hot = cells.filter(F.col("n") * HOT * shards >= n).select("g", "start", F.col("shard").alias("hot_shard"))
    cold = cells.filter(F.col("n") * HOT * shards < n).select("g", "start", "shard")
    placed = rows.join(F.broadcast(hot), ["g", "start"], "left")
    no_hot = placed.filter("hot_shard is null").drop("hot_shard").join(cold, ["g", "start"], "left")
    placed = cut(placed.filter("hot_shard is not null").withColumnRenamed("hot_shard", "shard").unionByName(no_hot), "shard-placed")

    # What is above a shard's share, if anything, leaves it: whole buckets of texts, then of rows, then single rows.
    over = placed.filter("shard is not null").withColumn("b1", hash_bucket(F.col("g"), SLOT_BUCKETS)).withColumn("b2", hash_bucket(F.col("rid"), SLOT_BUCKETS))
    first = over.groupBy("shard", "b1").agg(F.sum("size").alias("s")).withColumn("upto1", F.sum("s").over(_up("shard", order=["b1"])))
    over = over.join(F.broadcast(first.select("shard", "b1", "upto1", (F.col("upto1") - F.col("s")).alias("before1"))), ["shard", "b1"])
    border = over.filter((F.col("before1") <= capacity) & (F.col("upto1") > capacity))
    second = border.groupBy("shard", "b2").agg(F.sum("size").alias("s")).withColumn("upto2", F.sum("s").over(_up("shard", order=["b2"])))
    border = border.join(F.broadcast(second.select("shard", "b2", "upto2", (F.col("upto2") - F.col("s")).alias("before2"))), ["shard", "b2"])
    border = border.withColumn("upto", F.when((F.col("before1") + F.col("before2") <= capacity) & (F.col("before1") + F.col("upto2") > capacity), F.lit(True)))
    fine = border.filter("upto").withColumn("at", F.col("before1") + F.col("before2") + F.sum("size").over(_up("shard", "b2", order=["rid"])))
    cols = ["doc_id", "size", "text_crc32", "rid"]
    leave = over.filter(F.col("before1") > capacity).select(*cols)
    leave = leave.unionByName(border.filter(F.col("upto").isNull() & (F.col("before1") + F.col("before2") > capacity)).select(*cols)).unionByName(fine.filter(F.col("at") > capacity).select(*cols))
    stay = over.filter(F.col("upto1") <= capacity).select(*cols, "shard")
    stay = stay.unionByName(border.filter(F.col("upto").isNull() & (F.col("before1") + F.col("before2") <= capacity)).select(*cols, "shard")).unionByName(fine.filter(F.col("at") <= capacity).select(*cols, "shard"))
    stay = cut(stay.withColumn("linked", F.lit(True)), "shard-stay")

    # The unlinked and those that left lie on one line, in hash order, which is cut into what each shard lacks.
    pool = placed.filter("shard is null").select(*cols, F.lit(False).alias("linked")).unionByName(leave.withColumn("linked", F.lit(True)))
    pool = cut(pool.withColumn("b", hash_bucket(F.col("rid"), POOL_BUCKETS)), "shard-pool")
    held = {r["shard"]: float(r["s"]) for r in stay.groupBy("shard").agg(F.sum("size").alias("s")).collect()}  # one row per shard
    ends, at = [], 0.0
    for s in range(shards - 1):
        at += max(0.0, capacity - held.get(s, 0.0))
        ends.append(at)
    base = pool.groupBy("b").agg(F.sum("size").alias("s"))
    base = base.withColumn("base", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s")).select("b", "base")
    middle = F.col("base") + F.sum("size").over(_up("b", order=["rid"])) - F.col("size") / 2
    pool = pool.join(F.broadcast(base), "b").withColumn("at", middle)
    filled = pool.withColumn("shard", sum([F.when(F.col("at") > end, 1).otherwise(0) for end in ends], F.lit(0)))
    both = cut(stay.select(*cols, "linked", "shard").unionByName(filled.select(*cols, "linked", F.col("shard").cast("int"))).withColumn("b", hash_bucket(F.col("rid"), SLOT_BUCKETS)), "shard-both")

    counts = both.groupBy("shard", "b").agg(F.count("*").alias("k"))
    counts = counts.withColumn("base", F.sum("k").over(_up("shard", order=["b"])) - F.col("k")).select("shard", "b", "base")
    slot = F.col("base") + F.row_number().over(Window.partitionBy("shard", "b").orderBy("rid")) - 1
    out = both.join(F.broadcast(counts), ["shard", "b"]).withColumn("slot", slot.cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
