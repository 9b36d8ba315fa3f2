"""What both searches over vectors share: classes of equal vectors, blocks of rows and slabs of queries.

Equal vectors tie in every search, and ties go to the smaller id. So of each set of equal vectors the ``k + 1`` smallest
ids can be in a result of k besides the query itself; the others can't, and aren't compared. Queries with equal vectors
share one search. Rows lie in blocks and queries in slabs, both by hash and of bounded size; Spark brings each block
together with each slab in a task of its own, so no vector passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

#: Numbers of a slab of queries, and rows of a block of the index, about; queries that are compared at a time.
SLAB, BLOCK, PART = 2_000_000, 8_192, 64


def equal_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, v) -> (vec_id, v, key), of equal vectors the k smallest ids, each once."""
    keyed = vectors.withColumn("key", F.xxhash64("v", F.hash("v")))
    first = keyed.withColumn("i", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("i") <= k)
    return first.dropDuplicates(["key", "vec_id"]).drop("i")


def matrix(lists: pa.Array, kind) -> np.ndarray:
    """Arrow lists of one length as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def search(index: DataFrame, members: DataFrame, k: int, searcher, kind: str) -> DataFrame:
    """Results of all queries: index rows (vec_id, dim, v, ...), members (query_id, key, v): the queries.

    searcher(keys, queries, block) gives (key, ids, scores) of the best k + 1 rows of a block (an Arrow table of index rows
    of one length) for each query. Results: query_id, rank, vec_id, score of the SQL type kind.
    """
    queries = members.groupBy("key").agg(F.first("v").alias("v")).withColumn("dim", F.size("v"))
    sizes = index.groupBy("dim").agg(F.count("*").alias("rows")).join(queries.groupBy("dim").agg(F.count("*").alias("queries")), "dim")
    deal = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    sizes = cut(sizes.select("dim", deal(F.col("rows"), BLOCK).alias("blocks"), deal(F.col("queries") * F.col("dim"), SLAB).alias("slabs")), "search-sizes")
    sizes = bounded(sizes, sizes.count())  # a row for each length of vectors
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")).withColumn("slab", every("slabs")).drop("blocks", "slabs")
    asked = queries.join(sizes, "dim").withColumn("slab", F.pmod("key", F.col("slabs")).cast("int")).withColumn("block", every("blocks")).select("dim", "block", "slab", "key", "v")

    def run(block: pa.Table, slab: pa.Table) -> pa.Table:
        found = []
        if block.num_rows and slab.num_rows:
            found = list(searcher(slab.column("key").to_numpy(), matrix(slab.column("v"), np.float64), block))
        join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        cols = (join([np.full(len(ids), key) for key, ids, _ in found], np.int64), join([x for _, x, _ in found], np.int64), join([x for _, _, x in found], np.float64 if kind == "double" else np.int64))
        return pa.table([pa.array(x) for x in cols], ["key", "vec_id", "score"])

    by = ["dim", "block", "slab"]
    found = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, f"key long, vec_id long, score {kind}")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    top = cut(found, "search-found").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank")
    mine = members.select("query_id", "key").join(top, "key").filter("query_id != vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]
