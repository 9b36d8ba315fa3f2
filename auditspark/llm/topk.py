"""Exact top-k by inner product: aggregation without random access.

In each block every component has two sorted lists, one for queries in which it is positive (highest first) and one for
those in which it is negative (lowest first). The lists are read in step, part by part. Of a vector, components that have
been read are known; an unread one lies between the list's end and the value read last. So every vector has a lower and an
upper bound, and an unseen one at most the sum of the values read last. Reading stops when all but a few vectors have upper
bounds below the k-th best lower bound; the few are resolved exactly. When all lists have been read bounds are the scores.
Sums are whole numbers: float32 holds them exactly below 2^24, float64 below 2^53, else Python's integers are used.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id; only vectors
of one length are compared; rows with equal ids count once if equal, else as candidates each; equal scores go to the smaller
id; with fewer than k candidates all are returned; very long vectors are vectors like any other, but a score beyond 64 bits
is an error; an empty table gives an empty result; more columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import PART, best, equal_vectors, matrix, search

#: Shares of the lists after which bounds are looked at, and how many vectors may be left to resolve, of each thousand.
DEPTHS, FEW = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0), 20


def _bounds(x: np.ndarray, place: np.ndarray, sorted_x: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each component the value if it is among the first read of its list, else the list's last value / the last read."""
    seen = place < read
    return np.where(seen, x, sorted_x[-1]), np.where(seen, x, sorted_x[read - 1])


def block_top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, read_of: list | None = None):
    """For each row of q: places in x of its best k by inner product (ties to smaller ids) and their scores.

    read_of gets the share of the lists that was read, for each query.
    """
    n, dim = x.shape
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dim
    kind = np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else object
    order = np.argsort(x, axis=0, kind="stable")
    up = np.empty_like(order)
    np.put_along_axis(up, order, np.broadcast_to(np.arange(n)[:, None], order.shape), 0)
    ascending = np.take_along_axis(x, order, 0)
    lists = ((n - 1 - up, ascending[::-1]), (up, ascending))  # for positive and for negative weights
    whole = x.astype(np.int64).astype(object) if kind is object else x.astype(np.int64)
    exact = lambda m: m.astype(np.int64).astype(object) if kind is object else m.astype(kind)
    left, depth = [None] * len(q), [1.0] * len(q)
    for share in DEPTHS:
        todo = [i for i in range(len(q)) if left[i] is None]
        if not todo:
            break
        read = max(1, int(share * n))
        (low_p, high_p), (low_n, high_n) = (_bounds(x, place, sorted_x, read) for place, sorted_x in lists)
        low, high = (exact(np.concatenate(m, 1)).T for m in ((low_p, low_n), (high_p, high_n)))
        for at in range(0, len(todo), PART):
            some = todo[at : at + PART]
            split = exact(np.concatenate((q[some].clip(0), q[some].clip(None, 0)), 1))
            lower, upper = split @ low, split @ high
            least = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
            for j, i in enumerate(some):
                near = np.flatnonzero(upper[j] >= least[j])
                if share == 1 or len(near) * 1000 <= FEW * n or len(near) <= k:
                    left[i], depth[i] = near, share
    for i, some in enumerate(left):
        scores = whole[some] @ (q[i].astype(np.int64).astype(object) if kind is object else q[i].astype(np.int64))
        top = best(scores, ids[some], k)
        yield i, some[top], scores[top]
    if read_of is not None:
        read_of.extend(depth)


def _searcher(k: int):
    def run(keys, q, block):
        ids = block.column("vec_id").to_numpy()
        for i, some, scores in block_top(q, matrix(block.column("v"), np.float64), ids, k + 1):
            yield int(keys[i]), ids[some], scores

    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, v) among vectors (vec_id, v) of other ids; v: whole numbers."""
    members = cut(queries.withColumn("key", F.xxhash64("v", F.hash("v"))).dropDuplicates(["key", "vec_id"]), "search-queries")
    index = cut(equal_vectors(vectors, k + 1).select("vec_id", F.size("v").alias("dim"), "v"), "search-index")
    return search(index, members.withColumnRenamed("vec_id", "query_id"), k, _searcher(k), "long")


def scaled(vectors: DataFrame, by: int = 256) -> DataFrame:
    """Components as floor(by * x)."""
    return vectors.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(by)) * x).cast("double")).alias("v"))
