"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are turned by one random rotation and kept as the signs of their components, packed to bits, with one number
for correction: the inner product of the vector and its code. From code and correction follows an unbiased estimate of any
inner product, and a bound on its error. A query is cut to whole numbers of LEVELS bits, so its product with a code is a
count of bits in common, bit plane by bit plane, and codes are never unpacked. For each query, vectors whose upper bound
reaches the k-th best lower bound of their block are compared again on the original vectors, in double precision. Every row
is coded; nothing is sampled.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows with a null id;
only vectors of one length are compared; rows with equal ids count once if equal, else as candidates each; equal scores go
to the smaller id; with fewer than k candidates all are returned; very long vectors are vectors like any other; an empty
table gives an empty result; more columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import PART, best, equal_vectors, matrix, search

#: Standard deviations of the estimate within its error bound.
SURE = 2.5
#: Bits of a component of a query.
LEVELS = 6


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _codes(batches):
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            t = b.filter(pa.array(dims == dim))
            x = matrix(t.column("v"), np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # so that squares stay finite
            turned = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ rotation(dim)
            fit = np.abs(turned).sum(1) / np.sqrt(dim)
            code = pa.array([c.tobytes() for c in _packed(turned > 0)], pa.binary())
            yield pa.RecordBatch.from_arrays([t.column("vec_id"), pa.array(np.full(len(x), dim), pa.int32()), code, pa.array(fit, pa.float64()), t.column("v")], ["vec_id", "dim", "code", "fit", "v"])


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, dim, code, fit (the correction), v."""
    return equal_vectors(vectors, k + 1).select("vec_id", "v", F.size("v").alias("dim")).mapInArrow(_codes, "vec_id long, dim int, code binary, fit double, v array<double>")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which round nothing, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = _scaled(q), _scaled(x)
    return (x @ q) / (np.sqrt((x * x).sum(-1)) * np.sqrt((q * q).sum()))


def estimates(turned: np.ndarray, code: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rotated unit queries and packed codes: estimated cosines, and the error that they have with near certainty."""
    dim = turned.shape[1]
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / (2**LEVELS - 1), 1e-12)
    whole = np.rint((turned - low) / step).astype(np.uint8)
    weighed = np.zeros((len(turned), len(code)))
    for b in range(LEVELS):
        plane = _packed((whole >> b) & 1 > 0)
        for w in range(code.shape[1]):
            weighed += np.bitwise_count(plane[:, w, None] & code[None, :, w]) * float(1 << b)
    ones = np.bitwise_count(code).sum(1)
    # a query component is low + step * whole, a code's +-1: the sum over ones counts twice, less the sum over all
    signed = 2 * (low * ones + step * weighed) - (low * dim + step * whole.sum(1, keepdims=True))
    coded = np.sqrt(np.maximum(0, 1 - fit**2) / max(1, dim - 1))
    return signed / np.sqrt(dim) / fit, SURE * np.sqrt(coded**2 + step**2 / 12) / fit


def _searcher(k: int):
    def run(keys, q, block):
        ids, x, fit = block.column("vec_id").to_numpy(), matrix(block.column("v"), np.float64), block.column("fit").to_numpy()
        code = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
        unit = q / np.abs(q).max(1, keepdims=True)
        turned = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))) @ rotation(q.shape[1])
        for at in range(0, len(q), PART):
            guess, error = estimates(turned[at : at + PART], code, fit)
            low = guess - error
            least = np.partition(low, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] if len(ids) > k else np.full(len(guess), -np.inf)
            near = guess + error >= least[:, None]
            for i in range(len(guess)):
                some = np.flatnonzero(near[i])
                scores = _cosine(q[at + i], x[some])
                top = best(scores, ids[some], k + 1)
                yield int(keys[at + i]), ids[some][top], scores[top]

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, v) among vectors (vec_id, v) of other ids."""
    members = cut(queries.withColumn("key", F.xxhash64("v", F.hash("v"))).dropDuplicates(["key", "vec_id"]), "search-queries")
    index = cut(build_index(vectors, k), "search-index")
    return search(index, members.withColumnRenamed("vec_id", "query_id"), k, _searcher(k), "double")


def finite_vectors(table: DataFrame, *, zero: bool, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector is whole; zero: vectors of zeros take part."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))
