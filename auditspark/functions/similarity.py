"""How much two descriptions look like the same printed item.

Of n characters that both texts have in the same order (the sum of their matching blocks), the measure takes the larger of
two shares: 2 n of all characters, and n of the shorter text's, which counts from a length on and up to a limit.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The shorter text's share counts from this length on, and at most so much.
COVER_FROM, COVER_MOST = 15, 0.95


def _in_common(a: list[str], b: list[str]) -> np.ndarray:
    """Characters of the matching blocks of each pair; pairs of one b follow each other and share its index."""
    out, match, held = np.zeros(len(a)), difflib.SequenceMatcher(autojunk=False), None
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y or not x or not y:
            out[i] = len(x) if x == y else 0
            continue
        if y != held:
            match.set_seq2(held := y)
        match.set_seq1(x)
        out[i] = sum(size for _, _, size in match.get_matching_blocks())
    return out


def strengths(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The measure for each pair of a batch: 0 to 1, 0 where one is null or empty; each different pair is compared once."""
    (a_of, a_at), (b_of, b_at) = ((x.dictionary.to_pylist(), x.indices.to_numpy().astype(np.int64)) for x in (a.fill_null("").dictionary_encode(), b.fill_null("").dictionary_encode()))
    pairs, place = np.unique(b_at * len(a_of) + a_at, return_inverse=True) if len(a_at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    left, right = [a_of[i] for i in pairs % max(1, len(a_of))], [b_of[i] for i in pairs // max(1, len(a_of))]
    sizes = np.array([[len(x), len(y)] for x, y in zip(left, right)], float).reshape(-1, 2)
    common, shorter = _in_common(left, right), sizes.min(1, initial=np.inf)
    same = np.array([x == y for x, y in zip(left, right)], bool)
    covered = np.where(shorter >= COVER_FROM, np.minimum(common / np.maximum(shorter, 1), COVER_MOST), 0)
    score = np.where(same, 1.0, np.maximum(2 * common / np.maximum(sizes.sum(1), 1), covered))
    return np.where(shorter > 0, score, 0.0)[place]


def measure(a: str, b: str) -> float:
    """The measure of one pair, as strengths() has it."""
    if a == b or not a or not b:
        return 1.0 if a and a == b else 0.0
    common, shorter = sum(size for _, _, size in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), min(len(a), len(b))
    return max(2 * common / (len(a) + len(b)), min(common / shorter, COVER_MOST) if shorter >= COVER_FROM else 0.0)


def letter_counts(texts: list[str], kinds: np.ndarray) -> np.ndarray:
    """How many of each of the sorted kinds (code points) each text has, one column a text."""
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    kind = np.searchsorted(kinds, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"))
    return np.bincount(kind * len(texts) + row, minlength=len(kinds) * len(texts)).reshape(len(kinds), len(texts)).astype(np.int32)


def most_alike(a: list[str], b: list[str]):
    """For some of a at a time: their places, and for each the bounds of the measure with all of b, had the texts all their
    common letters in the same order. Never below the measure; of equal texts it is 1."""
    kinds = np.unique(np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), "<u4"))
    theirs, m, number = letter_counts(b, kinds), np.array([len(x) for x in b]), {x: i for i, x in enumerate(dict.fromkeys(b))}
    same, step = np.array([number[x] for x in b]), max(1, 1_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        some = a[at : at + step]
        mine, n = letter_counts(some, kinds), np.array([len(x) for x in some])[:, None]
        common = np.zeros((len(some), len(b)), np.int32)
        for k in np.flatnonzero(mine.any(1) & theirs.any(1)):
            common += np.minimum(mine[k][:, None], theirs[k][None, :])
        shorter = np.minimum(n, m)
        covered = np.where(shorter >= COVER_FROM, np.minimum(common / np.maximum(shorter, 1), COVER_MOST), 0.0)
        most = np.where(shorter > 0, np.maximum(2 * common / np.maximum(n + m, 1), covered) + 1e-9, 0.0)
        most[same == np.array([number.get(x, -1) for x in some])[:, None]] = 1.0
        yield range(at, at + len(some)), most


def strength(a: str, b: str) -> float:
    return float(strengths(pa.array([a], pa.string()), pa.array([b], pa.string()))[0])


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(strengths(a, b), pa.float64())
