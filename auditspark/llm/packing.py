"""Best-fit packing of tokenized documents by bin completion.

Tasks cut documents into pieces and count them by length; the histogram has at most as many rows as a sequence has tokens,
whatever the corpus. Branch and bound over it completes bins around the largest piece left. Fillings of the room beside it
are enumerated from the least waste on, larger pieces first; one whose pieces fit into those of a filling already seen is
dominated and skipped, and so are fillings and branches whose waste leaves no chance to beat the incumbent, which is best-fit
decreasing at first. While many pieces are left a filling is used as often as they last, so the plan is short; the last ones
are packed bin by bin. Each piece then finds its place by its rank among pieces of its length, which comes from counts by
(length, salt); pieces as long as a sequence need no place.

The search ends when it meets the lower bound or has tried STEPS fillings; the best packing found is always whole. Nulls and
odd input: a null text is an empty one, which is the end token alone; rows with equal ids are packed each; null ids are kept;
of pieces of one length any may have any place; very long texts are cut, every token stays; an empty table gives an empty
result; more columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bucket, small_batches

SALTS = 64
#: Fillings that later ones of a bin are compared with.
KNOWN = 200
#: Fillings that the search tries, and pieces from which on down bins are filled one by one.
STEPS, FEW = 2000, 120


class Encoder:
    """Texts to little-endian 32-bit ids, equal to what the tokenizers library makes of the vocabulary at path.

    ranks holds the same vocabulary for tiktoken, which is faster but doesn't know special tokens: texts with one of their
    strings go to the tokenizers library itself, which is loaded when the first one comes.
    """

    def __init__(self, path: str, ranks: str, pattern: str, special: list[str]):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.path, self.special, self.exact = path, special, None

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _special(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def _pieces(path: str, ranks: str, pattern: str, special: list[str], end: int, size: int, ids: bool):
    def run(batches):
        encode, last = Encoder(path, ranks, pattern, special), np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = encode(text.as_py() or "") + last
                n = len(x) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + (size if start or n <= size else n % size or size)
                    part = x[4 * start : 4 * min(stop, n)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part if ids else None))
                    start, piece = stop, piece + 1
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _times(reach: int, length: int, count: int, keep: int) -> int:
    """Sums reachable when up to count pieces of a length may be added to those of reach (bit i: sum i)."""
    step = 1
    while count:
        take = min(step, count)
        reach |= (reach << (length * take)) & keep
        count, step = count - take, step * 2
    return reach


def _fits_into(pieces: tuple[int, ...], rooms: tuple[int, ...]) -> bool:
    """Whether pieces (largest first) fit into rooms, each into the smallest that has space: enough to call them dominated."""
    left = list(rooms)
    for x in pieces:
        best = min((i for i, room in enumerate(left) if room >= x), key=lambda i: left[i], default=None)
        if best is None:
            return False
        left[best] -= x
    return True


def fillings(counts: dict[int, int], room: int, least: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of room with at least `least` in them, from the fullest on, each largest piece first."""
    keep = (1 << (room + 1)) - 1
    lengths = [x for x in sorted(counts) if x <= room]
    reach = [1]  # sums that the lengths up to each place can make
    for x in lengths:
        reach.append(_times(reach[-1], x, min(counts[x], room // x), keep))

    def exact(upto: int, total: int):
        """All ways to make total of the first lengths."""
        if not total:
            yield ()
            return
        for i in range(upto - 1, -1, -1):
            if not reach[i + 1] >> total & 1:
                return
            x = lengths[i]
            for m in range(min(counts[x], total // x), 0, -1):
                if reach[i] >> (total - m * x) & 1:
                    for rest in exact(i, total - m * x):
                        yield (x,) * m + rest

    seen: list[tuple[int, ...]] = []
    for total in range(room, max(0, least) - 1, -1):
        if reach[-1] >> total & 1:
            for pieces in exact(len(lengths), total):
                if not any(_fits_into(pieces, other) for other in seen[:KNOWN]):
                    if len(seen) < KNOWN:
                        seen.append(pieces)
                    yield pieces


def _best_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on the histogram: each bin takes the largest piece that fits, again and again."""
    counts, plan = dict(counts), []
    while counts:
        room, filling = size, []
        for x in sorted(counts, reverse=True):
            if m := min(counts[x], room // x):
                filling.append((x, m))
                room -= m * x
        plan.append((_use(counts, filling), filling))
    return plan


def _use(counts: dict[int, int], filling: list[tuple[int, int]], k: int | None = None) -> int:
    """Take a filling from counts k times, or as often as its pieces last: how often."""
    k = k or min(counts[x] // m for x, m in filling)
    for x, m in filling:
        counts[x] -= k * m
        if not counts[x]:
            del counts[x]
    return k


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer bins: total length, and for each limit the pieces that can't share with those above it."""
    total = -(-sum(x * c for x, c in counts.items()) // size)
    large = sum(c for x, c in counts.items() if 2 * x > size)
    for k in {x for x in counts if 2 * x <= size}:
        alone = sum(c for x, c in counts.items() if x > size - k)
        half = [(x, c) for x, c in counts.items() if size - k >= x and 2 * x > size]
        small = sum(x * c for x, c in counts.items() if k <= x and 2 * x <= size)
        spare = sum((size - x) * c for x, c in half)
        large = max(large, alone + sum(c for _, c in half) + max(0, -(-(small - spare) // size)))
    return max(total, large)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often to use which filling [(length, how many)], for all pieces in as few bins as the search finds."""
    counts = {x: c for x, c in counts.items() if c}
    bins = lambda plan: sum(k for k, _ in plan)
    best, least, total = _best_fit(counts, size), lower_bound(counts, size), sum(x * c for x, c in counts.items())

    def completions(left: dict[int, int], waste: int):
        """Fillings of the bin of the largest piece that can still lead to fewer bins than the incumbent has."""
        largest = max(left)
        rest = dict(left)
        _use(rest, [(largest, 1)], 1)
        for pieces in fillings(rest, size - largest, size - largest - ((bins(best) - 1) * size - total - waste)):
            yield sorted(Counter((largest, *pieces)).items(), reverse=True)

    stack, tried = [(counts, [], 0, completions(counts, 0))] if counts else [], 0
    while stack and bins(best) > least and tried < STEPS:
        left, plan, waste, more = stack[-1]
        if total + waste > (bins(best) - 1) * size or (used := next(more, None)) is None:
            stack.pop()
            continue
        tried += 1
        left = dict(left)
        k = _use(left, used, None if sum(left.values()) > FEW else 1)
        plan = [*plan, (k, used)]
        waste += k * (size - sum(x * m for x, m in used))
        if not left:
            if bins(plan) < bins(best):
                best = plan
        elif total + waste <= (bins(best) - 1) * size:
            stack.append((left, plan, waste, completions(left, waste)))
    return best


def _places(plan) -> pd.DataFrame:
    """For each length and filling: ranks from..to of its pieces, how many a sequence holds, the first sequence and offset."""
    used, rows, sequence = {}, [], 0
    for k, filling in plan:
        at = 0
        for x, m in filling:
            first = used.get(x, 0)
            rows.append((x, first, first + k * m, m, sequence, at))
            used[x], at = first + k * m, at + x * m
        sequence += k
    return pd.DataFrame(rows, columns=["length", "low", "high", "each", "first", "at"]).astype("int64")


def pack_documents(docs: DataFrame, size: int = 1024, end: int = 2, *, path: str | None = None, ranks: str | None = None, pattern: str | None = None, ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, the piece's tokens, if asked for)."""
    if path is None or ranks is None or pattern is None:
        import public_tokenizers

        path, ranks, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    small_batches(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = docs.mapInArrow(_pieces(str(path), str(ranks), pattern, _special(str(path)), end, size, ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = cut(pieces.withColumn("rid", F.monotonically_increasing_id()), "pack-pieces").withColumn("salt", hash_bucket(F.col("rid"), SALTS))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids]
    full = pieces.filter(F.col("length") == size).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long"))  # each is a sequence
    pieces = pieces.filter(F.col("length") < size)
    by_salt = pieces.groupBy("length", "salt").agg(F.count("*").alias("k"))
    counts = {r["length"]: r["k"] for r in by_salt.groupBy("length").agg(F.sum("k").alias("k")).collect()}  # at most size rows
    places = pa.Table.from_pandas(_places(pack_histogram(counts, size)), preserve_index=False)  # Arrow: rows of pandas would go through workers of their own
    places = pieces.sparkSession.createDataFrame(places, "length long, low long, high long, each long, first long, at long")
    up = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = by_salt.withColumn("base", F.sum("k").over(up) - F.col("k")).select("length", "salt", "base")  # at most size * SALTS rows
    rank = F.col("base") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid")) - 1
    ranked = pieces.join(F.broadcast(base), ["length", "salt"]).withColumn("rank", rank)
    placed = ranked.join(F.broadcast(places), "length").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div each")).withColumn("offset", F.col("at") + F.pmod(F.col("rank") - F.col("low"), F.col("each")) * F.col("length"))
    return placed.select(*out).unionByName(full.select(*out))
