"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

Rows of the matrix are classes of documents with equal shingle sets, columns are shingles. It is cut into blocks of
columns by hash. Texts are taken in groups, which send each block their columns once. A block counts how many rows each of
its columns has and tells the groups; columns of one row can't be in any overlap and go.
A row with fewer than 75 % of its entries left can't link with anything and goes as well. What is left is ordered by how
rare its columns are: two rows of the wanted similarity have a column in common within the first n - ceil(0.75 n) + 1 of
each. In these columns the product is accumulated in two passes. The first takes two rows of each column, the one with the
fewest unshared entries and one by hash, and counts their overlap with every other row of the column; links merge rows into
components. The second looks at columns that still hold several components: every row outside the column's largest
component is compared with all rows of other components. So a group of near copies costs about as many comparisons as it
has members, and no link between components is lost. Pairs whose sizes, or whose
places in the order of columns, rule a link out are discarded before their overlap is counted.

A class of which several groups have copies counts as several rows at first, so it may stay in vain; it is one row where
overlaps are counted. Texts are read again for the matrix, which isn't written: a read has to give the same rows each time.

Shingle hashes have 64 bits; the matrix keeps 40 bits and the number of the block. Null and empty texts have no shingles
and link with nothing; a text of fewer words than a shingle is one shingle; rows with equal ids are rows like any other;
null ids stay null and are never the smallest of a component that has another; very long texts are rows like any other; two
rows exactly at the limit link; an empty table gives an empty result; more columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, discard, small_batches
from .words import chunks, mix, shingles, words

#: Entries of a block of columns, for each bucket of records of groups, and of a group of texts: what one task holds.
BLOCK, BUCKET, PACK = 1_500_000, 1_000_000, 1_000_000
#: In place of a row: the group's record has the rows. A group has no more rows than this.
SEVERAL = 2**16 - 1
#: Rows of a column of the second pass that one key of its join holds.
PART = 512
#: Bits of a column within its block, and bytes that they take when written.
BITS, WIDTH = 40, 5

_KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
#: Incidence by block, and what is shared of it.
PRODUCT, SHARED = (pa.schema(list(zip(("block", "group", "c", "n", "h", "row", x), _KINDS))) for x in ("times", "df"))


def _key(x: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes."""
    return int(mix(mix(x).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0]) if len(x) else 0


def _sets(texts: pa.Array, k: int):
    for _, data, offsets in chunks(texts):
        yield shingles(*words(data, offsets), k)


def _classes(k: int):
    @F.arrow_udf("struct<n: bigint, c: bigint>")
    def classes(texts: pa.Array) -> pa.Array:
        found = [(len(x), _key(x)) for part in _sets(texts, k) for x in part]  # sets of one chunk at a time
        n = pa.array([n for n, _ in found], pa.int64())
        c = pa.array(np.array([c for _, c in found], np.uint64).view(np.int64), pa.int64())
        return pa.StructArray.from_arrays([n, c], ["n", "c"])

    return classes


def _pack(h: np.ndarray) -> bytes:
    """Columns of BITS bits as WIDTH bytes each."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all their next ones: of small numbers the high bytes compress to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _steps(rows: np.ndarray) -> bytes:
    """Rows of a group, in order, as steps from one to the next."""
    return _planes(np.diff(rows.astype("<u2"), prepend=np.uint16(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, "<u2"), dtype=np.int64)


def _incidence(k: int, blocks: int, buckets: int):
    """Texts -> for each group of texts a record of its rows (block below 0), and a cell of each block of columns.

    Within a group a row is known by its place. A cell has each of its columns once, by row: its 40 bits, the row, and how
    many rows of the group have it. Columns of several rows are in the group's record, and last in the cell; so a column is
    in a block at most once a group, however many rows have it, and an entry takes the same bytes in any number of blocks.
    """

    def pack(held, group):
        c = np.array([_key(x) for x in held], np.uint64)
        n = np.array([len(x) for x in held], np.uint32)
        h = np.concatenate(held)
        held.clear()
        block = h >> np.uint64(BITS)
        block %= np.uint64(blocks)
        block <<= np.uint64(BITS)
        h &= np.uint64((1 << BITS) - 1)
        h |= block
        del block
        order = np.argsort(h, kind="stable")
        h, row = h[order], np.repeat(np.arange(len(c), dtype=np.uint16), n)[order]
        del order
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        times = np.diff(np.append(begins, len(h)))
        several = np.repeat(times > 1, times)
        yield -1 - (group ^ group >> 32) % buckets, group, c.tobytes(), n.tobytes(), h[several].tobytes(), row[several].tobytes(), b""
        h, row = h[begins], np.where(times > 1, SEVERAL, row[begins])
        del several, begins
        block = h >> np.uint64(BITS)
        order = np.lexsort((row, block))
        h, row, times, block = h[order], row[order], times[order].astype(np.uint16), block[order]
        for b, first, last in _runs(block):
            yield b, group, b"", b"", _pack(h[first:last]), _steps(row[first:last]), times[first:last].tobytes()

    def batches_of(rows, size=1024):
        while part := list(islice(rows, size)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), PRODUCT.types)], schema=PRODUCT)

    def run(batches):
        seen, held, size = set(), [], 0  # a copy that this task has had adds nothing
        group = TaskContext.get().partitionId() << 32
        for b in batches:
            for sets in _sets(b.column(0), k):
                for x in sets:
                    if len(x) and (key := _key(x)) not in seen:
                        seen.add(key)
                        held.append(x)
                        size += len(x)
                        if len(held) == SEVERAL:
                            yield from batches_of(pack(held, group))
                            held, size, group = [], 0, group + 1
                if size > PACK:
                    yield from batches_of(pack(held, group))
                    held, size, group = [], 0, group + 1
        if held:
            yield from batches_of(pack(held, group))

    return run


def _join(values: pa.ChunkedArray) -> bytes:
    return b"".join(x.as_buffer() for x in values)  # no copy of each value besides the whole


def _runs(x: np.ndarray):
    """Sorted numbers -> each once, with its first place and the place behind its last."""
    begins = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return zip(x[begins].tolist(), begins.tolist(), np.append(begins[1:], len(x)).tolist())


def _rows_of_columns(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Columns of entries, and how many rows each stands for -> how many rows the entry's column has."""
    order = np.argsort(h)
    begins = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(np.add.reduceat(times[order], begins, dtype=np.int64), np.diff(np.append(begins, len(h))))
    return df.clip(0, 2**32 - 1).astype(np.uint32)


def _shared(most: int):
    """One block of columns -> for each of its cells the columns with two rows or more. Records of groups pass."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        if block < 0:
            return table.select(PRODUCT.names).rename_columns(SHARED.names)
        h, times = _unpack(_join(table.column("h"))), np.frombuffer(_join(table.column("times")), np.uint16)
        df, parts = np.empty(len(h), np.uint32), -(-len(h) // most)
        for p in range(parts):  # so many columns at a time
            at = np.flatnonzero(h % np.uint64(parts) == p)
            if len(at):
                df[at] = _rows_of_columns(h[at], times[at])
        out, first = [], 0
        for group, row in zip(table.column("group").to_pylist(), table.column("row")):
            row = _from_steps(row.as_buffer())
            last = first + len(row)
            keep = df[first:last] > 1
            if keep.any():
                out.append((block, group, b"", b"", _pack(h[first:last][keep]), _steps(row[keep]), _planes(df[first:last][keep])))
            first = last
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(SHARED.types)], schema=SHARED)

    return run


def _shared_entries(product: DataFrame, buckets: int, most: int) -> DataFrame:
    """The incidence by block -> records of groups, and of each cell the columns with two rows or more.

    A column is in a block once a group, so blocks are about equal; more than most entries are counted in parts by column.
    """
    return product.groupBy("block").applyInArrow(_shared(most), "block int, group long, c binary, n binary, h binary, row binary, df binary")


def _survivors(percent: int):
    """What is shared of a group -> rows that can have a link: shared columns, and those to look for partners by, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        at = int(np.flatnonzero(block < 0)[0])
        c, n, local, local_row = (np.frombuffer(table.column(x)[at].as_buffer(), t) for x, t in (("c", np.uint64), ("n", np.uint32), ("h", np.uint64), ("row", np.uint16)))
        cells = table.filter(pa.array(block >= 0))
        row, df = ([f(x.as_buffer()) for x in cells.column(y)] for f, y in ((_from_steps, "row"), (lambda x: _from_planes(x, np.uint32), "df")))
        h = _unpack(_join(cells.column("h"))) | np.repeat(block[block >= 0].astype(np.uint64) << np.uint64(BITS), np.array([len(x) for x in row], np.int64))
        row, df = np.concatenate([np.zeros(0, np.int64), *row]), np.concatenate([np.zeros(0, np.uint32), *df])
        several = row == SEVERAL
        order = np.argsort(h[several])
        local_df = df[several][order][np.searchsorted(h[several], local, sorter=order)] if len(local) else df[:0]
        h, row, df = np.append(h[~several], local), np.append(row[~several], local_row), np.append(df[~several], local_df)
        n = n.astype(np.int64)
        m = np.bincount(row, minlength=len(c))
        keep = (100 * m >= percent * n)[row]
        h, df, row = h[keep], df[keep], row[keep]
        order = np.lexsort((h, df, row))
        h, row = h[order].view(np.int64), row[order]
        begins = np.searchsorted(row, np.arange(len(c) + 1))
        out = []
        for i in np.unique(row).tolist():
            mine, need = h[begins[i] : begins[i + 1]], -(-percent * int(n[i]) // 100)
            out.append((int(c[i : i + 1].view(np.int64)[0]), int(n[i]), len(mine), np.sort(mine), mine[: len(mine) - need + 1]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["c", "n", "m", "shared", "first"])

    return run


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Links (a, b) -> (c, label), one row per end: label is the smallest value reachable.

    In each round a value takes the smallest label among its neighbours and the value that its label names, so that paths
    halve.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    n = labels.count()
    for _ in range(most_rounds):
        own = labels.select(F.col("c").alias("a"), F.col("label").alias("b"))
        of = bounded(labels.select(F.col("c").alias("b"), F.col("label").alias("near")), n)
        near = both.unionByName(own).join(of, "b").select(F.col("a").alias("c"), "near", F.lit(None).cast("long").alias("old"))
        every = near.unionByName(labels.select("c", F.col("label").alias("near"), F.col("label").alias("old")))
        new = cut(every.groupBy("c").agg(F.min("near").alias("label"), F.max("old").alias("old")), "labels")
        discard(labels)
        labels = new
        if not new.filter("label != old").limit(1).count():
            discard(both)
            return new.select("c", "label")
    raise RuntimeError("components: labels still change")


def _overlaps(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with n_a, n_b and overlap, counted over all shared columns."""
    left = rows.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x"))
    right = rows.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("overlap"))


def _linked(percent: int):
    return F.lit(100) * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))


def _rows_and_posts(docs: DataFrame, entries: int, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes that can have a link, and the columns in which they meet."""
    blocks, buckets = max(8, -(-entries // BLOCK)), max(8, -(-entries // BUCKET))
    product = docs.select("text").mapInArrow(_incidence(k, blocks, buckets), "block int, group long, c binary, n binary, h binary, row binary, times binary")
    shared = _shared_entries(product, buckets, 3 * BLOCK // 2)
    rows = shared.groupBy("group").applyInArrow(_survivors(percent), "c long, n long, m long, shared array<long>, first array<long>")
    rows = cut(rows.dropDuplicates(["c"]), "jaccard-rows")  # classes that came from several groups, all with the same columns
    # A column at place i of a row, being the first that two rows share, leaves an overlap of at most left = m - i.
    posts = rows.select(F.posexplode("first").alias("i", "h"), "c", "n", "m")
    return rows, cut(posts.select("h", "c", "n", (F.col("m") - F.col("i")).alias("left"), ((F.col("n") - F.col("m")) / F.col("n")).alias("own")), "jaccard-columns")


def _sizes(percent: int):
    return F.lit(100 + percent) * F.least("left", "left_a") >= percent * (F.col("n") + F.col("n_a"))


def class_links(docs: DataFrame, entries: int, k: int = 5, percent: int = 75) -> DataFrame:
    """(a, b), a < b: all pairs of classes that link, also those within one component."""
    rows, posts = _rows_and_posts(docs, entries, k, percent)
    other = posts.select("h", F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    pairs = posts.join(other, "h").filter((F.col("a") < F.col("c")) & _sizes(percent)).select("a", F.col("c").alias("b")).distinct()
    return cut(_overlaps(rows, cut(pairs, "jaccard-pairs")).filter(_linked(percent)).select("a", "b"), "jaccard-links")


def _with_leaders(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): every row of a column with the column's leaders: the row with the fewest unshared entries, and one by hash.

    Leaders are found by partial aggregates; a hot column is spread by Spark's handling of skewed joins.
    """
    lead = lambda *by: F.min(F.struct(*by, "c", "n", "left"))
    leads = posts.groupBy("h").agg(lead("own").alias("p"), lead(F.xxhash64("c", F.lit("leader"))).alias("q"), F.count("*").alias("rows")).filter("rows > 1")
    one = lambda x: F.struct(F.col(f"{x}.c").alias("a"), F.col(f"{x}.n").alias("n_a"), F.col(f"{x}.left").alias("left_a"))
    pairs = posts.join(leads, "h").select("c", "n", "left", F.explode(F.array(one("p"), one("q"))).alias("l")).select("c", "n", "left", "l.*")
    return pairs.filter((F.col("a") != F.col("c")) & _sizes(percent)).select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()


def _across(posts: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """(a, b): rows that share a column but no component, the smaller side of each column against all; None if there are none.

    The largest component of a column isn't compared within itself. Columns of many rows are dealt into parts of about PART
    rows, each of which meets a copy of the rows of the other components.
    """
    posts = posts.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    held = posts.groupBy("h", "label").agg(F.count("*").alias("k"))
    open_ = held.groupBy("h").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("rows")).filter(F.col("top.k") < F.col("rows"))
    open_ = cut(open_.select("h", F.col("top.label").alias("top"), F.ceil(F.col("rows") / PART).cast("int").alias("parts")), "jaccard-open")
    if not (n := open_.count()):
        return None
    posts = cut(posts.join(bounded(open_, n), "h"), "jaccard-open-columns")
    rest = posts.filter("label != top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = posts.select("h", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("label").alias("label_a"))
    pairs = rest.join(other, ["h", "part"]).filter((F.col("label") != F.col("label_a")) & ((F.col("label_a") == F.col("top")) | (F.col("c") < F.col("a"))) & _sizes(percent))
    return pairs.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()


def link_classes(docs: DataFrame, entries: int, k: int = 5, percent: int = 75) -> DataFrame:
    """(c, label) of the classes that have a link to another class: label is the smallest class of the component."""
    rows, posts = _rows_and_posts(docs, entries, k, percent)
    pairs = cut(_with_leaders(posts, percent), "jaccard-pairs")
    links = cut(_overlaps(rows, pairs).filter(_linked(percent)).select("a", "b"), "jaccard-links")
    discard(pairs)
    labels = components(links)
    pairs = _across(posts, labels, percent)
    if pairs is not None:
        pairs = cut(pairs, "jaccard-pairs")
        more = cut(_overlaps(rows, pairs).filter(_linked(percent)).select("a", "b"), "jaccard-links")
        discard(pairs)
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    discard(rows, posts)
    return labels


def _first():
    """What orders the rows of a component: the smallest id, null last, then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t")


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, t, n, c of each row; c, first, lead, of the classes that have several rows or a link).

    first and lead are the first rows of the class and of its component.
    """
    small_batches(docs)
    each = cut(docs.select("doc_id", F.xxhash64("text").alias("t"), _classes(k)("text").alias("s")).select("doc_id", "t", "s.n", "s.c"), "jaccard-docs")
    classes = cut(each.filter("n > 0").groupBy("c").agg(F.min(_first()).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies")), "jaccard-classes")
    labels = link_classes(docs, classes.agg(F.sum("n")).first()[0] or 0, k, percent)
    known = classes.join(labels, "c", "left").filter("copies > 1 or label is not null")
    least = known.filter("label is not null").groupBy("label").agg(F.min("first").alias("lead"))
    return each, cut(known.join(least, "label", "left").select("c", "first", F.coalesce("lead", "first").alias("lead")), "jaccard-known")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest with an equal set)."""
    each, known = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent)
    out = each.join(bounded(known, known.count()), "c", "left")  # a hot class is spread by Spark's handling of skewed joins
    smallest = lambda x: F.coalesce(F.col(f"{x}.doc_id"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), smallest("lead").alias("component_id"), smallest("first").alias("class_id"))


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 75, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, n_links (other rows that the row links with, those with an equal set too), one row per row of docs.

    All pairs of classes are compared that can link, so the work grows with the square of a group of near copies.
    """
    small_batches(docs)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    each = cut(docs.select("doc_id", _classes(k)("text").alias("s")).select("doc_id", F.col("s.n").alias("n"), F.col("s.c").alias("c")), "jaccard-docs")
    copies = cut(each.filter("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.count("*").alias("copies")), "jaccard-classes")
    links = class_links(docs, copies.agg(F.sum("n")).first()[0] or 0, k, percent)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(copies.select(F.col("c").alias("b"), F.col("copies").alias("others")), "b").groupBy(F.col("a").alias("c")).agg(F.sum("others").alias("near"))
    counts = copies.join(near, "c", "left").select("c", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")).filter("n_links > 0")
    counts = cut(counts, "jaccard-counts")
    out = each.join(bounded(counts, counts.count()), "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component: the smallest doc_id, null last, and of rows that share it the one by text hash.

    Rows are told apart by id and text: those without shingles all stay, rows of one id with unrelated texts each belong to
    their own component, and of rows equal in both, one stays if any does.
    """
    each, known = _grouped(docs.select("doc_id", "text"), k, percent)
    named = each.join(bounded(known, known.count()), "c").select("doc_id", "t", (_first() == F.col("lead")).alias("stays"))
    counted = cut(named.groupBy("doc_id", "t", "stays").agg(F.count("*").alias("k")).filter("not stays or k > 1"), "jaccard-drop")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_t"))  # a struct, for names may clash
    same = F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("t") == F.col("row_t"))
    drop, again = (counted.filter(x).select("doc_id", "t") for x in ("not stays", "stays"))
    kept = rows.join(bounded(drop, drop.count()), same, "left_anti")
    if n := again.count():
        again = bounded(again, n)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["row_id", "row_t"]))
    return kept.select("row.*")
