"""Conversation structure repair by the cheapest edits.

Rows of a conversation, in order, become one whose roles read ``(s?(ua)+)?`` by their initials: a row is kept (0), given the
role user or assistant (1) or deleted (2, which blank and duplicate rows must be), and empty rows of these roles are
inserted (5); a truncated row that isn't deleted costs 5 more. Nodes of the graph are (rows consumed, state of the pattern).
Forward and backward minimum costs mark every arc that lies on a cheapest path; from the start a frontier of nodes follows,
step by step, the marked arcs of the least letter (D, I, K, R), so the edits are, of the cheapest, the least in ASCII order.

Rows are dealt by ranges of (conversation, turn, role, text), so one conversation may lie in many tasks. Those that lie
within a task, nearly all, are repaired there, many at a time: step i of all of them is one operation on arrays. Those at a
task's edges, and longer ones, are cut into segments of at most SEGMENT rows: duplicates come from an aggregate; each segment
gives its 4 x 4 matrix of least costs between states; their products give each one's costs before and after it; segments are
walked from each state that a cheapest path can enter in; and the entered states are chained. What is one value of the
result, a conversation's edits and its repaired rows, is put together at the end and must fit into a row.

Nulls and odd input: null roles and texts are read as one space; rows are ordered by turn (nulls first), then role and text,
so repeated rows and ties of a turn have one order; a null conv_id is one conversation; a conversation without rows, all of
them marked as dropped, has counts of 0, no edits and no repaired rows; very long texts are carried whole; an empty table
gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a segment of a conversation that isn't repaired as a whole.
SEGMENT = 2048
FAR = np.int64(1) << 40
LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: States: nothing yet, after s, after u, after a. Where an inserted or rerolled row leads from each; where a kept row of
#: initial (0 other, 1 s, 2 u, 3 a) leads from each, -1 where it can't stand.
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
START, ACCEPT = np.array([0, FAR, FAR, FAR]), np.array([0, FAR, FAR, 0])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPAIRED = "array<struct<role: string, text: string>>"


def damage(turns: DataFrame) -> DataFrame:
    """turns with faults by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20, and the column dropped."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("fault"))
    fault = lambda n: F.col("fault") == n
    text = F.when(fault(1), "").when(fault(2), F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(fault(4), "user").otherwise(F.col("role"))).withColumn("dropped", fault(0))
    return rows.withColumn("copy", F.explode(F.when(fault(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fault")


# Faults and costs, on arrays


def faults(roles: pa.Array, texts: pa.Array, duplicate: np.ndarray):
    """(initial, blank, duplicate and not blank, truncated and neither) of each row."""
    first = pc.utf8_slice_codeunits(roles, 0, 1)
    initial = sum(pc.equal(first, x).to_numpy(zero_copy_only=False).astype(np.int64) * i for i, x in ((1, "s"), (2, "u"), (3, "a")))
    flag = lambda pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    blank = ~flag(r"[^\x20\x09-\x0D]")
    duplicate = duplicate & ~blank
    return initial, blank, duplicate, ~blank & ~duplicate & ~flag(r"[.!?][\x20\x09-\x0D]*\z")


def repeated(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> np.ndarray:
    """Which rows have the role and text of an earlier row of their conversation."""
    codes = [conv, *[x.dictionary_encode().indices.to_numpy() for x in (roles, texts)]]
    order = np.lexsort(codes[::-1])  # stable: of equal rows the first in order comes first
    same = np.ones(max(0, len(conv) - 1), bool)
    for x in codes:
        same &= x[order][1:] == x[order][:-1]
    out = np.zeros(len(conv), bool)
    out[order[1:]] = same
    return out


def _close(f: np.ndarray) -> None:
    """Forward costs with insertions within a layer."""
    f[:, 2] = np.minimum(f[:, 2], f[:, [0, 1, 3]].min(1) + 5)
    f[:, 3] = np.minimum(f[:, 3], f[:, 2] + 5)


def _close_back(b: np.ndarray) -> None:
    two, three = b[:, 2].copy(), b[:, 3].copy()
    b[:, 2], b[:, 3] = np.minimum(two, three + 5), np.minimum(three, two + 5)
    b[:, :2] = np.minimum(b[:, :2], b[:, 2:3] + 5)


class Graph:
    """The graphs of many sequences of rows: rows lie one after another, sequence i's from begins[i] to begins[i + 1]."""

    def __init__(self, initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, begins: np.ndarray):
        self.initial, self.begins, self.n = initial, begins, np.diff(begins)
        self.stay = np.where(must_go, FAR, 5 * truncated.astype(np.int64))  # what a row costs that isn't deleted
        self.layer = begins[:-1] + np.arange(len(self.n))  # a sequence of n rows has n + 1 layers
        self.of_row = np.repeat(np.arange(len(self.n)), self.n)
        self.longest = np.argsort(-self.n, kind="stable")
        self.alive = np.searchsorted(-self.n[self.longest], -np.arange(self.n.max(initial=0)), "left")  # sequences with a row p

    def _costs(self) -> np.ndarray:
        return np.empty((len(self.initial) + len(self.n), 4), np.int64)

    def forward(self, entry: np.ndarray) -> np.ndarray:
        """Least costs from the entry (costs of each sequence's states before its first row) to each node."""
        f, now = self._costs(), entry[self.longest].astype(np.int64)
        _close(now)
        f[self.layer[self.longest]] = now
        for p, m in enumerate(self.alive.tolist()):
            some = self.longest[:m]
            row = self.begins[some] + p
            old, c, stay = now[:m], self.initial[row], self.stay[row]
            now = old + 2
            now[:, 1] = np.minimum(now[:, 1], np.where(c == 1, old[:, 0] + stay, FAR))
            now[:, 2] = np.minimum(now[:, 2], old[:, [0, 1, 3]].min(1) + stay + (c != 2))
            now[:, 3] = np.minimum(now[:, 3], old[:, 2] + stay + (c != 3))
            _close(now)
            f[self.layer[some] + p + 1] = now
        return f

    def backward(self, leave: np.ndarray) -> np.ndarray:
        """Least costs from each node to the end (costs of each sequence's states after its last row)."""
        b, last = self._costs(), leave.astype(np.int64).copy()
        _close_back(last)
        b[self.layer + self.n] = last
        for p in range(len(self.alive) - 1, -1, -1):
            some = self.longest[: self.alive[p]]
            row, after = self.begins[some] + p, b[self.layer[some] + p + 1]
            c, stay, now = self.initial[row], self.stay[row], after + 2
            now[:, [0, 1, 3]] = np.minimum(now[:, [0, 1, 3]], (after[:, 2] + stay + (c != 2))[:, None])
            now[:, 2] = np.minimum(now[:, 2], after[:, 3] + stay + (c != 3))
            now[:, 0] = np.minimum(now[:, 0], np.where(c == 1, after[:, 1] + stay, FAR))
            _close_back(now)
            b[self.layer[some] + p] = now
        return b

    def tight(self, f: np.ndarray, b: np.ndarray, best: np.ndarray) -> dict[str, np.ndarray]:
        """Of each layer and state, whether the arc of a letter lies on a path of cost best (of each sequence)."""
        layers = np.repeat(np.arange(len(self.n)), self.n + 1)
        rows = np.arange(len(self.initial)) + self.of_row  # the layer before each row
        goal = best[self.of_row][:, None]
        arcs = {x: np.zeros(f.shape, bool) for x in "DIKR"}
        before, after, stay = f[rows], b[rows + 1], self.stay[:, None]
        arcs["D"][rows] = before + 2 + after == goal
        arcs["R"][rows] = before + 1 + stay + after[:, NEXT] == goal
        to = KEPT[self.initial]
        arcs["K"][rows] = (to >= 0) & (before + stay + np.take_along_axis(after, to.clip(0), 1) == goal)
        arcs["I"][:] = f + 5 + b[:, NEXT] == best[layers][:, None]
        return arcs

    def walk(self, f: np.ndarray, b: np.ndarray, best: np.ndarray, enter: np.ndarray, final: np.ndarray):
        """Each sequence's least edits: (sequence, letter, row or -1, state entered) of all steps, in order of sequences, and
        the state that each one leaves in. enter: the state it starts in; final: whether the pattern must end with it."""
        arcs = self.tight(f, b, best)
        frontier = np.arange(4) == enter[:, None]
        at, live, steps = np.zeros(len(self.n), np.int64), np.arange(len(self.n)), []
        while True:
            layer = self.layer[live] + at[live]
            ended = at[live] == self.n[live]
            accepted = (frontier[live] & (b[layer] + ACCEPT == 0)).any(1)
            live, layer = (x[~(ended & (accepted | ~final[live]))] for x in (live, layer))
            if not len(live):
                break
            here, row = frontier[live], self.begins[live] + at[live]
            on = np.stack([here & arcs[x][layer] for x in "DIKR"], 1)
            letter = on.any(2).argmax(1)
            on = on[np.arange(len(live)), letter]
            initial = self.initial[row.clip(max=max(0, len(self.initial) - 1))] if len(self.initial) else np.zeros(len(live), np.int64)
            to = np.where((letter == 0)[:, None], np.arange(4), np.where((letter == 2)[:, None], KEPT[initial], NEXT))
            new = np.zeros_like(here)
            np.logical_or.at(new, (np.repeat(np.arange(len(live)), 4), to.clip(0).ravel()), on.ravel())
            frontier[live] = new
            consumes = letter != 1
            steps.append((live, letter, np.where(consumes, row, -1), new.argmax(1)))
            at[live] += consumes
        joined = [np.concatenate([s[i] for s in steps]) if steps else np.zeros(0, np.int64) for i in range(4)]
        order = np.argsort(joined[0], kind="stable")
        return [x[order] for x in joined], frontier.argmax(1)


def _edits(steps, n: int, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(letters, repaired rows) of n sequences."""
    of, letter, row, state = steps
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
    audit = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(LETTERS[letter].tobytes()))
    left = letter != 0
    of, letter, row, state = (x[left] for x in (of, letter, row, state))
    size = len(roles)
    role = pa.concat_arrays([roles, pa.array(["user", "assistant"])]).take(pa.array(np.where(letter == 2, row, size + state - 2)))
    text = pa.concat_arrays([texts, pa.array([""])]).take(pa.array(np.where(row < 0, size, row)))
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
    return audit, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([role, text], ["role", "text"]))


def _sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return upto[begins[1:]] - upto[begins[:-1]]


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (after == 2) & ((before == 1) | (before == 3)) | (before == 2) & (after == 3)


def _turns(turns: pa.Array, begins: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, greatest, number) of the different turns of each sequence, which come in order, nulls first."""
    n = len(begins) - 1
    there = np.flatnonzero(turns.is_valid().to_numpy(zero_copy_only=False))
    value, of = turns.take(pa.array(there)).to_numpy(zero_copy_only=False).astype(np.int64), of[there]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])))[: len(value)]
    low, high, number = np.zeros(n, np.int64), np.zeros(n, np.int64), np.bincount(of[new], minlength=n)
    high[of] = value
    low[of[::-1]] = value[::-1]
    return low, high, number


def repair_batch(ids: pa.Array, begins: np.ndarray, turns: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Whole conversations: the results of each."""
    n = len(ids)
    of = np.repeat(np.arange(n), np.diff(begins))
    initial, blank, duplicate, truncated = faults(roles, texts, repeated(of, roles, texts))
    graph = Graph(initial, blank | duplicate, truncated, begins)
    f, b = graph.forward(np.broadcast_to(START, (n, 4))), graph.backward(np.broadcast_to(ACCEPT, (n, 4)))
    best = b[graph.layer, 0]
    steps, _ = graph.walk(f, b, best, np.zeros(n, np.int64), np.ones(n, bool))
    audit, repaired = _edits(steps, n, roles, texts)
    low, high, number = _turns(turns, begins, of)
    wrong = np.zeros(len(of), bool)
    wrong[1:] = (of[1:] == of[:-1]) & ~_legal(initial[:-1], initial[1:])
    counts = [np.where(number > 0, high - low + 1 - number, 0), *[_sums(x, begins) for x in (blank, duplicate, truncated, wrong)], best]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(x.astype(np.int64)) for x in counts], audit, repaired], ["conv_id", *COUNTS, "audit", "repaired"])


# Conversations within a task, and segments of the others

_WHOLE = ", ".join(f"{x} long" for x in COUNTS) + f", audit string, repaired {_REPAIRED}"
_OPEN = "part int, seq long, turns array<long>, roles array<string>, texts array<string>"


def _starts(ids: pa.Array) -> np.ndarray:
    """Where another id begins; null is an id."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    differ = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], differ | (null[1:] != null[:-1])))) if len(ids) else np.zeros(0, np.int64)


def _local(batches):
    """Rows in order -> results of the conversations known to be whole, segments of those at the edges and of long ones."""
    part, seq, held, first = TaskContext.get().partitionId(), 0, None, True

    def there(rows: pa.Table, begins: np.ndarray):
        """Without rows marked as dropped, the sequences as they are."""
        kept = ~rows.column("dropped").to_numpy()
        left = rows.filter(pa.array(kept)).combine_chunks()
        column = lambda name: pa.concat_arrays(left.column(name).chunks) if left.num_rows else pa.array([], rows.schema.field(name).type)
        return np.concatenate(([0], np.cumsum(kept)))[begins], *[column(x) for x in ("turn", "role", "text")]

    def whole(rows: pa.Table):
        at = _starts(rows.column("conv_id").combine_chunks())
        out = repair_batch(rows.column("conv_id").combine_chunks().take(pa.array(at)), *there(rows, np.append(at, rows.num_rows)))
        none = [pa.nulls(len(at), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*out.columns, *none], [*out.schema.names, "part", "seq", "turns", "roles", "texts"])

    def segment(rows: pa.Table):
        begins, *lists = there(rows, np.array([0, rows.num_rows]))
        lists = [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), x) for x in lists]
        none = [*[pa.nulls(1, pa.int64())] * len(COUNTS), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
        columns = [rows.column("conv_id").slice(0, 1).combine_chunks(), *none, pa.array([part], pa.int32()), pa.array([seq], pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit", "repaired", "part", "seq", "turns", "roles", "texts"])

    is_open = True  # the conversation held: the task's first one may have begun in another task
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        at = np.append(_starts(rows.column("conv_id").combine_chunks()), rows.num_rows)
        done = 0
        if len(at) > 2:
            if is_open:
                yield segment(rows.slice(0, at[1]))
                seq, done = seq + 1, 1
            if len(at) - 2 > done:
                yield whole(rows.slice(at[done], at[-2] - at[done]))
            is_open = False
        held = rows.slice(at[-2])
        while held.num_rows > SEGMENT:
            yield segment(held.slice(0, SEGMENT))
            seq, held, is_open = seq + 1, held.slice(SEGMENT), True
        held = held.combine_chunks()
    if held is not None and held.num_rows:
        yield segment(held)


def _segment_arrays(batch: pa.RecordBatch, i: int):
    """Graph and columns of a row that holds a segment."""
    turns, roles, texts = (batch.column(x)[i].values for x in ("turns", "roles", "texts"))
    duplicate = np.zeros(len(roles), bool)
    duplicate[batch.column("dups")[i].values.to_numpy(zero_copy_only=False).astype(np.int64) if batch.column("dups")[i].is_valid else []] = True
    initial, blank, duplicate, truncated = faults(roles, texts, duplicate)
    return Graph(initial, blank | duplicate, truncated, np.array([0, len(roles)])), turns, roles, texts, (blank, duplicate, truncated)


def _summaries(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            graph, turns, roles, _, flags = _segment_arrays(batch, i)
            n, c = len(roles), graph.initial
            costs = [graph.forward(np.where(np.arange(4) == s, 0, FAR)[None])[-1].tolist() for s in range(4)]
            low, high, number = (int(x[0]) for x in _turns(turns, graph.begins, graph.of_row))
            values = {"costs": sum(costs, []), "rows": n, "first": int(c[0]) if n else -1, "last": int(c[-1]) if n else -1, "low": low, "high": high, "number": number}
            values |= dict(zip(("blank", "duplicate", "truncated"), (int(x.sum()) for x in flags))) | {"illegal": int((~_legal(c[:-1], c[1:])).sum())}
            names = ["c", "part", "seq"]
            yield pa.RecordBatch.from_pylist([{x: batch.column(x)[i].as_py() for x in names} | values], pa.schema([("c", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("costs", pa.list_(pa.int64())), *[(x, pa.int64()) for x in list(values)[1:]]]))


_SUMMARY = "c string, part int, seq long, costs array<long>, rows long, first long, last long, low long, high long, number long, blank long, duplicate long, truncated long, illegal long"


def _chain_costs(group: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments: costs before and after each, and the conversation's counts, on every one of its rows."""
    g = group.sort_values(["part", "seq"]).reset_index(drop=True)
    matrices = [np.array(x, np.int64).reshape(4, 4) for x in g["costs"]]
    before, after = [START], [ACCEPT]
    for m in matrices[:-1]:
        before.append((before[-1][:, None] + m).min(0).clip(max=FAR))
    for m in matrices[:0:-1]:
        after.append((m + after[-1]).min(1).clip(max=FAR))
    best = int((matrices[0][0] + after[-1]).min())
    full, timed = g[g["rows"] > 0], g[g["number"] > 0]
    illegal = int(g["illegal"].sum()) + int((~_legal(full["last"].to_numpy()[:-1], full["first"].to_numpy()[1:])).sum())
    number = int(timed["number"].sum()) - int((timed["high"].to_numpy()[:-1] == timed["low"].to_numpy()[1:]).sum())
    gaps = int(timed["high"].max() - timed["low"].min()) + 1 - number if len(timed) else 0
    out = g[["c", "part", "seq"]].copy()
    out["before"], out["after"] = [x.tolist() for x in before], [x.tolist() for x in after[::-1]]
    out["final"] = np.arange(len(g)) == len(g) - 1
    sums = {x: int(g[x].sum()) for x in ("blank", "duplicate", "truncated")}
    return out.assign(gaps=gaps, illegal=illegal, cost=best, **sums)


_CHAINED = "c string, part int, seq long, before array<long>, after array<long>, final boolean, gaps long, illegal long, cost long, blank long, duplicate long, truncated long"


def _walks(batches):
    """Each segment from each state in which a cheapest path can enter it."""
    for batch in batches:
        for i in range(batch.num_rows):
            graph, _, roles, texts, _ = _segment_arrays(batch, i)
            before, after = (batch.column(x)[i].values.to_numpy().astype(np.int64)[None] for x in ("before", "after"))
            best, final = np.array([batch.column("cost")[i].as_py()]), np.array([batch.column("final")[i].as_py()])
            f, b = graph.forward(before), graph.backward(after)
            for s in np.flatnonzero(f[0] + b[0] == best):
                steps, leave = graph.walk(f, b, best, np.array([s]), final)
                audit, repaired = _edits(steps, 1, roles, texts)
                keys = [batch.column(x).slice(i, 1) for x in ("c", "part", "seq")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([s], pa.int64()), pa.array(leave.astype(np.int64)), audit, repaired], ["c", "part", "seq", "enter", "leave", "audit", "repaired"])


def _chain_states(group: pd.DataFrame) -> pd.DataFrame:
    """(c, part, seq, enter) of the walks that follow one another from state 0."""
    state, out = 0, []
    for _, g in group.sort_values(["part", "seq"]).groupby(["part", "seq"], sort=True):
        row = g[g["enter"] == state].iloc[0]
        out.append((row["c"], row["part"], row["seq"], state))
        state = row["leave"]
    return pd.DataFrame(out, columns=["c", "part", "seq", "enter"])


def _repair_segments(segments: DataFrame) -> DataFrame:
    """Results of the conversations that lie in segments."""
    kind = dict(segments.dtypes)["conv_id"]
    at = ["c", "part", "seq"]
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("null"))
    segments = segments.select(key.alias("c"), "conv_id", "part", "seq", "turns", "roles", "texts")
    each = segments.select(*at, F.posexplode(F.zip_with("roles", "texts", lambda r, t: F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))).alias("i", "h"))
    place = F.struct("part", "seq", "i")
    first = each.groupBy("c", "h").agg(F.min(place).alias("first"))
    later = each.join(first, ["c", "h"]).filter(place > F.col("first")).groupBy(*at).agg(F.collect_list("i").alias("dups"))
    segments = cut(segments.join(later, at, "left"), "repair-segments")
    small = segments.select(*at, "turns", "roles", "texts", "dups").mapInArrow(_summaries, _SUMMARY)
    chained = cut(small.groupBy("c").applyInPandas(_chain_costs, _CHAINED), "repair-chained")
    walks = segments.join(chained, at).select(*at, "turns", "roles", "texts", "dups", "before", "after", "final", "cost")
    walks = cut(walks.mapInArrow(_walks, f"c string, part int, seq long, enter long, leave long, audit string, repaired {_REPAIRED}"), "repair-walks")
    path = walks.select(*at, "enter", "leave").groupBy("c").applyInPandas(_chain_states, "c string, part int, seq long, enter long")
    parts = walks.join(path, [*at, "enter"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "audit", "repaired"))).alias("p"))
    names = chained.filter("final").select("c", *COUNTS).join(segments.groupBy("c").agg(F.first("conv_id").cast(kind).alias("conv_id")), "c")
    joined = parts.select("c", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"), F.flatten(F.transform("p", lambda x: x["repaired"])).alias("repaired"))
    return names.join(joined, "c").select("conv_id", *COUNTS, "audit", "repaired")


def repair(turns: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (rows of role and text) of each conversation
    of turns (conv_id, turn, role, text). Rows for which dropped holds only say that their conversation exists."""
    gone = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    or_space = lambda name: F.when(F.col("dropped"), "").otherwise(F.coalesce(name, F.lit(" "))).alias(name)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", gone.alias("dropped"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("conv_id", "turn", or_space("role"), or_space("text"), "dropped", "row")
    order = [F.col(x).asc_nulls_first() for x in ("conv_id", "turn", "role", "text", "row")]  # row parts equal rows between tasks
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    kind = dict(turns.dtypes)["conv_id"]
    found = cut(rows.mapInArrow(_local, f"conv_id {kind}, {_WHOLE}, {_OPEN}"), "repair-found")
    whole = found.filter("part is null").select("conv_id", *COUNTS, "audit", "repaired")
    return whole.unionByName(_repair_segments(found.filter("part is not null")))


def repaired_text(repaired: str = "repaired") -> Column:
    return F.array_join(F.transform(repaired, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
