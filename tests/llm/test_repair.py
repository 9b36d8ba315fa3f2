"""Conversation repair against a search over all edit strings, whole and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from auditspark.llm import repair

TURN = "conv_id long, turn long, role string, text string, part int, seq string, c int, row int, dropped string, enter int"
DELTA = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best_edits(rows):
    """Cheapest, then least: a queue of (cost, letters, ...) gives the least letters of the least cost first."""
    seen, out = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        duplicate = not blank and (role, text) in seen
        truncated = not blank and not duplicate and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        seen.add((role, text))
        out.append((role, text, blank, duplicate, truncated))
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, letters, i, state, made = heapq.heappop(queue)
        if (i, state) in done:  # the first way to a node is the cheapest and least, and any way on is open to both
            continue
        if i == len(out) and state in (0, 3):
            return out, cost, letters, list(made)
        done.add((i, state))
        role_next = "assistant" if state == 2 else "user"
        heapq.heappush(queue, (cost + 5, letters + "I", i, DELTA[state, role_next[0]], (*made, (role_next, ""))))
        if i < len(out):
            role, text, blank, duplicate, truncated = out[i]
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, state, made))
            if not blank and not duplicate:
                add = 5 * truncated
                heapq.heappush(queue, (cost + 1 + add, letters + "R", i + 1, DELTA[state, role_next[0]], (*made, (role_next, text))))
                if (state, role[:1]) in DELTA:
                    heapq.heappush(queue, (cost + add, letters + "K", i + 1, DELTA[state, role[:1]], (*made, (role, text))))


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [] if fault == 0 else [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows, ids):
    convs = {c: [] for c in ids}
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, " " if role is None else role, " " if text is None else text))
    out = []
    for c, some in convs.items():
        some.sort()
        flags, cost, letters, made = best_edits([x[2:] for x in some])
        turns = [t for there, t, *_ in some if there]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        counts = [sum(x[i] for x in flags) for i in (2, 3, 4)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1) * rng.randint(1, 5) - (rng.random() < 0.1)
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"])
            text = rng.choice(["Hello.", "Well", "yes!", "No?  ", "", " \t", None, "é中.", "a. b", f"{rng.random()}."])
            rows.append((c, turn, role, text))
    return rows + [rows[3], rows[9], rows[9]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3, "d", 4) for r in rows], TURN).repartition(5)


def results(df):
    return sorted((tuple(r) for r in df.select("conv_id", *repair.COUNTS, "audit", F.sha2(repair.repaired_text(), 256)).collect()), key=str)


@pytest.mark.parametrize("segment", [2048, 3, 1])
def test_against_search(spark, monkeypatch, segment):
    """Long ones and those at the edges of tasks go the way of segments; with segments of one row nearly all do."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations(segment)
    got = results(repair.repair(frame(spark, rows)))
    assert got == brute(rows, {r[0] for r in rows})


def test_damage_and_conversations_without_rows(spark):
    rows = conversations(7, 400) + [(c, 0, "user", "x.") for c in range(1000, 1200)]
    got = results(repair.repair(repair.damage(frame(spark, rows)), F.col("dropped")))
    assert got == brute(damaged(rows), {r[0] for r in rows})
    empty = [r for r in got if r[0] is not None and r[0] >= 1000 and r[6] == 0 and r[7] == ""]
    assert empty and all(r[1:7] == (0, 0, 0, 0, 0, 0) and r[8] == hashlib.sha256(b"").hexdigest() for r in empty)


def test_one_conversation_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rng = random.Random(3)
    rows = [(5, rng.randint(0, 400), rng.choice(["user", "assistant", "tool"]), rng.choice(["One.", "Two", "", f"{rng.random()}."])) for _ in range(900)] + conversations(8, 30)
    assert results(repair.repair(frame(spark, rows))) == brute(rows, {r[0] for r in rows})


def test_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "x" * 1_000_000), (2, 0, "user", "Hi.")]
    assert results(repair.repair(frame(spark, rows))) == brute(rows, {1, 2})
    assert repair.repair(frame(spark, rows).limit(0)).count() == 0
