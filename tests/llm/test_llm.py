"""Each operator against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import chat, common, html, jaccard, langid, mixing, neighbours, packing, sharding, topk, toxicity, vectors
from auditspark.llm.words import chunks, shingles, words

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, h string, copy int, label string, c string"


def rows_of(*docs):
    """(doc_id, text, lang, source) with columns whose names clash with those that operators make."""
    return [(*d, 0, 9, "x", "x", 9, "x", "x") for d in docs]


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            text = rng.choice(texts)
        elif kind < 0.6 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 90])))
        texts.append(text)
        docs.append((i, text, "en", rng.choice(["a", "b", "b", "b"])))
    return docs + [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n", "en", None), (n + 3, "LONG " * 5000, "en", "c"), (7, docs[7][1], "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(*corpus()), DOC).repartition(3)


def none(spark):
    return spark.createDataFrame([], DOC)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sets(rows, k=5):
    out = []
    for r in rows:
        w = WORD.findall(lower(r["text"]))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def groups(items, linked):
    parent = list(range(len(items)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(items))]


# -- words ----------------------------------------------------------------------------------------------------------------


def test_shingles_are_those_of_python():
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbB \t\n\x0b\x00é日") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 3_000_000]
    got = [s for _, d, o in chunks(pa.array(texts)) for s in shingles(*words(d, o), 5)]
    want = sets([{"text": t} for t in texts])
    assert [len(x) for x in got] == [len(x) for x in want]
    seen = {}
    for g, w in zip(got, want):
        assert seen.setdefault(w, tuple(g)) == tuple(g)
    assert len(set(seen.values())) == len(seen)


# -- 10: n-gram Jaccard join ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [50, 6_000_000])
def test_jaccard(spark, docs, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BLOCK", blocks)
    monkeypatch.setattr(jaccard, "BUCKET", blocks)
    rows = docs.collect()
    s = sets(rows)
    top = groups(s, lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b))
    least = defaultdict(lambda: 10**9)
    for r, t in zip(rows, top):
        least[t] = min(least[t], r["doc_id"])
    want = Counter((r["doc_id"], len(x), least[t]) for r, x, t in zip(rows, s, top))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    assert got == want


def test_jaccard_large_blocks_are_cut_into_parts(spark, docs, monkeypatch):
    whole = Counter(map(tuple, jaccard.jaccard_components(docs).collect()))
    plain, cuts = jaccard._shared_entries, []

    def in_parts(product, buckets, most):
        large = product.groupBy("block").agg((F.sum(F.octet_length("h")) / 4).alias("n"))
        most = int(large.agg(F.expr("percentile(n, 0.5)")).first()[0]) // 3  # all are large, most of several parts
        cuts.append(large.filter(F.col("n") > most).count())
        return plain(product, buckets, most)

    monkeypatch.setattr(jaccard, "_shared_entries", in_parts)
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == whole
    assert cuts[0] > 2


def test_jaccard_entries_take_the_same_bytes_in_any_number_of_blocks(spark, docs, monkeypatch):
    plain, sizes, results = jaccard._shared_entries, [], []

    def measured(product, buckets, most):
        wide = [f.name for f in product.schema if f.dataType.typeName() == "binary"]
        sizes.append(product.agg(F.sum(sum(F.octet_length(x) for x in wide)), F.countDistinct("block")).first())
        return plain(product, buckets, most)

    monkeypatch.setattr(jaccard, "_shared_entries", measured)
    for block in (6_000_000, 5):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        results.append(Counter(map(tuple, jaccard.jaccard_components(docs).collect())))
    assert results[0] == results[1]
    assert sizes[1][1] > 20 * sizes[0][1] and sizes[1][0] <= 1.1 * sizes[0][0]


def test_jaccard_of_small_groups(spark, monkeypatch):
    """Copies, near copies and columns of a group and of several; groups in which nothing is shared."""
    rng = random.Random(23)
    texts = [" ".join(f"u{i}_{j}" for j in range(rng.randint(1, 30))) for i in range(60)]
    for i in range(12):
        w = [f"c{i}_{j}" for j in range(40)]
        texts += [" ".join(w)] * rng.randint(1, 4) + [" ".join(w[: rng.randint(30, 40)] + ["end"]) for _ in range(3)] + [" ".join(w[:5]) + f" own{i}"] * 2
    rng.shuffle(texts)
    texts += [" ".join(f"t{i}_{j}" for j in range(30)) for i in range(40)]
    s = sets([{"text": t} for t in texts])
    top = groups(s, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    frame = spark.createDataFrame(rows_of(*[(i, t, "", "") for i, t in enumerate(texts)]), DOC).repartition(3)
    for pack, rows in ((100, 2**16 - 1), (10**6, 3), (10**6, 2**16 - 1)):
        monkeypatch.setattr(jaccard, "PACK", pack)
        monkeypatch.setattr(jaccard, "SEVERAL", rows)
        monkeypatch.setattr(jaccard, "BLOCK", 200)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame).collect()} == dict(enumerate(top))


def test_jaccard_chains_and_bad_leaders(spark):
    """Chains whose ends aren't alike, and many variants of a text that is not there itself."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base[i : i + 40]) for i in range(0, 20, 2)]
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(60), 2):
            w[j] = f"v{i}_{j}"
        texts.append(" ".join(w))
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    s = sets(rows)
    top = groups(s, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    frame = spark.createDataFrame(rows_of(*[(i, t, "", "") for i, t in enumerate(texts)]), DOC)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame).collect()}
    assert got == {i: t for i, t in enumerate(top)}
    assert len(set(top)) > 1


def test_jaccard_counts_all_links(spark, docs):
    rows = docs.collect()
    s = sets(rows)
    linked = lambda i, j: i != j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])
    want = Counter((r["doc_id"], len(s[i]), sum(bool(linked(i, j)) for j in range(len(rows)))) for i, r in enumerate(rows))
    assert Counter(map(tuple, jaccard.jaccard_links(docs).collect())) == want
    assert jaccard.jaccard_links(none(spark)).count() == 0


def test_keep_one(spark, docs):
    kept = [r["doc_id"] for r in jaccard.keep_one(docs).collect()]
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert sorted(kept) == sorted({i for i, c in comp.items() if i == c})
    assert jaccard.keep_one(docs).columns == docs.columns
    assert jaccard.keep_one(none(spark)).count() == 0


def test_keep_one_goes_by_row(spark):
    """Of rows of one id with unrelated texts each belongs to its own component; a null id is last of its component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t, i: t.replace(f"{t[0]}{i} ", "z ")
    rows = [(1, a), (7, a), (7, b), (9, near(b, 20)), (9, c), (None, near(c, 30)), (None, near(c, 30)), (None, "own text"), (None, None), (None, None), (3, ""), (7, a), (20, "same"), (20, "same"), (20, "Same")]
    frame = spark.createDataFrame([(i, t, f"{n}", "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, t string, _drop_t string").withColumnRenamed("_drop_t", "c")
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(frame).collect()]
    assert Counter(got) == Counter([(1, a), (7, b), (9, c), (None, "own text"), (None, None), (None, None), (3, "")] + [x for x in got if x[0] == 20])
    assert sum(x[0] == 20 for x in got) == 1
    assert jaccard.keep_one(frame).columns == frame.columns
    least = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(frame).collect() if r["doc_id"] is None}
    assert {v for (_, n), v in least.items() if n > 1} == {9}


def test_keep_one_of_clashing_names(spark):
    names = ["_drop_id", "_drop_t", "row", "row_id", "row_t", "t", "lead", "k", "c", "stays", "n"]
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([a, b, a + " end", "short", None, ""])] + [(6, b, *names), (6, b, *names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = jaccard.keep_one(frame)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], *rows[3:6]], key=str)


def test_jaccard_of_a_hot_column(spark):
    """A passage in half of all texts, variants of one text by the hundred, and strays that link to one variant only."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"{i}x{j}" for j in range(rng.randint(0, 14))]) for i in range(150)]
    base = [f"b{i}" for i in range(80)]
    for i in range(150):
        w = list(base)
        at = rng.randrange(70)
        w[at : at + rng.randint(1, 8)] = [f"v{i}_{j}" for j in range(rng.randint(1, 8))]
        texts.append(" ".join(w))
        if i % 10 == 0:
            w[(at + 20) % 70 : (at + 26) % 70] = [f"s{i}"]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    s = sets(rows)
    top = groups(s, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    frame = spark.createDataFrame(rows_of(*[(i, t, "", "") for i, t in enumerate(texts)]), DOC)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame).collect()}
    assert got == dict(enumerate(top)) and len(set(top)) > 3


# -- 1: sharding ----------------------------------------------------------------------------------------------------------


def sharded(frame, n=4):
    got = sharding.shard_documents(frame, n).collect()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    return got


def test_sharding(spark):
    rng = random.Random(2)
    texts = [f"text {i} " * rng.randint(1, 9) for i in range(150)]
    docs = [(i, rng.choice(texts), "en", "s") for i in range(800)] + [(i, f"only {i}", "en", "s") for i in range(800, 1000)] + [(2000, None, None, None), (2001, "", "", ""), (5, None, "", "")]
    frame = spark.createDataFrame(rows_of(*docs), DOC).repartition(4)
    got = sharded(frame)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 0.1 * len(of)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


@pytest.mark.parametrize("n", [300, 1])
def test_sharding_of_one_text(spark, n):
    """A text that is larger than a shard is split, and sizes stay equal."""
    frame = spark.createDataFrame(rows_of(*[(i, "same", "en", "s") for i in range(n)]), DOC)
    got = sharded(frame)
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and (n == 1 or max(counts.values()) - min(counts.values()) <= 2)


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(none(spark), 4).count() == 0


# -- 9: mixing ------------------------------------------------------------------------------------------------------------


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    want = docs.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], size(r["text"])) for r in want)
    sizes = Counter()
    for r in want:
        sizes[r["source"]] += size(r["text"])
    targets = water(sizes)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max([r["size"] for r in got if r["source"] == s], default=0)
    assert {tuple(r) for r in mixing.mix_sources(docs.repartition(5)).collect()} == {tuple(r) for r in got}
    mix = mixing.take_mix(docs)
    assert mix.columns == docs.columns
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({i: n for i, n in sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter()).items() if n})


def test_mixing_of_clashing_names_and_ids(spark):
    """Rows of one id, or of none, have hashes of their own; the mix returns the columns of its rows as they are."""
    names = ["h", "copy", "copies", "target", "threshold", "full", "source_size", "size", "of", "rest", "row", "prefix", "b", "s"]
    rng = random.Random(3)
    rows = [(None if i % 3 else 7, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 20))), rng.choice("ab"), *[f"{n}{i}" for n in names]) for i in range(400)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    mix = mixing.take_mix(frame)
    assert mix.columns == frame.columns
    taken = Counter(map(tuple, mix.collect()))
    assert set(taken) <= set(rows) and max(taken.values()) <= 2
    plan = {(r["source"], r["target"]) for r in mixing.mix_sources(frame).collect()}
    for source, target in plan:
        assert abs(sum(k * len(r[1].split()) for r, k in taken.items() if r[2] == source) - target) <= 20
    assert Counter(map(tuple, mixing.take_mix(frame.repartition(7)).collect())) == taken


@pytest.mark.parametrize("parts", [1, 4])
def test_mixing_of_equal_rows(spark, parts):
    """A source of one text without ids is taken to within half a text of its target; the other source is mixed as ever."""
    names = ["h", "fit", "alike", "threshold", "at", "part", "of_part", "before", "i", "copies"]
    rows = [(None, "four words of text", "a", *"0123456789")] * 1000 + [(i, f"w{i} " * (1 + i % 7), "b", *"0123456789") for i in range(300)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}").repartition(parts)
    got = mixing.mix_sources(frame).collect()
    target = {r["source"]: r["target"] for r in got}
    assert 4000 < target["a"] < 8000 and target["a"] % 4000 > 4
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - target["a"]) <= 2
    assert abs(sum(r["taken"] for r in got if r["source"] == "b") - target["b"]) <= 7
    mix = mixing.take_mix(frame)
    assert mix.columns == frame.columns
    assert Counter(map(tuple, mix.select("doc_id", "text").collect())) == sum((Counter({(r["doc_id"], rows[0][1] if r["doc_id"] is None else rows[1000 + r["doc_id"]][1]): r["copies"]}) for r in got if r["copies"]), Counter())


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(none(spark)).count() == 0
    empty = spark.createDataFrame(rows_of((1, None, "", "a"), (2, "", "", "b")), DOC)
    assert {(r["target"], r["taken"]) for r in mixing.mix_sources(empty).collect()} == {(0.0, 0)}


# -- 2: packing -----------------------------------------------------------------------------------------------------------


def check_packing(rows, tokens, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, ids in tokens.items():
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == size for r in parts[1:])
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_seq)


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = [d for d in corpus(4, 200) if d[0] != 7] + [(900, "<|endoftext|> in a text", "", ""), (901, "  two  spaces\n\n\ttab ", "", ""), (902, "été 日本 don't 123", "", "")]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x, *_ in docs}
    frame = spark.createDataFrame(rows_of(*docs), DOC).repartition(3)
    used = check_packing(packing.pack_documents(frame, 256).collect(), tokens, 256)
    assert used <= -(-sum(map(len, tokens.values())) // 256) + 1
    with_ids = packing.pack_documents(frame, 256, ids=True).filter("doc_id = 902").first()
    assert np.frombuffer(with_ids["ids"], "<u4").tolist() == tokens[902]
    assert packing.pack_documents(none(spark)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_histogram_packing(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([10, 50, 200]))
    counts = Counter(int(x) for x in rng.integers(1, size + 1, rng.integers(1, 60)))
    plan = packing.pack_histogram(counts, size)
    used = Counter()
    for k, filling in plan:
        assert sum(x * m for x, m in filling) <= size
        for x, m in filling:
            used[x] += k * m
    assert used == counts
    bins = sum(k for k, _ in plan)
    assert packing.lower_bound(counts, size) <= bins <= sum(k for k, _ in packing._best_fit(counts, size))


def fewest_bins(lengths, size):
    """By trying, for ever more bins, every place of every piece (largest first; equal rooms once)."""

    def place(i, rooms):
        if i == len(lengths):
            return True
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[i]
                if place(i + 1, rest):
                    return True
        return False

    lengths = sorted(lengths, reverse=True)
    return next(n for n in range(len(lengths) + 1) if place(0, [size] * n))


@pytest.mark.parametrize("seed", range(10))
def test_histogram_packing_is_optimal_on_small_sets(seed):
    rng = random.Random(seed)
    for _ in range(20):
        size = rng.choice([10, 20, 30])
        lengths = [rng.randint(max(1, size // rng.choice([3, 5, 10])), size - 1) for _ in range(rng.randint(1, 11))]
        assert sum(k for k, _ in packing.pack_histogram(Counter(lengths), size)) == fewest_bins(lengths, size), (size, lengths)


def test_fillings_are_undominated_and_fullest_first():
    got = list(packing.fillings({3: 2, 4: 1, 5: 1, 7: 1, 8: 1}, 8, 6))
    assert got[0] == (8,) and [sum(x) for x in got] == sorted(map(sum, got), reverse=True)
    assert all(not packing._fits_into(b, a) for i, a in enumerate(got) for b in got[i + 1 :])
    assert list(packing.fillings({5: 3}, 4, 0)) == [()]


def test_histogram_packing_beats_greedy():
    counts = {9: 2, 3: 1, 5: 2, 13: 1, 6: 1, 7: 1, 14: 1, 8: 1}
    assert sum(k for k, _ in packing._best_fit(counts, 20)) == 5
    assert sum(k for k, _ in packing.pack_histogram(counts, 20)) == packing.lower_bound(counts, 20) == 4
    assert packing.pack_histogram({}, 10) == []


# -- 3 and 5: vectors -----------------------------------------------------------------------------------------------------


def vector_table(spark, n=400, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:180] = x[100]
    x[200] = 0
    data = [(i, [float(v) for v in x[i]], 1, "x") for i in range(n)]
    data += [(n, None, 1, "x"), (n + 1, [], 1, "x"), (n + 2, [None] * dim, 1, "x"), (n + 3, [float("nan")] + [1.0] * (dim - 1), 1, "x"), (n + 4, [1.0, 2.0], 1, "x"), (100, data[100][1], 1, "x")]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, key int, v string").repartition(3), x


def brute(x, queries, score, k, alive):
    out = {}
    for i in queries:
        s = score(x[i])
        cand = [j for j in range(len(x)) if j != i and alive[j]]
        out[i] = sorted(cand, key=lambda j: (-s[j], j))[:k]
    return out


def test_neighbours(spark):
    table, x = vector_table(spark)
    vecs = neighbours.finite_vectors(table, zero=False)
    got = neighbours.nearest(vecs, vecs.filter("vec_id % 50 = 0"), 5).collect()
    unit = x.astype(float) / np.maximum(np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True)), 1e-30)
    alive = (x != 0).any(1)
    want = brute(x, [i for i in range(0, 400, 50) if alive[i]], lambda q: np.round(unit @ (q.astype(float) / np.linalg.norm(q.astype(float))), 12), 5, alive)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(unit[r["query_id"]] @ unit[r["vec_id"]]), abs=1e-12) if r["query_id"] < 400 else True
    hits = sum(len(set(mine[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert mine[100] == [101, 102, 103, 104, 105] and 400 not in mine and 200 not in mine
    assert neighbours.nearest(vecs.limit(0), vecs.limit(0), 5).count() == 0


def test_top_products(spark):
    table, x = vector_table(spark, seed=3)
    vecs = topk.scaled(neighbours.finite_vectors(table, zero=True))
    got = topk.top_products(vecs, vecs.filter("vec_id % 50 = 0"), 5).collect()
    whole = np.floor(256 * x.astype(float))
    want = brute(whole, range(0, 400, 50), lambda q: whole @ q, 5, np.ones(400, bool))
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine[r["query_id"]].append(r["vec_id"])
        assert r["score"] == int(whole[r["query_id"]] @ whole[r["vec_id"]])
    assert dict(mine) == want
    few = vecs.filter("vec_id in (50, 51)")
    assert [(r["query_id"], r["vec_id"]) for r in topk.top_products(few, few.filter("vec_id = 50"), 5).collect()] == [(50, 51)]


@pytest.mark.parametrize("scale", [1, 1e4, 1e7])
def test_block_top_stops_early_and_stays_exact(scale):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 8)) ** 3 * 256 * scale)
    x[50:90] = x[50]
    q = np.floor(rng.normal(size=(20, 8)) ** 3 * 256 * scale)
    ids = rng.permutation(500)
    exact = x.astype(np.int64).astype(object) @ q.T.astype(np.int64).astype(object)
    for i, some, scores in topk.block_top(q, x, ids, 6):
        want = sorted(range(500), key=lambda j: (-int(exact[j, i]), ids[j]))[:6]
        assert some.tolist() == want and [int(s) for s in scores] == [int(exact[j, i]) for j in want]


def test_blocks_and_slabs(spark, monkeypatch):
    """Every block meets every slab, and what they find is merged."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "SLAB", 24)
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(300, 6)) * 256)
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    got = defaultdict(list)
    for r in sorted(topk.top_products(frame, frame.filter("vec_id % 25 = 0"), 5).collect()):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(j, int(x[j] @ x[q])) for j in sorted(set(range(300)) - {q}, key=lambda j: (-(x[j] @ x[q]), j))[:5]] for q in range(0, 300, 25)}
    near = defaultdict(list)
    for r in sorted(neighbours.nearest(frame, frame.filter("vec_id % 25 = 0"), 5).collect()):
        near[r["query_id"]].append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: sorted(set(range(300)) - {q}, key=lambda j: -(unit[j] @ unit[q]))[:5] for q in range(0, 300, 25)}
    assert set(near) == set(want) and sum(len(set(near[q]) & set(w)) for q, w in want.items()) >= 0.9 * 60


@pytest.mark.parametrize("dim", [3, 24, 64, 130])
def test_estimates_from_bits(dim):
    """Estimates are close to the cosines, and bounds hold for nearly all."""
    rng = np.random.default_rng(dim)
    x, q = rng.normal(size=(500, dim)), rng.normal(size=(20, dim))
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    table = spark_free_codes(x)
    code = np.frombuffer(b"".join(table["code"]), np.uint64).reshape(500, -1)
    guess, error = neighbours.estimates(unit @ neighbours.rotation(dim), code, np.array(table["fit"]))
    true = unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert (np.abs(guess - true) <= error).mean() > 0.95
    assert dim < 24 or np.abs(guess - true).mean() < 1.2 / np.sqrt(dim)


def spark_free_codes(x):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "dim", "v"])
    return pa.Table.from_batches(list(neighbours._codes([batch]))).to_pydict()


def test_lists_are_not_read_to_the_end():
    """Where few components decide, reading stops early."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(4000, 4)) ** 3 * 256)
    read = []
    list(topk.block_top(x[:50], x, np.arange(4000), 6, read))
    assert np.mean(read) < 0.7


def test_equal_vectors(spark):
    table, _ = vector_table(spark)
    vecs = neighbours.finite_vectors(table, zero=False)
    kept = vectors.equal_vectors(vecs, 3).collect()
    assert sorted(r["vec_id"] for r in kept if 100 <= r["vec_id"] < 180) == [100, 101, 102]


# -- 4 and 7: classifiers -------------------------------------------------------------------------------------------------


def speech(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_toxicity_learns_pairs(spark):
    """Neither word alone is toxic; both together are."""
    rng = random.Random(4)
    plain = [f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(30)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["insult"] * a + ["group"] * b
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(a and b)))
    docs += [(5000, None, None, None), (5001, "", "", ""), (5002, "insult and group " * 4000, "", "")]
    frame, marks = spark.createDataFrame(rows_of(*docs), DOC), spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, marks).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(r["predicted"], t) for (i, _, t) in labels for r in [got[i]] if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[5002]["predicted"] == 1 and got[5000]["score"] == got[5001]["score"]
    kept = toxicity.keep_civil(frame, marks)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_scores_of_huge_and_tiny_vectors(spark):
    """Cosines of vectors whose squares overflow or vanish."""
    v = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3.0, -1.0]), (3, [5e-324, 0.0]), (4, [1.7e308, -1.7e308]), (5, [1e300, 1e-300])]
    frame = neighbours.finite_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>"), zero=False)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in neighbours.nearest(frame, frame, 5).collect()}
    unit = [np.array(x) / np.abs(x).max() for _, x in v]
    assert len(got) == 30
    for (i, j), score in got.items():
        assert score == pytest.approx(unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]), abs=1e-12)


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame(rows_of((1, "a", "", "")), DOC)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score_toxicity(frame, marks).collect()] == [0]
    assert toxicity.score_toxicity(none(spark), marks).count() == 0


def longest_parse(text, train):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(6)
    train = {"x": "".join(rng.choice("abc ") for _ in range(300)), "y": "".join(rng.choice("bcd ") for _ in range(300))}
    model = langid.Model(train)
    for _ in range(50):
        text = "a" + "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200)))
        s = model.symbols(text)
        got = model.phrases(np.ascontiguousarray(s[None, :].T), np.array([len(s)]))[:, 0]
        back = {v: chr(k) for k, v in model.letters.items()} | {0: " ", 1: "?"}
        norm = lambda t: "".join(back[int(v)] for v in model.symbols(t))
        assert got.tolist() == [longest_parse(norm(text), norm(train[name])) for name in model.languages]


def test_many_letters_stay_apart():
    rng = random.Random(8)
    common = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμ"
    train = {"en": common * 9 + "xyz " * 50, "zh": "".join(rng.choice([chr(0x4E00 + i) for i in range(300)]) for _ in range(900)), "ja": "".join(rng.choice([chr(0x3041 + i) for i in range(80)] + [chr(0x4E00 + i) for i in range(30)]) for _ in range(900))}
    model = langid.Model(train)
    assert len(set(model.letters.values())) == len(model.letters) > langid.SYMBOLS
    unknown = chr(0xAC00)
    for _ in range(50):
        text = "".join(rng.choice(" abя" + common[-3:] + train["zh"][:60] + train["ja"][:60] + unknown) if rng.random() < 0.7 else rng.choice(list(train.values()))[(i := rng.randrange(400)) : i + 9] for _ in range(rng.randint(1, 60))).strip() or "a"
        s = model.symbols(text)
        got = model.phrases(np.ascontiguousarray(s[None, :].T), np.array([len(s)]))[:, 0]
        norm = "".join(x if ord(x) in model.letters else " " if not x.isalpha() else "?" for x in re.sub(" +", " ", text))
        assert got.tolist() == [longest_parse(norm, train[name]) for name in model.languages]
    assert [x for x, _ in model.predict([train["zh"][100:140], train["ja"][100:140], "xyz xyz"])] == ["zh", "ja", "en"]
    before = model.phrases(model.symbols(unknown * 20)[:, None], np.array([20]))[:, 0]
    assert before.tolist() == [20] * 3


@pytest.mark.parametrize("n", [1, 130])
def test_whole_texts_are_parsed(n):
    """Phrases go on over all borders, side by side and in the loop, with rare letters as with frequent ones."""
    rng = random.Random(n)
    some = "abcdefgh ijklmnop" + "".join(chr(0x4E00 + i) for i in range(90))
    train = {"x": "".join(rng.choice(some) for _ in range(900)), "y": "".join(rng.choice(some[:40]) for _ in range(900))}
    model = langid.Model(train)
    assert len(model.letters) > langid.SYMBOLS
    texts = ["".join(rng.choice([rng.choice(some), train["x"][(i := rng.randrange(800)) : i + 30], train["y"][i : i + 12]]) for _ in range(rng.randint(1, 100))).strip() or "a" for _ in range(n)]
    texts.append("".join(rng.choice([train["x"], train["y"]])[(i := rng.randrange(800)) : i + 40] for _ in range(60)).strip())
    texts.sort(key=lambda t: -len(model.symbols(t)))
    assert len(model.symbols(texts[0])) > 4 * langid.WINDOW
    got = model.count([model.symbols(t) for t in texts])
    norm = lambda t: re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in t))
    for i, t in enumerate(texts):
        assert got[:, i].tolist() == [longest_parse(norm(t), norm(train[name])) for name in model.languages]


def test_scripts():
    """Letters of many scripts, more than a table of frequent ones holds."""
    rng = random.Random(12)
    first = {"latin": 0x61, "cyrillic": 0x430, "greek": 0x3B1, "devanagari": 0x915, "thai": 0xE01, "han": 0x4E00, "hangul": 0xAC00, "ethiopic": 0x1210}
    many = {"han": 800, "hangul": 400, "ethiopic": 100}
    word = lambda name: "".join(chr(first[name] + rng.randrange(many.get(name, 20))) for _ in range(3))
    words = {name: [word(name) for _ in range(200)] for name in first}
    model = langid.Model({name: " ".join(rng.choice(w) for _ in range(900)) for name, w in words.items()})
    texts = [(name, " ".join(rng.choice(w) for _ in range(30))) for name, w in words.items() for _ in range(20)]
    assert [x for x, _ in model.predict([t for _, t in texts])] == [name for name, _ in texts]


def test_language(spark):
    rng = random.Random(7)
    vocab = {"en": ["the", "thing", "with", "ing", "ship", "world"], "de": ["der", "schön", "über", "licht", "und", "zeit"], "fr": ["les", "être", "çaux", "mou", "une", "été"]}
    docs = [(i, speech(rng, vocab[l], rng.randint(3, 80)), l, "s") for i in range(300) for l in [rng.choice(list(vocab))]]
    docs += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 34 --", "en", None), (1003, speech(rng, vocab["de"], 20_000), None, "s"), (1004, "日本", None, "s"), (3, None, "de", "s")]
    frame = spark.createDataFrame(rows_of(*docs), DOC).repartition(2)
    got = langid.identify(frame).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    assert sum(by[i]["lang_pred"] == l for i, _, l, _ in docs[:300] if i != 3) >= 297
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "de" and by[1004]["lang_pred"] in vocab
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(docs) - 4
    assert langid.identify(none(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- 6: pages -------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><header class="top"><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div class="main-12"><h1>Title&nbsp;&amp; more</h1><p>First <b>para
graph<p>Second<br>line <a href='x>y'>link</a><script>var a="</p>";</script><form><input><p>ask</p></form><div class="comments"><p>nice!</p></div></div><aside>side</aside><footer>end</footer>"""


def test_html(spark):
    pages = [(i, "https://Host.example/a?b", PAGE.replace("First", f"First {i}"), "x", "x") for i in range(5)]
    pages += [(10, None, None, "x", "x"), (11, "no url", "", "x", "x"), (12, "http://other/", "<p>one<p>two", "x", "x"), (13, "https://host.example/", "<div class=main-3><p>short</div>", "x", "x"), (14, "https://host.example/", "<article><p>" + "word " * 200_000 + "</article>", "x", "x"), (15, "https://host.example/", "<nav><p>menu</nav><script>x", "x", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r["main_text"] for r in html.extract(frame).collect()}
    assert got[3] == "Title & more\n\nFirst 3 para graph\n\nSecond line link"
    assert got[10] == got[11] == got[15] == "" and got[12] == "one\n\ntwo" and got[13] == "short"
    assert got[14] == ("word " * 200_000).strip()
    assert html.extract(frame.limit(0)).count() == 0


def parts(*some):
    return "<body><div class=page>" + "".join(f"<div class={c}><p>{t}</div>" for c, t in some) + "</div><nav><p>menu</nav></body>"


def extracted(spark, *pages):
    frame = spark.createDataFrame([(i, "http://h/", p, "o", ["w"], "r") for i, p in enumerate(pages)], "page_id long, url string, html string, _of string, winners array<string>, row string").repartition(2)
    got = html.extract(frame)
    assert got.columns == [*frame.columns, "host", "main_text"] and {(r["_of"], *r["winners"], r["row"]) for r in got.collect()} == {("o", "w", "r")}
    return [r["main_text"] for r in got.orderBy("page_id").collect()]


def test_html_consensus_puts_a_misread_page_right(spark):
    """One page of the host has a long text beside its article; alone it would be taken for a part of it."""
    usual = parts(("content", "long words of the article " * 9), ("x", "<a href=a>more</a>"))
    odd = parts(("content", "its own article is here " * 9), ("x", "follow our channel every day " * 5))
    assert extracted(spark, odd)[0].endswith("follow our channel every day")
    got = extracted(spark, *[usual] * 12, odd)
    assert got[:12] == [("long words of the article " * 9).strip()] * 12
    assert got[12] == ("its own article is here " * 9).strip()


def test_html_layouts_of_a_host(spark):
    """A layout with a tenth of the votes keeps its path; a page unlike its host's is read by itself."""
    one, two = parts(("content", "one part " * 20)), parts(("content", "first part " * 20), ("more", "second part " * 15))
    got = extracted(spark, *[one] * 9, two)
    assert got[9].count("\n\n") == 1 and got[9].endswith("second part") and got[0] == ("one part " * 20).strip()
    other = parts(("content", "few words"), ("more", "and many more " * 9))
    assert extracted(spark, *[one] * 20, other)[20] == "few words\n\n" + ("and many more " * 9).strip()


def test_html_winners_decide():
    content, more = ">body>div.page>div.content", ">body>div.page>div.more"
    page = parts(("content", "long " * 90), ("more", "end"))
    assert html.main_text(page, [content]) == ("long " * 90).strip()
    for winners in (None, [], [content, more], [more, content], [">body>div.other"], [more]):
        assert html.main_text(page, winners).endswith("long\n\nend")
    assert html.main_text("<div class=content><p>" + "long " * 90 + "</div><div><p>end</div>", None).endswith("long\n\nend")
    assert html.main_text(parts(("content", "long " * 90), ("more", "<a href=x>elsewhere</a>")), [content]) == ("long " * 90).strip()
    assert html.main_text(parts(("content", "<a href=x>one</a>"), ("more", "<a href=y>two</a>")), [content]).split() == ["one", "two"]


@pytest.mark.parametrize("piece", ["<a ", "<script ", "</script ", '<a href="x', "<div " + "a" * 999, "<a 'x>' ", "<!-", "<!x", "<a \"x>\" ", "<p a=\"'>", "<script>", "<", "</", "<a b='", "&amp", "<i>", "x='", "<td a=\" '"])
def test_html_of_broken_tags(piece):
    """A megabyte of each shape, with and without an end."""
    import time

    for end in ("", ">", " x=1>", "\"'>"):
        source = "<p>the start</p>" + piece * (1_000_000 // len(piece)) + end + "<p>the end"
        began = time.time()
        assert html.main_text(source, None).startswith("the start")
        assert time.time() - began < 5


def test_html_tags_after_one_that_never_ends():
    assert html.main_text("<p>a</p><p>b</p><a href='x>y <p>c</p>d", None) == "a\n\nb\n\ny\n\nc\n\nd"
    assert html.main_text("<p>a <b title='1 > 2'>c</b> 1 < 2 <3</p><!-- no", None) == "a c 1 < 2 <3"
    assert html.main_text("<p>a <b", None) == "a <b"


def test_html_against_a_plain_reading():
    """Scores, containers and blocks worked out by walking up from every block, on random pages with broken nesting."""
    rng = random.Random(21)
    tags = ["div", "p", "article", "section", "ul", "li", "table", "tr", "td", "span", "a", "div class=x1", "div class=content", "div class=share", "nav", "blockquote"]
    for _ in range(150):
        source = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags).split()[0]}>", "word " * rng.randint(1, 9)]) for _ in range(rng.randint(1, 60)))
        page = html.Page(source)
        chains = [list(page.above(node)) for node, *_ in page.blocks]
        scores = defaultdict(float)
        for chain, (_, text, links) in zip(chains, page.blocks):
            share = max(0, len(text) - 2 * links) + 1e-3
            for i in chain:
                if page._tags[i] in html.CONTAINERS:
                    scores[i] += share
                    share *= 0.8
        weight = {i: v * (1.5 if page.good[i] else 1) for i, v in scores.items()}
        got = page.best()
        if not weight:
            assert got is None
            continue
        plain = [c for c, (_, text, links) in zip(chains, page.blocks) if 2 * links <= len(text)]
        holds = lambda i: all(i in c for c in plain) and page._tags[i] in html.CONTAINERS
        top = [i for i in weight if weight[i] > max(weight.values()) * (1 - 1e-9)]
        assert got in {next((j for j in page.above(i) if holds(j)), None) for i in top}
        some = {i for i in range(1, len(page.parent)) if rng.random() < 0.2}
        assert page.under(some) == [k for k, c in enumerate(chains) if some & set(c)]
        if got is not None:
            assert got in page.at([page.named(got)]) and all(page.named(i) == page.named(got) for i in page.at([page.named(got)]))


@pytest.mark.parametrize("piece", ["<div class=a>", "<div>x", "<p>x", "<li>x", "<td>", "</div>", "<a>x", "<section><ul><li>y"])
def test_html_of_any_depth(piece):
    import time

    began = time.time()
    assert "the end" in html.main_text(piece * 50_000 + "<p>the end", [">div.a" * 3])
    assert time.time() - began < 20


def test_html_inside_of_articles():
    page = "<article><div class=legal-note><p>the law</div><div class=share><p>our share</div><math>x</math><div class=ad-slot><p>buy</div><div id=comments><p>nice</div><div class=\"x newsletter\"><p>mail</div></article><div class=legal><p>imprint</div>"
    assert html.main_text(page, None) == "the law\n\nour share\n\nx"
    page = "<article><p>a</p><div class=notice-board>b</div><p class=reply>c</p><table class=nav-stats><tr><td>d</table><div class=reply>no</div></article>"
    assert html.main_text(page, None) == "a\n\nb\n\nc\n\nd"


# -- 8: chats -------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    logs = {1: "ab", 2: "abc", 3: "abd", 4: "abc", 5: "x", 6: "", 7: "abcd"}
    turns = [(c, i, "user" if i % 2 == 0 else None, t, 0, "x") for c, ts in logs.items() for i, t in enumerate(ts)]
    turns += [(5, 0, "user", "x", 0, "x"), (8, 0, "user", None, 0, "x"), (9, 0, "user", "", 0, "x"), (None, 0, "user", "n", 0, "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos int, line string").repartition(3)
    got = {r["conv_id"]: r for r in chat.format_chats(frame).collect()}
    assert set(got) == {3, 5, 7, 8, 9, None}
    assert got[7]["rendered"].count("<|end|>") == 4 and got[5]["n_copies"] == 1 and got[3]["rendered"] == "<|user|>\na<|end|>\n<||>\nb<|end|>\n<|user|>\nd<|end|>\n"
    twice = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (3, 0, "u", "b")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_copies"] for r in chat.format_chats(twice).collect()} == {1: 2, 3: 1}
    assert chat.format_chats(frame.limit(0)).count() == 0


# -- the pipeline ---------------------------------------------------------------------------------------------------------


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Spark's own batches hold 10,000 rows or 64 MB: a whole split of texts, in the JVM and in the worker."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(size)
    frame = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat("id", F.repeat(F.lit(" word"), 2000)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    seen = lambda batches: (b.from_pydict({"bytes": [b.nbytes]}) for b in batches)
    marks = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for stage in (langid.keep_identified, lambda x: toxicity.keep_civil(x, marks), jaccard.keep_one, packing.pack_documents):
        try:
            stage(frame.limit(5))
            sizes = [r["bytes"] for r in frame.select("text").mapInArrow(seen, "bytes long").collect()]
            assert len(sizes) > 5 and max(sizes) < 1.1 * common.BATCH
            spark.conf.set(size, "1m")  # a session's own choice stays
            stage(frame.limit(5))
            assert spark.conf.get(size) == "1m"
        finally:
            spark.conf.unset(size)


def test_special_tokens_are_known_before_the_tokenizer_is_loaded():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, exact = P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = packing._special(path)
    assert special == [x.content for x in exact.get_added_tokens_decoder().values()]
    encode = packing.Encoder(path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special)
    for text, loaded in (("plain text", False), (f"a {special[0]} b", True), ("plain again", True)):
        assert np.frombuffer(encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
        assert (encode.exact is not None) == loaded


def test_packing_starts_no_workers_for_its_plan(spark, docs):
    """Python workers of an RDD are others than those of SQL: executors would hold both."""
    plan = packing.pack_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_toxicity_training_in_little_memory():
    """Arrays of 8 bytes for each term of the sample aren't made, and counts are those of the plain way."""
    import tracemalloc

    rng = np.random.default_rng(3)
    places, begins = rng.integers(0, 5000, 8_000_000).astype(np.int32), np.arange(0, 8_000_001, 1000)
    labels = (rng.random(8000) < 0.3).astype(float)
    assert (toxicity._counts(places) == np.bincount(places, minlength=1 << toxicity.BITS)).all()
    toxic = np.zeros(5000)
    toxic[:20] = 1
    y = np.repeat(labels > 0, np.diff(begins))
    tracemalloc.start()
    try:
        toxicity._partners(places, begins, labels, np.flatnonzero(toxic), y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * len(places)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocab = {"en": ["the", "thing", "with", "ing", "ship", "world"], "de": ["der", "schön", "über", "licht", "und", "zeit"]}
    docs = [(i, speech(rng, vocab[l], rng.randint(20, 60)) + f" u{chr(97 + i % 26)}" + " scum" * (i % 10 == 0), l, rng.choice("ab")) for i in range(300) for l in [rng.choice(list(vocab))]]
    docs += [(400 + i, docs[1][1], "en", "a") for i in range(30)] + [(500, None, None, None), (501, "1 2 3", "en", "a")]
    spark.createDataFrame([d + (0,) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept.append([r["doc_id"] for r in frame.collect()])
    assert set(range(300)) <= set(kept[0]) and not {500, 501} & set(kept[0])
    assert {i for i in range(300) if i % 10} <= set(kept[1]) and not {i for i in range(0, 300, 10)} & set(kept[1])
    assert not set(range(400, 430)) & set(kept[2]) and set(kept[2]) <= set(kept[1]) and 1 in kept[2]
    assert max(Counter(kept[3]).values()) <= 2
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(kept[3])
