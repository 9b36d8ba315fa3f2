"""Quality rules: measures against plain loops, exact bounds against sums of fractions, thresholds on made corpora."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest

from auditspark.llm import rules
from auditspark.llm.words import chunks

DOC = "doc_id long, text string, lang string, stratum string, key int, fold string, level int, s string, quality int, c_marks int, r_marks int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = lambda chars: sum(text.count(x) for x in chars)
    return [len(w), sum(map(len, w)), n("#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), n("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n("!\"'()+,-./:;=?@[\\]^_`{}~"), n("0123456789")]


def texts(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "A", "été", "中文", "#*", "x!", "12", " ", "a b"]
    made = ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "\n\n", " \n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return made + [None, "", " \n\t", "\n", "a", "a b", "a b c", "a b c a b c", "x\nx\n x\nx", "same line\n" * 3, "long word " * 50_000, "end\n", "\nstart"]


def test_measures_are_those_of_a_plain_loop():
    some = texts(1)
    got = []
    for _, data, offsets in chunks(pa.array(some)):
        got += list(zip(*[x.tolist() for x in rules.measure(data, offsets)]))
    assert [list(x) for x in got] == [plain(t) for t in some]


@pytest.mark.parametrize("x, n, p", [(0, 1, 0.5), (0, 90, 0.05), (3, 100, 0.05), (5, 100, 0.05), (40, 50, 0.7), (49, 50, 0.9), (50, 50, 0.9), (1, 2000, 0.001), (7, 30, 0.1)])
def test_binomial_tail_is_exact(x, n, p):
    f = Fraction(p)
    want = float(sum(math.comb(n, i) * f**i * (1 - f) ** (n - i) for i in range(x + 1)))
    assert rules.binomial_tail(x, n, p) == pytest.approx(want, rel=1e-9)
    bound = rules.upper_bound(x, n, 0.01)
    assert bound == 1.0 if x >= n else rules.binomial_tail(x, n, bound) == pytest.approx(0.01, rel=1e-6)


def test_tail_of_large_counts():
    assert rules.binomial_tail(500_000, 10**7, 0.05) == pytest.approx(0.5, abs=1e-3)
    assert rules.binomial_tail(490_000, 10**7, 0.05) < 1e-40


def made(seed, n, junk, noise):
    """Good texts of words, bad ones with symbols; a share noise of good texts has symbols too."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, odd = rng.random() < junk, rng.random() < noise
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(55, 80))]
        text = " ".join(w + ("#" if bad or odd else "") for w in words)
        docs.append((i, text, "x" if i % 2 else None, "s", 1, "f", 2, "s", 3, 4, 5))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def run(spark, docs, labels, **more):
    d, m = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return [r.asDict() for r in rules.judge(d, m, **more).collect()]


def test_bad_texts_go_and_good_ones_stay(spark):
    docs, labels = made(2, 1200, 0.2, 0.0)
    docs += [(5000, None, "x", "", 0, "", 0, "", 0, 0, 0), (5001, "", None, "", 0, "", 0, "", 0, 0, 0), docs[3], (5002, docs[7][1], "never seen", "", 0, "", 0, "", 0, 0, 0)]
    got = run(spark, docs, labels + [(3, None, 0), (4, 7, 0), (9999, 1, 0)])
    assert len(got) == len(docs)
    quality = {i: q for i, q, _ in labels}
    kept = [(r["kept"], quality[r["doc_id"]]) for r in got if r["doc_id"] in quality]
    assert all(q == 0 for k, q in kept if not k) or sum(q for k, q in kept if not k) < 0.05 * len(kept)
    assert sum(k for k, q in kept if q == 0) == 0
    odd = {r["doc_id"]: r for r in got if r["doc_id"] >= 5000}
    assert odd[5000]["base_failed"] and odd[5001]["base_failed"] and not odd[5000]["kept"] and odd[5002]["kept"]
    again = sorted(map(str, run(spark, docs, labels)))
    assert again == sorted(map(str, got))


def test_a_rule_that_rejects_too_many_good_texts_is_not_certified(spark):
    docs, labels = made(3, 900, 0.2, 0.15)
    got = run(spark, docs, labels)
    quality = {i: q for i, q, _ in labels}
    lost = [not r["kept"] for r in got if quality[r["doc_id"]]]
    assert sum(lost) <= 0.05 * len(lost)


def test_too_few_labels_certify_nothing(spark):
    docs, labels = made(4, 60, 0.5, 0.0)
    assert all(r["kept"] for r in run(spark, docs, labels))


def test_copies_count_once(spark):
    docs, labels = made(5, 60, 0.5, 0.0)
    more = [(1000 + i, *docs[i % 60][1:]) for i in range(3000)]
    assert all(r["kept"] for r in run(spark, docs + more, labels + [(1000 + i, labels[i % 60][1], 0) for i in range(3000)]))


def test_empty_tables(spark):
    docs, labels = made(6, 5, 0.5, 0.0)
    assert run(spark, [], labels) == []
    assert all(r["kept"] for r in run(spark, docs, []))


def test_held_out_texts_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out and not base_failed").join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert len(good) > 100 and sum(not k for k in good) <= rules.ALPHA * len(good)
    assert len(bad) > 5 and sum(bad) <= 0.2 * len(bad)
