"""Neighbours by keys against comparing all pairs."""

import random
import re

from auditspark.operators import slips


def near(a, b):
    zeros = lambda v: re.sub("0+", "0", v)
    changed = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    exchanged = any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))
    lost = lambda x, y: any(x[:i] + x[i + 1 :] == y for i in range(len(x)))
    return a and b and a != b and (changed or exchanged or lost(a, b) or lost(b, a) or abs(len(a) - len(b)) <= 2 and zeros(a) == zeros(b))


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), "".join(rng.choice("0012a") for _ in range(rng.randint(0, 6)))) for _ in range(400)] + [(1, None), (None, None)]
    frame = spark.createDataFrame(rows, "g int, v string").repartition(3)
    got = {tuple(r) for r in slips.near_values(frame, ["g"], "v").collect()}
    known = {x for x in rows if x[1] is not None}
    assert got == {(g, a, b) for g, a in known for h, b in known if g == h and near(a, b)} and len(got) > 200
    some, rest = frame.filter("v < '1'"), frame.filter("v >= '1'")
    assert {tuple(r) for r in slips.near_values(some, ["g"], "v", rest).collect()} == {x for x in got if x[1] < "1" <= x[2]}
    assert slips.near_values(frame.limit(0), ["g"], "v").count() == 0
