"""Intervention packages against a plain enumeration, and the conditions made of them."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evloom.operators import packages as pk

GOLD = {k: [(50.0, 110.0), (200.0, 250.0), (300.0, 330.0)][: 2 + k % 2] for k in range(12)} | {20: [(0.0, 50.0)], 21: [(0.0, 3.0), (50.0, 90.0)], 22: [(0.0, 200.0), (200.0, 396.0)]}


@pytest.fixture(scope="module")
def times():
    rng = random.Random(4)
    return {k: sorted(float(t) for t in rng.sample(range(400), 80)) for k in GOLD}


def four(x):
    return [x[round(i * (len(x) - 1) / 3)] for i in range(4)]


def plainly(key, ts, gold, seed=17):
    """Reason, and the groups' times: every window at its turn, the best one taken."""
    inside = lambda t: any(s <= t < e for s, e in gold)
    own = [[t for t in ts if s <= t < e] for s, e in sorted(gold)]
    if not 2 <= len(gold) <= 4:
        return "merged_group_count_outside_2_to_4", []
    if any(len(x) < 4 for x in own):
        return "evidence_group_has_fewer_than_four_distinct_pts", []
    span = statistics.median(e - s for s, e in gold)
    runs, out = {}, [four(x) for x in own]
    for n, t in enumerate(ts):
        if not inside(t):
            runs.setdefault(sum(map(inside, ts[:n])), []).append(t)
    offers = []
    for r, x in runs.items():
        for a in range(len(x)):
            near = max(b for b in range(a, len(x)) if x[b] / span <= x[a] / span + 1)
            for b in {max(a + 3, near), max(a + 3, near + 1)}:
                if b < len(x):
                    tie = hashlib.sha256(f"{seed}:{key}:{round(x[a] * 1e6)}:{round(x[b] * 1e6)}".encode()).hexdigest()
                    offers.append((abs(x[b] - x[a] - span), tie, r, a, b))
    used = {r: set() for r in runs}

    def room(used):
        n = 0
        for r, x in runs.items():
            free = [i not in used[r] for i in range(len(x))]
            n += sum(len(s) // 4 for s in "".join("x" if f else " " for f in free).split())
        return n

    for still in (2, 1, 0):
        for _, _, r, a, b in sorted(offers):
            whole = set(range(a, b + 1))
            if not whole & used[r] and room(used | {r: used[r] | whole}) >= still:
                used[r] |= whole
                out.append(four(runs[r][a : b + 1]))
                break
        else:
            return "fewer_than_three_disjoint_distractor_groups", []
    return "", out


@pytest.fixture(scope="module")
def built(spark, times):
    frames = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts + ts[:2]], "v long, t double").repartition(3)
    gold = spark.createDataFrame([(k, s, e) for k, g in GOLD.items() for s, e in g], "v long, s double, e double")
    return spark.createDataFrame(pk.packages(frames, gold, "v").collect(), pk.PACKAGE)


def test_packages_equal_a_plain_enumeration(built, times):
    rows = built.collect()
    reasons = set()
    for k, gold in GOLD.items():
        why, groups = plainly(k, times[k], gold)
        reasons.add(why)
        own = sorted((r.grp, r.is_gold, r.pts) for r in rows if r.key == k and r.built)
        assert [r.reason for r in rows if r.key == k and not r.built] == ([why] if why else [])
        assert own == [(n, n < len(gold), pts) for n, pts in enumerate(groups)]
    assert len(reasons) == 4
    names = [r.group_id for r in rows if r.built]
    assert len(names) == len(set(names))


def test_conditions_leave_out_one_group_in_the_order_of_time(built):
    made, start = pk.conditions(built), {(r.key, r.grp): r.pts[0] for r in built.collect() if r.built}
    rows = made.collect()
    assert {r.condition for r in rows if r.key == 0} == {"Full", "Key-1", "Key-2", "Irrel-1", "Irrel-2", "Blind"}
    for r in rows:
        m = len(GOLD[r.key])
        every = set(range(m + 3))
        gone = {"Full": m + 2, "Irrel-1": m, "Irrel-2": m + 1}.get(r.condition)
        gone = int(r.condition[4:]) - 1 if r.condition.startswith("Key") else gone
        assert set(r.groups) == (set() if r.condition == "Blind" else every - {gone})
        assert [start[r.key, g] for g in r.groups] == sorted(start[r.key, g] for g in r.groups)
    assert pk.one_replaced(made).count() == 0
    spoiled = made.withColumn("groups", F.when(F.col("condition") == "Key-1", F.slice("groups", 2, 9)).otherwise(F.col("groups")))
    assert pk.one_replaced(spoiled).count() == len({r.key for r in rows})


def test_hidden_copies_are_found(spark, built):
    rows = [r for r in built.collect() if r.built]
    contents = [(r.key, t, f"{r.key}:{t}") for r in rows for t in r.pts]
    made = pk.conditions(built)
    clean = pk.hidden_copies(made, built, spark.createDataFrame(contents, "key long, t double, h string")).collect()
    assert clean
    assert all(r.valid and r.n_shared == 0 for r in clean)
    # A frame of key 0's first group shows what one of its last distractor does.
    a, b = (next(r.pts[0] for r in rows if (r.key, r.grp) == (0, g)) for g in (0, 4))
    contents = [(k, t, f"{k}:{b}" if (k, t) == (0, a) else h) for k, t, h in contents]
    bad = {(r.key, r.condition, r.n_shared) for r in pk.hidden_copies(made, built, spark.createDataFrame(contents, "key long, t double, h string")).collect() if not r.valid}
    assert bad == {(0, "Key-1", 1)}
