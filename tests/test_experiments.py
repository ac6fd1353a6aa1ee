"""Evaluations against plain versions: any number of Keys, audits, costs, resampling, joins by buckets."""

import random
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from evloom.operators import evaluation as ev
from evloom.operators import experiments as ex
from evloom.operators import intervals as iv

GOOD = ("complete", "ok", "success")


def plain_score(r):
    if r["abstained"] or (r["answer"] is not None and not r["answer"].strip()):
        return 0
    return int(r["status"] in GOOD and r["verdict"] == "correct" and r["parse_ok"] is not False and not r["truncated"])


def plain_pair(plan, rows, audit):
    """One question's record, step by step."""
    m = plan["m"]
    keys = [f"Key-{i + 1}" for i in range(m)]
    none = {"status": "missing", "verdict": None, "parse_ok": None, "truncated": None, "abstained": None, "answer": None, "legal": False, "valid": None, "why": "missing_final_logical_result"}
    at = {c: rows.get(c, none) for c in ["Full", *keys, "Irrel-1", "Irrel-2", "Blind"]}
    explicit = all((plan["valid"] if r["valid"] is None else r["valid"]) is True for r in at.values())
    broken = [r["parse_ok"] is False or bool(r["truncated"]) for r in at.values()]
    done = all(r["status"] in GOOD for r in at.values()) and not any(broken)
    valid = m >= 2 and explicit and done
    s = {c: plain_score(r) for c, r in at.items()}
    irrel = [s["Irrel-1"], s["Irrel-2"]]
    candidate = valid and s["Full"] == 1 and s["Blind"] == 0 and irrel == [1, 1] and [s[k] for k in keys].count(0) >= 2 and all(r["verdict"] in ("correct", "incorrect") and r["legal"] for r in at.values())
    confirmed = bool(candidate and audit and audit[0] == "human" and audit[1])
    reasons = ["fewer_than_two_event_groups"] * (m < 2) + [plan["why"] or "intervention_not_validated"] * (not explicit)
    if not done:
        reasons += sorted({r["why"] or r["status"] for r in at.values() if r["status"] not in GOOD}) + ["parse_failure_or_truncation"] * any(broken)
    dk = s["Full"] - mean([s[k] for k in keys]) if valid else None
    di = s["Full"] - mean(irrel) if valid else None
    return valid, reasons, dk, di, s["Full"] - s["Blind"] if valid else None, candidate, confirmed, "human_confirmed" if confirmed else "reviewed_unconfirmed" if audit else "pending"


def test_pair_report_equals_plain_version(spark):
    rng = random.Random(4)
    plans, rows, audits, want = [], [], [], {}
    for q in range(400):
        plan = {"m": rng.randrange(5), "valid": rng.choice([True, True, True, False, None]), "why": rng.choice([None, "hidden copy"])}
        right = rng.random() < 0.5  # half of the questions are near to candidates
        own = {}
        for c in ["Full", *[f"Key-{i + 1}" for i in range(plan["m"])], "Irrel-1", "Irrel-2", "Blind"]:
            if rng.random() < 0.03:
                continue
            good = (c in ("Full", "Irrel-1", "Irrel-2")) if right else rng.random() < 0.5
            own[c] = {
                "status": rng.choices(["complete", "ok", "failed"], [20, 5, 1])[0], "verdict": "correct" if good else rng.choice(["incorrect"] * 9 + ["uncertain"]), "parse_ok": rng.choice([True, None] * 12 + [False]),
                "truncated": rng.choice([False, None] * 12 + [True]), "abstained": rng.choice([None] * 30 + [True]), "answer": rng.choice(["x", None] * 15 + [" "]), "legal": rng.random() < 0.97,
                "valid": rng.choice([None, None, True, True]) if rng.random() < 0.98 else False, "why": rng.choice([None, "timeout"]),
            }
        audit = rng.choice([None, ("human", True), ("human", False), ("model", True)])
        plans.append((q, q % 37, plan["m"], plan["valid"], plan["why"]))
        rows += [(q, c, r["status"], r["verdict"], r["parse_ok"], r["truncated"], r["abstained"], r["answer"], r["legal"], r["valid"], r["why"]) for c, r in own.items()]
        if audit:
            audits.append((q, audit[0], *[True] * 5, audit[1]))
        want[q] = plain_pair(plan, own, audit)
    planned = spark.createDataFrame(plans, "q long, cluster long, m int, intervention_valid boolean, invalid_reason string")
    results = spark.createDataFrame(rows, "q long, condition string, status string, verdict string, parse_ok boolean, truncated boolean, abstained boolean, answer string, citations_legal boolean, intervention_valid boolean, failure_reason string")
    seen = spark.createDataFrame(audits, f"q long, reviewer_type string, {', '.join(f'{c} boolean' for c in ex.CHECKS)}")
    out = ex.pair_report(planned, results, "q", seen)
    got = {r.q: (r.valid_pair, r.invalid_reasons, r.delta_key, r.delta_irrel, r.full_minus_blind, r.candidate, r.confirmed, r.audit_status) for r in out.collect()}
    for q, w in want.items():
        assert got[q] == (*w[:2], *[None if x is None else pytest.approx(x) for x in w[2:5]], *w[5:]), q
    assert sum(w[5] for w in want.values()) > 5
    assert any(len(w[1]) > 1 for w in want.values())
    report = ex.intervention_report(out, 200).first()
    d = [w[2] - w[3] for w in want.values() if w[0]]
    assert report.n_valid == len(d)
    assert report.d == pytest.approx(mean(d))
    assert report.d_low < report.d < report.d_high
    for bad in (results.limit(1).withColumn("condition", F.lit("Key-9")), results.limit(1).withColumn("q", F.lit(999))):
        with pytest.raises(Exception, match="unplanned result"):
            ex.pair_report(planned, results.unionByName(bad), "q").collect()
    with pytest.raises(Exception, match="repeated result"):
        ex.pair_report(planned, results.unionByName(results.limit(1)), "q").collect()
    with pytest.raises(Exception, match="0 to 4 groups"):
        ex.pair_report(planned.withColumn("m", F.lit(5)), results, "q").collect()
    with pytest.raises(Exception, match="repeated audit"):
        ex.pair_report(planned, results, "q", seen.unionByName(seen.limit(1))).collect()


def test_method_rows_refuse_bad_costs_and_disagreement(spark):
    planned = spark.createDataFrame([(1, 1), (2, 1)], "q long, cluster long")
    schema = "q long, method string, status string, verdict string, citations_legal boolean, access_ann boolean, feasible_ann boolean, logical_tokens double"
    row = lambda m="R1", f=True, t=5.0: (1, m, "complete", "correct", True, True, f, t)
    good = ex.method_rows(planned, spark.createDataFrame([row(), row("R2")], schema), "q")
    assert {(r.q, r.method): (r.status, r.score, r.feasible) for r in good.collect()}[2, "R*"] == ("missing", 0, None)
    assert ex.method_report(good, "q", 50).first().n_unknown_feasibility == 1
    for bad, why in (([row(t=-1.0)], "invalid cost"), ([row(t=float("nan"))], "invalid cost"), ([row(), row("R2", False)], "methods disagree on feasible_ann")):
        with pytest.raises(Exception, match=why):
            ex.method_rows(planned, spark.createDataFrame(bad, schema), "q").collect()


def test_resampling_of_nothing_and_of_one_cluster(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "c long, x double")
    r = ex.resampled(df, "c", {"x": F.col("x"), "none": F.lit(None).cast("double")}, 100).collect()
    got = {x.name: (x.estimate, x.n, x.n_clusters, x.positive) for x in r}
    assert got == {"x": (1.5, 2, 1, True), "none": (None, 0, 0, False)}
    assert ex.resampled(df.limit(0), "c", {"x": F.col("x")}, 100).collect() == [] or ex.resampled(df.limit(0), "c", {"x": F.col("x")}, 100).first().n == 0


def test_weights_are_poisson_and_apart(spark):
    w = ex.poisson_weights(2000, np.arange(300), 43).astype(float)
    assert abs(w.mean() - 1) < 0.01
    assert abs(w.var() - 1) < 0.02
    c = np.corrcoef(w.T)
    assert np.abs(c[np.triu_indices(300, 1)]).max() < 0.15  # clusters: as for independent ones
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01  # draws


def test_interval_is_near_to_the_drawn_one(spark):
    rng = random.Random(8)
    rows = [(c, rng.gauss(0.2, 1) + 0.3 * (c % 3)) for c in range(120) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "c long, x double")
    one = ex.resampled(df, "c", {"x": F.col("x")}).first()
    two = ev.bootstrap_twister(ev.cluster_sums(df, "c", "x"), "c").first()
    assert one.estimate == pytest.approx(two.estimate)
    assert one.low == pytest.approx(two.low, abs=0.04)
    assert one.high == pytest.approx(two.high, abs=0.04)


def test_points_in_intervals_by_buckets(spark):
    rng = random.Random(6)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.random() * 100, float(rng.randrange(100)), -rng.random()])) for _ in range(800)] + [(1, None), (1, float("nan"))]
    spans = []
    for j in range(150):
        s = rng.choice([rng.random() * 100, float(rng.randrange(-2, 100))])
        spans.append((rng.choice([1, 1, 2, 3, None]), j, s, s + rng.choice([0.001, 0.3, 1.0, 2.0, 7.5, 64.0, 500.0, 0.0, -1.0])))
    spans += [(1, 900, float("nan"), 1.0), (1, 901, 0.0, None), (1, 902, 0.0, float("inf"))]
    p = spark.createDataFrame(points, "k long, t double").withColumn("id", F.monotonically_increasing_id())
    g = spark.createDataFrame(spans, "k long, j long, s double, e double")
    out = iv.points_in(p, g, "k")
    got = sorted((r.id, r.j) for r in out.collect())
    fine = [x for x in spans if x[2] == x[2] and x[3] is not None and x[3] < float("inf")]
    want = sorted((r.id, j) for r in p.collect() for k, j, s, e in fine if r.k is not None and r.k == k and r.t is not None and s <= r.t < e)
    assert got == want
    assert sorted(out.columns) == ["e", "id", "j", "k", "s", "t"]
    assert iv.points_in(p, g.limit(0), "k").count() == iv.points_in(p.limit(0), g, "k").count() == 0


def test_hot_key_meets_by_bucket(spark):
    """One key with all rows: what meets is not its product."""
    p = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    g = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("j"), (F.col("id") * 10.0).alias("s"), (F.col("id") * 10.0 + 5).alias("e"))
    out = iv.points_in(p, g, "k")
    assert out.count() == 10_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
