"""Evaluation of interventions and of retrieval methods over planned denominators, with intervals for many
differences from one resampling of clusters.

Resampling is by Poisson weights: in draw d a cluster counts as often as a number from a hash of
(seed, d, cluster) says, mean and variance one. So the weights of a cluster are made where its sums lie,
and what goes on is an array of sums by draw: no draw sees a list of all clusters, nothing is broadcast,
and a statistic more is a column more. Estimates are weighted by rows, as those of drawn clusters are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SUCCESS, score
from .evaluation import condition_summary, disagreeing, planned_results

#: The weights' hash is arithmetic modulo this prime; the fifth power is one to one there.
PRIME = (1 << 31) - 1
#: Weight w goes to hashes from the (w - 1)-th of these to the w-th: the distribution of a Poisson variable of mean one.
STEPS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(w + 1))) for w in range(12)]


def poisson_weights(draws: int, clusters: np.ndarray, seed: int) -> np.ndarray:
    """draws x clusters: how often each cluster counts."""
    d, c = np.arange(draws, dtype=np.int64)[:, None], (clusters.astype(np.int64) % PRIME)[None]
    x = (d * 48271 + c * 69621 + seed) % PRIME
    for add in (c, d):
        two = x * x % PRIME
        x = (two * two % PRIME * x + add + 1) % PRIME
    two = x * x % PRIME
    x = two * two % PRIME * x % PRIME
    return np.searchsorted(np.array(STEPS), x, "right")


def weight_sql(draw: str, cluster: str, seed: int) -> str:
    """poisson_weights() as nested SELECTs: columns draw, cluster, w over `FROM` (draw, cluster)."""
    fifth = "((x * x % {p}) * (x * x % {p}) % {p} * x{add}) % {p}".replace("{p}", str(PRIME))
    case = " ".join(f"WHEN x < {s} THEN {w}" for w, s in enumerate(STEPS))
    first = f"SELECT *, ({draw} * 48271 + ({cluster} % {PRIME}) * 69621 + {seed}) % {PRIME} AS x FROM"
    a = f"SELECT * REPLACE ({fifth.replace('{add}', f' + {cluster} % {PRIME} + 1')} AS x) FROM"
    b = f"SELECT * REPLACE ({fifth.replace('{add}', f' + {draw} + 1')} AS x) FROM"
    c = f"SELECT * REPLACE ({fifth.replace('{add}', '')} AS x) FROM"
    return f"SELECT *, CASE {case} ELSE {len(STEPS)} END AS w FROM ({c} ({b} ({a} ({first} {{source}}))))"


def resampled(rows: DataFrame, cluster: str, values: dict[str, Column], draws: int = 2000, seed: int = 43) -> DataFrame:
    """name, estimate, low, high, positive, n, n_clusters of the mean of each value (null: the row is not in
    it), with 95 % of the resampled means between low and high. cluster: whole numbers. A value that no
    row has: nulls, n 0."""
    names = sorted(values)
    sums = [x for k, v in enumerate(names) for x in (F.coalesce(F.sum(values[v].cast("double")), F.lit(0.0)).alias(f"t{k}"), F.count(values[v]).alias(f"n{k}"))]
    clusters = rows.groupBy(F.col(cluster).cast("long").alias("c")).agg(*sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, 2 * len(names)))
        plain = np.zeros((len(names), 3))  # total, rows, clusters
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = np.stack([part.column(f"{x}{k}").to_numpy().astype(float) for k in range(len(names)) for x in "tn"], 1)
                total += poisson_weights(draws, part.column("c").to_numpy(), seed).astype(float) @ own
                plain += np.stack([own[:, 0::2].sum(0), own[:, 1::2].sum(0), (own[:, 1::2] > 0).sum(0)], 1)
        for k, name in enumerate(names):
            t, n, c = ([*total[:, 2 * k], plain[k, 0]], [*total[:, 2 * k + 1], plain[k, 1]], [0.0] * draws + [plain[k, 2]])
            yield pa.record_batch([pa.array([name] * (draws + 1)), pa.array([*range(draws), -1], pa.int32()), pa.array(t), pa.array(n), pa.array(c)], ["name", "draw", "t", "n", "c"])

    parts = clusters.where("c is not null").mapInArrow(fold, "name string, draw int, t double, n double, c double")
    one = parts.groupBy("name", "draw").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("c").alias("c")).withColumn("m", F.when(F.col("n") > 0, F.col("t") / F.col("n")))
    plain, drawn = F.col("draw") < 0, F.when(F.col("draw") >= 0, F.col("m"))
    out = one.groupBy("name").agg(
        F.max(F.when(plain, F.col("m"))).alias("estimate"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"),
        F.max(F.when(plain, F.col("n"))).cast("long").alias("n"), F.max(F.when(plain, F.col("c"))).cast("long").alias("n_clusters"),
    )
    return out.select("name", "estimate", "low", "high", F.coalesce(F.col("low") > 0, F.lit(False)).alias("positive"), "n", "n_clusters")


# Interventions

#: The checks that a human review has to pass.
CHECKS = ("distinct_necessary_facts", "visually_resolved", "no_text_leakage", "no_alternative_distractor_path", "reference_valid", "citation_and_format_valid")


def conditions_of(m: Column) -> Column:
    """Full, Key-1 to Key-m, Irrel-1, Irrel-2, Blind; an error if m isn't 0 to 4."""
    keys = F.when(m > 0, F.transform(F.sequence(F.lit(1), m.cast("int")), lambda i: F.concat(F.lit("Key-"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    ok = F.coalesce(m.between(0, 4), F.lit(False))
    return F.when(ok, F.concat(F.array(F.lit("Full")), keys, F.array(F.lit("Irrel-1"), F.lit("Irrel-2"), F.lit("Blind")))).otherwise(F.raise_error(F.lit("a question has 0 to 4 groups")).cast("array<string>"))


def optional(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def condition_rows(planned: DataFrame, rows: DataFrame, unit: str) -> DataFrame:
    """Every planned condition of every question with its result and score; see pair_report()."""
    flags = [optional(planned, "intervention_valid", "boolean").alias("_valid"), optional(planned, "invalid_reason", "string").alias("_why")]
    plan = planned.select(unit, "cluster", "m", *flags, F.explode(conditions_of(F.col("m"))).alias("condition"))
    kinds = {"status": "string", "verdict": "string", "parse_ok": "boolean", "truncated": "boolean", "abstained": "boolean", "answer": "string", "citations_legal": "boolean", "intervention_valid": "boolean", "failure_reason": "string", "error": "string"}
    met = planned_results(plan, rows.select(unit, "condition", *[optional(rows, c, k).alias(c) for c, k in kinds.items()]), [unit, "condition"])
    return met.withColumn("score", score(*[F.col(c) for c in ("status", "verdict", "parse_ok", "truncated", "abstained", "answer")]))


def pair_report(planned: DataFrame, rows: DataFrame, unit: str, audits: DataFrame | None = None) -> DataFrame:
    """A row a question: what its conditions say together.

    planned: (unit, cluster, m, and if there intervention_valid, invalid_reason); rows: (unit, condition,
    status, verdict, citations_legal, and if there parse_ok, truncated, abstained, answer,
    intervention_valid, failure_reason, error); a planned condition without row is missing, an unplanned
    or repeated one an error. audits: (unit, reviewer_type, one boolean a check). A pair is valid with two
    groups or more, all its conditions' interventions valid and all of them done, parsed and whole;
    else its differences are null. All Keys count, however many; a candidate needs two zeros among them.
    """
    met = condition_rows(planned, rows, unit)
    key, irrel, c = F.col("condition").startswith("Key-"), F.col("condition").startswith("Irrel-"), F.col("condition")
    success = F.coalesce(F.col("status").isin(*SUCCESS), F.lit(False))
    broken = (F.coalesce(F.col("parse_ok"), F.lit(True)) == F.lit(False)) | F.coalesce("truncated", F.lit(False))
    why = F.coalesce("failure_reason", "error", F.when(F.col("status") == "missing", "missing_final_logical_result"), "status")
    at = lambda name: F.max(F.when(c == name, F.col("score")))
    one = met.groupBy(unit, "cluster", "m", "_why").agg(
        at("Full").alias("full"), at("Blind").alias("blind"), F.avg(F.when(key, F.col("score"))).alias("keys"), F.avg(F.when(irrel, F.col("score"))).alias("irrels"),
        F.count_if(key & (F.col("score") == 0)).alias("zeros"), F.bool_and(F.coalesce("intervention_valid", "_valid", F.lit(False))).alias("explicit"), F.bool_and(success & ~broken).alias("done"),
        F.bool_and(F.coalesce(F.col("verdict").isin("correct", "incorrect"), F.lit(False))).alias("decided"), F.bool_and(F.coalesce("citations_legal", F.lit(False))).alias("legal"),
        F.bool_or(F.coalesce(F.col("verdict") == "uncertain", F.lit(False))).alias("any_uncertain"), F.bool_or(broken).alias("broken"), F.array_sort(F.collect_set(F.when(~success, why))).alias("bad"),
    )
    given = lambda test, text: F.when(test, F.array(text)).otherwise(F.array().cast("array<string>"))
    few = F.col("m") < 2
    reasons = F.concat(
        given(few, F.lit("fewer_than_two_event_groups")), given(~F.col("explicit"), F.coalesce("_why", F.lit("intervention_not_validated"))), F.when(~F.col("done"), F.col("bad")).otherwise(F.array().cast("array<string>")),
        given(~F.col("done") & F.col("broken"), F.lit("parse_failure_or_truncation")),
    )
    valid = ~few & F.col("explicit") & F.col("done")
    candidate = valid & (F.col("full") == 1) & (F.col("blind") == 0) & (F.col("irrels") == 1) & (F.col("zeros") >= 2) & F.col("decided") & F.col("legal")
    out = one.select(
        unit, "cluster", F.col("m").alias("num_gold_groups"), (~few & F.col("explicit")).alias("construction_available"), valid.alias("valid_pair"), reasons.alias("invalid_reasons"),
        F.col("full").alias("full_score"), F.when(valid, F.col("full") - F.col("keys")).alias("delta_key"), F.when(valid, F.col("full") - F.col("irrels")).alias("delta_irrel"),
        F.when(valid, F.col("irrels") - F.col("keys")).alias("d"), F.when(valid, F.col("full") - F.col("blind")).alias("full_minus_blind"), candidate.alias("candidate"), "any_uncertain",
    )
    if audits is None:
        return out.withColumn("confirmed", F.lit(False)).withColumn("audit_status", F.lit("pending"))
    passed = F.col("reviewer_type") == "human"
    for check in CHECKS:
        passed = passed & F.coalesce(F.col(check), F.lit(False))
    seen = audits.select(unit, F.lit(True).alias("_seen"), F.coalesce(passed, F.lit(False)).alias("_passed"), F.count(F.lit(1)).over(Window.partitionBy(unit)).alias("_n"))
    both = out.withColumn("_planned", F.lit(True)).join(seen, unit, "full_outer")
    wrong = F.col("_planned").isNull() | (F.coalesce("_n", F.lit(1)) > 1)
    both = both.where(F.when(~wrong, True).otherwise(F.raise_error(F.lit("unplanned or repeated audit")).cast("boolean")))
    confirmed = F.col("candidate") & F.coalesce("_passed", F.lit(False))
    status = F.when(confirmed, "human_confirmed").when(F.col("_seen").isNull(), "pending").otherwise("reviewed_unconfirmed")
    return both.withColumn("confirmed", confirmed).withColumn("audit_status", status).drop("_planned", "_seen", "_passed", "_n")


def intervention_report(pairs: DataFrame, draws: int = 2000, seed: int = 43) -> DataFrame:
    """One row over pair_report(): counts, the main difference with its interval, and its gates."""
    ok, resolved = F.col("valid_pair"), F.col("valid_pair") & ~F.col("any_uncertain")
    values = {"d": F.col("d"), "full_minus_blind": F.col("full_minus_blind"), "d_decided": F.when(resolved, F.col("d"))}
    found = resampled(pairs, "cluster", values, draws, seed).select("name", F.struct("estimate", "low", "high", "positive").alias("x"))
    wide = found.groupBy(F.lit(1).alias("one")).pivot("name", sorted(values)).agg(F.first("x"))
    distinct = lambda test: F.countDistinct(F.when(test, F.col("cluster")))
    n = pairs.agg(
        F.count(F.lit(1)).alias("n_planned"), F.count_if("construction_available").alias("n_available"), distinct(F.col("construction_available")).alias("available_clusters"), F.count_if(ok).alias("n_valid"),
        distinct(ok).alias("valid_clusters"), F.avg(F.when(ok, F.col("full_score"))).alias("paired_full_accuracy"), F.avg("delta_key").alias("mean_delta_key"), F.avg("delta_irrel").alias("mean_delta_irrel"),
        F.count_if("candidate").alias("n_candidates"), F.count_if("confirmed").alias("n_confirmed"), distinct(F.col("confirmed")).alias("confirmed_clusters"),
    )
    out = n.join(F.broadcast(wide.drop("one")), how="left", on=F.lit(True))  # one row each
    joint = (F.col("d.estimate") >= 0.15) & (F.col("n_confirmed") >= F.greatest(F.lit(12), F.ceil(0.15 * F.col("n_planned")))) & (F.col("confirmed_clusters") >= 6)
    sure = lambda x: F.coalesce(x, F.lit(False))
    return out.select(
        *n.columns, F.col("d.estimate").alias("d"), F.col("d.low").alias("d_low"), F.col("d.high").alias("d_high"), F.col("d_decided.estimate").alias("d_decided"),
        F.col("full_minus_blind.estimate").alias("full_minus_blind"), F.col("full_minus_blind.low").alias("full_minus_blind_low"), F.col("full_minus_blind.high").alias("full_minus_blind_high"),
        ((F.col("n_available") >= 60) & (F.col("available_clusters") >= 15)).alias("standard_sample"), ((F.col("n_valid") >= 36) & (F.col("valid_clusters") >= 10)).alias("valid_intervention_count"),
        sure((F.col("paired_full_accuracy") >= 0.6) & (F.col("full_minus_blind.estimate") >= 0.15)).alias("consumer_visual_entry"), sure(joint).alias("joint_signal"),
        sure(joint & (F.col("n_confirmed") >= F.ceil(0.3 * F.col("n_planned")))).alias("strong_joint_signal"),
    )


# Retrieval methods

METHODS = ["R0", "R1", "R2", "R*"]
COSTS = ("logical_tokens", "logical_calls", "physical_tokens", "physical_calls", "latency_s")


def method_rows(planned: DataFrame, rows: DataFrame, unit: str) -> DataFrame:
    """Every planned question by method with its result, score and costs. planned: (unit, cluster); rows:
    (unit, method, status, verdict, citations_legal, access_ann, feasible_ann, COSTS, and if there the
    fields of condition_rows()). Errors: unplanned and repeated results, costs that are negative or not
    finite, methods that disagree on a question's feasibility, stored_ann or snapshot_hash."""
    kinds = {"status": "string", "verdict": "string", "parse_ok": "boolean", "truncated": "boolean", "abstained": "boolean", "answer": "string", "citations_legal": "boolean", "access_ann": "boolean",
             "feasible_ann": "boolean", "stored_ann": "boolean", "snapshot_hash": "string", **{c: "double" for c in COSTS}}
    plan = planned.select(unit, "cluster", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    met = planned_results(plan, rows.select(unit, "method", *[optional(rows, c, k).alias(c) for c, k in kinds.items()]), [unit, "method"])
    bad = F.lit(False)
    for c in COSTS:
        x = F.col(c)
        bad = bad | F.coalesce(F.isnan(x) | (x < 0) | (x == float("inf")), F.lit(False))
    met = met.where(F.when(~bad, True).otherwise(F.raise_error(F.lit("invalid cost")).cast("boolean")))
    fields = ["feasible_ann", "stored_ann", "snapshot_hash"]
    apart = disagreeing(met, unit, fields).withColumn("e", F.raise_error(F.concat(F.lit("methods disagree on "), "field")).cast("boolean")).select(F.col(unit).alias("_u"), "e")
    met = met.join(apart, F.col(unit) == F.col("_u"), "left").where(F.coalesce("e", F.lit(True))).drop("_u", "e")
    out = met.withColumn("score", score(*[F.col(c) for c in ("status", "verdict", "parse_ok", "truncated", "abstained", "answer")]))
    known = out.groupBy(unit).agg(F.max("feasible_ann").alias("feasible")).withColumnRenamed(unit, "_u")
    return out.join(known, F.col(unit) == F.col("_u")).drop("_u")


def method_table(met: DataFrame) -> DataFrame:
    """A row a method over method_rows(); unknown costs and feasibility stay unknown."""
    access, legal = F.coalesce("access_ann", F.lit(False)), F.coalesce("citations_legal", F.lit(False))
    base = condition_summary(met, ["method"], F.col("score"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(f"total_{c}_known")
    more = met.groupBy("method").agg(
        F.count_if(access).alias("n_access_ann"), F.avg(access.cast("int")).alias("access_ann"), F.count_if(F.col("access_ann").isNull()).alias("n_unknown_access_ann"),
        F.avg(F.when(F.col("feasible"), access.cast("int"))).alias("access_ann_feasible"), F.count_if("feasible").alias("n_feasible_denominator"), F.avg(F.col("score") * (access & legal).cast("int")).alias("j_ann"),
        F.count("logical_tokens").alias("n_known_costs"), F.avg("logical_tokens").alias("mean_logical_tokens"), total("logical_tokens"), total("logical_calls"), total("physical_tokens"), total("physical_calls"),
        F.avg("latency_s").alias("mean_latency_s_known"),
    )
    return base.join(more, "method")


def side_by_side(met: DataFrame, unit: str) -> DataFrame:
    """A row a question: score, access and whether it is decided, by method."""
    at = [F.max(F.when(F.col("method") == m, x)).alias(f"{n}{m}") for m in METHODS for n, x in (("a", F.col("score")), ("c", F.coalesce("access_ann", F.lit(False)).cast("int")), ("u", F.coalesce(F.col("verdict") == "uncertain", F.lit(False))))]
    return met.groupBy(unit, "cluster", "feasible").agg(*at)


def contrasts() -> dict[str, Column]:
    """The differences between methods, each null where a question is not in it."""
    a, c = (lambda m: F.col(f"`a{m}`")), (lambda m: F.col(f"`c{m}`"))
    return {
        "R2-R1": a("R2") - a("R1"), "R*-R1 feasible": F.when(F.col("feasible"), a("R*") - a("R1")), "access R2-R1 feasible": F.when(F.col("feasible"), c("R2") - c("R1")),
        "R2-R0": a("R2") - a("R0"), "R2-R1 decided": F.when(~F.col("uR1") & ~F.col("uR2"), a("R2") - a("R1")),
    }


def method_contrasts(met: DataFrame, unit: str, draws: int = 2000, seed: int = 43) -> DataFrame:
    """A row a contrast: estimate, interval, gains, losses, net, clusters with gains; all from one resampling."""
    wide, values = side_by_side(met, unit), contrasts()
    found = resampled(wide, "cluster", values, draws, seed)
    long = wide.select("cluster", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("x")) for n, v in values.items()])).alias("v")).select("cluster", "v.*")
    tallies = long.groupBy("name").agg(F.count_if(F.col("x") > 0).alias("gains"), F.count_if(F.col("x") < 0).alias("losses"), F.countDistinct(F.when(F.col("x") > 0, F.col("cluster"))).alias("gain_clusters"))
    return found.join(tallies, "name").withColumn("net", F.col("gains") - F.col("losses"))


def method_report(met: DataFrame, unit: str, draws: int = 2000, seed: int = 43) -> DataFrame:
    """One row: feasible space, token gap, budget violations and the gates on all of them."""
    n = met.agg(
        F.countDistinct(unit).alias("n_planned"), F.countDistinct(F.when(F.col("feasible"), F.col(unit))).alias("n_feasible"), F.countDistinct(F.when(F.col("feasible"), F.col("cluster"))).alias("feasible_clusters"),
        F.countDistinct(F.when(F.col("feasible").isNull(), F.col(unit))).alias("n_unknown_feasibility"),
        *[F.avg(F.when(F.col("method") == m, F.col("logical_tokens"))).alias(f"t{m}") for m in ("R1", "R2")],
        (F.count_if(F.col("method").isin("R1", "R2") & F.col("logical_tokens").isNull()) == 0).alias("all_known"),
        F.count_if((F.coalesce("logical_tokens", F.lit(0.0)) > 12288) | (F.coalesce("logical_calls", F.lit(0.0)) > F.when(F.col("method").isin("R1", "R2"), 2).otherwise(1))).alias("budget_violations"),
    ).withColumn("cost_complete", F.col("all_known") & (F.col("n_planned") > 0))
    rows = method_contrasts(met, unit, draws, seed).select("name", F.struct("estimate", "low", "net", "gain_clusters", "positive").alias("x"))
    wide = rows.groupBy(F.lit(1).alias("one")).pivot("name", list(contrasts())).agg(F.first("x")).drop("one")
    out = n.join(F.broadcast(wide), how="left", on=F.lit(True))  # one row each
    x = lambda name, field: F.col(f"`{name}`.{field}")
    gap = F.when(F.col("cost_complete") & (F.col("tR1") != 0) & (F.col("tR2") != 0), F.abs(F.col("tR2") - F.col("tR1")) / F.least("tR1", "tR2"))
    space = (F.col("n_feasible") >= 24) & (F.col("feasible_clusters") >= 8) & (x("R*-R1 feasible", "estimate") >= 0.1) & (x("R*-R1 feasible", "net") >= 4)
    signal = (x("R2-R1", "estimate") >= 0.05) & (x("R2-R1", "net") >= 4) & (x("R2-R1", "gain_clusters") >= 3) & (x("access R2-R1 feasible", "estimate") >= 0.1) & (x("R2-R0", "estimate") >= -0.02)
    sure = lambda v: F.coalesce(v, F.lit(False))
    return out.select(
        "n_planned", "n_feasible", "feasible_clusters", "n_unknown_feasibility", "cost_complete", "budget_violations", gap.alias("token_gap"), sure(gap <= 0.05).alias("token_fairness"),
        sure(space).alias("read_space"), sure(signal).alias("combination_signal"), sure(x("R2-R1", "positive")).alias("interval_positive"),
    )
