"""Evaluation over planned denominators: outer joins, rates, pairs, clusters, scenarios, gates."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SUCCESS


def planned_outer(planned: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every planned row with its result; one without is there as status "missing", verdict null and
    no legal citations. Unplanned and repeated results are what unplanned() and repeated() give."""
    out = planned.join(rows, keys, "left")
    filled = {"status": F.coalesce("status", F.lit("missing"))}
    if "citations_legal" in rows.columns:
        filled["citations_legal"] = F.coalesce("citations_legal", F.lit(False))
    return out.withColumns(filled)


def planned_results(planned: DataFrame, rows: DataFrame, keys: list[str], same: list[str] | None = None) -> DataFrame:
    """planned_outer(), or an error at a result that is not planned, that repeats a key, or whose columns
    `same` disagree with the plan's."""
    same = same or []
    once = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_there", F.lit(True))
    once = once.withColumnsRenamed({c: f"_{c}" for c in same})
    met = planned.withColumn("_planned", F.lit(True)).join(once, keys, "full_outer")
    why = F.when(F.col("_planned").isNull(), "unplanned result").when(F.col("_n") > 1, "repeated result")
    for c in same:
        why = why.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), f"result disagrees on {c}")
    met = met.where(F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean")))
    out = met.drop("_planned", "_n", "_there", *[f"_{c}" for c in same]).withColumn("status", F.coalesce("status", F.lit("missing")))
    return out.withColumn("citations_legal", F.coalesce("citations_legal", F.lit(False))) if "citations_legal" in rows.columns else out


def disagreeing(rows: DataFrame, unit: str, fields: list[str]) -> DataFrame:
    """unit, field: units whose rows know more than one value of a field (nulls are unknown)."""
    counts = rows.groupBy(unit).agg(*[F.countDistinct(f).alias(f) for f in fields])
    return counts.select(unit, F.explode(F.filter(F.array(*[F.when(F.col(f) > 1, f) for f in fields]), lambda x: x.isNotNull())).alias("field"))


def micro_macro(rows: DataFrame, group: str, unit: str, value: str) -> DataFrame:
    """group, micro (the mean over rows), macro (the mean over units of their means), n, n_units."""
    units = rows.groupBy(group, unit).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("k"))
    return units.groupBy(group).agg(F.try_divide(F.sum("s"), F.sum("k")).alias("micro"), F.avg("m").alias("macro"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_units"))


def method_gates(rows: DataFrame, unit: str, cluster: str) -> DataFrame:
    """One row on R2 against R1 (and R0): the difference and its gates, and whether the tokens are fair.
    rows: (unit, cluster, method, score, known, tokens), a row a planned unit and method; costs are
    complete if every row of R1 and R2 is known."""
    wide = rows.groupBy(unit, cluster).pivot("method", ["R0", "R1", "R2"]).agg(F.max("score")).withColumn("d", F.col("R2") - F.col("R1"))
    g = wide.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("difference"), F.avg(F.col("R2") - F.col("R0")).alias("less_r0"), F.sum("d").alias("net"), F.countDistinct(F.when(F.col("d") > 0, F.col(cluster))).alias("gain_clusters"))
    mean = lambda m: F.avg(F.when(F.col("method") == m, F.col("tokens")))
    k = rows.agg(mean("R1").alias("a"), mean("R2").alias("b"), (F.count_if(~F.col("known") & F.col("method").isin("R1", "R2")) == 0).alias("cost_complete"))
    gap = F.try_divide(F.abs(F.col("a") - F.col("b")), F.least("a", "b"))
    signal = (F.col("difference") >= 0.05) & (F.col("net") >= 4) & (F.col("gain_clusters") >= 3) & (F.col("less_r0") >= -0.02)
    met = g.join(F.broadcast(k))  # one row each
    return met.select("n", F.round("difference", 9).alias("difference"), "net", "gain_clusters", F.round(gap, 9).alias("token_gap"), "cost_complete", signal.alias("signal"), (F.col("cost_complete") & (gap <= 0.05)).alias("token_fairness"))


def unplanned(planned: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(planned, keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that only one side has, with the side."""
    l, r = left.select(*keys).distinct().withColumn("in_left", F.lit(True)), right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    out = l.join(r, keys, "full_outer").where("in_left is null or in_right is null")
    return out.select(*keys, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("only_in"))


def condition_summary(rows: DataFrame, by: list[str], score: Column) -> DataFrame:
    """Counts and rates over the planned rows of each condition; rates of nothing are null."""
    s, unclear = score, F.coalesce(F.col("verdict") == "uncertain", F.lit(False))
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("n_planned"), F.sum(s).alias("n_correct"), F.avg(s).alias("accuracy"),
        F.count_if(F.col("status").isin(*SUCCESS)).alias("n_success"), F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.count_if(unclear).alias("n_uncertain"), F.try_divide(F.count_if(unclear), n).alias("uncertain_rate"),
        F.avg(F.when(~unclear, s)).alias("accuracy_decided"), F.count_if(~unclear).alias("n_decided"),
    )


def paired(scores: DataFrame, unit: str, cluster: str, left: str, right: str) -> DataFrame:
    """One row: n, gains, losses, net, clusters of gains, mean difference. scores: (unit, cluster,
    method, score), a row a unit and method."""
    wide = scores.groupBy(unit, cluster).pivot("method", [left, right]).agg(F.max("score"))
    both = wide.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("d", F.col(left) - F.col(right))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("gains"), F.count_if(F.col("d") < 0).alias("losses"),
        F.sum("d").alias("net"), F.countDistinct(F.when(F.col("d") > 0, F.col(cluster))).alias("gain_clusters"), F.avg("d").alias("mean_difference"),
    )


def cluster_sums(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    return rows.groupBy(cluster).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def bootstrap_hash(clusters: DataFrame, cluster: str, draws: int, seed: int = 43) -> DataFrame:
    """draw, estimate: weighted means of clusters drawn with replacement, the draw by arithmetic on
    (draw, slot), so that any engine repeats it. clusters: cluster_sums()'s rows, which are few."""
    at = Window.orderBy(cluster)
    indexed = clusters.withColumn("at", F.row_number().over(at) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    slots = indexed.select(F.col("at").alias("slot"), "all").join(F.broadcast(clusters.sparkSession.range(draws).withColumnRenamed("id", "draw")))
    z = (F.col("draw") * 48271 + F.col("slot") * 69621 + seed) % 2147483647
    for m in (48271, 69621):
        z = (z * m) % 2147483647
    picked = slots.select("draw", (z % F.col("all")).alias("at")).groupBy("draw", "at").agg(F.count(F.lit(1)).alias("times"))
    met = picked.join(indexed.select("at", "total", "n"), "at")
    return met.groupBy("draw").agg((F.sum(F.col("total") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("estimate"))


def interval95(draws: DataFrame, value: str = "estimate") -> DataFrame:
    return draws.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.count(F.lit(1)).alias("draws"))


def bootstrap_twister(clusters: DataFrame, cluster: str, draws: int = 2000, seed: int = 43) -> DataFrame:
    """estimate, low, high, n_clusters with Python's Mersenne twister, clusters in ascending order. The
    generator is one sequence, so one task draws; it gets two numbers a cluster, not the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        total, n = pdf["total"].to_numpy(float), pdf["n"].to_numpy(float)
        rng = random.Random(seed)
        found = np.empty(draws)
        for d in range(draws):
            at = [rng.randrange(len(total)) for _ in range(len(total))]
            found[d] = total[at].sum() / n[at].sum()
        low, high = np.quantile(found, [0.025, 0.975])
        return pd.DataFrame({"estimate": [total.sum() / n.sum()], "low": [low], "high": [high], "n_clusters": [len(total)]})

    return clusters.select(cluster, "total", "n").groupBy().applyInPandas(run, "estimate double, low double, high double, n_clusters long")


def scenarios(rows: DataFrame, groups: DataFrame, unit: str, score: str, k: int) -> DataFrame:
    """assignment, mean_score for all 2**k ways of setting the scores of k conflict groups to 0 or 1.

    groups: (unit, g) with g in 0..k-1, k up to 20. Only sums by group meet the assignments: k + 1 rows.
    """
    if not 0 <= k <= 20:  # what is broadcast has 2**k rows
        raise ValueError("scenarios takes 20 groups at most")
    own = rows.join(groups, unit, "left")
    sums = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"))
    cases = rows.sparkSession.range(1 << k).withColumnRenamed("id", "assignment")
    met = sums.join(F.broadcast(cases))
    bit = F.expr("cast(shiftright(assignment, cast(coalesce(g, 0) as int)) & 1 as long)")
    value = F.when(F.col("g").isNull(), F.col("s")).otherwise(bit * F.col("n"))
    return met.groupBy("assignment").agg((F.sum(value) / F.sum("n")).alias("mean_score"))


def conflicts(rows: DataFrame, text: Column, attribute: str) -> DataFrame:
    """text_hash, n, n_values of texts that occur twice or more; conflicting if n_values > 1."""
    return rows.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(attribute).alias("n_values")).where("n > 1")


def attempts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def admitted(rows: DataFrame, key: str, order: list[str], cost: str, cap: int, calls: int) -> DataFrame:
    """Adds ok and spent: requests in order are admitted while calls and cost stay within the caps; a
    refused one adds nothing, so this is a fold by key, not a running sum. Keys come sorted from Spark
    and pass through in batches; a key's state is two numbers."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n = object(), 0, 0
        for batch in batches:
            ok, spent = [], []
            for own, c in zip(batch.column(key).to_pylist(), batch.column(cost).to_pylist(), strict=True):
                if own != now:
                    now, used, n = own, 0, 0
                yes = n < calls and used + c <= cap
                used, n = used + c * yes, n + yes
                ok.append(yes)
                spent.append(used)
            yield pa.record_batch([*batch.columns, pa.array(ok, pa.bool_()), pa.array(spent, pa.int64())], [*batch.schema.names, "ok", "spent"])

    ordered = rows.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(run, f"{fields}, ok boolean, spent long")


def reservoir(rows: DataFrame, key: str, order: str, item: str, k: int, seed: int = 17) -> DataFrame:
    """key, slot, item, seen: Algorithm R over each key's items in order, with Python's generator.

    Groups come sorted from Spark and pass through in batches, so memory holds k items a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, seen, rng = None, [], 0, random.Random(seed)

        def out() -> pa.RecordBatch:
            n = len(slots)
            return pa.record_batch([pa.array([now] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(slots, pa.int64()), pa.array([seen] * n, pa.int64())], ["key", "slot", "item", "seen"])

        for batch in batches:
            for own, it in zip(batch.column("key").to_pylist(), batch.column("item").to_pylist(), strict=True):
                if own != now:
                    if slots:
                        yield out()
                    now, slots, seen, rng = own, [], 0, random.Random(seed)
                seen += 1
                if len(slots) < k:
                    slots.append(it)
                elif (at := rng.randrange(seen)) < k:
                    slots[at] = it
        if slots:
            yield out()

    ordered = rows.select(F.col(key).cast("long").alias("key"), F.col(order).alias("o"), F.col(item).cast("long").alias("item"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "o", "item").select("key", "item")
    return ordered.mapInArrow(run, "key long, slot int, item long, seen long")
