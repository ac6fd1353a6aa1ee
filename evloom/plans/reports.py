"""Queries on evaluation: paired interventions, methods side by side, ledgers, reviewers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from ..operators import intervals as iv
from ..session import table
from .catalogue import CAPSULES, GROUPS, RESULTS, T, daily, events, query, scored

# Lines 1 to 6 of an order stand for Full, Key-1, Key-2, Irrel-1, Irrel-2, Blind.

PAIRS = f"""
{RESULTS},
v AS (SELECT l_orderkey, o_custkey, list(score ORDER BY l_linenumber) AS s, bool_and(status = 'complete') AS valid FROM al WHERE l_linenumber <= 6 GROUP BY ALL),
dl AS (SELECT *, s[1] - (s[2] + s[3]) / 2.0::DOUBLE AS delta_key, s[1] - (s[4] + s[5]) / 2.0::DOUBLE AS delta_irrel, s[1] - s[6] AS full_minus_blind,
  valid AND s[1] = 1 AND s[6] = 0 AND s[4] = 1 AND s[5] = 1 AND s[2] = 0 AND s[3] = 0 AS candidate FROM v)"""


def deltas(spark, sf_dir):
    rows = scored(spark, sf_dir).where("l_linenumber <= 6")
    wide = rows.groupBy("l_orderkey", "o_custkey").agg(F.every(F.col("status") == "complete").alias("valid"), *[F.max(F.when(F.col("l_linenumber") == k, F.col("score"))).alias(f"s{k}") for k in range(1, 7)])
    s = [None, *[F.col(f"s{k}") for k in range(1, 7)]]
    candidate = F.col("valid") & (s[1] == 1) & (s[6] == 0) & (s[4] == 1) & (s[5] == 1) & (s[2] == 0) & (s[3] == 0)
    return wide.select("l_orderkey", "o_custkey", "valid", (s[1] - (s[2] + s[3]) / 2).alias("delta_key"), (s[1] - (s[4] + s[5]) / 2).alias("delta_irrel"), (s[1] - s[6]).alias("full_minus_blind"), candidate.alias("candidate"))


@query(f"WITH {PAIRS} SELECT l_orderkey, valid, delta_key, delta_irrel, delta_key - delta_irrel AS d, full_minus_blind, candidate FROM dl")
def intervention_deltas(spark, sf_dir):
    return deltas(spark, sf_dir).select("l_orderkey", "valid", "delta_key", "delta_irrel", (F.col("delta_key") - F.col("delta_irrel")).alias("d"), "full_minus_blind", "candidate")


@query(f"""
WITH {PAIRS} SELECT count(*) AS planned, count_if(valid)::BIGINT AS valid_pairs, count(DISTINCT CASE WHEN valid THEN o_custkey END) AS clusters, avg(delta_key - delta_irrel) FILTER (valid) AS d,
  avg(full_minus_blind) FILTER (valid) AS full_minus_blind, count_if(candidate)::BIGINT AS candidates FROM dl""")
def intervention_summary(spark, sf_dir):
    ok = F.col("valid")
    return deltas(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(ok).alias("valid_pairs"), F.countDistinct(F.when(ok, F.col("o_custkey"))).alias("clusters"),
        F.avg(F.when(ok, F.col("delta_key") - F.col("delta_irrel"))).alias("d"), F.avg(F.when(ok, F.col("full_minus_blind"))).alias("full_minus_blind"), F.count_if("candidate").alias("candidates"),
    )


@query(f"""
WITH {RESULTS}, me AS (SELECT *, ['R0', 'R1', 'R2', 'R*'][l_linenumber] AS method, status <> 'missing' AS feasible FROM al WHERE l_linenumber <= 4),
w AS (SELECT l_orderkey, o_custkey, max(score) FILTER (method = 'R2') - max(score) FILTER (method = 'R1') AS d FROM me GROUP BY ALL),
g AS (SELECT count_if(d > 0)::BIGINT AS gains, count_if(d < 0)::BIGINT AS losses, avg(d) AS difference, count(DISTINCT CASE WHEN d > 0 THEN o_custkey END) AS gain_clusters FROM w)
SELECT method, count(*) AS n_planned, avg(score) AS accuracy, avg(score * citations_legal::INT) AS joint, avg(score) FILTER (feasible) AS feasible_accuracy, any_value(gains) AS gains, any_value(losses) AS losses,
  any_value(difference) AS r2_less_r1, any_value(gain_clusters) AS gain_clusters FROM me, g GROUP BY method""")
def methods_side_by_side(spark, sf_dir):
    method = F.element_at(F.array(*[F.lit(m) for m in ("R0", "R1", "R2", "R*")]), F.col("l_linenumber"))
    rows = scored(spark, sf_dir).where("l_linenumber <= 4").withColumn("method", method).withColumn("feasible", F.col("status") != "missing")
    wide = rows.groupBy("l_orderkey", "o_custkey").pivot("method", ["R1", "R2"]).agg(F.max("score")).withColumn("d", F.col("R2") - F.col("R1"))
    tally = wide.agg(F.count_if(F.col("d") > 0).alias("gains"), F.count_if(F.col("d") < 0).alias("losses"), F.avg("d").alias("r2_less_r1"), F.countDistinct(F.when(F.col("d") > 0, F.col("o_custkey"))).alias("gain_clusters"))
    table_ = rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_planned"), F.avg("score").alias("accuracy"), F.avg(F.col("score") * F.col("citations_legal").cast("int")).alias("joint"), F.avg(F.when(F.col("feasible"), F.col("score"))).alias("feasible_accuracy")
    )
    return table_.join(F.broadcast(tally))  # one row


@query("""
WITH e AS (SELECT CASE WHEN l_linenumber = 7 THEN 'E3' WHEN l_linenumber > 3 THEN 'E2' ELSE 'E1' END AS phase, l_partkey + CASE WHEN l_returnflag = 'N' THEN 500 ELSE l_suppkey END AS tokens, l_tax > 0.02 AS physical, l_returnflag = 'N' AS pending, l_suppkey > 500 AS violation FROM lineitem)
SELECT count(*) AS logical_calls, count_if(physical)::BIGINT AS physical_calls, count_if(physical AND phase <> 'E3')::BIGINT AS core_physical_calls, count_if(physical AND phase = 'E3')::BIGINT AS e3_physical_calls,
  sum(tokens)::BIGINT AS logical_tokens, (sum(tokens) FILTER (physical))::BIGINT AS physical_tokens, count_if(violation AND NOT pending)::BIGINT AS violations, count_if(pending)::BIGINT AS pending FROM e""")
def ledger_summary(spark, sf_dir):
    phase = F.when(F.col("l_linenumber") == 7, "E3").when(F.col("l_linenumber") > 3, "E2").otherwise("E1")
    pending = F.col("l_returnflag") == "N"
    e = table(spark, sf_dir, "lineitem").select(phase.alias("phase"), (F.col("l_partkey") + F.when(pending, 500).otherwise(F.col("l_suppkey"))).alias("tokens"), (F.col("l_tax") > 0.02).alias("physical"), pending.alias("pending"), (F.col("l_suppkey") > 500).alias("violation"))
    return e.agg(
        F.count(F.lit(1)).alias("logical_calls"), F.count_if("physical").alias("physical_calls"), F.count_if(F.col("physical") & (F.col("phase") != "E3")).alias("core_physical_calls"), F.count_if(F.col("physical") & (F.col("phase") == "E3")).alias("e3_physical_calls"),
        F.sum("tokens").alias("logical_tokens"), F.sum(F.when(F.col("physical"), F.col("tokens"))).alias("physical_tokens"), F.count_if(F.col("violation") & ~F.col("pending")).alias("violations"), F.count_if("pending").alias("pending"),
    )


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS a, max(l_returnflag) AS b FROM lineitem GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS n, count_if(a = b)::BIGINT AS agreed, count_if(a = b) / count(*) AS agreement FROM r""")
def reviewer_agreement(spark, sf_dir):
    """Repeated lines as reviews of one answer."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k"), F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b")).where("k > 1")
    same = F.count_if(F.col("a") == F.col("b"))
    return r.agg(F.count(F.lit(1)).alias("n"), same.alias("agreed"), F.try_divide(same, F.count(F.lit(1))).alias("agreement"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY user_id")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds")).withColumn("n_kinds", F.size("kinds").cast("long"))


@query(f"""
WITH {CAPSULES.replace("FROM events", "FROM events WHERE event_type <> 'purchase'")}, {GROUPS},
pt AS (SELECT DISTINCT user_id, idx, unnest(pts) AS t FROM p)
SELECT pt.user_id, j, min((t - s) / (e - s)) AS relative FROM pt JOIN gr ON pt.user_id = gr.user_id AND t >= s AND t < e GROUP BY ALL""")
def relative_position(spark, sf_dir):
    """Where in each group its first frame lies, from 0 to 1."""
    e = events(spark, sf_dir)
    merged = iv.merge(e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 43200).alias("e")), "user_id")
    order = Window.partitionBy("user_id").orderBy(F.desc(F.col("e") - F.col("s")), "s")
    groups = merged.withColumn("j", F.row_number().over(order) - 1).where("j < 4")
    caps = iv.capsules(e.where("event_type <> 'purchase'"), "user_id", "t", 86400.0)
    points = caps.select("user_id", F.explode("pts").alias("t")).where("t is not null").distinct()
    hit = points.join(groups, "user_id").where("t >= s and t < e")
    return hit.groupBy("user_id", "j").agg(F.min((F.col("t") - F.col("s")) / (F.col("e") - F.col("s"))).alias("relative"))


@query(f"WITH {CAPSULES}, u AS (SELECT user_id, count(*) AS n, count_if(n_frames >= 4)::BIGINT AS full_ FROM p GROUP BY user_id) SELECT sum(full_)::BIGINT AS full_windows, sum(n)::BIGINT AS windows, sum(full_) / sum(n) AS rate, CASE WHEN sum(full_) / sum(n) > 0.9 THEN 32 ELSE 64 END AS k FROM u")
def reservoir_size(spark, sf_dir):
    """The slots to hold: fewer where over nine tenths of the windows are full."""
    full = F.count_if(F.col("n_frames") >= 4)
    s = daily(spark, sf_dir).agg(full.alias("full_windows"), F.count(F.lit(1)).alias("windows"))
    rate = F.try_divide(F.col("full_windows"), F.col("windows"))
    return s.select("full_windows", "windows", rate.alias("rate"), F.when(rate > 0.9, 32).otherwise(64).alias("k"))


@query("""
WITH o AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('5:row:' || c_custkey), c_custkey) AS r FROM customer),
a AS (SELECT c_custkey FROM o WHERE r <= 2),
b AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('6:row:' || c_custkey), c_custkey) AS r FROM customer WHERE c_custkey NOT IN (FROM a))
SELECT c_custkey, 'nation' AS stratum FROM a UNION ALL SELECT c_custkey, 'segment' FROM b WHERE r <= 3""")
def sequential_strata(spark, sf_dir):
    """Two customers a nation, then three a market segment of those not yet taken."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    first = lambda df, by, seed, n: df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, F.lit("row"), F.col("c_custkey")), "c_custkey"))).where(F.col("r") <= n).select("c_custkey")
    a = first(c, "c_nationkey", 5, 2)
    b = first(c.join(a, "c_custkey", "left_anti"), "c_mktsegment", 6, 3)
    return a.withColumn("stratum", F.lit("nation")).unionByName(b.withColumn("stratum", F.lit("segment")))


@query(f"SELECT count(*) AS n, min(ts)::VARCHAR AS first_at, round(max({T}) - min({T}), 6) AS elapsed FROM events")
def elapsed(spark, sf_dir):
    e = events(spark, sf_dir)
    text = F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.agg(F.count(F.lit(1)).alias("n"), text.alias("first_at"), F.round(F.max("t") - F.min("t"), 6).alias("elapsed"))
