"""Queries of whole evaluations: interventions and retrieval methods, orders as questions and their lines as results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import experiments as ex
from ..operators import retrieval as rt
from ..session import settled, table
from .catalogue import POOL, RESULTS, asked, dim_of, query, vectors

DRAWS = 500


def rounded(df, names):
    """Means and intervals to nine places, so that the order of sums doesn't show."""
    return df.withColumns({c: F.round(c, 9) for c in names})


def sql_rounded(names: list[str]) -> str:
    return f"* REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in names)})"


REPORT = ["paired_full_accuracy", "mean_delta_key", "mean_delta_irrel", "d", "d_low", "d_high", "d_decided", "full_minus_blind", "full_minus_blind_low", "full_minus_blind_high"]
BOUNDS = ["estimate", "low", "high"]
ROWS = f"""
{RESULTS},
rs AS (SELECT l_orderkey AS q, l_linenumber AS ln, CASE m[6] WHEN 'F' THEN 'complete' ELSE 'failed' END AS status, CASE m[5] WHEN 'A' THEN 'correct' WHEN 'R' THEN 'incorrect' ELSE 'uncertain' END AS verdict, m[4]::DOUBLE AS qty FROM u)"""


def lines(spark, sf_dir):
    """q, ln, status, verdict, qty: of repeated lines the least by price and keys."""
    cols = ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ln")).agg(F.min(F.struct(*cols)).alias("m"))
    verdict = F.when(F.col("m.l_returnflag") == "A", "correct").when(F.col("m.l_returnflag") == "R", "incorrect").otherwise("uncertain")
    status = F.when(F.col("m.l_linestatus") == "F", "complete").otherwise("failed")
    return one.select("q", "ln", status.alias("status"), verdict.alias("verdict"), F.col("m.l_quantity").cast("double").alias("qty"))


def drawn(clusters: str, stats: list[str], source: str) -> str:
    """CTEs: `source` (one row a unit: cluster and values) resampled; es holds name, draw, estimate, and pt the plain ones."""
    sums = ", ".join(f"coalesce(sum({s}), 0)::DOUBLE AS t{k}, count({s}) AS n{k}" for k, s in enumerate(stats))
    weighted = ", ".join(f"sum(w * t{k}) AS t{k}, sum(w * n{k}) AS n{k}" for k in range(len(stats)))
    union = " UNION ALL ".join(f"SELECT {k} AS k, draw, t{k} / nullif(n{k}, 0) AS estimate FROM wd" for k in range(len(stats)))
    plain = " UNION ALL ".join(f"SELECT {k} AS k, sum(t{k}) / nullif(sum(n{k}), 0) AS estimate, sum(n{k})::BIGINT AS n, count_if(n{k} > 0)::BIGINT AS n_clusters FROM cx" for k in range(len(stats)))
    return f"""
cx AS MATERIALIZED (SELECT {clusters} AS cluster, {sums} FROM {source} GROUP BY ALL),
cd AS (SELECT draw, cx.* FROM cx, range({DRAWS}) d(draw)),
ww AS ({ex.weight_sql("draw", "cluster", 43).replace("{source}", "cd")}),
wd AS MATERIALIZED (SELECT draw, {weighted} FROM ww GROUP BY draw),
es AS MATERIALIZED (SELECT k, quantile_cont(estimate, 0.025) AS low, quantile_cont(estimate, 0.975) AS high FROM ({union}) GROUP BY k),
pt AS MATERIALIZED ({plain})"""


# Interventions: conditions by line

PAIRS = f"""
{ROWS},
pc AS (SELECT o_orderkey AS q, o_custkey AS cluster, o_custkey % 4 AS m, o_orderkey % 7 <> 0 AS iv, CASE WHEN o_orderkey % 14 = 0 THEN 'hidden_copy_in_retained_group' END AS why,
  unnest(list_concat(['Full', 'Irrel-1', 'Irrel-2', 'Blind'], list_transform(range(1, o_custkey % 4 + 1), lambda i: 'Key-' || i))) AS condition FROM orders),
rw AS (SELECT q, CASE ln WHEN 1 THEN 'Full' WHEN 2 THEN 'Irrel-1' WHEN 3 THEN 'Irrel-2' WHEN 4 THEN 'Blind' ELSE 'Key-' || (ln - 4) END AS condition, status, verdict, qty > 10 AS legal, qty <> 13 AS parse_ok, qty = 17 AS truncated FROM rs),
mt AS (SELECT pc.*, coalesce(status, 'missing') AS status, verdict, coalesce(legal, false) AS legal, NOT coalesce(parse_ok, true) OR coalesce(truncated, false) AS broken,
  CASE WHEN status = 'complete' AND verdict = 'correct' AND parse_ok AND NOT truncated THEN 1 ELSE 0 END AS score FROM pc LEFT JOIN rw ON rw.q = pc.q AND rw.condition = pc.condition),
pg AS (SELECT q, cluster, m, iv, why, max(score) FILTER (condition = 'Full') AS f, max(score) FILTER (condition = 'Blind') AS b, avg(score) FILTER (condition LIKE 'Key-%') AS ks, avg(score) FILTER (condition LIKE 'Irrel-%') AS ir,
  count_if(condition LIKE 'Key-%' AND score = 0) AS zeros, bool_and(status = 'complete' AND NOT broken) AS done, bool_and(coalesce(verdict IN ('correct', 'incorrect'), false)) AS decided, bool_and(legal) AS legal,
  bool_or(coalesce(verdict = 'uncertain', false)) AS unsure, bool_or(broken) AS broken, coalesce(list_sort(list_distinct(list(CASE WHEN status = 'missing' THEN 'missing_final_logical_result' ELSE status END) FILTER (status <> 'complete'))), []) AS bad FROM mt GROUP BY ALL),
pv AS (SELECT *, m >= 2 AND iv AND done AS valid, m >= 2 AND iv AND done AND f = 1 AND b = 0 AND ir = 1 AND zeros >= 2 AND decided AND legal AS candidate FROM pg),
pr AS MATERIALIZED (SELECT q, cluster, m AS num_gold_groups, m >= 2 AND iv AS construction_available, valid AS valid_pair,
  list_concat(CASE WHEN m < 2 THEN ['fewer_than_two_event_groups'] ELSE [] END, CASE WHEN NOT iv THEN [coalesce(why, 'intervention_not_validated')] ELSE [] END, CASE WHEN NOT done THEN bad ELSE [] END, CASE WHEN NOT done AND broken THEN ['parse_failure_or_truncation'] ELSE [] END) AS invalid_reasons,
  f AS full_score, CASE WHEN valid THEN f - ks END AS delta_key, CASE WHEN valid THEN f - ir END AS delta_irrel, CASE WHEN valid THEN ir - ks END AS d, CASE WHEN valid THEN f - b END AS full_minus_blind, candidate, unsure AS any_uncertain,
  candidate AND q % 3 = 0 AND cluster % 2 = 0 AND q % 5 <> 0 AS confirmed,
  CASE WHEN candidate AND q % 3 = 0 AND cluster % 2 = 0 AND q % 5 <> 0 THEN 'human_confirmed' WHEN q % 3 <> 0 THEN 'pending' ELSE 'reviewed_unconfirmed' END AS audit_status FROM pv)"""


def pairs(spark, sf_dir):
    q, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    planned = orders.select(q.alias("q"), c.alias("cluster"), (c % 4).alias("m"), (q % 7 != 0).alias("intervention_valid"), F.when(q % 14 == 0, "hidden_copy_in_retained_group").alias("invalid_reason"))
    name = F.when(F.col("ln") == 1, "Full").when(F.col("ln") == 2, "Irrel-1").when(F.col("ln") == 3, "Irrel-2").when(F.col("ln") == 4, "Blind").otherwise(F.concat(F.lit("Key-"), (F.col("ln") - 4).cast("string")))
    rows = lines(spark, sf_dir).join(planned.select("q", "m"), "q").where("ln <= 4 + m")
    rows = rows.select("q", name.alias("condition"), "status", "verdict", (F.col("qty") > 10).alias("citations_legal"), (F.col("qty") != 13).alias("parse_ok"), (F.col("qty") == 17).alias("truncated"))
    checks = [(q % 5 != 0 if x == "reference_valid" else F.lit(True)).alias(x) for x in ex.CHECKS]
    audits = orders.where(q % 3 == 0).select(q.alias("q"), F.when(c % 2 == 0, "human").otherwise("model").alias("reviewer_type"), *checks)
    return ex.pair_report(planned, rows, "q", audits)


@query(f"WITH {PAIRS} SELECT * FROM pr")
def pair_reports(spark, sf_dir):
    """Each question's intervention with up to three Keys: whether it counts, why not, its differences, its review."""
    return pairs(spark, sf_dir)


@query(f"""
WITH {PAIRS}, pd AS (SELECT *, CASE WHEN valid_pair AND NOT any_uncertain THEN d END AS dd FROM pr), {drawn("cluster", ["d", "dd", "full_minus_blind"], "pd")},
n AS (SELECT count(*) AS n_planned, count_if(construction_available)::BIGINT AS n_available, count(DISTINCT CASE WHEN construction_available THEN cluster END) AS available_clusters, count_if(valid_pair)::BIGINT AS n_valid,
  count(DISTINCT CASE WHEN valid_pair THEN cluster END) AS valid_clusters, avg(full_score) FILTER (valid_pair) AS paired_full_accuracy, avg(delta_key) AS mean_delta_key, avg(delta_irrel) AS mean_delta_irrel,
  count_if(candidate)::BIGINT AS n_candidates, count_if(confirmed)::BIGINT AS n_confirmed, count(DISTINCT CASE WHEN confirmed THEN cluster END) AS confirmed_clusters FROM pr),
z AS (SELECT n.*, p0.estimate AS d, e0.low AS d_low, e0.high AS d_high, p1.estimate AS d_decided, p2.estimate AS full_minus_blind, e2.low AS full_minus_blind_low, e2.high AS full_minus_blind_high
  FROM n, (FROM pt WHERE k = 0) p0, (FROM es WHERE k = 0) e0, (FROM pt WHERE k = 1) p1, (FROM pt WHERE k = 2) p2, (FROM es WHERE k = 2) e2),
j AS (SELECT *, coalesce(d >= 0.15 AND n_confirmed >= greatest(12, ceil(0.15 * n_planned)) AND confirmed_clusters >= 6, false) AS joint_signal FROM z)
SELECT {sql_rounded(REPORT)}, n_available >= 60 AND available_clusters >= 15 AS standard_sample, n_valid >= 36 AND valid_clusters >= 10 AS valid_intervention_count, coalesce(paired_full_accuracy >= 0.6 AND full_minus_blind >= 0.15, false) AS consumer_visual_entry,
  joint_signal AND n_confirmed >= ceil(0.3 * n_planned) AS strong_joint_signal FROM j""")
def intervention_report(spark, sf_dir):
    return rounded(ex.intervention_report(settled(pairs(spark, sf_dir), "pairs"), DRAWS), REPORT)


# Methods: the first four lines

METHOD_ROWS = f"""
{ROWS},
mp AS (SELECT o_orderkey AS q, o_custkey AS cluster, unnest([1, 2, 3, 4]) AS ln FROM orders),
mr AS MATERIALIZED (SELECT mp.q, cluster, ['R0', 'R1', 'R2', 'R*'][mp.ln] AS method, coalesce(status, 'missing') AS status, verdict, coalesce(qty > 10, false) AS legal, coalesce(qty > 25, false) AS access, qty IS NULL AS unknown,
  max(CASE WHEN qty IS NOT NULL THEN CASE cluster % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END END) OVER (PARTITION BY mp.q) AS feasible, mp.q % 700 + qty AS tokens, CASE WHEN qty = 50 THEN 2 WHEN qty IS NOT NULL THEN 1 END AS calls, qty / 10 AS latency,
  CASE WHEN status = 'complete' AND verdict = 'correct' THEN 1 ELSE 0 END AS score FROM mp LEFT JOIN rs ON rs.q = mp.q AND rs.ln = mp.ln),
sd AS (SELECT q, cluster, feasible, max(score) FILTER (method = 'R0') AS a0, max(score) FILTER (method = 'R1') AS a1, max(score) FILTER (method = 'R2') AS a2, max(score) FILTER (method = 'R*') AS ax,
  max(access::INT) FILTER (method = 'R1') AS c1, max(access::INT) FILTER (method = 'R2') AS c2, bool_or(coalesce(verdict = 'uncertain', false)) FILTER (method IN ('R1', 'R2')) AS unsure FROM mr GROUP BY ALL),
cs AS MATERIALIZED (SELECT cluster, a2 - a1 AS v0, CASE WHEN feasible THEN ax - a1 END AS v1, CASE WHEN feasible THEN c2 - c1 END AS v2, a2 - a0 AS v3, CASE WHEN NOT unsure THEN a2 - a1 END AS v4 FROM sd)"""
CONTRASTS = f"""
{METHOD_ROWS}, {drawn("cluster", ["v0", "v1", "v2", "v3", "v4"], "cs")},
ta AS (SELECT k, count_if(v > 0)::BIGINT AS gains, count_if(v < 0)::BIGINT AS losses, count(DISTINCT CASE WHEN v > 0 THEN cluster END) AS gain_clusters FROM (SELECT cluster, unnest([v0, v1, v2, v3, v4]) AS v, unnest([0, 1, 2, 3, 4]) AS k FROM cs) GROUP BY k),
co AS MATERIALIZED (SELECT ['R2-R1', 'R*-R1 feasible', 'access R2-R1 feasible', 'R2-R0', 'R2-R1 decided'][pt.k + 1] AS name, estimate, low, high, coalesce(low > 0, false) AS positive, n, n_clusters, gains, losses, gain_clusters, gains - losses AS net
  FROM pt JOIN es ON es.k = pt.k JOIN ta ON ta.k = pt.k)"""


def method_rows(spark, sf_dir):
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("cluster"))
    method = F.element_at(F.array(*[F.lit(m) for m in ex.METHODS]), F.col("ln").cast("int"))
    met = lines(spark, sf_dir).where("ln <= 4").join(planned, "q")
    feasible = F.when(F.col("cluster") % 5 == 0, False).when(F.col("cluster") % 5 != 1, True)
    qty, calls = F.col("qty"), F.when(F.col("qty") == 50, 2).otherwise(1)
    rows = met.select(
        "q", method.alias("method"), "status", "verdict", (qty > 10).alias("citations_legal"), (qty > 25).alias("access_ann"), feasible.alias("feasible_ann"), (F.col("q") % 700 + qty).alias("logical_tokens"),
        calls.alias("logical_calls"), F.when(qty > 5, F.col("q") % 700 + qty).alias("physical_tokens"), calls.alias("physical_calls"), (qty / 10).alias("latency_s"),
    )
    return settled(ex.method_rows(planned, rows, "q"), "methods")


@query(f"""
WITH {METHOD_ROWS}
SELECT method, count(*) AS n_planned, sum(score)::BIGINT AS n_correct, avg(score) AS accuracy, count_if(status = 'complete')::BIGINT AS n_success, count_if(status = 'missing')::BIGINT AS n_missing, count_if(coalesce(verdict = 'uncertain', false))::BIGINT AS n_uncertain,
  count_if(coalesce(verdict = 'uncertain', false)) / count(*) AS uncertain_rate, avg(score) FILTER (verdict IS DISTINCT FROM 'uncertain') AS accuracy_decided, count_if(verdict IS DISTINCT FROM 'uncertain')::BIGINT AS n_decided,
  count_if(access)::BIGINT AS n_access_ann, avg(access::INT) AS access_ann, count_if(unknown)::BIGINT AS n_unknown_access_ann, avg(access::INT) FILTER (feasible) AS access_ann_feasible, count_if(coalesce(feasible, false))::BIGINT AS n_feasible_denominator,
  avg(score * (access AND legal)::INT) AS j_ann, count(tokens) AS n_known_costs, avg(tokens) AS mean_logical_tokens, sum(tokens)::DOUBLE AS total_logical_tokens_known, sum(calls)::DOUBLE AS total_logical_calls_known,
  coalesce(sum(tokens) FILTER (latency > 0.5), 0)::DOUBLE AS total_physical_tokens_known, sum(calls)::DOUBLE AS total_physical_calls_known, round(avg(latency), 9) AS mean_latency_s_known FROM mr GROUP BY method""")
def method_table(spark, sf_dir):
    return rounded(ex.method_table(method_rows(spark, sf_dir)), ["mean_latency_s_known"])


@query(f"WITH {CONTRASTS} SELECT {sql_rounded(BOUNDS)} FROM co")
def method_contrasts(spark, sf_dir):
    """Five differences of methods with intervals from one resampling."""
    return rounded(ex.method_contrasts(method_rows(spark, sf_dir), "q", DRAWS), BOUNDS)


@query(f"""
WITH {CONTRASTS},
n AS (SELECT count(DISTINCT q) AS n_planned, count(DISTINCT CASE WHEN feasible THEN q END) AS n_feasible, count(DISTINCT CASE WHEN feasible THEN cluster END) AS feasible_clusters, count(DISTINCT CASE WHEN feasible IS NULL THEN q END) AS n_unknown_feasibility,
  avg(tokens) FILTER (method = 'R1') AS t1, avg(tokens) FILTER (method = 'R2') AS t2, count_if(method IN ('R1', 'R2') AND tokens IS NULL) = 0 AND count(*) > 0 AS cost_complete,
  count_if(coalesce(tokens, 0) > 12288 OR coalesce(calls, 0) > CASE WHEN method IN ('R1', 'R2') THEN 2 ELSE 1 END)::BIGINT AS budget_violations FROM mr),
g AS (SELECT *, CASE WHEN cost_complete AND t1 <> 0 AND t2 <> 0 THEN round(abs(t2 - t1) / least(t1, t2), 9) END AS token_gap FROM n)
SELECT n_planned, n_feasible, feasible_clusters, n_unknown_feasibility, cost_complete, budget_violations, token_gap, coalesce(token_gap <= 0.05, false) AS token_fairness,
  n_feasible >= 24 AND feasible_clusters >= 8 AND sp.estimate >= 0.1 AND sp.net >= 4 AS read_space, m.estimate >= 0.05 AND m.net >= 4 AND m.gain_clusters >= 3 AND ac.estimate >= 0.1 AND z.estimate >= -0.02 AS combination_signal, m.positive AS interval_positive
FROM g, (FROM co WHERE name = 'R2-R1') m, (FROM co WHERE name = 'R*-R1 feasible') sp, (FROM co WHERE name = 'access R2-R1 feasible') ac, (FROM co WHERE name = 'R2-R0') z""")
def method_report(spark, sf_dir):
    return rounded(ex.method_report(method_rows(spark, sf_dir), "q", DRAWS), ["token_gap"])


@query(f"""
WITH {METHOD_ROWS}, {drawn("cluster", ["v0"], "cs")}, k AS (SELECT avg(tokens) FILTER (method = 'R1') AS a, avg(tokens) FILTER (method = 'R2') AS b, count_if(unknown AND method IN ('R1', 'R2')) = 0 AS complete FROM mr),
g AS (SELECT count(*) AS n, avg(v0) AS difference, avg(v3) AS less_r0, sum(v0)::BIGINT AS net, count(DISTINCT CASE WHEN v0 > 0 THEN cluster END) AS gain_clusters FROM cs)
SELECT n, round(difference, 9) AS difference, net, gain_clusters, round(abs(a - b) / least(a, b), 9) AS token_gap, complete AS cost_complete, difference >= 0.05 AND net >= 4 AND gain_clusters >= 3 AND less_r0 >= -0.02 AS signal,
  complete AND abs(a - b) / least(a, b) <= 0.05 AS token_fairness, (SELECT coalesce(low > 0, false) FROM es) AS interval_positive FROM g, k""")
def method_gates(spark, sf_dir):
    """R2 against R1, with the interval of that very difference."""
    rows = method_rows(spark, sf_dir)
    gates = ev.method_gates(rows.select("q", "cluster", "method", "score", (F.col("status") != "missing").alias("known"), F.col("logical_tokens").alias("tokens")), "q", "cluster")
    found = ex.resampled(ex.side_by_side(rows, "q"), "cluster", {"R2-R1": ex.contrasts()["R2-R1"]}, DRAWS).select(F.col("positive").alias("interval_positive"))
    return gates.join(F.broadcast(found))  # one row each


# Questions: the ids divisible by 100; a question's gaps are itself and the id 50 behind it

GAPS = POOL.replace("FROM n WHERE rank <= 6)", "FROM n2 WHERE rank <= 6)").replace(
    "g AS (SELECT DISTINCT",
    """in3 AS MATERIALIZED (SELECT query_id, item_id, rank FROM n WHERE query_id % 100 = 0 AND rank <= 3),
n2 AS MATERIALIZED (SELECT n.query_id, n.item_id, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank) AS rank FROM n WHERE NOT EXISTS (SELECT 1 FROM in3 WHERE in3.query_id // 100 = n.query_id // 100 AND in3.item_id = n.item_id)),
g AS (SELECT DISTINCT""",
)
MASK = "(CASE WHEN e.label = a.label THEN 1 ELSE 0 END | CASE WHEN e.label = (a.label + 3) % 10 THEN 2 ELSE 0 END | CASE WHEN e.label = (a.label + 6) % 10 THEN 4 ELSE 0 END)"


@query(f"""
WITH {GAPS},
mk AS MATERIALIZED (SELECT query_id AS q, item_id, rank, {MASK} AS mask FROM n JOIN embeddings e ON e.vec_id = item_id JOIN embeddings a ON a.vec_id = query_id WHERE query_id % 100 = 0 AND rank <= 32),
c1 AS MATERIALIZED (SELECT q, mask, min(item_id) AS id FROM mk WHERE mask > 0 GROUP BY ALL),
s0 AS (SELECT DISTINCT q, []::BIGINT[] AS ids, 0 AS mask FROM mk),
s1 AS (SELECT q, [id] AS ids, mask FROM c1),
s2 AS MATERIALIZED (SELECT s.q, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s1 s JOIN c1 c ON s.q = c.q AND id > ids[-1]),
s3 AS MATERIALIZED (SELECT s.q, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s2 s JOIN c1 c ON s.q = c.q AND id > ids[-1]),
bc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bit_count(mask) DESC, len(ids), ids) AS r FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2 UNION ALL FROM s3)) WHERE r = 1),
fl AS (SELECT bc.q, mk.item_id, row_number() OVER (PARTITION BY bc.q ORDER BY mk.rank) AS r FROM bc JOIN mk ON mk.q = bc.q AND NOT list_contains(bc.ids, mk.item_id)),
ml AS (SELECT 'R0' AS method, query_id AS q, list(item_id ORDER BY rank) AS ids FROM n WHERE query_id % 100 = 0 AND rank <= 6 GROUP BY ALL
  UNION ALL SELECT 'R1', q, list(item_id ORDER BY rank) FROM (SELECT query_id AS q, item_id, rank FROM in3 UNION ALL SELECT query_id - 50, item_id, rank + 3 FROM n2 WHERE query_id % 100 = 50 AND rank <= 3) GROUP BY q
  UNION ALL SELECT 'R2', i.q, list_concat(i.ids, o.ids) FROM (SELECT query_id AS q, list(item_id ORDER BY rank) AS ids FROM in3 GROUP BY q) i
    JOIN (SELECT group_id * 100 AS q, ids, row_number() OVER (PARTITION BY group_id ORDER BY cover - 0.2 * red DESC, ids) AS r FROM t) o ON o.q = i.q AND o.r = 1
  UNION ALL SELECT 'R*', bc.q, list_concat(any_value(bc.ids), coalesce(list(fl.item_id ORDER BY fl.r) FILTER (fl.r <= 6 - len(bc.ids)), [])) FROM bc LEFT JOIN fl ON fl.q = bc.q GROUP BY bc.q),
cv AS (SELECT method, q, bit_or({MASK}) AS covered FROM (SELECT method, q, unnest(ids) AS item_id FROM ml) x JOIN embeddings e ON e.vec_id = x.item_id JOIN embeddings a ON a.vec_id = x.q GROUP BY ALL)
SELECT ml.method, ml.q AS question, ml.ids, cv.covered::INT AS covered, cv.covered = 7 AS access FROM ml JOIN cv ON cv.method = ml.method AND cv.q = ml.q""")
def four_methods(spark, sf_dir):
    """R0, R1, R2 and R* side by side, and whether what each reads covers its question's three groups (labels)."""
    q = asked(spark, sf_dir)
    questions = q.where("id % 100 = 0")
    gaps = q.withColumn("question", F.col("id") - F.col("id") % 100).join(questions.select(F.col("id").alias("question")), "question")
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")

    def masks(rows):
        met = rows.join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("e")), "item_id").join(labels.select(F.col("vec_id").alias("question"), F.col("label").alias("a")), "question")
        bits = [F.when(F.col("e") == (F.col("a") + 3 * j) % 10, 1 << j).otherwise(0) for j in range(3)]
        return met.select("question", *[c for c in rows.columns if c != "question"], bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("mask"))

    chosen = settled(rt.four_methods(vectors(spark, sf_dir), questions, gaps, masks, dim_of(spark, sf_dir), 3), "chosen")
    read = chosen.select("method", "question", F.explode("ids").alias("item_id"))
    covered = masks(read).groupBy("method", "question").agg(F.bit_or("mask").alias("covered"))
    return chosen.join(covered, ["method", "question"]).withColumn("access", F.col("covered") == 7)
