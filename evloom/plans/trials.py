"""Queries on trials: interventions, covers within a cap, retrieval methods, ledgers and their gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluation as ev
from ..operators import intervals as iv
from ..operators import ledger as lg
from ..operators import packages as pk
from ..operators import retrieval as rt
from ..session import settled, table
from .catalogue import COS, MASKS, ORACLE, RESULTS, T, asked, dim_of, events, masks, planned, query, results, scored, vectors

# Interventions: users' purchases close together as evidence, all their events as frames

_ROUND = """
t{k} AS (SELECT key, sum((hi - lo + 1) // 4) AS room FROM o{k} GROUP BY key),
p{k} AS (SELECT * FROM (SELECT c.key, c.run, a, b, {k} AS k, row_number() OVER (PARTITION BY c.key ORDER BY dev, tie, c.run, a, b) AS r FROM cb c JOIN o{k} o ON c.key = o.key AND c.run = o.run AND a >= lo AND b <= hi JOIN t{k} t ON t.key = c.key
  WHERE room - (hi - lo + 1) // 4 + (a - lo) // 4 + (hi - b) // 4 >= {still}) WHERE r = 1),
o{n} AS (SELECT o.key, o.run, lo, hi FROM o{k} o JOIN p{k} p ON p.key = o.key WHERE NOT (o.run = p.run AND a >= lo AND b <= hi)
  UNION ALL SELECT o.key, o.run, lo, a - 1 FROM o{k} o JOIN p{k} p ON p.key = o.key AND o.run = p.run AND a >= lo AND b <= hi WHERE a - lo >= 4
  UNION ALL SELECT o.key, o.run, b + 1, hi FROM o{k} o JOIN p{k} p ON p.key = o.key AND o.run = p.run AND a >= lo AND b <= hi WHERE hi - b >= 4)"""
_NAME = "substring(sha256('17:' || key || ':' || list_aggregate(list_transform(pts, lambda p: round(p * 1e6)::BIGINT::VARCHAR), 'string_agg', ',')), 1, 16)"
BUILT = f"""
ga AS (SELECT user_id, {T} AS s, {T} + 129600 AS e FROM events WHERE event_type = 'purchase' AND value >= 60),
gb AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM ga),
gc AS (SELECT *, sum(CASE WHEN ahead IS NULL OR s >= ahead THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM gb),
gd AS (SELECT user_id AS key, min(s) AS s, max(e) AS e FROM gc GROUP BY user_id, island),
gx AS (SELECT key, s, e, row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS grp, count(*) OVER (PARTITION BY key) AS m FROM gd),
pl AS (SELECT key, max(m) AS m, quantile_cont(e - s, 0.5) AS span FROM gx GROUP BY key),
fr AS (SELECT DISTINCT user_id AS key, {T} AS t FROM events),
fl AS (SELECT fr.key, t, grp FROM fr JOIN pl ON fr.key = pl.key LEFT JOIN gx ON gx.key = fr.key AND t >= s AND t < e),
gn AS (SELECT *, row_number() OVER (PARTITION BY key, grp ORDER BY t) AS r, count(*) OVER (PARTITION BY key, grp) AS n FROM fl WHERE grp IS NOT NULL),
gp AS (SELECT key, grp, max(n) AS n, list(t ORDER BY t) FILTER (n < 4 OR r IN (1, round((n - 1) / 3.0) + 1, round(2 * (n - 1) / 3.0) + 1, n)) AS pts FROM gn GROUP BY key, grp),
sh AS (SELECT gx.key, min(coalesce(n, 0)) AS least FROM gx LEFT JOIN gp ON gp.key = gx.key AND gp.grp = gx.grp GROUP BY gx.key),
fa AS (SELECT *, count(grp) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM fl),
fb AS (SELECT fa.key, run, t, t / span AS x, span, row_number() OVER (PARTITION BY fa.key, run ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY fa.key, run) AS n FROM fa JOIN pl ON pl.key = fa.key WHERE grp IS NULL),
fc AS (SELECT *, max(pos) OVER (PARTITION BY key, run ORDER BY x RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS inb FROM fb WHERE n >= 4),
ca AS (SELECT key, run, pos AS a, t AS ta, span, unnest(list_distinct([greatest(pos + 3, inb), greatest(pos + 3, inb + 1)])) AS b FROM fc),
cb AS (SELECT ca.key, ca.run, a, b, abs(fc.t - ta - ca.span) AS dev, sha256('17:' || ca.key || ':' || round(ta * 1e6)::BIGINT || ':' || round(fc.t * 1e6)::BIGINT) AS tie FROM ca JOIN fc ON fc.key = ca.key AND fc.run = ca.run AND fc.pos = b),
o0 AS (SELECT key, run, 0 AS lo, max(n) - 1 AS hi FROM fc GROUP BY key, run),{",".join(_ROUND.format(k=k, n=k + 1, still=2 - k) for k in range(3))},
pk AS (FROM p0 UNION ALL FROM p1 UNION ALL FROM p2),
st AS (SELECT pl.key, m, CASE WHEN m NOT BETWEEN 2 AND 4 THEN 'merged_group_count_outside_2_to_4' WHEN least < 4 THEN 'evidence_group_has_fewer_than_four_distinct_pts' WHEN (SELECT count(*) FROM pk WHERE pk.key = pl.key) < 3 THEN 'fewer_than_three_disjoint_distractor_groups' ELSE '' END AS reason FROM pl JOIN sh ON sh.key = pl.key),
ot AS (SELECT pk.key, k, list(fc.t ORDER BY fc.t) AS pts FROM pk JOIN fc ON fc.key = pk.key AND fc.run = pk.run AND fc.pos IN (a, a + round((b - a) / 3.0), a + round(2 * (b - a) / 3.0), b) GROUP BY pk.key, k),
al AS (SELECT gp.key, grp::INT AS grp, true AS is_gold, pts, reason FROM gp JOIN st ON st.key = gp.key UNION ALL SELECT ot.key, (m + k)::INT, false, pts, reason FROM ot JOIN st ON st.key = ot.key),
bu AS (SELECT key, true AS built, reason, grp, is_gold, pts, {_NAME} AS group_id FROM al WHERE reason = '' UNION ALL SELECT key, false, reason, NULL, NULL, NULL, NULL FROM st WHERE reason <> '')"""
MADE = f"""
{BUILT},
ks AS (SELECT key, list(grp ORDER BY pts[1], group_id) AS ordered, max(grp) AS spare, count_if(is_gold)::INT AS m FROM bu WHERE built GROUP BY key),
cn AS (SELECT key, ordered, spare, unnest(list_concat([{{'c': 'Full', 'x': NULL::INT}}, {{'c': 'Blind', 'x': NULL}}, {{'c': 'Irrel-1', 'x': m}}, {{'c': 'Irrel-2', 'x': m + 1}}], list_transform(range(0, m), lambda i: {{'c': 'Key-' || (i + 1), 'x': i::INT}}))) AS u FROM ks),
md AS (SELECT key, u.c AS condition, CASE WHEN u.c = 'Blind' THEN []::INT[] ELSE list_filter(ordered, lambda g: g <> coalesce(u.x, spare)) END AS groups, u.x AS replaced FROM cn)"""


def built(spark, sf_dir):
    """Evidence: the days after purchases of 60 or more, all of them; users with too little or too much of it get a reason."""
    e = events(spark, sf_dir)
    gold = iv.merge(e.where("event_type = 'purchase' and value >= 60").select("user_id", F.col("t").alias("s"), (F.col("t") + 129600).alias("e")), "user_id")
    return pk.packages(e.select("user_id", "t"), gold.select("user_id", "s", "e"), "user_id")


@query(f"WITH {BUILT} SELECT * FROM bu")
def intervention_packages(spark, sf_dir):
    return built(spark, sf_dir)


@query(f"WITH {MADE} SELECT * FROM md")
def intervention_conditions(spark, sf_dir):
    return pk.conditions(built(spark, sf_dir))


@query(f"""
WITH {MADE},
sp AS (SELECT md.key, condition, CASE WHEN condition = 'Irrel-1' AND md.key % 2 = 0 THEN w.groups WHEN condition = 'Key-1' AND md.key % 3 = 0 THEN md.groups[3:] ELSE md.groups END AS groups, w.groups AS whole
  FROM md JOIN (SELECT key, groups FROM md WHERE condition = 'Full') w ON w.key = md.key)
SELECT key, condition FROM sp WHERE condition NOT IN ('Full', 'Blind')
  AND (len(list_filter(whole, lambda x: NOT list_contains(groups, x))) <> 1 OR len(list_filter(groups, lambda x: NOT list_contains(whole, x))) <> 1)""")
def replacement_violations(spark, sf_dir):
    """Conditions spoiled for some users: nothing replaced, and two groups left out."""
    made = settled(pk.conditions(built(spark, sf_dir)), "made")
    whole = made.where("condition = 'Full'").select("key", F.col("groups").alias("whole"))
    none = (F.col("condition") == "Irrel-1") & (F.col("key") % 2 == 0)
    two = (F.col("condition") == "Key-1") & (F.col("key") % 3 == 0)
    spoiled = F.when(none, F.col("whole")).when(two, F.slice("groups", 3, 1000)).otherwise(F.col("groups"))
    return pk.one_replaced(made.join(whole, "key").withColumn("groups", spoiled).drop("whole"))


@query(f"""
WITH {MADE},
sw AS (SELECT DISTINCT key, grp, event_type || ':' || floor(value / 120)::BIGINT AS h FROM (SELECT key, grp, unnest(pts) AS t FROM bu WHERE built) b JOIN events ON user_id = key AND {T} = b.t),
kp AS (SELECT DISTINCT r.key, condition, h FROM (SELECT key, condition, unnest(groups) AS grp FROM md WHERE replaced IS NOT NULL) r JOIN sw ON sw.key = r.key AND sw.grp = r.grp),
gn2 AS (SELECT md.key, condition, h FROM md JOIN sw ON sw.key = md.key AND sw.grp = replaced)
SELECT md.key, md.condition, count(kp.h) AS n_shared, count(kp.h) = 0 AS valid FROM md LEFT JOIN gn2 ON gn2.key = md.key AND gn2.condition = md.condition LEFT JOIN kp ON kp.key = gn2.key AND kp.condition = gn2.condition AND kp.h = gn2.h
WHERE replaced IS NOT NULL GROUP BY ALL""")
def hidden_copies_by_condition(spark, sf_dir):
    """What a frame shows is its event's type and rough value."""
    rows = settled(built(spark, sf_dir), "built")
    made = pk.conditions(rows)
    shown = events(spark, sf_dir).select(F.col("user_id").alias("key"), "t", F.concat_ws(":", "event_type", F.floor(F.col("value") / 120).cast("string")).alias("h"))
    return pk.hidden_copies(made, rows, shown)


# Covers and retrieval methods


@query(f"""
WITH {MASKS},
c1 AS MATERIALIZED (SELECT user_id, mask, min(idx) AS id FROM mk WHERE mask > 0 GROUP BY ALL),
s0 AS (SELECT DISTINCT user_id, []::BIGINT[] AS ids, 0 AS mask FROM mk),
s1 AS (SELECT user_id, [id] AS ids, mask FROM c1),
s2 AS MATERIALIZED (SELECT s.user_id, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s1 s JOIN c1 c ON s.user_id = c.user_id AND id > ids[-1]),
s3 AS MATERIALIZED (SELECT s.user_id, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s2 s JOIN c1 c ON s.user_id = c.user_id AND id > ids[-1]),
s4 AS MATERIALIZED (SELECT s.user_id, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s3 s JOIN c1 c ON s.user_id = c.user_id AND id > ids[-1]),
u AS MATERIALIZED (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2 UNION ALL FROM s3 UNION ALL FROM s4),
b AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bit_count(mask) DESC, len(ids), ids) AS r FROM u WHERE len(ids) <= 3) WHERE r = 1),
l AS (SELECT user_id, min(len(ids)) FILTER (mask = 7) AS least FROM u GROUP BY user_id),
rl AS (SELECT b.user_id, idx, mk.mask, row_number() OVER (PARTITION BY b.user_id ORDER BY sha256('17:' || b.user_id || ':' || idx), idx) AS r FROM b JOIN mk ON mk.user_id = b.user_id AND NOT list_contains(ids, idx)),
pd AS (SELECT b.user_id, coalesce(list(idx ORDER BY rl.r) FILTER (rl.r <= 3 - len(ids)), []) AS more, coalesce(bit_or(rl.mask) FILTER (rl.r <= 3 - len(ids)), 0) AS also FROM b LEFT JOIN rl ON rl.user_id = b.user_id GROUP BY b.user_id)
SELECT b.user_id, list_concat(ids, more) AS ids, least IS NOT NULL AS stored, coalesce(least <= 3, false) AS feasible, least::INT AS minimum_size, (b.mask | also)::INT AS covered, (b.mask | also) = 7 AS access
FROM b JOIN l ON l.user_id = b.user_id JOIN pd ON pd.user_id = b.user_id""".replace("mk AS (SELECT p.user_id, p.idx, coalesce(bit_or(CASE WHEN n >= 2 THEN 1 << j::INT END), 0)::INT AS mask", "mk AS MATERIALIZED (SELECT p.user_id, p.idx, coalesce(bit_or(CASE WHEN n >= 2 AND j < 3 THEN 1 << j::INT END), 0)::INT AS mask"))
def set_cover_capped(spark, sf_dir):
    """Three groups, three items at most, filled up in hash order."""
    m = masks(spark, sf_dir).withColumn("mask", F.expr("mask & 7"))
    m = settled(m.select("user_id", "idx", "mask"), "masks")
    order = Window.partitionBy("user_id").orderBy(scalars.hash_order(17, F.col("user_id"), F.col("idx")), "idx")
    return iv.capped_cover(m, m.select("user_id", "idx", F.row_number().over(order).alias("rank")), "user_id", "idx", 3, 3)


@query(f"""
WITH {COS},
r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c WHERE item_id <> query_id),
f AS (SELECT query_id AS g, item_id FROM r WHERE query_id % 100 = 0 AND rank <= 3),
n AS (SELECT query_id - 50 AS g, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE query_id % 100 = 50 AND NOT EXISTS (SELECT 1 FROM f WHERE f.g = query_id - 50 AND f.item_id = r.item_id)),
k AS (SELECT 'R0' AS method, query_id AS g, item_id, rank FROM r WHERE query_id % 100 = 0 AND rank <= 6 UNION ALL
  SELECT 'R1', query_id, item_id, rank FROM r WHERE query_id % 100 = 0 AND rank <= 3 UNION ALL SELECT 'R1', g, item_id, rank + 3 FROM n WHERE rank <= 3)
SELECT method, g AS question, list(item_id ORDER BY rank) AS ids FROM k GROUP BY ALL""")
def methods_r0_r1(spark, sf_dir):
    """The six nearest of a question; or three, and three others for its refined question."""
    q = asked(spark, sf_dir)
    return rt.plain_and_refined(vectors(spark, sf_dir), q.where("id % 100 = 0"), q.where("id % 100 = 50").withColumn("question", F.col("id") - 50), dim_of(spark, sf_dir))


# Methods and conditions side by side


@query(f"""
WITH {RESULTS}
SELECT l_orderkey, o_custkey, l_linenumber, status, verdict, citations_legal FROM al""")
def planned_results_checked(spark, sf_dir):
    return ev.planned_results(planned(spark, sf_dir), results(spark, sf_dir), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "o_custkey", "l_linenumber", "status", "verdict", "citations_legal")


@query("""
WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'l_returnflag' AS field FROM c WHERE a > 1 UNION ALL SELECT l_orderkey, 'l_linestatus' FROM c WHERE b > 1""")
def methods_disagreeing(spark, sf_dir):
    return ev.disagreeing(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query(f"""
WITH {RESULTS}, un AS (SELECT l_linenumber, o_custkey, avg(score) AS m, sum(score) AS s, count(*) AS k FROM al GROUP BY ALL)
SELECT l_linenumber, sum(s) / sum(k) AS micro, avg(m) AS macro, sum(k)::BIGINT AS n, count(*) AS n_units FROM un GROUP BY l_linenumber""")
def micro_macro(spark, sf_dir):
    return ev.micro_macro(scored(spark, sf_dir), "l_linenumber", "o_custkey", "score")


CONDITIONS = ["Full", "Key-1", "Key-2", "Irrel-1", "Irrel-2", "Blind"]


@query(f"""
WITH {RESULTS}, x AS (SELECT l_orderkey, ['Full', 'Key-1', 'Key-2', 'Irrel-1', 'Irrel-2', 'Blind'][l_linenumber] AS condition, l_linenumber AS place, score FROM al WHERE l_linenumber <= 6),
d AS (SELECT x.condition, x.place, f.score - x.score AS d FROM x JOIN x f ON f.l_orderkey = x.l_orderkey AND f.place = 1)
SELECT condition, split_part(condition, '-', 1) AS family, place, CASE WHEN d > 0 THEN 'positive' WHEN d < 0 THEN 'negative' ELSE 'zero' END AS outcome, count(*) AS n FROM d GROUP BY ALL""")
def outcomes_by_condition(spark, sf_dir):
    """How often Full does better than each condition, these in their own order."""
    name = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), F.col("l_linenumber"))
    x = scored(spark, sf_dir).where("l_linenumber <= 6").select("l_orderkey", name.alias("condition"), "score")
    full = x.where("condition = 'Full'").select("l_orderkey", F.col("score").alias("whole"))
    d = x.join(full, "l_orderkey").select("condition", scalars.condition_family(F.col("condition")).alias("family"), scalars.domain_order(F.col("condition"), CONDITIONS).alias("place"), scalars.outcome(F.col("whole") - F.col("score")).alias("outcome"))
    return d.groupBy("condition", "family", "place", "outcome").agg(F.count(F.lit(1)).alias("n"))


# Ledgers: lines of an order as one ledger's requests

CAPS = lg.Caps(request_tokens=4000, method_tokens=2500, physical={"total": 3, "core": 2, "E3": 1, "D0": 1, "RESERVE": 1})
REQUESTS = """
rn AS (SELECT l_orderkey AS ledger, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS n, * FROM lineitem),
rq AS (SELECT ledger, n, CASE WHEN l_linenumber = 7 THEN 'E3' WHEN l_linenumber > 2 THEN 'E2' ELSE 'E1' END AS phase, (l_suppkey % 2)::VARCHAR AS question, ['R0', 'R1', 'R2', 'R*'][l_partkey % 4 + 1] AS method, CASE WHEN l_tax > 0.06 THEN 'judge' ELSE 'answer' END AS role,
  'c' AS condition, l_partkey * 3 AS input_tokens, 500::BIGINT AS max_output_tokens, CASE WHEN l_returnflag <> 'N' THEN l_suppkey * 8 END AS output_tokens, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 'timeout' END AS error, l_discount > 0.03 AS physical, l_returnflag <> 'N' AS done FROM rn)"""
FOLDED = f"""
{REQUESTS},
fo AS (SELECT DISTINCT ledger, 0::BIGINT AS n, []::STRUCT(q VARCHAR, m VARCHAR, e2 BOOLEAN, e3 BOOLEAN, p BOOLEAN, c BIGINT)[] AS seen, NULL::VARCHAR AS refusal FROM rq
  UNION ALL
  SELECT ledger, n, CASE WHEN refusal IS NULL THEN list_append(seen, {{'q': question, 'm': method, 'e2': e2, 'e3': phase = 'E3', 'p': physical, 'c': input_tokens + coalesce(output_tokens, max_output_tokens)}}) ELSE seen END, refusal FROM (
    SELECT rq.*, seen, phase = 'E2' AND role <> 'judge' AS e2, CASE WHEN input_tokens + max_output_tokens > 4000 THEN 'request tokens'
      WHEN phase = 'E2' AND role <> 'judge' AND len(list_filter(seen, lambda x: x.e2 AND x.q = question AND x.m = method)) >= CASE WHEN method IN ('R1', 'R2') THEN 2 ELSE 1 END THEN 'method calls'
      WHEN phase = 'E2' AND role <> 'judge' AND coalesce(list_sum(list_transform(list_filter(seen, lambda x: x.e2 AND x.q = question AND x.m = method), lambda x: x.c)), 0) + input_tokens + max_output_tokens > 2500 THEN 'method tokens'
      WHEN physical AND len(list_filter(seen, lambda x: x.p)) >= 3 THEN 'physical total' WHEN physical AND phase = 'E3' AND len(list_filter(seen, lambda x: x.p AND x.e3)) >= 1 THEN 'physical E3'
      WHEN physical AND phase <> 'E3' AND len(list_filter(seen, lambda x: x.p AND NOT x.e3)) >= 2 THEN 'physical core' END AS refusal
    FROM fo JOIN rq ON rq.ledger = fo.ledger AND rq.n = fo.n + 1)),
en AS (SELECT rq.*, CASE WHEN NOT done THEN 'reserved' WHEN coalesce(output_tokens > max_output_tokens, false) THEN 'budget_violation' WHEN error IS NOT NULL THEN 'failed' ELSE 'complete' END AS state, input_tokens + coalesce(output_tokens, max_output_tokens) AS charged,
  row_number() OVER (PARTITION BY rq.ledger, phase, question, method, condition, role ORDER BY rq.n) AS attempt FROM rq JOIN fo ON fo.ledger = rq.ledger AND fo.n = rq.n WHERE refusal IS NULL)"""


def requests(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    phase = F.when(F.col("l_linenumber") == 7, "E3").when(F.col("l_linenumber") > 2, "E2").otherwise("E1")
    method = F.element_at(F.array(*[F.lit(m) for m in ("R0", "R1", "R2", "R*")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ledger"), F.row_number().over(order).cast("long").alias("n"), phase.alias("phase"), (F.col("l_suppkey") % 2).cast("string").alias("question"), method.alias("method"),
        F.when(F.col("l_tax") > 0.06, "judge").otherwise("answer").alias("role"), F.lit("c").alias("condition"), (F.col("l_partkey") * 3).alias("input_tokens"), F.lit(500).cast("long").alias("max_output_tokens"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") * 8).alias("output_tokens"), F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), "timeout").alias("error"), (F.col("l_discount") > 0.03).alias("physical"), (F.col("l_returnflag") != "N").alias("done"),
    )


def entries(spark, sf_dir):
    checked = lg.checked_requests(requests(spark, sf_dir), "ledger", "n")
    admitted = lg.reserve(checked, "ledger", ["n"], CAPS).where("refusal is null").drop("refusal")
    return settled(lg.with_attempts(lg.finalized(admitted), "ledger", ["n"]), "entries")


@query(f"WITH RECURSIVE {FOLDED} SELECT ledger, n, refusal FROM fo WHERE n > 0")
def ledger_reserve(spark, sf_dir):
    return lg.reserve(requests(spark, sf_dir), "ledger", ["n"], CAPS).select("ledger", "n", "refusal")


@query(f"WITH RECURSIVE {FOLDED} SELECT ledger, n, method, state, charged, attempt FROM en")
def ledger_replay(spark, sf_dir):
    """The admitted entries, stored and replayed under the same caps."""
    return lg.replayed(entries(spark, sf_dir), "ledger", ["n"], CAPS).select("ledger", "n", "method", "state", "charged", "attempt")


@query(f"""
WITH RECURSIVE {FOLDED} SELECT phase, method, count(*) AS logical_calls, sum(charged)::BIGINT AS logical_tokens, count_if(physical)::BIGINT AS physical_calls, coalesce(sum(charged) FILTER (physical), 0)::BIGINT AS physical_tokens,
  count_if(NOT physical)::BIGINT AS cache_saved_calls, count_if(output_tokens IS NULL)::BIGINT AS unknown_output_calls, count_if(state IN ('failed', 'budget_violation'))::BIGINT AS failed_calls FROM en WHERE role <> 'judge' GROUP BY ALL""")
def ledger_method_cost(spark, sf_dir):
    return lg.method_cost(entries(spark, sf_dir), ["phase", "method"])


@query(f"""
WITH RECURSIVE {FOLDED} SELECT count(*) AS logical_calls, count_if(physical)::BIGINT AS physical_calls, count_if(physical AND phase <> 'E3')::BIGINT AS core_physical_calls, count_if(physical AND phase = 'E3')::BIGINT AS e3_physical_calls,
  sum(charged)::BIGINT AS logical_tokens, coalesce(sum(charged) FILTER (physical), 0)::BIGINT AS physical_tokens, coalesce(sum(charged) FILTER (role = 'judge'), 0)::BIGINT AS judge_logical_tokens,
  count_if(state = 'budget_violation')::BIGINT AS budget_violations, count_if(state = 'reserved')::BIGINT AS pending_requests FROM en""")
def ledger_totals(spark, sf_dir):
    return lg.summary(entries(spark, sf_dir), [])


ORACLE["running_budget"] = """
WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_quantity::BIGINT AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS n FROM lineitem),
f AS (SELECT *, cost <= 60 AS ok, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS spent, CASE WHEN cost <= 60 THEN 1 ELSE 0 END AS calls FROM o WHERE n = 1
  UNION ALL SELECT o.*, calls < 4 AND spent + o.cost <= 60, CASE WHEN calls < 4 AND spent + o.cost <= 60 THEN spent + o.cost ELSE spent END, CASE WHEN calls < 4 AND spent + o.cost <= 60 THEN calls + 1 ELSE calls END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, cost, ok, spent::BIGINT AS spent FROM f"""
