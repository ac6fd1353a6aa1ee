"""Queries over the test tables, each bound to an operator by shape, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import model_json, scalars
from ..operators import evaluation as ev
from ..operators import intervals as iv
from ..operators import retrieval as rt
from ..operators import sampling as sp
from ..session import settled, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", seconds("ts"))


T = "epoch_us(ts) / 1e6"

# Sampling


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('17:row:' || c_custkey), c_custkey) AS round FROM customer),
o AS (SELECT *, row_number() OVER (ORDER BY round, sha256('17:stratum:' || c_mktsegment), c_mktsegment) AS pick FROM r)
SELECT c_custkey, c_mktsegment, round, pick FROM o WHERE pick <= 48""")
def stratified_take(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sp.stratified_take(rows, "c_mktsegment", "c_custkey", 48)


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('17:row:' || o_orderkey), o_orderkey) AS rank FROM orders),
c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('17:row:' || c_custkey), c_custkey) AS round
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM p WHERE rank = 2)),
o AS (SELECT *, row_number() OVER (ORDER BY round, sha256('17:stratum:' || c_nationkey), c_nationkey) AS pick FROM c)
SELECT c_custkey, c_nationkey, pick, o_orderkey, rank FROM o JOIN p ON o_custkey = c_custkey WHERE pick <= 24 AND rank <= 2""")
def nested_stratified_take(spark, sf_dir):
    orders = sp.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2)
    able = orders.where("rank = 2").select("o_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    taken = sp.stratified_take(rows.join(able, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "c_nationkey", "c_custkey", 24)
    met = F.broadcast(taken).join(orders, F.col("c_custkey") == F.col("o_custkey"))  # 24 rows
    return met.select("c_custkey", "c_nationkey", "pick", "o_orderkey", "rank")


@query("""
SELECT c_custkey, c_mktsegment, n_orders FROM (SELECT o_custkey, count(*) AS n_orders, bool_and(o_totalprice > 0) AS good FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey
WHERE c_acctbal BETWEEN 0 AND 6000 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND n_orders BETWEEN 4 AND 14 AND good
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def eligible_pool(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.every(F.col("o_totalprice") > 0).alias("good")).where("n_orders between 4 and 14 and good")
    out = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("excluded"))
    pool = table(spark, sf_dir, "customer").where("c_acctbal between 0 and 6000 and c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')")
    pool = pool.join(per, F.col("c_custkey") == F.col("o_custkey")).join(out, F.col("c_custkey") == F.col("excluded"), "left_anti")
    return pool.select("c_custkey", "c_mktsegment", "n_orders")


@query("""
WITH o AS (SELECT doc_id, source, row_number() OVER (ORDER BY sha256('43:' || doc_id), doc_id) - 1 AS pos FROM documents)
SELECT doc_id, source, pos // 4 AS batch, pos % 4 AS slot FROM o""")
def batches_of_four(spark, sf_dir):
    return sp.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query("""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('43:' || doc_id), doc_id) - 1 AS pos FROM documents)
SELECT doc_id, pos // 4 AS batch, 'a' || (row_number() OVER (PARTITION BY pos // 4 ORDER BY sha256('43:' || (pos // 4) || ':' || doc_id), doc_id) - 1) AS anon FROM o""")
def anonymous_batches(spark, sf_dir):
    return sp.anonymous(sp.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").drop("slot"), "batch", "doc_id")


@query("""
WITH o AS (SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('17:row:' || c_custkey), c_custkey) AS rank FROM customer)
SELECT c_custkey, c_name, c_mktsegment, CASE WHEN rank <= 6 THEN 'dev' WHEN rank <= 24 THEN 'pilot' ELSE 'train' END AS role FROM o""")
def role_export(spark, sf_dir):
    order = Window.partitionBy("c_mktsegment").orderBy(scalars.hash_order(17, F.lit("row"), F.col("c_custkey")), "c_custkey")
    ranked = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.row_number().over(order).alias("rank"))
    return ranked.withColumn("role", F.when(F.col("rank") <= 6, "dev").when(F.col("rank") <= 24, "pilot").otherwise("train")).drop("rank")


# Time


SPANS = f"(SELECT user_id, {T} AS s, {T} + 3600 * (value / 10 + 1) AS e FROM events)"


def spans(spark, sf_dir):
    return iv.checked_intervals(events(spark, sf_dir).select("user_id", F.col("t").alias("s"), (F.col("t") + 3600 * (F.col("value") / 10 + 1)).alias("e")))


@query(f"""
WITH a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM {SPANS}),
b AS (SELECT *, sum(CASE WHEN ahead IS NULL OR s >= ahead THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM b GROUP BY user_id, island""")
def interval_merge(spark, sf_dir):
    return iv.merge(spans(spark, sf_dir), "user_id")


@query(f"""
WITH a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM {SPANS})
SELECT user_id, greatest(0.0::DOUBLE, coalesce(max(s - ahead), 0.0::DOUBLE)) AS gap FROM a GROUP BY user_id""")
def max_uncovered_gap(spark, sf_dir):
    return iv.uncovered_gap(spans(spark, sf_dir), "user_id")


@query(f"""
WITH f AS (SELECT user_id, event_id * 3 AS seq, {T} AS t FROM events UNION ALL SELECT user_id, event_id * 3 + 1, {T} FROM events UNION ALL SELECT user_id, event_id * 3 + 2, {T} - 3600 FROM events WHERE event_type = 'error'),
a AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM f),
v AS (SELECT user_id, CASE WHEN t IS NULL THEN 'null' WHEN t < ahead THEN 'backward' WHEN t = ahead THEN 'duplicate' ELSE 'kept' END AS verdict FROM a)
SELECT user_id, verdict, count(*) AS n FROM v GROUP BY ALL""")
def monotonic_dedup(spark, sf_dir):
    """Every event again, and each error once more an hour early, so that all verdicts occur."""
    e = events(spark, sf_dir)
    rows = e.selectExpr("user_id", "event_id * 3 as seq", "t").unionAll(e.selectExpr("user_id", "event_id * 3 + 1", "t"))
    rows = rows.unionAll(e.where("event_type = 'error'").selectExpr("user_id", "event_id * 3 + 2", "t - 3600"))
    return iv.monotonic(rows, "user_id", "seq", "t").groupBy("user_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


CAPSULES = f"""
f AS (SELECT DISTINCT user_id, {T} AS t, floor({T} / 86400)::BIGINT AS idx FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, idx ORDER BY t) AS r, count(*) OVER (PARTITION BY user_id, idx) AS n FROM f),
p AS (SELECT user_id, idx, list(t ORDER BY t) FILTER (n < 4 OR r IN (1, round((n - 1) / 3.0) + 1, round(2 * (n - 1) / 3.0) + 1, n)) AS pts, max(n) AS n_frames, max(t) AS last FROM r GROUP BY user_id, idx)"""


def daily(spark, sf_dir):
    return iv.capsules(events(spark, sf_dir), "user_id", "t", 86400.0, tail=60.0)


@query(f"""
WITH {CAPSULES}
SELECT user_id, idx, idx * 86400.0::DOUBLE AS s, CASE WHEN idx = max(idx) OVER (PARTITION BY user_id) THEN least((idx + 1) * 86400.0::DOUBLE, last + 60) ELSE (idx + 1) * 86400.0::DOUBLE END AS e, n_frames,
  list_resize(pts, 4) AS pts, [len(pts) > 0, len(pts) > 1, len(pts) > 2, len(pts) > 3] AS valid FROM p""")
def capsules_tumbling(spark, sf_dir):
    return daily(spark, sf_dir)


@query("""
WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM a GROUP BY user_id, event_type, island""")
def gaps_islands(spark, sf_dir):
    return iv.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query(f"""
WITH a AS (SELECT user_id, {T} AS t, {T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
SELECT user_id, count(*) AS n, max(d) AS max_gap, avg(d) AS mean_gap FROM a GROUP BY user_id""")
def adjacent_gaps(spark, sf_dir):
    return iv.adjacent_gaps(events(spark, sf_dir).select("user_id", "t"), "user_id", "t")


GROUPS = f"""
ga AS (SELECT user_id, {T} AS s, {T} + 43200 AS e FROM events WHERE event_type = 'purchase'),
gb AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM ga),
gc AS (SELECT *, sum(CASE WHEN ahead IS NULL OR s >= ahead THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM gb),
gd AS (SELECT user_id, min(s) AS s, max(e) AS e FROM gc GROUP BY user_id, island),
ge AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e - s DESC, s) - 1 AS j FROM gd),
gr AS (SELECT * FROM ge WHERE j < 4)"""
MASKS = f"""
{CAPSULES.replace("FROM events", "FROM events WHERE event_type <> 'purchase'")}, {GROUPS},
pt AS (SELECT DISTINCT user_id, idx, unnest(pts) AS t FROM p),
bt AS (SELECT pt.user_id, idx, j, count(DISTINCT t) AS n FROM pt JOIN gr ON pt.user_id = gr.user_id AND t >= s AND t < e GROUP BY ALL),
mk AS (SELECT p.user_id, p.idx, coalesce(bit_or(CASE WHEN n >= 2 THEN 1 << j::INT END), 0)::INT AS mask FROM p LEFT JOIN bt ON p.user_id = bt.user_id AND p.idx = bt.idx GROUP BY ALL)"""


def masks(spark, sf_dir):
    """Days of events but purchases, covering each user's four longest stretches around purchases."""
    e = events(spark, sf_dir)
    merged = iv.merge(e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 43200).alias("e")), "user_id")
    order = Window.partitionBy("user_id").orderBy(F.desc(F.col("e") - F.col("s")), "s")
    groups = merged.withColumn("j", F.row_number().over(order) - 1).where("j < 4")
    caps = iv.capsules(e.where("event_type <> 'purchase'"), "user_id", "t", 86400.0)
    return iv.coverage(caps, groups, "user_id")


@query(f"WITH {MASKS} SELECT user_id, idx, mask FROM mk")
def coverage_mask(spark, sf_dir):
    return masks(spark, sf_dir)


@query(f"WITH {MASKS} SELECT user_id, bit_or(mask)::INT AS covered FROM mk GROUP BY user_id")
def packet_coverage(spark, sf_dir):
    m = masks(spark, sf_dir)
    return iv.packet_coverage(m.select("user_id", "idx"), m, "user_id", "idx")


@query(f"""
WITH {MASKS},
c1 AS (SELECT user_id, mask, min(idx) AS id FROM mk WHERE mask > 0 GROUP BY ALL),
s1 AS (SELECT user_id, [id] AS ids, mask FROM c1),
s2 AS (SELECT s.user_id, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s1 s JOIN c1 c ON s.user_id = c.user_id AND id > ids[-1]),
s3 AS (SELECT s.user_id, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s2 s JOIN c1 c ON s.user_id = c.user_id AND id > ids[-1]),
s4 AS (SELECT s.user_id, list_append(ids, id) AS ids, s.mask | c.mask AS mask FROM s3 s JOIN c1 c ON s.user_id = c.user_id AND id > ids[-1]),
u AS (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3 UNION ALL FROM s4),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bit_count(mask) DESC, len(ids), ids) AS r FROM u)
SELECT k.user_id, coalesce(ids, []::BIGINT[]) AS ids, coalesce(b.mask, 0) AS covered, coalesce(len(ids), 0)::INT AS size, coalesce(b.mask = 15, false) AS complete
FROM (SELECT DISTINCT user_id FROM mk) k LEFT JOIN b ON k.user_id = b.user_id AND r = 1""")
def set_cover_rstar(spark, sf_dir):
    return iv.minimal_cover(masks(spark, sf_dir), "user_id", "idx")


# Retrieval


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def asked(spark, sf_dir):
    return vectors(spark, sf_dir).where("id % 50 = 0")


def dim_of(spark, sf_dir):
    row = vectors(spark, sf_dir).select(F.size("v").alias("n")).first()
    return row.n if row else 1


COS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
i AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS iv FROM embeddings),
c AS (SELECT query_id, item_id, iv, list_dot_product(qv, iv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(iv, iv))) AS score FROM q, i)"""


@query(f"""
WITH {COS}, r AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c WHERE item_id <> query_id)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 6""")
def topk_cosine(spark, sf_dir):
    q = asked(spark, sf_dir)
    own = q.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    return rt.topk(vectors(spark, sf_dir), q, 6, dim_of(spark, sf_dir), own).withColumn("score", F.round("score", 6))


@query(f"""
WITH {COS}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c WHERE item_id <> query_id),
l AS (SELECT query_id, list(item_id ORDER BY rank) AS ids FROM r WHERE rank <= 6 GROUP BY query_id)
SELECT a.query_id AS query_a, b.query_id AS query_b, len(list_intersect(a.ids, b.ids)) AS shared, len(list_distinct(list_concat(a.ids, b.ids))) AS joint, len(list_intersect(a.ids, b.ids)) = len(a.ids) AS subset
FROM l a JOIN l b ON b.query_id = a.query_id + 50""")
def packet_overlap(spark, sf_dir):
    q = asked(spark, sf_dir)
    own = q.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    near = rt.topk(vectors(spark, sf_dir), q, 6, dim_of(spark, sf_dir), own)
    lists = near.groupBy("query_id").agg(F.collect_list("item_id").alias("ids"))
    a, b = lists.select(F.col("query_id").alias("query_a"), F.col("ids").alias("x")), lists.select(F.col("query_id").alias("query_b"), F.col("ids").alias("y"))
    met = a.join(b, F.col("query_b") == F.col("query_a") + 50)
    return met.select("query_a", "query_b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("joint"), (F.size(F.array_except("x", "y")) == 0).alias("subset"))


def pooled(spark, sf_dir):
    q = asked(spark, sf_dir)
    members = q.select(F.expr("id div 100").alias("group_id"), F.col("id").alias("query_id"))
    out = members.alias("a").join(members.alias("b"), "group_id").select(F.col("a.query_id").alias("query_id"), F.col("b.query_id").alias("item_id"))
    near = rt.topk(vectors(spark, sf_dir), q, 6, dim_of(spark, sf_dir), out)
    return rt.pool(near, members, vectors(spark, sf_dir), q)


POOL = f"""
{COS},
n AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c WHERE NOT (item_id % 50 = 0 AND item_id // 100 = query_id // 100)),
g AS (SELECT DISTINCT query_id // 100 AS group_id, item_id FROM n WHERE rank <= 6),
s AS (SELECT g.group_id, g.item_id, any_value(iv) AS v, list(score ORDER BY query_id) AS sims, max(score) AS best FROM g JOIN c ON c.item_id = g.item_id AND c.query_id // 100 = g.group_id GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY best DESC, item_id) AS r FROM s) WHERE r <= 8),
pr AS (SELECT a.group_id, a.item_id AS x, b.item_id AS y, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS cs FROM p a JOIN p b ON a.group_id = b.group_id AND a.item_id < b.item_id),
t AS (SELECT a.group_id, [a.item_id, b.item_id, d.item_id] AS ids, list_sum(list_transform(range(1, len(a.sims) + 1), lambda k: greatest(a.sims[k], b.sims[k], d.sims[k]))) AS cover, (ab.cs + ad.cs + bd.cs) / 3 AS red
  FROM p a JOIN p b ON a.group_id = b.group_id AND a.item_id < b.item_id JOIN p d ON a.group_id = d.group_id AND b.item_id < d.item_id
  JOIN pr ab ON ab.group_id = a.group_id AND ab.x = a.item_id AND ab.y = b.item_id JOIN pr ad ON ad.group_id = a.group_id AND ad.x = a.item_id AND ad.y = d.item_id
  JOIN pr bd ON bd.group_id = a.group_id AND bd.x = b.item_id AND bd.y = d.item_id)"""


@query(f"""WITH {POOL}, o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cover - 0.2 * red DESC, ids) AS r FROM t)
SELECT group_id, ids, round(cover - 0.2 * red, 6) AS score FROM o WHERE r = 1""")
def r2_complement(spark, sf_dir):
    return rt.complement(pooled(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cover - 0.2 * red DESC, ids) AS r FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cover DESC, ids) AS r FROM t)
SELECT a.group_id, a.ids AS with_penalty, b.ids AS without_penalty, a.ids <> b.ids AS changed, round(a.red, 6) AS pair_with, round(b.red, 6) AS pair_without
FROM a JOIN b ON a.group_id = b.group_id AND a.r = 1 AND b.r = 1""")
def r2_alpha_ablation(spark, sf_dir):
    pool, items = pooled(spark, sf_dir), vectors(spark, sf_dir)
    one, two = rt.complement(pool, 0.2), rt.complement(pool, 0.0)
    a = one.join(rt.redundancy(one, items), "group_id").select("group_id", F.col("ids").alias("with_penalty"), F.round("mean_pair", 6).alias("pair_with"))
    b = two.join(rt.redundancy(two, items), "group_id").select("group_id", F.col("ids").alias("without_penalty"), F.round("mean_pair", 6).alias("pair_without"))
    return a.join(b, "group_id").withColumn("changed", F.col("with_penalty") != F.col("without_penalty"))


@query(f"""
WITH {COS}, m AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM c WHERE item_id <> query_id)
SELECT item_id, count(*) AS n_queries, round(max(score), 6) AS best FROM m WHERE r = 1 GROUP BY item_id""")
def contributing_items(spark, sf_dir):
    """Items that are the nearest of some query other than themselves."""
    q = asked(spark, sf_dir)
    own = q.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    near = rt.topk(vectors(spark, sf_dir), q, 1, dim_of(spark, sf_dir), own)
    return near.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.max("score"), 6).alias("best"))


# Evaluation: lines of orders as results of planned conditions

RESULTS = """
u AS (SELECT l_orderkey, l_linenumber, any_value(c) AS c, min(ROW(l_extendedprice, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)) AS m FROM (SELECT *, 1 AS c FROM lineitem) GROUP BY ALL),
res AS (SELECT l_orderkey, l_linenumber, CASE m[6] WHEN 'F' THEN 'complete' ELSE 'failed' END AS status, CASE m[5] WHEN 'A' THEN 'correct' WHEN 'R' THEN 'incorrect' ELSE 'uncertain' END AS verdict, m[4] > 10 AS legal FROM u),
pl AS (SELECT o_orderkey AS l_orderkey, o_custkey, unnest(range(1, 8))::INT AS l_linenumber FROM orders),
al AS (SELECT pl.*, coalesce(status, 'missing') AS status, verdict, coalesce(legal, false) AS citations_legal, CASE WHEN status = 'complete' AND verdict = 'correct' THEN 1 ELSE 0 END AS score FROM pl LEFT JOIN res USING (l_orderkey, l_linenumber))"""


def results(spark, sf_dir):
    """One result a logical key: of repeated lines the least by price and keys."""
    cols = ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*cols)).alias("m"))
    verdict = F.when(F.col("m.l_returnflag") == "A", "correct").when(F.col("m.l_returnflag") == "R", "incorrect").otherwise("uncertain")
    status = F.when(F.col("m.l_linestatus") == "F", "complete").otherwise("failed")
    return one.select("l_orderkey", "l_linenumber", status.alias("status"), verdict.alias("verdict"), (F.col("m.l_quantity") > 10).alias("citations_legal"))


def planned(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l_linenumber"))


def scored(spark, sf_dir):
    none = F.lit(None).cast("string")
    score = scalars.score(F.col("status"), F.col("verdict"), F.lit(True), F.lit(False), F.lit(False), none)
    return ev.planned_outer(planned(spark, sf_dir), results(spark, sf_dir), ["l_orderkey", "l_linenumber"]).withColumn("score", score)


@query(f"""
WITH {RESULTS}
SELECT l_linenumber, count(*) AS n_planned, sum(score)::BIGINT AS n_correct, avg(score) AS accuracy, count_if(status IN ('complete', 'ok', 'success'))::BIGINT AS n_success, count_if(status = 'missing')::BIGINT AS n_missing,
  count_if(verdict = 'uncertain')::BIGINT AS n_uncertain, count_if(verdict = 'uncertain') / count(*) AS uncertain_rate, avg(score) FILTER (verdict IS DISTINCT FROM 'uncertain') AS accuracy_decided,
  count_if(verdict IS DISTINCT FROM 'uncertain')::BIGINT AS n_decided FROM al GROUP BY l_linenumber""")
def planned_outer_summary(spark, sf_dir):
    return ev.condition_summary(scored(spark, sf_dir), ["l_linenumber"], F.col("score"))


@query("""
SELECT o_orderkey, 'orders' AS only_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def unplanned_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    found = ev.same_keys(table(spark, sf_dir, "orders"), lines, ["o_orderkey"])
    return found.withColumn("only_in", F.when(F.col("only_in") == "left", "orders").otherwise("lineitem"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_logical_rows(spark, sf_dir):
    return ev.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""
WITH {RESULTS}, w AS (SELECT l_orderkey, o_custkey, max(score) FILTER (l_linenumber = 1) - max(score) FILTER (l_linenumber = 2) AS d FROM al GROUP BY ALL)
SELECT count(*) AS n, count_if(d > 0)::BIGINT AS gains, count_if(d < 0)::BIGINT AS losses, sum(d)::BIGINT AS net, count(DISTINCT CASE WHEN d > 0 THEN o_custkey END) AS gain_clusters, avg(d) AS mean_difference FROM w""")
def paired_difference(spark, sf_dir):
    rows = scored(spark, sf_dir).where("l_linenumber <= 2").withColumn("method", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")))
    return ev.paired(rows, "l_orderkey", "o_custkey", "m1", "m2")


@query("""
SELECT l_linestatus AS method, count(*) AS logical_calls, sum(l_partkey + CASE WHEN l_returnflag = 'N' THEN 500 ELSE l_suppkey END)::BIGINT AS logical_tokens, count_if(l_tax > 0.02)::BIGINT AS physical_calls,
  coalesce(sum(l_partkey + CASE WHEN l_returnflag = 'N' THEN 500 ELSE l_suppkey END) FILTER (l_tax > 0.02), 0)::BIGINT AS physical_tokens, count_if(l_returnflag = 'N')::BIGINT AS unknown_output_calls, max(l_partkey) AS largest_input,
  round(avg(l_quantity), 6) AS mean_latency FROM lineitem GROUP BY l_linestatus""")
def method_cost_rollup(spark, sf_dir):
    """Lines as ledger entries: part as input tokens, supplier as output tokens, unknown where the flag is N."""
    out = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("tokens", scalars.charged(F.col("l_partkey"), out, F.lit(500))).withColumn("physical", F.col("l_tax") > 0.02)
    return rows.groupBy(F.col("l_linestatus").alias("method")).agg(
        F.count(F.lit(1)).alias("logical_calls"), F.sum("tokens").alias("logical_tokens"), F.count_if("physical").alias("physical_calls"),
        F.coalesce(F.sum(F.when(F.col("physical"), F.col("tokens"))), F.lit(0)).alias("physical_tokens"), F.count_if(F.col("l_returnflag") == "N").alias("unknown_output_calls"),
        F.max("l_partkey").alias("largest_input"), F.round(F.avg("l_quantity"), 6).alias("mean_latency"),
    )


@query("""
WITH m AS (SELECT o_orderstatus, sum(l_extendedprice) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT max(x) FILTER (o_orderstatus = 'O') AS a, max(x) FILTER (o_orderstatus = 'F') AS b FROM m)
SELECT round(abs(a - b) / least(a, b), 6) AS gap, abs(a - b) / least(a, b) <= 0.05 AS within FROM p""")
def token_gap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = lines.agg(*[F.sum(F.when(F.col("o_orderstatus") == s, F.col("l_extendedprice"))).alias(n) for s, n in (("O", "a"), ("F", "b"))])
    gap = F.try_divide(F.abs(F.col("a") - F.col("b")), F.least("a", "b"))
    return p.select(F.round(gap, 6).alias("gap"), (gap <= 0.05).alias("within"))


CLUSTERS = """cl AS (SELECT c_nationkey, sum(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS total, count(*) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)"""


def clusters(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("case l_returnflag when 'A' then 1d when 'R' then -1d else 0d end").alias("d"))
    met = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    met = met.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return ev.cluster_sums(met, "c_nationkey", "d")


@query(f"WITH {CLUSTERS} SELECT * FROM cl")
def cluster_preagg(spark, sf_dir):
    return clusters(spark, sf_dir)


BOOT = f"""
{CLUSTERS},
ix AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) - 1 AS pos, count(*) OVER () AS k FROM cl),
dr AS (SELECT d AS draw, pos AS slot, k, (d * 48271 + pos * 69621 + 43) % 2147483647 AS z FROM ix, range(500) r(d)),
pk AS (SELECT draw, ((((z * 48271) % 2147483647) * 69621) % 2147483647) % k AS pos FROM dr),
es AS (SELECT draw, sum(total) / sum(n) AS estimate FROM pk JOIN ix USING (pos) GROUP BY draw)"""


@query(f"WITH {BOOT} SELECT draw, round(estimate, 9) AS estimate FROM es")
def cluster_bootstrap_hash(spark, sf_dir):
    return ev.bootstrap_hash(clusters(spark, sf_dir), "c_nationkey", 500).withColumn("estimate", F.round("estimate", 9))


@query(f"WITH {BOOT} SELECT round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high, count(*) AS draws FROM es")
def bootstrap_interval(spark, sf_dir):
    found = ev.interval95(ev.bootstrap_hash(clusters(spark, sf_dir), "c_nationkey", 500))
    return found.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "draws")


@query()
def cluster_bootstrap_mt(spark, sf_dir):
    return ev.bootstrap_twister(clusters(spark, sf_dir), "c_nationkey")


TEXT = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"


@query(f"SELECT sha256({TEXT}) AS text_hash, count(*) AS n, count(DISTINCT source) AS n_values, count(DISTINCT source) > 1 AS conflicting FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_text_conflicts(spark, sf_dir):
    found = ev.conflicts(table(spark, sf_dir, "documents"), scalars.normalised_text(F.col("text")), "source")
    return found.withColumn("conflicting", F.col("n_values") > 1)


@query(f"""
WITH h AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS score, sha256({TEXT}) AS h, source FROM documents),
g AS (SELECT h, row_number() OVER (ORDER BY count(*) DESC, h) - 1 AS g FROM h GROUP BY h HAVING count(DISTINCT source) > 1),
s AS (SELECT g, count(*) AS n, sum(score) AS s FROM h LEFT JOIN (SELECT * FROM g WHERE g < 6) USING (h) GROUP BY g)
SELECT a AS assignment, sum(CASE WHEN g IS NULL THEN s ELSE ((a >> g) & 1) * n END) / sum(n) AS mean_score FROM s, range(64) r(a) GROUP BY a""")
def sensitivity_2k(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", (F.col("lang") == "en").cast("int").alias("score"), F.sha2(scalars.normalised_text(F.col("text")), 256).alias("h"))
    split = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("k")).where("k > 1").orderBy(F.desc("n"), "h").limit(6)
    groups = split.withColumn("g", F.row_number().over(Window.orderBy(F.desc("n"), "h")) - 1).select("h", "g")  # six rows
    return ev.scenarios(docs, F.broadcast(groups), "h", "score", 6)


@query("SELECT min(mean_score) AS lowest, max(mean_score) AS highest, count(*) AS n FROM (" + ORACLE["sensitivity_2k"] + ")")
def sensitivity_range(spark, sf_dir):
    return sensitivity_2k(spark, sf_dir).agg(F.min("mean_score").alias("lowest"), F.max("mean_score").alias("highest"), F.count(F.lit(1)).alias("n"))


@query(r"""
WITH w AS (SELECT lang, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::DOUBLE AS n FROM documents)
SELECT lang, count(*) AS n, min(n) AS least, quantile_cont(n, 0.5) AS median, avg(n) AS mean, max(n) AS most, count_if(n > 30)::BIGINT AS above_30 FROM w GROUP BY lang""")
def text_stats(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")).cast("double").alias("w"))
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.percentile("w", 0.5).alias("median"), F.avg("w").alias("mean"), F.max("w").alias("most"), F.count_if(F.col("w") > 30).alias("above_30"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    p = F.percentile("value", [0.5, 0.75, 0.95])
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p75"), F.col("p")[2].alias("p95"))


@query("""
WITH p AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.75) AS p75 FROM events GROUP BY event_type)
SELECT round(sum(n * p75) * 1.2 + 600, 6) AS forecast, sum(n * p75) * 1.2 + 600 <= 54000 AS admitted FROM p""")
def admission_forecast(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", 0.75).alias("p75"))
    total = F.sum(F.col("n") * F.col("p75")) * 1.2 + 600
    return p.agg(total.alias("x")).select(F.round("x", 6).alias("forecast"), (F.col("x") <= 54000).alias("admitted"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) AS attempt FROM lineitem")
def attempt_number(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ev.attempts(rows, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey", "l_suppkey"])


@query()
def running_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", F.col("l_quantity").cast("long").alias("cost"))
    return ev.admitted(rows, "l_orderkey", ["l_linenumber", "l_extendedprice", "l_partkey"], "cost", 60, 4)


@query(r"""
WITH d AS (SELECT doc_id, lang, n_chars, quality, toxic, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN w < 5 THEN 'frontend_or_data_not_captured' WHEN n_chars > 20000 THEN 'known_path_not_stored' WHEN quality IS NULL THEN 'read_budget_infeasible' WHEN toxic = 1 THEN 'method_execution_or_parse_failure'
  WHEN quality = 0 AND lang = 'en' AND NOT w > 100 THEN 'observed_repairable_read_gap' WHEN quality = 0 AND w > 300 THEN 'consumer_representation_or_injection_unresolved' WHEN quality = 1 THEN 'success' ELSE 'insufficient_diagnostic_information' END AS category FROM d""")
def failure_category(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("w", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")))
    wrong = F.col("quality") == 0
    why = scalars.failure_category(F.col("w") >= 5, F.col("n_chars") <= 20000, F.col("quality").isNotNull(), F.col("toxic") != 1, wrong, F.col("lang") == "en", F.col("w") > 100, F.col("w") > 300)
    return d.select("doc_id", why.alias("category"))


@query("""
SELECT doc_id, sha256(text) AS content, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id FROM documents""")
def content_hash_dedup(spark, sf_dir):
    """Every document with the first one of the same content: a mapping, by an aggregate and a join."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return d.join(d.groupBy("content").agg(F.min("doc_id").alias("canonical_id")), "content").select("doc_id", "content", "canonical_id")


@query("""
WITH b AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark),
d AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
h AS (SELECT doc_id, count(*) AS n_shared FROM d JOIN b USING (line) WHERE line <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(n_shared, 0) AS n_shared, n_shared IS NOT NULL AS hidden_copy FROM documents LEFT JOIN h USING (doc_id)""")
def hidden_copy_gate(spark, sf_dir):
    """Documents that share a whole line with a benchmark item. Lines meet by hash, the text stays behind."""
    lines = lambda name: F.transform(F.split(name, "\n"), lambda x: F.trim(x))
    docs = table(spark, sf_dir, "documents")
    b = table(spark, sf_dir, "benchmark").select(F.explode(lines("text")).alias("line")).where("line <> ''").select(F.sha2("line", 256).alias("h")).distinct()
    d = docs.select("doc_id", F.explode(F.array_distinct(lines("text"))).alias("line")).where("line <> ''").select("doc_id", F.sha2("line", 256).alias("h"))
    hits = d.join(b, "h", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shared"), F.col("n").isNotNull().alias("hidden_copy"))


@query(r"""
WITH p AS (SELECT page_id, 'videos/' || regexp_extract(url, '^https?://([^/]*)', 1) || CASE WHEN url LIKE '%?%' THEN '.mp4' WHEN url LIKE '%#%' THEN '/../x.mkv' ELSE '.webm' END AS path FROM pages)
SELECT page_id, path, regexp_matches(replace(path, '.example', ''), '^videos/[A-Za-z0-9_-]+\.(mp4|mkv|webm|avi|mov)$') AS safe, regexp_matches(path, '^videos/[A-Za-z0-9_-]+\.(mp4|mkv|webm|avi|mov)$') AS strict FROM p""")
def path_safety(spark, sf_dir):
    end = F.when(F.col("url").contains("?"), ".mp4").when(F.col("url").contains("#"), "/../x.mkv").otherwise(".webm")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("videos/"), F.regexp_extract("url", "^https?://([^/]*)", 1), end).alias("path"))
    return p.select("page_id", "path", scalars.safe_path(F.replace("path", F.lit(".example"), F.lit(""))).alias("safe"), scalars.safe_path(F.col("path")).alias("strict"))


@query("""
SELECT page_id, CASE WHEN url LIKE '%.example.com%' AND starts_with('v_' || page_id, 'v_') THEN page_id::VARCHAR ELSE 'v_' || page_id END AS canonical FROM pages""")
def canonical_ids(spark, sf_dir):
    source = F.when(F.col("url").contains(".example.com"), "marked").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", scalars.canonical_id(F.concat(F.lit("v_"), F.col("page_id").cast("string")), source, "marked").alias("canonical"))


# Model output


def turns(spark, sf_dir, cases: int):
    """Turns with a case of each kind of fault, by number."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", ((F.col("conv_id") + F.col("turn")) % cases).alias("k"))


def said(k: Column, bodies: list[Column]) -> Column:
    """The body of each case."""
    out = F.when(k == 0, bodies[0])
    for n, body in enumerate(bodies[1:], 1):
        out = out.when(k == n, body)
    return out


def bodied(rows: DataFrame, bodies: list[Column]) -> DataFrame:
    """conv_id, turn, said: written once, as the parsers name it many times."""
    return settled(rows.select("conv_id", "turn", said(F.col("k"), bodies).alias("said")), "said")


def fenced(body: Column, kind: str = "") -> Column:
    return F.concat(F.lit(f"```{kind}\n"), body, F.lit("\n```"))


BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _sql_json(cases: int, bodies: list[str]) -> str:
    """CTEs of the same strings, and v: what they are as one JSON object, or null."""
    whens = " ".join(f"WHEN {n} THEN {b}" for n, b in enumerate(bodies))
    inner = lambda c, n: f"trim(substring({c}, {n}, length({c}) - {n + 2}), {BLANK})"
    return f"""
tn AS (SELECT conv_id, turn, text, (conv_id + turn) % {cases} AS k FROM conversations),
sd AS (SELECT conv_id, turn, text, k, trim(CASE k {whens} END, {BLANK}) AS c FROM tn),
cl AS (SELECT conv_id, turn, text, k, CASE WHEN starts_with(c, '```json' || chr(10)) AND ends_with(c, '```') THEN {inner("c", 9)} WHEN starts_with(c, '```' || chr(10)) AND ends_with(c, '```') THEN {inner("c", 5)} ELSE c END AS c FROM sd),
vs AS (SELECT conv_id, turn, text, k, CASE WHEN json_valid(c) AND json_type(CASE WHEN json_valid(c) THEN c END) = 'OBJECT' THEN c END AS v FROM cl)"""


_FENCE = "'```{}' || chr(10) || {} || chr(10) || '```'"
_A = "json_object('answer', text, 'citations', {})::VARCHAR"
_ANSWERS = [
    _A.format("['c1', 'c2']"), _FENCE.format("json", _A.format("[]")), "json_object('answer', length(text), 'citations', ['c1'])::VARCHAR", _A.format("""json('["c1", 2]')"""),
    "json_object('answer', '  ', 'citations', ['c9'])::VARCHAR", "left(" + _A.format("['c1']") + ", -2)", "text", _FENCE.format("", _A.format("['c4', 'zz']")),
]


@query(f"""
WITH {_sql_json(8, _ANSWERS)},
p AS (SELECT *, CASE WHEN json_type(v, '$.answer') = 'VARCHAR' THEN json_extract_string(v, '$.answer') END AS a, CASE WHEN json_type(v, '$.citations') = 'ARRAY' AND len(list_filter(json_extract(v, '$.citations[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN json_extract_string(v, '$.citations[*]') END AS cs FROM vs),
o AS (SELECT *, a IS NOT NULL AND cs IS NOT NULL AS ok FROM p)
SELECT conv_id, turn, ok AS parse_ok, CASE WHEN ok THEN trim(a, {BLANK}) ELSE '' END AS answer, CASE WHEN ok THEN cs ELSE [] END AS citations, ok AND len(list_filter(coalesce(cs, []), lambda x: x NOT IN ('c1', 'c2', 'c3', 'c4'))) = 0 AS citations_legal, ok AND coalesce(trim(a, {BLANK}) = '', false) AS abstained FROM o""")
def json_parse_answer(spark, sf_dir):
    """Whole turns as model output of every shape: bare, fenced, of wrong types, cut off, not JSON at all."""
    body = lambda citations, a=F.col("text"): F.to_json(F.struct(a.alias("answer"), citations.alias("citations")))
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    cut = body(ids("c1"))
    mixed = F.replace(body(ids("c1", "@2@")), F.lit('"@2@"'), F.lit("2"))
    bodies = [body(ids("c1", "c2")), fenced(body(F.array().cast("array<string>")), "json"), body(ids("c1"), F.length("text")), mixed, body(ids("c9"), F.lit("  ")), F.substring(cut, F.lit(1), F.length(cut) - 2), F.col("text"), fenced(body(ids("c4", "zz")))]
    rows = bodied(turns(spark, sf_dir, 8), bodies)
    return rows.select("conv_id", "turn", model_json.answer(F.col("said"), ids("c1", "c2", "c3", "c4")).alias("a")).select("conv_id", "turn", "a.*")


_Q = "json_object('queries', {})::VARCHAR"
_QUERIES = [_Q.format("text"), _FENCE.format("", _Q.format("[text, ' two']")), _Q.format("[text, 'two', 'three']"), _Q.format("[text, text || ' ']"), _Q.format("[]"), _Q.format("['', text]")]


@query(f"""
WITH {_sql_json(6, _QUERIES)},
p AS (SELECT *, json_type(v, '$.queries') = 'VARCHAR' AS single, CASE WHEN json_type(v, '$.queries') = 'VARCHAR' THEN [json_extract_string(v, '$.queries')] WHEN json_type(v, '$.queries') = 'ARRAY' THEN json_extract_string(v, '$.queries[*]') END AS qs FROM vs),
r AS (SELECT *, list_transform(qs, lambda x: trim(x, {BLANK})) AS pl FROM p),
o AS (SELECT *, coalesce(len(pl) BETWEEN 1 AND 2 AND len(list_filter(pl, lambda x: x = '')) = 0, false) AS ok FROM r)
SELECT conv_id, turn, CASE WHEN NOT ok THEN ['question'] WHEN len(pl) = 2 AND pl[1] = pl[2] THEN pl[1:1] ELSE pl END AS queries, ok AS parse_ok, ok AND coalesce(single, false) AS normalized_from_string FROM o""")
def json_parse_control(spark, sf_dir):
    body = lambda q: F.to_json(F.struct(q.alias("queries")))
    text = F.col("text")
    bodies = [body(text), fenced(body(F.array(text, F.lit(" two")))), body(F.array(text, F.lit("two"), F.lit("three"))), body(F.array(text, F.concat(text, F.lit(" ")))), body(F.array().cast("array<string>")), body(F.array(F.lit(""), text))]
    rows = bodied(turns(spark, sf_dir, 6), bodies).select("conv_id", "turn", model_json.control(F.col("said"), F.lit(" question "), 2).alias("c"))
    return rows.select("conv_id", "turn", "c.*")


_R = "{{'id': {}, 'verdict': '{}', 'reason': {}}}"
_RESULTS = [
    [_R.format("'a1'", "incorrect", "text"), _R.format("'a0'", "correct", "text")], [_R.format("'a0'", "correct", "text"), _R.format("'zz'", "correct", "text")], [_R.format("'a0'", "correct", "text")] * 2,
    [_R.format("'a0'", "maybe", "text"), _R.format("'a1'", "correct", "' '"), _R.format("'a2'", "correct", "text")],
]
_JUDGED = [f"json_object('results', [{', '.join(x)}])::VARCHAR" for x in _RESULTS] + ["json_object('results', length(text))::VARCHAR"]


@query(f"""
WITH {_sql_json(5, _JUDGED)},
it AS (SELECT conv_id, turn, json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.verdict') AS verdict, trim(json_extract_string(x, '$.reason')) AS reason FROM (SELECT conv_id, turn, unnest(json_extract(v, '$.results[*]')) AS x FROM vs WHERE json_type(v, '$.results') = 'ARRAY')),
wh AS (SELECT conv_id, turn, bool_and(coalesce(id IN ('a0', 'a1', 'a2'), false)) AND count(DISTINCT id) = count(*) AS whole FROM it GROUP BY ALL),
ex AS (SELECT conv_id, turn, unnest(['a0', 'a1', 'a2']) AS id FROM conversations),
jd AS (SELECT ex.*, coalesce(whole AND verdict IN ('correct', 'incorrect', 'uncertain') AND reason <> '', false) AS parse_ok, verdict FROM ex LEFT JOIN wh USING (conv_id, turn) LEFT JOIN (SELECT DISTINCT ON (conv_id, turn, id) * FROM it) it USING (conv_id, turn, id))
SELECT conv_id, turn, id, CASE WHEN parse_ok THEN verdict ELSE 'uncertain' END AS verdict, parse_ok FROM jd""")
def json_parse_judge(spark, sf_dir):
    text = F.col("text")
    row = lambda i, verdict, reason=text: F.struct(F.lit(i).alias("id"), F.lit(verdict).alias("verdict"), reason.alias("reason"))
    body = lambda *rows: F.to_json(F.struct(F.array(*rows).alias("results")))
    bodies = [
        body(row("a1", "incorrect"), row("a0", "correct")), body(row("a0", "correct"), row("zz", "correct")), body(row("a0", "correct"), row("a0", "correct")),
        body(row("a0", "maybe"), row("a1", "correct", F.lit(" ")), row("a2", "correct")), F.to_json(F.struct(F.length("text").alias("results"))),
    ]
    rows = bodied(turns(spark, sf_dir, 5), bodies).select("conv_id", "turn", F.explode(model_json.verdicts(F.col("said"), F.array(*[F.lit(f"a{k}") for k in range(3)]))).alias("v"))
    return rows.select("conv_id", "turn", "v.*")


# State


@query()
def reservoir_batch(spark, sf_dir):
    return ev.reservoir(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 8)


# Reports


@query(f"""
WITH {RESULTS},
s AS (SELECT count(*) FILTER (l_linenumber = 1) AS planned, count(DISTINCT o_custkey) AS clusters, avg(score) FILTER (l_linenumber = 1) AS first_acc, avg(score) FILTER (l_linenumber = 7) AS last_acc,
  avg(CASE WHEN citations_legal THEN score ELSE 0 END) AS joint FROM al)
SELECT planned, clusters, round(first_acc, 6) AS first_accuracy, round(joint, 6) AS joint_score, planned >= 36 AND clusters >= 10 AS enough, first_acc >= 0.6 AND first_acc - last_acc >= 0.15 AS effect FROM s""")
def gates_report(spark, sf_dir):
    first, last = (F.avg(F.when(F.col("l_linenumber") == k, F.col("score"))) for k in (1, 7))
    s = scored(spark, sf_dir).agg(
        F.count_if(F.col("l_linenumber") == 1).alias("planned"), F.countDistinct("o_custkey").alias("clusters"), first.alias("a"), last.alias("z"),
        F.avg(F.when(F.col("citations_legal"), F.col("score")).otherwise(0)).alias("joint"),
    )
    enough, effect = (F.col("planned") >= 36) & (F.col("clusters") >= 10), (F.col("a") >= 0.6) & (F.col("a") - F.col("z") >= 0.15)
    return s.select("planned", "clusters", F.round("a", 6).alias("first_accuracy"), F.round("joint", 6).alias("joint_score"), enough.alias("enough"), effect.alias("effect"))
