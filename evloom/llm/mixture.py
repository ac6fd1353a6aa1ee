"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of levels (domain, language, source). At each node it is shared by
weight; what a child cannot take (its tokens times the epochs allowed) goes to its siblings by their
weights, and only what all siblings together cannot take goes up to the parent's siblings. As a
node's capacity is that of all leaves below it, one pass from the root settles this: filling siblings
in the order of capacity by weight is a running sum, so the whole tree is window functions over leaf
totals, in integers.

A leaf's budget is so many whole epochs and a prefix of one more. The prefix is by the order of
sha256(seed:epoch:doc_id): sums by the first and second byte find where it ends without sorting a
leaf, and only documents that share both bytes with the end are put in order. So a leaf with a third
of all rows is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, durable, text_of

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
#: Bytes of a leaf's decision, for the check before a broadcast.
LEAF_BYTES = 400


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def weight_of(path: Column, weights: dict[str, int]) -> Column:
    """The weight of a node by its path ("d0", "d0/en", ...) or, below that, by its own name; else 1."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, name), F.lit(1)).cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`nodes` (parent columns, name, cap, weight, have: the parent's budget) with each one's budget."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.try_divide(F.col("cap"), F.col("weight")), name)  # weight 0: no capacity, and first
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_from = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = nodes.withColumn("own", F.col("cap") * weight_from <= F.col("weight") * (F.col("have") - before))
    out = out.withColumn("full", F.min("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    open_weight = F.when(~F.col("full"), F.col("weight"))
    out = out.withColumn("rest", F.greatest(F.lit(0), F.col("have") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))))
    out = out.withColumn("open", F.sum(open_weight).over(group))
    out = out.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(weight * rest) div open")))
    spare = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("part"))).over(group)
    turn = F.row_number().over(group.orderBy("full", name))
    extra = F.when(~F.col("full") & (turn <= F.coalesce(spare, F.lit(0))), 1).otherwise(0)
    return out.withColumn("budget", F.col("part") + extra).drop("own", "full", "rest", "open", "part")


def budgets(leaves: DataFrame, levels: list[str], total: int | None, weights: dict[str, int], max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with budget; total: None for as many tokens as there are."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    least = F.least(*[weight_of(F.concat_ws("/", *levels[:n]), weights) for n in range(1, len(levels) + 1)], F.lit(1).cast("long"))
    leaves = leaves.withColumn("cap", F.when(least > 0, F.col("tokens") * max_epochs).otherwise(0))
    above = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("have")) if total is None else leaves.sparkSession.range(1).select(F.lit(total).cast("long").alias("have"))
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.concat_ws("/", *keys), weights))
        nodes = nodes.crossJoin(F.broadcast(above)) if depth == 1 else nodes.join(above, keys[:-1])  # the root is one row
        filled = durable(fill(nodes, keys[:-1], keys[-1]).select(*keys, "budget"), f"budget{depth}")
        above = filled.withColumnRenamed("budget", "have")
    return leaves.join(filled, levels).select(*levels, "tokens", "budget")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE))), 256)


def cut_at(sums: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Of `sums` (keys, by, n, rest), the row of each key in which the running sum reaches rest, with
    rest less what came before it."""
    w = Window.partitionBy(*keys).orderBy(*by)
    start = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = sums.withColumn("start", start).where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("n")))
    return out.withColumn("rest", F.col("rest") - F.col("start")).drop("start", "n")


def decide(slim: DataFrame, levels: list[str], *, total: int | None, weights: dict[str, int], max_epochs: int, seed: int) -> DataFrame:
    """One row for each leaf: levels, budget, epochs, and the end of the prefix: last_hash, last_id, last_tokens
    (nulls where there's no prefix). slim: doc_id, levels, n_tokens."""
    leaves = durable(slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = budgets(leaves, levels, total, weights, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long"))
    plan = durable(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "plan")
    partial = plan.where("rest > 0").select(*levels, "epochs", "rest")
    hashed = slim.join(checked(partial.select(*levels, "epochs"), LEAF_BYTES), levels).withColumn("h", order_hash(seed, F.col("epochs"), F.col("doc_id")))
    hashed = hashed.select(*levels, "doc_id", "n_tokens", "h", F.substring("h", 1, 2).alias("b1"), F.substring("h", 3, 2).alias("b2"))
    fine = durable(hashed.groupBy(*levels, "b1", "b2").agg(F.sum("n_tokens").alias("n")), "sums")
    one = cut_at(fine.groupBy(*levels, "b1").agg(F.sum("n").alias("n")).join(partial.select(*levels, "rest"), levels), levels, ["b1"])
    two = durable(cut_at(fine.join(one, [*levels, "b1"]), levels, ["b2"]), "ends")
    near = hashed.join(checked(two, LEAF_BYTES), [*levels, "b1", "b2"]).groupBy(*levels, "h", "doc_id", "rest").agg(F.sum("n_tokens").alias("n"))
    last = cut_at(near, levels, ["h", "doc_id"]).select(*levels, F.col("h").alias("last_hash"), F.col("doc_id").alias("last_id"), F.col("rest").alias("last_tokens"))
    return durable(plan.join(last, levels, "left").select(*levels, "budget", "epochs", "last_hash", "last_id", "last_tokens"), "decisions")


def mixture(docs: DataFrame, levels: dict[str, Column], *, total: int | None = None, weights: dict[str, int] | None = None, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the levels, n_tokens, budget (its leaf's), epochs (whole ones), prefix_tokens (of one
    more) for every row of `docs`. A token is a word [^\\x20\\x09-\\x0D]+.

    total: the tokens of the mixture (None: as many as `docs` has). weights: whole numbers by node
    path or name, 1 where none is given; 0 leaves out all below; a negative one is an error. What all
    that are not left out can't take stays undealt. Null text: no tokens. Null level: a node "(none)".
    Null id: ordered as "(none)". Ties in the order of hashes: by id. Repeated rows: rows of one id
    stand together, and the last one's cut holds for each of them. Very long texts: counted whole.
    Empty table: no rows. Other columns, whatever their names, are not read.
    """
    names = list(levels)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in levels.items()], n_words(text_col).alias("n_tokens"))
    slim = durable(slim, "mixture")
    return applied(slim, decide(slim, names, total=total, weights=weights or {}, max_epochs=max_epochs, seed=seed), names, seed)


def applied(slim: DataFrame, decided: DataFrame, names: list[str], seed: int) -> DataFrame:
    rows = slim.join(checked(decided, LEAF_BYTES), names)
    h = order_hash(seed, F.col("epochs"), F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("last_id"))
    sooner = (F.col("h") < F.col("last_hash")) | ((F.col("h") == F.col("last_hash")) & ~same & (F.col("doc_id") < F.col("last_id")))
    take = F.when(F.col("last_hash").isNull(), 0).when(sooner, F.col("n_tokens")).when((F.col("h") == F.col("last_hash")) & same, F.least("n_tokens", "last_tokens")).otherwise(0)
    return rows.withColumn("h", h).select("doc_id", *names, "n_tokens", "budget", "epochs", take.cast("long").alias("prefix_tokens"))


def mixed(docs: DataFrame, levels: dict[str, Column], *, total: int | None = None, weights: dict[str, int] | None = None, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixture itself: the columns of `docs`, a row for each epoch that a document is in; the last
    document of a leaf's prefix has only its words up to the budget (and n_chars, if there, to match).

    Nulls, ties, repeated rows, long texts, weights and empty tables: as in mixture(). All columns are
    kept as they are, whatever their names.
    """
    names = list(levels)
    inner = {f"_l{k}": c for k, c in enumerate(levels.values())}
    slim = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in levels.items()], n_words(text_col).alias("n_tokens")), "mixture")
    decided = decide(slim, names, total=total, weights=weights or {}, max_epochs=max_epochs, seed=seed)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(id_col).cast("long").alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in inner.items()], n_words(text_col).alias("n_tokens"),
    )
    for k, n in zip(inner, names, strict=True):
        decided = decided.withColumnRenamed(n, k)
    on = reduce(lambda a, b: a & b, [F.col(f"w.{k}") == F.col(f"p.{k}") for k in inner])
    rows = whole.alias("w").join(checked(decided, LEAF_BYTES).alias("p"), on).select("w.*", "p.epochs", "p.last_hash", "p.last_id", "p.last_tokens")
    h = order_hash(seed, F.col("epochs"), F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("last_id"))
    sooner = (F.col("h") < F.col("last_hash")) | ((F.col("h") == F.col("last_hash")) & ~same & (F.col("doc_id") < F.col("last_id")))
    take = F.when(F.col("last_hash").isNull(), -1).when(sooner, F.col("n_tokens")).when((F.col("h") == F.col("last_hash")) & same, F.least("n_tokens", "last_tokens")).otherwise(-1)
    rows = rows.withColumn("h", h).withColumn("take", take)
    takes = F.concat(F.array_repeat(F.col("n_tokens"), F.col("epochs").cast("int")), F.when(F.col("take") >= 0, F.array("take")).otherwise(F.array().cast("array<long>")))
    rows = rows.select("d", "n_tokens", F.explode(takes).alias("take"))
    cut = F.col("take") < F.col("n_tokens")
    upto = F.array_join(F.slice(F.regexp_extract_all(F.col(f"d.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("take").cast("int")), "")
    text = F.when(cut, upto).otherwise(F.col(f"d.`{text_col}`"))
    cols = []
    for c in docs.columns:
        value = F.col(f"d.`{c}`")
        if c == text_col:
            value = text
        elif c == "n_chars":
            value = F.when(cut, F.length(upto).cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return rows.select(*cols)


def document_levels() -> dict[str, Column]:
    """The levels of `documents`: the number in a source's name, mod 4, stands for its domain."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.when(number == "", F.lit(NONE)).otherwise(F.concat(F.lit("d"), (number.try_cast("long") % 4).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Target weights of the registered query and the pipeline.
WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 2, "en": 6, "de": 2, "fr": 2, "es": 1}


def _sql_level(keys: list[str], above: str, weight: str) -> str:
    n = len(keys)
    k, parent = ", ".join(keys), ", ".join(keys[:-1])
    part = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
    name = keys[-1]
    return f"""
n{n} AS (SELECT {k}, sum(cap)::HUGEINT AS cap, {weight} AS weight FROM leaf GROUP BY {k}),
a{n} AS (SELECT n{n}.*, have FROM n{n} {join}),
b{n} AS (SELECT *, cap * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= weight * (have - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own FROM a{n}
  WINDOW w AS ({part} ORDER BY cap::DOUBLE / weight, {name})),
c{n} AS (SELECT *, bool_and(own) OVER ({part} ORDER BY cap::DOUBLE / weight, {name} ROWS UNBOUNDED PRECEDING) AS full_ FROM b{n}),
d{n} AS (SELECT *, greatest(0, have - coalesce(sum(cap) FILTER (full_) OVER ({part}), 0)) AS rest, sum(weight) FILTER (NOT full_) OVER ({part}) AS open_ FROM c{n}),
e{n} AS (SELECT *, CASE WHEN full_ THEN cap ELSE (weight * rest) // open_ END AS part_ FROM d{n}),
f{n} AS (SELECT {k}, part_ + CASE WHEN NOT full_ AND row_number() OVER ({part} ORDER BY full_, {name}) <= rest - sum(part_) FILTER (NOT full_) OVER ({part}) THEN 1 ELSE 0 END AS have FROM e{n})"""


#: The registered query in DuckDB SQL.
ORACLE = (
    rf"""
WITH slim AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN '{NONE}'
    ELSE 'd' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4)::VARCHAR END AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 4 AS cap FROM slim GROUP BY ALL),
root AS (SELECT sum(tokens) AS have FROM leaf),"""
    + _sql_level(["domain"], "root", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 2 ELSE 1 END")
    + ","
    + _sql_level(["domain", "lang"], "f1", "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")
    + ","
    + _sql_level(["domain", "lang", "source"], "f2", "1")
    + rf""",
plan AS (SELECT domain, lang, source, f3.have AS budget, CASE WHEN tokens > 0 THEN f3.have // tokens ELSE 0 END AS epochs, f3.have - (CASE WHEN tokens > 0 THEN f3.have // tokens ELSE 0 END) * tokens AS rest
  FROM leaf JOIN f3 USING (domain, lang, source)),
o AS (SELECT slim.*, budget, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY sha256('7:' || epochs::BIGINT::VARCHAR || ':' || doc_id::VARCHAR), doc_id
  ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM slim JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS budget, epochs::BIGINT AS epochs, greatest(0, least(n_tokens, rest - start))::BIGINT AS prefix_tokens FROM o"""
)
