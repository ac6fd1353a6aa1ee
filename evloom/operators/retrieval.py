"""Exact vector retrieval and complementary-set selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..session import settled
from .intervals import capped_cover

#: Bytes of query vectors that go to every task at a time, and of scores that a task computes at a time.
QUERY_BYTES, SCORE_BYTES = 16 << 20, 32 << 20
SCORED = "query_id long, item_id long, score double"


def topk(items: DataFrame, queries: DataFrame, k: int, dim: int, exclude: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, score, rank: the k items of greatest cosine for each query, ties by id.

    items, queries: (id, v); an id that repeats among items is an error. exclude: (query_id, item_id)
    pairs that don't count. Queries go to the tasks in blocks of bounded size; each task multiplies its
    items with a block, in tiles of bounded size, and passes on k rows a query, so the shuffle has k
    rows a task and query, never all pairs.
    """
    if items.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an item id stands in two rows")
    spark = items.sparkSession
    per_block = max(1, QUERY_BYTES // (8 * dim))
    width = k + (exclude.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0 if exclude is not None else 0)
    found, block = None, []

    def ask(block: list) -> DataFrame:
        q = np.array([r.v for r in block], float).reshape(-1, dim)
        norm = np.linalg.norm(q, axis=1)
        if not np.isfinite(norm).all() or (norm == 0).any():
            raise ValueError("cosine needs finite nonzero vectors")
        shared = spark.sparkContext.broadcast((np.array([r.id for r in block]), q / norm[:, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s, best_i = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
            tile = max(1, SCORE_BYTES // (8 * len(ids)))
            for batch in (b.slice(lo, tile) for b in batches for lo in range(0, b.num_rows, tile)):
                v = np.array(batch.column("v").to_pylist(), float).reshape(-1, dim)
                norm = np.linalg.norm(v, axis=1)
                if not np.isfinite(norm).all() or (norm == 0).any():
                    raise ValueError("cosine needs finite nonzero vectors")
                s = np.concatenate([best_s, q @ (v / norm[:, None]).T], 1)
                i = np.concatenate([best_i, np.broadcast_to(batch.column("id").to_numpy(), (len(ids), len(v)))], 1)
                order = np.lexsort((i, -s), axis=1)[:, :width]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            n = best_s.shape[1]
            yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], ["query_id", "item_id", "score"])

        return items.select("id", "v").mapInArrow(run, SCORED)

    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == per_block:
            found, block = (ask(block) if found is None else found.unionByName(ask(block))), []
    if block:
        found = ask(block) if found is None else found.unionByName(ask(block))
    if found is None:
        found = spark.createDataFrame([], SCORED)
    if exclude is not None:
        found = found.join(exclude, ["query_id", "item_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def plain_and_refined(items: DataFrame, first: DataFrame, refined: DataFrame, dim: int) -> DataFrame:
    """method, question, ids: R0, a question's six nearest items; R1, its three nearest and then three
    others that are nearest to its refined question. first: (id, v); refined: (id, v, question). An
    item with a question's own id isn't an answer to it."""
    own = lambda q: q.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    six = topk(items, first.select("id", "v"), 6, dim, own(first)).select(F.col("query_id").alias("question"), "item_id", "rank")
    three = six.where("rank <= 3")
    asks = refined.select(F.col("id").alias("query_id"), "question")
    taken = own(refined).unionByName(three.join(asks, "question").select("query_id", "item_id"))
    more = topk(items, refined.select("id", "v"), 3, dim, taken).join(asks, "query_id").select("question", "item_id", (F.col("rank") + 3).alias("rank"))
    rows = six.withColumn("method", F.lit("R0")).unionByName(three.unionByName(more).withColumn("method", F.lit("R1")))
    lists = rows.groupBy("method", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return lists.select("method", "question", F.col("l.item_id").alias("ids"))


def four_methods(items: DataFrame, questions: DataFrame, gaps: DataFrame, masks: Callable[[DataFrame], DataFrame], dim: int, n_groups: int, store: int = 32, cap: int = 6) -> DataFrame:
    """method, question, ids of R0 (the `cap` nearest items), R1 (three, and three others that are nearest to
    the question's first gap), R2 (three, and the complementary set for all its gaps) and R* (the smallest cover
    of the known groups within the `store` nearest, filled up by relevance).

    questions: (id, v); gaps: (id, v, question), of which the question itself may be one. Neither the question
    nor a gap of it answers it. masks: gives (question, item_id, rank, mask) for (question, item_id, rank),
    the groups as bits.
    """
    asks = gaps.select(F.col("id").alias("query_id"), "question")
    whose = asks.unionByName(questions.select(F.col("id").alias("query_id"), F.col("id").alias("question"))).distinct()
    own = whose.join(whose.select(F.col("query_id").alias("item_id"), "question"), "question")
    near = settled(topk(items, questions.select("id", "v"), store, dim, own.where("query_id = question").select("query_id", "item_id")).select(F.col("query_id").alias("question"), "item_id", "rank"), "store")
    three = near.where("rank <= 3")
    taken = own.select("query_id", "item_id", "question").join(asks, ["query_id", "question"], "left_semi").select("query_id", "item_id")
    taken = taken.unionByName(three.join(asks, "question").select("query_id", "item_id")).distinct()
    more = settled(topk(items, gaps.select("id", "v"), 6, dim, taken), "gaps")
    first = gaps.where("id <> question").groupBy("question").agg(F.min("id").alias("query_id"))
    extra = more.join(first, "query_id").where("rank <= 3").select("question", "item_id", (F.col("rank") + 3).alias("rank"))
    rows = near.where(F.col("rank") <= cap).withColumn("method", F.lit("R0")).unionByName(three.unionByName(extra).withColumn("method", F.lit("R1")))
    set_of = complement(pool(more, asks.withColumnRenamed("question", "group_id"), items, gaps.select("id", "v")))
    joint = set_of.select(F.col("group_id").alias("question"), F.posexplode("ids").alias("place", "item_id")).select("question", "item_id", (F.col("place") + 4).alias("rank"))
    rows = rows.unionByName(three.unionByName(joint).withColumn("method", F.lit("R2")))
    lists = rows.groupBy("method", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l")).select("method", "question", F.col("l.item_id").alias("ids"))
    held = settled(masks(near), "masks")
    best = capped_cover(held.select("question", "item_id", "mask"), held.select("question", "item_id", "rank"), "question", "item_id", n_groups, cap)
    return lists.unionByName(best.select(F.lit("R*").alias("method"), "question", "ids"))


def pool(near: DataFrame, members: DataFrame, items: DataFrame, queries: DataFrame, most: int = 8) -> DataFrame:
    """group_id, item_id, v, sims: up to `most` items of a group's candidates by greatest relevance.

    near: topk()'s rows; members: (group_id, query_id); sims: the item's cosine with each of the
    group's queries, by query_id. A group has `most` rows, so what follows is small.
    """
    one = near.join(members, "query_id").select("group_id", "item_id").distinct()
    scored = one.join(members, "group_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = scored.join(items.select(F.col("id").alias("item_id"), "v"), "item_id")
    sims = scored.groupBy("group_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("query_id", cosine(F.col("v"), F.col("q")).alias("c")))).alias("s"), F.first("v").alias("v"))
    sims = sims.select("group_id", "item_id", "v", F.col("s.c").alias("sims"))
    order = Window.partitionBy("group_id").orderBy(F.desc(F.array_max("sims")), "item_id")
    return sims.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def complement(pooled: DataFrame, alpha: float = 0.2) -> DataFrame:
    """group_id, ids, score: the three items (or all, if fewer) of a pool with the greatest coverage of
    the group's queries less alpha times their mean mutual cosine; ties by ids."""
    n = pooled.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    a, b, c = (pooled.select("group_id", *[F.col(x).alias(f"{x}_{k}") for x in ("item_id", "v", "sims")]) for k in "abc")
    best = lambda *s: F.aggregate(F.array(*s), F.col(s[0]), lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(p, q)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    two = a.join(b, "group_id").where("item_id_a < item_id_b").withColumn("ab", cosine(F.col("v_a"), F.col("v_b")))
    three = two.join(c, "group_id").where("item_id_b < item_id_c")
    red3 = (F.col("ab") + cosine(F.col("v_a"), F.col("v_c")) + cosine(F.col("v_b"), F.col("v_c"))) / 3
    trio = three.select("group_id", F.array("item_id_a", "item_id_b", "item_id_c").alias("ids"), (total(best("sims_a", "sims_b", "sims_c")) - alpha * red3).alias("score"))
    duo = two.join(n.where("n = 2"), "group_id").select("group_id", F.array("item_id_a", "item_id_b").alias("ids"), (total(best("sims_a", "sims_b")) - alpha * F.col("ab")).alias("score"))
    solo = a.join(n.where("n = 1"), "group_id").select("group_id", F.array("item_id_a").alias("ids"), total(F.col("sims_a")).alias("score"))
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), "ids")
    every = trio.unionByName(duo).unionByName(solo)
    return every.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def redundancy(chosen: DataFrame, items: DataFrame) -> DataFrame:
    """group_id, mean_pair: the mean cosine of the pairs in ids; null for one item."""
    one = chosen.select("group_id", F.explode("ids").alias("id")).join(items.select("id", "v"), "id")
    pairs = one.alias("a").join(one.alias("b"), "group_id").where("a.id < b.id")
    means = pairs.groupBy("group_id").agg(F.avg(cosine(F.col("a.v"), F.col("b.v"))).alias("mean_pair"))
    return chosen.select("group_id").join(means, "group_id", "left")
