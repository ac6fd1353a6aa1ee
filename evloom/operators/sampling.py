"""Seeded sampling, batching and role export; every order is total."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from ..session import settled


def stratified_take(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 17) -> DataFrame:
    """`n` rows dealt round-robin from strata: rows in a stratum and strata themselves in hash order. An
    error, if there are fewer.

    Adds round and pick (both from 1). As no stratum gives more than n rows, the rank is cut at n, so
    that Spark keeps n rows a task and stratum before it shuffles.
    """
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.lit("row"), F.col(key)), key)
    ranked = rows.withColumn("round", F.row_number().over(order)).where(F.col("round") <= n)
    deal = [F.col("round"), hash_order(seed, F.lit("stratum"), F.col(stratum)), F.col(stratum)]
    taken = ranked.orderBy(*deal).limit(n).withColumn("pick", F.row_number().over(Window.orderBy(*deal)))  # n rows
    enough = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) == n
    return taken.withColumn("enough", enough).where(F.when(F.col("enough"), True).otherwise(F.raise_error(F.lit(f"fewer than {n} rows")).cast("boolean"))).drop("enough")


def first_per(rows: DataFrame, group: str, key: str, n: int, seed: int = 17) -> DataFrame:
    """The first `n` rows of each group in hash order, with their rank."""
    order = Window.partitionBy(group).orderBy(hash_order(seed, F.lit("row"), F.col(key)), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def global_rank(rows: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """rank (from 1) in a total order, without one task that holds all rows: ranges are sorted apart,
    counted, and shifted by the counts before them.

    The ranges' bounds come from a sample that each plan draws for itself, so the rows are written with
    their place and read again: counts and rows then tell of the same ranges.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_within", F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33) + 1).drop("_id")
    placed = settled(placed, "ranges")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row a partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_part", before.alias("_before"))  # as many rows as partitions: n at most
    return placed.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def batches(rows: DataFrame, key: str, size: int = 4, seed: int = 43) -> DataFrame:
    """batch and slot (from 0) of each row in hash order."""
    hashed = rows.withColumn("_h", hash_order(seed, F.col(key)))
    ranked = global_rank(hashed, ["_h", key]).withColumn("_at", F.col("rank") - 1)
    return ranked.select(*rows.columns, F.floor(F.col("_at") / size).alias("batch"), (F.col("_at") % size).alias("slot"))


def anonymous(rows: DataFrame, batch: str, key: str, seed: int = 43) -> DataFrame:
    """Adds anon ("a0", ...), by the hash order within a batch."""
    order = Window.partitionBy(batch).orderBy(hash_order(seed, F.col(batch), F.col(key)), key)
    return rows.withColumn("anon", F.concat(F.lit("a"), (F.row_number().over(order) - 1).cast("string")))


def twister_order(seed: Column, n: Column) -> Column:
    """0 to n - 1 as Python's random.Random(seed).shuffle() leaves them: the exact Fisher-Yates of its
    Mersenne twister. For short lists: the whole order is a value."""

    def order(seeds: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for s, k in zip(seeds.to_pylist(), sizes.to_pylist(), strict=True):
            own = list(range(k))
            random.Random(s).shuffle(own)
            out.append(own)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(order, "array<int>")(seed.cast("long"), n.cast("int"))


def anonymous_batches(rows: DataFrame, key: str, size: int = 4, seed: int = 43) -> tuple[DataFrame, DataFrame]:
    """The rows as a judge sees them, and what leads back: (batch, anon, all columns but `key`) and
    (batch, anon, key). Rows in hash order, `size` a batch; a batch that begins at row b is shuffled by
    the twister with seed + b, and its items are a0, a1, ... in that order. Keys are distinct."""
    placed = batches(rows, key, size, seed)
    sized = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("batch")).cast("int"))
    order = twister_order(F.lit(seed) + F.col("batch") * size, F.col("_n"))
    named = sized.withColumn("_o", order).withColumn("anon", F.concat(F.lit("a"), (F.array_position("_o", F.col("slot").cast("int")) - 1).cast("string")))
    named = named.drop("_o", "_n", "slot")
    return named.drop(key), named.select("batch", "anon", key)


def joined_back(verdicts: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """The verdicts (batch, anon, ...) by key; an error at a verdict for what no batch holds, or a second one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("batch", "anon"))
    met = verdicts.withColumn("_n", n).join(mapping, ["batch", "anon"], "left")
    fine = F.col(key).isNotNull() & (F.col("_n") == 1)
    return met.where(F.when(fine, True).otherwise(F.raise_error(F.lit("unknown or repeated anonymous id")).cast("boolean"))).drop("batch", "anon", "_n")
