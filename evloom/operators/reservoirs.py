"""Algorithm R as relations: the draw for a key's n-th row comes from a hash of (seed, key, n) alone, so any
engine, and any stream that resumes, draws the same; no generator is carried along."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: int, n: int) -> int:
    """A number below n: 60 bits of SHA-256, modulo n."""
    return int(hashlib.sha256(f"{seed}:{key}:{n}".encode()).hexdigest()[:15], 16) % n


def reservoir_steps(rows: DataFrame, key: str, order: str, item: str, payload: str, k: int, cap: int, seed: int = 17) -> DataFrame:
    """key, item, n, slot, prefix_hash of each row by (order, item): the n-th row of its key that fits takes
    the slot, if any; prefix_hash is the hash of {"seen":n,"slots":[payloads by slot]} after it. Payloads
    (JSON) of over `cap` bytes are refused: n, slot and hash are null, and they don't count."""
    fits = rows.select(F.col(key).cast("long").alias("key"), F.col(order).alias("o"), F.col(item).cast("long").alias("item"), F.col(payload).alias("payload")).withColumn("fits", F.octet_length("payload") <= cap)
    w = Window.partitionBy("key").orderBy("o", "item")
    n = F.when(F.col("fits"), F.sum(F.col("fits").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "key", "n"), 256), 1, 15), 16, 10).cast("long") % F.col("n")
    at = F.when(F.col("n") <= k, F.col("n") - 1).otherwise(drawn)
    placed = fits.withColumn("n", n).withColumn("at", at).withColumn("slot", F.when(F.col("at") < k, F.col("at").cast("int")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    held = [F.last(F.when(F.col("slot") == j, F.col("payload")), ignorenulls=True).over(so_far).alias(f"s{j}") for j in range(k)]
    text = F.concat(F.lit('{"seen":'), F.col("n").cast("string"), F.lit(',"slots":['), F.concat_ws(",", *[f"s{j}" for j in range(k)]), F.lit("]}"))
    return placed.select("*", *held).select("key", "item", "n", "slot", F.sha2(text, 256).alias("prefix_hash"))


def reservoir_slots(rows: DataFrame, key: str, order: str, item: str, payload: str, k: int, cap: int, seed: int = 17) -> DataFrame:
    """key, slot, item, payload of what is held in the end: the last row to take each slot."""
    steps = reservoir_steps(rows, key, order, item, payload, k, cap, seed).where("slot is not null").select("key", "slot", "n", "item")
    last = steps.groupBy("key", "slot").agg(F.max_by("item", "n").alias("item"))
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(item).cast("long").alias("item"), F.col(payload).alias("payload"))
    return last.join(own, ["key", "item"]).select("key", "slot", "item", "payload")
