"""Exact dedup as a tree-merge of digest runs, in DataFrame operations only.

Every scan partition yields a run: its distinct digests in order, each with the best identifier and
the row count (sorted and combined before anything is exchanged). Runs meet in rounds of `fan_in`:
round k merges the runs whose numbers agree after k divisions. A round's exchange is keyed by
(digest, run), and the sorted aggregate behind it merges the parts of the runs that arrive, so a
digest held by a third of all rows arrives as at most `fan_in` rows a key, never as its rows. The last
round leaves one run. The verdict goes down the same way: to the first-level runs (a row a digest and
scan partition) and from them to the rows, joined by (digest, run), so that the rows of a hot digest
stay dealt over all partitions.

A digest is verified at every level: runs are merged by SHA-256 together with the byte length and a
second, independent 64-bit hash, so two texts would have to agree in all three to be taken as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, durable, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["digest", "n_bytes", "check"]


def normalised(text: str = "text") -> Column:
    """The text with A-Z in lower case and all else as it is; null is empty. Where lower() touches
    nothing but A-Z (a text of ASCII bytes only) its byte loop serves, else translate()."""
    t = text_of(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row for each row of `docs`: id, digest, n_bytes, check."""
    norm = normalised(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id", F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check")
    )


def tree_merge(rows: DataFrame, runs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The first level's runs and the last run: KEY, run, best (struct of id and uid), size."""
    level = rows.groupBy(*KEY, "run").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("size"))
    first, left = level, runs
    while left > 1:
        left = -(-left // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy(*KEY, "run")
        level = level.agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    return first, level.drop("run")


def exact_dedup(docs: DataFrame, *, runs: int = 64, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    runs: the runs that the rounds are for, at least; as many as there are scan partitions, if more.

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the row with the
    largest id stays. Null text: empty. Null id: smaller than any id (a group of null ids only has
    a null keep_id). Repeated rows: exactly one row of a group has kept = true, whichever of the
    identical ones. Very long texts: whole. Empty table: no rows. Other columns, whatever their
    names, are not read.
    """
    slim = digests(docs, id_col, text_col).select(
        "*", F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().cast("long").alias("run")
    )
    slim = durable(slim, "digests")
    scanned = slim.agg(F.max("run")).first()[0] or 0
    first, last = tree_merge(slim, max(runs, scanned + 1), fan_in)
    verdict = first.select(*KEY, "run").join(last, KEY)
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"v.{k}") for k in [*KEY, "run"]])
    return (
        slim.alias("s")
        .join(verdict.alias("v"), same)
        .select(
            F.col("s.doc_id").alias("doc_id"),
            F.col("v.best.doc_id").alias("keep_id"),
            F.col("v.size").alias("group_size"),
            (F.col("s.uid") == F.col("v.best.uid")).alias("kept"),
            F.lower(F.hex("s.digest")).alias("text_sha256"),
        )
    )


def keep_distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` without the rows that exact_dedup() drops, all columns as they were, whatever their names.

    Nulls, ties, repeated rows, long texts and empty tables: as in exact_dedup().
    """
    verdict = durable(exact_dedup(docs, id_col=id_col, text_col=text_col, **how), "verdict")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeats = verdict.where(stays & ~F.col("kept")).limit(1).count()
    gone = durable(verdict.where(~stays).select("doc_id", F.unhex("text_sha256").alias("digest")).distinct(), "gone")
    doc_id = F.col(f"d.`{id_col}`")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.unhex(F.sha2(normalised(text_col), 256)).alias("h"))
    out = tagged.join(checked(gone, 64).alias("g"), doc_id.eqNullSafe(F.col("g.doc_id")) & (F.col("h") == F.col("g.digest")), "left_anti")
    if repeats:  # rows that share both id and text: one of them stays
        out = out.groupBy(doc_id.alias("i"), "h").agg(F.first("d").alias("d"))
    return out.select([F.col(f"d.`{c}`").alias(c) for c in docs.columns])
