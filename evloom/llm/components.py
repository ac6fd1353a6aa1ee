"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label for every node of `links` (a long, b long); label is the least node reachable.

    A round gives each node the least label among its neighbours, then the label of its label.
    Rounds end when nothing changes; every round is written, so none is lost with an executor. Raises
    where `rounds` are not enough, which takes chains of 2**rounds links or so.
    """
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("above"))
        step = step.join(roots, F.col("new") == F.col("root"), "left").select("node", "label", F.least("new", F.coalesce("above", "new")).alias("new"))
        step = durable(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if not step.where("new < label").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
