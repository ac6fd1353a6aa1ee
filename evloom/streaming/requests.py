"""A stream's requests, each reserved before it is called and called at most once, whatever is killed when.

A micro-batch has a folder for its reservations and one for its results, by batch id. Reservations are
written whole before the first call; results are written whole behind the last. A restarted stream is given
the batch anew and finds one of three: results (done, nothing happens), reservations alone (the calls may
have been made: all are unresolved, are charged in full and never called again), or neither (no call was
made). Calls run in tasks that read the reservations and shuffle nothing, so only a task's own failure
starts it again, and then it calls nothing. Leave spark.speculation off, or copies will leave requests unresolved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import ANSWER, Client, called, exists

RESERVED = "key string, prompt string, input_tokens long, max_output_tokens long"


def committed(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/_SUCCESS")


def reserved_before(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Keys that other batches have reserved."""
    path = f"{root}/reservations"
    if not exists(spark, path):
        return spark.createDataFrame([], "key string")
    return spark.read.schema(f"{RESERVED}, batch long").parquet(path).where(F.col("batch") != batch).select("key")


def request_sink(root: str, make: Callable[[], Client]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of RESERVED. A key that came before, in this batch or another, is not asked again."""

    def sink(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        reservations, results = f"{root}/reservations/batch={batch}", f"{root}/results/batch={batch}"
        if committed(spark, results):
            return
        if committed(spark, reservations):
            lost = F.lit("stopped between reservation and result")
            held = spark.read.schema(RESERVED).parquet(reservations)
            out = held.select("key", F.lit("unresolved").alias("state"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("long").alias("output_tokens"), lost.alias("error"))
        else:
            names = [x.split()[0] for x in RESERVED.split(", ")]
            fresh = rows.select(*names).dropDuplicates(["key"]).join(reserved_before(spark, root, batch), "key", "left_anti")
            fresh.write.mode("overwrite").parquet(reservations)
            out = called(spark.read.schema(RESERVED).parquet(reservations), make, once=True)
        out.write.mode("overwrite").parquet(results)

    return sink


def request_ledger(spark: SparkSession, root: str) -> DataFrame:
    """key, batch, state, response, output_tokens, error, charged of every reservation: what was used where
    that is known, else the whole reservation. A reservation without result is pending."""
    held = spark.read.schema(f"{RESERVED}, batch long").parquet(f"{root}/reservations")
    path = f"{root}/results"
    done = spark.read.schema(f"{ANSWER}, batch long").parquet(path) if exists(spark, path) else spark.createDataFrame([], f"{ANSWER}, batch long")
    met = held.join(done, ["key", "batch"], "left")
    charged = F.col("input_tokens") + F.coalesce("output_tokens", "max_output_tokens")
    return met.select("key", "batch", F.coalesce("state", F.lit("pending")).alias("state"), "response", "output_tokens", "error", charged.alias("charged"))


def answer_stream(requests: DataFrame, root: str, make: Callable[[], Client]) -> None:
    """Answers all that a stream has now; called again with the same root, it goes on where it was stopped."""
    writer = requests.writeStream.foreachBatch(request_sink(root, make)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
