"""Requests to a model or service behind a cache by content, with a client that the caller gives.

`make()` builds a client in each task: a function from a prompt to (response, tokens). What it raises is
that request's failure and nothing else's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

Client = Callable[[str], tuple[str, int]]
ANSWER = "key string, state string, response string, output_tokens long, error string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def called(prompts: DataFrame, make: Callable[[], Client], once: bool = False) -> DataFrame:
    """ANSWER of (key, prompt): complete, or failed with the error. once: a task that Spark starts again
    calls nothing, since its first attempt may have; its requests are unresolved. A null prompt fails uncalled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = once and TaskContext.get().attemptNumber() > 0
        client = None if again else make()
        for batch in batches:
            out = []
            for key, prompt in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                if again:
                    out.append((key, "unresolved", None, None, "task attempted before"))
                elif prompt is None:
                    out.append((key, "failed", None, None, "no prompt"))
                else:
                    try:
                        response, tokens = client(prompt)
                        out.append((key, "complete", response, tokens, None))
                    except Exception as e:  # the client's own errors, of any kind, are data
                        out.append((key, "failed", None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "state", "response", "output_tokens", "error"])

    return prompts.select("key", "prompt").mapInArrow(run, ANSWER)


def answered(rows: DataFrame, prompt: str, make: Callable[[], Client], root: str, model: str = "") -> DataFrame:
    """`rows` with request_key, state, response, output_tokens, error, cached.

    Each distinct prompt (with `model`, which names what answers) that the cache under `root` doesn't hold is
    asked once, whatever the number of its rows; complete answers are added to the cache, failures to
    another table, and asked again the next time. cached: the answer was there before. A null prompt fails.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("request_key", F.sha2(F.concat_ws("\x1f", F.lit(model), F.coalesce(F.col(prompt), F.lit(""))), 256))
    known = settled(read_or_empty(spark, f"{root}/answers", ANSWER).dropDuplicates(["key"]), "known")
    asked = keyed.where(F.col(prompt).isNotNull()).select(F.col("request_key").alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
    made = settled(called(asked.join(known, "key", "left_anti"), make), "made")  # each is called once, here
    made.where("state = 'complete'").write.mode("append").parquet(f"{root}/answers")
    made.where("state <> 'complete'").withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(f"{root}/failures")
    every = known.withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False)))
    out = keyed.join(every, (F.col("request_key") == F.col("key")) & F.col(prompt).isNotNull(), "left").drop("key")
    none = F.col(prompt).isNull()
    return out.withColumns({"state": F.when(none, "failed").otherwise(F.col("state")), "error": F.when(none, "no prompt").otherwise(F.col("error")), "cached": F.coalesce("cached", F.lit(False))})
