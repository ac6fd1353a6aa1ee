"""The temporal operators on streams. A stream's rows come with times that may be late by `late`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, key: str, t: str, width: str, late: str = "0 seconds") -> DataFrame:
    """key, s, e, n, total of event-time windows that the watermark has passed."""
    grouped = events.withWatermark(t, late).groupBy(key, F.window(t, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n", "total")


def ordered_times(events: DataFrame, key: str, seq: str, t: str) -> DataFrame:
    """key, kept, nulls, duplicates after each micro-batch, rows taken by `seq`: a time before the latest
    is an error, an equal one is dropped and counted, so is a null. There is no tolerance for late rows."""

    def step(own: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, kept, nulls, duplicates = held.get if held.exists else (None, 0, 0, 0)
        for x in pd.concat(list(frames)).sort_values(seq)[t]:
            if pd.isna(x):
                nulls += 1
            elif last is not None and x < last:
                raise ValueError(f"time {x} of {own[0]} is before {last}")
            elif last is not None and x == last:
                duplicates += 1
            else:
                last, kept = float(x), kept + 1
        held.update((last, kept, nulls, duplicates))
        yield pd.DataFrame({"key": [own[0]], "kept": [kept], "nulls": [nulls], "duplicates": [duplicates]})

    out = "key long, kept long, nulls long, duplicates long"
    return events.groupBy(key).applyInPandasWithState(step, out, "last double, kept long, nulls long, duplicates long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream yields for all that is there now, by a memory sink."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
