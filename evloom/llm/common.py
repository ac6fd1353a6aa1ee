"""What the operators of this subpackage share: durable intermediate tables, size-checked joins and
Arrow batches by groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, own_dir, shared_dir  # noqa: F401  what the operators take from here
from ..session import settled as durable  # noqa: F401

#: A join side is broadcast up to so many bytes by count and stated width; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Fewer rows an Arrow batch where the session has Spark's default: texts and sets are long rows, and
    both ends hold a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "4000")


def removed(df: DataFrame) -> None:
    """Deletes the table that `df` reads, one that durable() wrote; what has been built on it is written by now."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/evloom/" not in folder:
            raise ValueError(f"{folder} is no intermediate table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (already durable) with a broadcast hint if its rows fit `most` bytes, else as it is.
    row_bytes: what a row takes in a join's hash table, 80 at least."""
    return F.broadcast(df) if df.count() * max(row_bytes, 80) <= most else df


def text_of(col: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and where each group begins; rows come sorted by `keys` (integers)."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def begins(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            x = rows.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.nonzero(new)[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = begins(batch)
        follows = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if held and not follows:
            rows, held = whole(), []
            yield rows, np.zeros(1, np.int64)
        if len(at) > 1:
            cut = at[1] if held else 0
            if held:
                held.append(batch.slice(0, cut))
                rows, held = whole(), []
                yield rows, np.zeros(1, np.int64)
            if at[-1] > cut:
                yield batch.slice(cut, at[-1] - cut), at[(at >= cut) & (at < at[-1])] - cut
            batch = batch.slice(at[-1])
        held.append(batch)
    if held:
        yield whole(), np.zeros(1, np.int64)


def bytes_of(values: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The buffer of a binary array without nulls, and where in it each value begins and the last ends."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    return data if data is not None else pa.py_buffer(b""), at


def sliced(data: pa.Buffer, cuts: np.ndarray) -> pa.Array:
    """The binary array of a buffer's stretches between cuts; nothing is copied."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), data])
