"""Arrays of fixed shape in tables: struct(dtype, shape, data), little-endian and in C order, and NPZ files."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TENSOR = "struct<dtype:string,shape:array<int>,data:binary>"
_KIND = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())])


def as_tensor(x: np.ndarray) -> dict:
    x = np.ascontiguousarray(x)
    if x.dtype.hasobject:
        raise ValueError("an array of objects has no bytes of its own")
    x = x.astype(x.dtype.newbyteorder("<"))
    return {"dtype": x.dtype.str, "shape": list(x.shape), "data": x.tobytes()}


def as_array(t: dict) -> np.ndarray:
    """The array of a tensor; an error unless its bytes fit its type and shape."""
    kind = np.dtype(t["dtype"])
    if kind.hasobject or any(n < 0 for n in t["shape"]) or len(t["data"]) != kind.itemsize * math.prod(t["shape"]):
        raise ValueError(f"{len(t['data'])} bytes are no {t['dtype']} of shape {t['shape']}")
    return np.frombuffer(t["data"], kind).reshape(t["shape"])


def tensor(values: Column, dtype: str = "<f4", shape: list[int] | None = None) -> Column:
    """An array column as tensors; of the given shape, or flat. Null stays null; null elements are an error."""

    def pack(column: pa.Array) -> pa.Array:
        out = []
        for v in column:
            if not v.is_valid:
                out.append(None)
                continue
            if v.values.null_count:
                raise ValueError("a tensor has no nulls")
            out.append(as_tensor(v.values.to_numpy(zero_copy_only=False).astype(dtype).reshape(shape or [-1])))
        return pa.array(out, _KIND)

    return F.arrow_udf(pack, TENSOR)(values)


def flat(tensors: Column, dtype: str = "<f4", shape: list[int] | None = None) -> Column:
    """The elements of tensors as an array column; an error unless all are of this type (and shape, if given)."""
    kind = np.dtype(dtype)
    out_kind = {"f4": "float", "f8": "double", "i4": "int", "i8": "bigint"}[kind.str[1:]]

    def unpack(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            if t is None:
                out.append(None)
                continue
            x = as_array(t)
            if x.dtype != kind or (shape is not None and list(x.shape) != shape):
                raise ValueError(f"a {x.dtype.str} of shape {list(x.shape)} instead of {kind.str} {shape or ''}")
            out.append(x.reshape(-1))
        return pa.array(out, pa.list_(pa.from_numpy_dtype(kind.newbyteorder("="))))

    return F.arrow_udf(unpack, f"array<{out_kind}>")(tensors)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, name, tensor of every array in NPZ files; pickled objects are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    rows = [(at, name, as_tensor(held[name])) for name in held.files]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), _KIND))], ["path", "name", "tensor"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, name string, tensor {TENSOR}")


def npz(tensors: DataFrame, key: str) -> DataFrame:
    """key, content: the bytes of one NPZ file for each key of (key, name, tensor). A key's arrays are one file and pass one task."""

    @F.arrow_udf("binary")
    def pack(names: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for own, held in zip(names.to_pylist(), values.to_pylist(), strict=True):
            to = io.BytesIO()
            np.savez(to, **{n: as_array(t) for n, t in zip(own, held, strict=True)})
            out.append(to.getvalue())
        return pa.array(out, pa.binary())

    own = tensors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "tensor"))).alias("r"))
    return own.select(key, pack(F.col("r.name"), F.col("r.tensor")).alias("content"))
