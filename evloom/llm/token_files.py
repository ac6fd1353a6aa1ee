"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart from data bytes.

An id is replaced by its rank by frequency (ties: smaller id first), so the commonest 256 ids take
one byte. A block holds whole documents in ascending id order: the number of ids of each, the
control bytes (four 2-bit lengths each, low bits first; 1 to 4 bytes a value) and the data bytes
(little-endian). Blocks are rows of Parquet part files, sorted by (shard, block), so that Spark's own
readers and writers carry them on any store, with task commit and retry. Beside them lies a header:
the format's version, the end id, the tokenizer file's SHA-256 and the id of every rank. A path is all
that reading takes. Decoding is by numpy: a 256-row table gives the four lengths of a control byte.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import bytes_of, checked, durable, own_dir, small_batches

TOKENS = "doc_id long, n long, ids binary"
BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
HEADER = "version int, end_id long, tokenizer_sha256 string, by_rank binary"
VERSION = 1
#: A block is closed at so many ids; a longer document is a block by itself.
BLOCK_IDS = 1 << 18
#: The byte lengths that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    r = ranks.astype("<u4")
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that encode_ranks() wrote."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (little-endian, as wide as the vocabulary needs), the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                ids, n = enc.ended(part.column("text"), end_id)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), ids], ["doc_id", "n", "ids"])

    return docs.mapInArrow(run, TOKENS)


def frequencies(tokens: DataFrame, width: int, size: int) -> DataFrame:
    """token, n: how often each id occurs; one row an id and task goes into the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                data, at = bytes_of(batch.column("ids"))
                seen += np.bincount(np.frombuffer(data, f"<u{width}", (at[-1] - at[0]) // width, at[0]), minlength=size)
        at = np.nonzero(seen)[0]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at])], ["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int = 1, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenises `docs` and writes the files in ascending id order; gives their path (by default one of
    its own in the shared folder).

    Null text: the end id alone. Null id: first. Repeated ids: side by side, by their ids' bytes;
    repeated rows: each written. Empty table: no blocks. Very long texts: a block each. Other columns,
    whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    spark, enc = docs.sparkSession, encoder(tokenizer)
    path = path or f"{own_dir(spark)}/token-files-{uuid.uuid4().hex}"
    width, size = enc.dtype.itemsize, max(enc.size, end_id + 1)
    tokens = durable(tokenised(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), tokenizer, end_id), "tokens", "zstd")
    seen = np.zeros(size, np.int64)
    for row in frequencies(tokens, width, size).collect():  # as many rows as the vocabulary has, at most
        seen[row.token] = row.n
    by_rank = np.lexsort((np.arange(size), -seen)).astype("<u4")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, n = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc ids, lengths, ids

        def out() -> pa.RecordBatch:
            control, data = encode_ranks(shared.value[np.concatenate([x for _, _, x in held])])
            own, lengths = pa.concat_arrays([i for i, _, _ in held]), np.concatenate([k for _, k, _ in held])
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([n]), one(own, pa.int64()), one(pa.array(lengths), pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.record_batch(row, [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = bytes_of(batch.column("ids"))
            ids, own = np.frombuffer(data, f"<u{width}", (at[-1] - at[0]) // width, at[0]), batch.column("doc_id")
            at = (at - at[0]) // width
            sizes, first = np.diff(at), 0
            hold = lambda a, b: held.append((own.slice(a, b - a), sizes[a:b], ids[at[a] : at[b]])) if b > a else None  # noqa: B023, E731
            for k, size in enumerate(sizes.tolist()):
                if n and n + size > block_ids:
                    hold(first, k)
                    yield out()
                    block, before, n, held, first = block + 1, before + n, 0, [], k
                n += size
            hold(first, len(sizes))
        if held:
            yield out()

    # Ids that many rows share are told apart by how their tokens begin.
    ordered = tokens.repartitionByRange("doc_id", F.substring("ids", 1, 16)).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    with open(tokenizer, "rb") as f:
        sha = hashlib.sha256(f.read()).hexdigest()
    spark.createDataFrame([(VERSION, end_id, sha, by_rank.tobytes())], HEADER).coalesce(1).write.parquet(f"{path}/header")
    return path


def decode_block(lengths: np.ndarray, control: bytes, data: bytes, n: int, by_rank: np.ndarray) -> list[np.ndarray]:
    """The ids of each document of a block."""
    return np.split(by_rank[decode_ranks(control, data, n)], np.cumsum(lengths)[:-1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files at `path`."""
    header = spark.read.schema(HEADER).parquet(f"{path}/header").first()
    if header.version != VERSION:
        raise ValueError(f"files of version {header.version}; this reads version {VERSION}")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(np.frombuffer(header.by_rank, "<u4"))
    # One row a shard: as many as the write had tasks.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = durable(shards.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("shard", "before", "n_ids", "doc_ids", "lengths", "control", "data")}
                lengths, start = row["lengths"].values.to_numpy(), row["before"].as_py()
                ids = shared.value[decode_ranks(row["control"].as_buffer(), row["data"].as_buffer(), row["n_ids"].as_py())]
                at = np.concatenate([[0], np.cumsum(lengths)])
                wide, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), (at * 4).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                shard = pa.array(np.full(len(lengths), row["shard"].as_py(), np.int32))
                yield pa.record_batch([shard, row["doc_ids"].values, pa.array(at[:-1] + start), pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "before", "n_ids", "doc_ids", "lengths", "control", "data").mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(checked(shards, 80), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
