"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens: its documents in the order they were tokenised. Queues are served at
rates in proportion to their weights until they run dry, and what is left of them then serves the
others; so how much of each queue comes before any point of the whole is a closed form of the queues'
totals. It is used in two levels, and neither needs a plan of all windows:

* Blocks of `windows` windows. A document is cut where its queue's share of a block ends; every task
  finds these places by itself. What rounding down owes a queue at the end of a block is in its share
  of the next, so deficits carry over from block to block and from partition to partition.
* Rounds inside a block. The task that owns a block serves every queue once a round, a round a
  window, with its share of that window (fractions are carried to the next round). A queue whose share
  is under `grain` tokens waits until it has as many.

So every window has each source's share to within a few tokens or a grain, and all blocks have the
same size whatever the sources' sizes: a source with a third of all rows is spread over all blocks.
Text is tokenised once; ids cross the network once, to their block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import bytes_of, checked, durable, groups, sliced, small_batches

TOKENS = "task int, queue string, before long, row_id long, doc_id long, n long, ids binary"
SEGMENTS = "block long, q long, p long, row_id long, doc_id long, start long, doc_tokens long, ids binary"
#: What sequences() gives: the ids of each piece, and the row that they are from.
SEQUENCES = "row_id long, doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Queues whose places in a block are worked out at a time.
QUEUES = 4096
#: Bytes of text encoded at a time; arrays of many times that size are made of them.
TEXTS = 2 << 20


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, task: int) -> Iterator[pa.RecordBatch]:
    """TOKENS' columns of a task's documents, TEXTS bytes of text (one document at least) at a time."""
    enc = encoder(tokenizer)
    before: dict[str, int] = defaultdict(int)
    row = task << 33
    for batch in batches:
        for part in slices(batch, most=TEXTS):
            ids, n = enc.ended(part.column("text"), end_id)
            queue = ["" if q is None else "=" + q for q in part.column("queue").to_pylist()]
            at = []
            for q, k in zip(queue, n.tolist(), strict=True):
                at.append(before[q])
                before[q] += k
            row_ids = np.arange(row, row + len(n))
            row += len(n)
            yield pa.record_batch(
                [pa.array([task] * len(n), pa.int32()), pa.array(queue, pa.string()), pa.array(at, pa.int64()), pa.array(row_ids), part.column("doc_id"), pa.array(n), ids],
                [x.split()[0] for x in TOKENS.split(", ")],
            )
    # The worker stays for other stages, which shouldn't find its memory taken.
    pa.default_memory_pool().release_unused()


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row for each document: its number, task, queue, the tokens before it in this task's part of the queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, tokenizer, end_id, TaskContext.get().partitionId())

    return docs.mapInArrow(run, TOKENS)


@dataclass
class Deal:
    """How many tokens of each queue come before each window. Queues have a token at least.

    A queue is served from time `start` on, `rate` tokens a unit of time. Queues of weight 0 start
    when all others are dry, in proportion to their tokens.
    """

    total: np.ndarray
    weight: np.ndarray
    size: int  # of a window
    windows: int  # of a block

    def __post_init__(self) -> None:
        first = self.weight > 0
        self.rate = np.where(first, self.weight, self.total).astype(float)
        dry = float((self.total[first] / self.rate[first]).max()) if first.any() else 0.0
        self.start = np.where(first, 0.0, dry)
        self.end = self.start + self.total / self.rate
        self.everything = int(self.total.sum())
        self.when = np.unique(np.concatenate([self.start, self.end, [0.0]]))
        # Time by time, the sum over queues of what has been served: rates change at starts and ends only.
        change = np.zeros(len(self.when))
        np.add.at(change, np.searchsorted(self.when, self.start), self.rate)
        np.add.at(change, np.searchsorted(self.when, self.end), -self.rate)
        pace = np.maximum(np.cumsum(change)[:-1], 1e-300)
        self.moved = np.concatenate([[0.0], np.cumsum(pace * np.diff(self.when))])
        self.unit = 1 / pace

    def taken(self, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Tokens of queues q before windows w; the same for a pair in whatever arrays it stands."""
        x = (w * self.size).astype(float)
        j = np.clip(np.searchsorted(self.moved, x, "right") - 1, 0, len(self.unit) - 1)
        t = np.minimum(self.when[j] + (x - self.moved[j]) * self.unit[j], self.when[j + 1])
        share = np.clip(np.floor((t - self.start[q]) * self.rate[q]), 0, self.total[q])
        return np.where((w * self.size >= self.everything) | (t >= self.end[q]), self.total[q], share).astype(np.int64)

    def block_of(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The block of token p of queue q."""
        x = np.interp(self.start[q] + p / self.rate[q], self.when, self.moved)
        b = np.clip((x // (self.size * self.windows)).astype(np.int64), 0, (self.everything - 1) // (self.size * self.windows))
        while True:
            late, soon = self.taken(q, b * self.windows) > p, self.taken(q, (b + 1) * self.windows) <= p
            if not (late | soon).any():
                return b
            b = b - late + (soon & ~late)


def stretches(deal: Deal, block: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What serves the block, in order: queue, from and to (tokens of the queue). Every queue is served
    once a window; one with a share under `grain` when it has so many, at a time of its own. Only queues
    with tokens in this block are looked at, so many at a time, however many there are."""
    first = block * deal.windows
    count = min(deal.windows, -(-(deal.everything - first * deal.size) // deal.size))
    every, w = np.arange(len(deal.total)), np.arange(first, first + count + 1)
    live = np.nonzero(deal.taken(every, np.full(len(every), first + count)) > deal.taken(every, np.full(len(every), first)))[0]
    parts = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    for at in range(0, len(live), QUEUES):
        own = live[at : at + QUEUES]
        upto = deal.taken(own[:, None], w[None, :])
        few = np.nonzero(upto[:, -1] - upto[:, 0] < grain * count)[0]
        turn = (own[few] * 0.6180339887 % 1 * grain).astype(np.int64)[:, None]
        upto[few, 1:-1] = np.clip((upto[few, 1:-1] + turn) // grain * grain, upto[few, :1], upto[few, -1:])
        i, k = np.nonzero(upto[:, 1:] > upto[:, :-1])
        parts.append((k, own[i], upto[i, k], upto[i, k + 1]))
    k, q, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((q, k))
    return q[order], lo[order], hi[order]


def cut(rows: pa.RecordBatch, at: dict[str, int], deal: Deal, width: int) -> pa.RecordBatch:
    """SEGMENTS' columns: documents cut where blocks end; the ids aren't copied."""
    q = np.array([at[x] for x in rows.column("queue").to_pylist()], np.int64)
    p, n = rows.column("start").to_numpy(), rows.column("n").to_numpy()
    first, last = deal.block_of(q, p), deal.block_of(q, p + n - 1)
    times = last - first + 1
    of = np.repeat(np.arange(len(q)), times)
    b = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    lo, hi = np.maximum(p[of], deal.taken(q[of], b * deal.windows)), np.minimum(p[of] + n[of], deal.taken(q[of], (b + 1) * deal.windows))
    some = hi > lo
    of, b, lo, hi = of[some], b[some], lo[some], hi[some]
    data, offsets = bytes_of(rows.column("ids"))
    cuts = np.append(offsets[of] + (lo - p[of]) * width, offsets[-1])
    own = rows.select(["row_id", "doc_id", "n"]).take(pa.array(of))
    return pa.record_batch(
        [pa.array(b), pa.array(q[of]), pa.array(lo), own.column("row_id"), own.column("doc_id"), pa.array(lo - p[of]), own.column("n"), sliced(data, cuts)], [x.split()[0] for x in SEGMENTS.split(", ")]
    )


def lay(rows: pa.RecordBatch, deal: Deal, grain: int, width: int) -> pa.RecordBatch:
    """SEQUENCES' columns of one block's segments, which come by queue and place."""
    block, size, every = rows.column("block")[0].as_py(), deal.size, np.arange(len(deal.total))
    start = deal.taken(every, np.full(len(every), block * deal.windows))
    base = int(start.sum())
    data, offsets = bytes_of(rows.column("ids"))
    begin = (offsets - offsets[0]) // width  # of segments, and the end of all
    stream = np.frombuffer(data, f"<u{width}", begin[-1], offsets[0])
    q = rows.column("q").to_numpy()
    shift = np.zeros(len(every), np.int64)
    of_queue = np.nonzero(np.concatenate([[True], q[1:] != q[:-1]]))[0]
    shift[q[of_queue]] = begin[of_queue]
    queue, lo, hi = stretches(deal, block, grain)
    lo, hi = lo + (shift - start)[queue], hi + (shift - start)[queue]
    out = np.cumsum(hi - lo) - (hi - lo)  # where each stretch stands in the block
    order = np.argsort(lo)
    home = order[np.searchsorted(lo[order], begin[:-1], "right") - 1]  # the stretch that a segment begins in
    edges = np.arange(-(-base // size) * size, base + begin[-1], size) - base
    cuts = np.unique(np.concatenate([out, out[home] + begin[:-1] - lo[home], edges]))
    stretch = np.searchsorted(out, cuts, "right") - 1
    source = lo[stretch] + cuts - out[stretch]
    segment = np.searchsorted(begin[:-1], source, "right") - 1
    moved = stream[np.repeat(lo - out, hi - lo) + np.arange(begin[-1])]
    length = np.diff(np.append(cuts, begin[-1]))
    own = rows.select(["row_id", "doc_id", "start", "doc_tokens"]).take(pa.array(segment))
    within = own.column("start").to_numpy() + source - begin[segment]
    ids = sliced(pa.py_buffer(moved), np.append(cuts, begin[-1]) * width)
    return pa.record_batch([own.column("row_id"), own.column("doc_id"), pa.array(within), pa.array(length), ids, own.column("doc_tokens"), pa.array((base + cuts) // size), pa.array((base + cuts) % size)], [x.split()[0] for x in SEQUENCES.split(", ")])


def sequences(docs: DataFrame, tokenizer: str, *, size: int = 1024, windows: int = 512, grain: int = 16, end_id: int = 0, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source") -> DataFrame:
    """SEQUENCES' columns: each stretch of each document's tokens, with its ids, and where it lies.

    ids: little-endian unsigned integers, of as many bytes each as the tokenizer's largest id takes
    (2 or 4). A sequence is its pieces' ids by offset. row_id: a number of its own for every row of
    `docs` (rows may repeat a doc_id, such as epochs); a row's tokens are its pieces' ids by start.

    weights: target proportions by source (default: each source's share of all tokens; a source not
    named: 0, served when the others are dry; a negative one: an error). A window holds each target to
    within `grain` tokens and one for each source, until a source is dry. Every source has a queue of its
    own, whatever their number; its name, total and weight (some 100 bytes) stand on the driver and in
    every task. A document is its ids, then end_id. Every sequence but the last is full; the last is as
    long as what is left, and padded to `size` by the reader unless its length is a power of two.

    Null text: the end id alone. Null id or source: passed on; a queue of its own. Repeated rows: each
    packed. Ties between queues: by name. Very long texts: cut over many sequences. Empty table: no
    rows. Other columns, whatever their names, are not read.
    """
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("a weight is negative")
    small_batches(docs.sparkSession)
    slim = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{queue_col}` as string) as queue", f"`{text_col}` as text")
    tokens = durable(tokenised(slim, tokenizer, end_id), "packing", "zstd")
    width = encoder(tokenizer).dtype.itemsize

    parts = durable(tokens.groupBy("task", "queue").agg(F.sum("n").alias("n")), "packing-parts")
    by_task = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offset = durable(parts.select("task", "queue", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("base")), "packing-offsets")
    found = sorted((r.queue, r.n) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # a row a source
    total = np.array([n for _, n in found], np.int64)
    weight = total.astype(float) if weights is None else np.array([float(weights.get(q[1:], 0.0)) if q else 0.0 for q, _ in found])
    deal = Deal(total, weight, size, windows)
    shared = docs.sparkSession.sparkContext.broadcast(({q: k for k, (q, _) in enumerate(found)}, deal))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, deal = shared.value
        for batch in batches:
            if batch.num_rows:
                yield cut(batch, at, deal, width)

    def laying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, deal = shared.value
        for rows, begin in groups(batches, ["block"]):
            for lo, hi in zip(begin, np.append(begin[1:], rows.num_rows), strict=True):
                yield lay(rows.slice(lo, hi - lo), deal, grain, width)

    # Beyond the broadcast's limit (of tasks times queues) this join moves the ids once more.
    placed = tokens.join(checked(offset, 80), ["task", "queue"]).select("queue", (F.col("before") + F.col("base")).alias("start"), "row_id", "doc_id", "n", "ids")
    segments = placed.mapInArrow(cutting, SEGMENTS)
    return segments.repartition("block").sortWithinPartitions("block", "q", "p").mapInArrow(laying, SEQUENCES)


def digests(pieces: DataFrame) -> DataFrame:
    """PIECES' columns of SEQUENCES' rows: the crc32 of each piece's ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = bytes_of(batch.column("ids"))
            width = (offsets[-1] - offsets[0]) // int(batch.column("length").to_numpy().sum())
            wide = memoryview(np.frombuffer(data, f"<u{width}", (offsets[-1] - offsets[0]) // width, offsets[0]).astype("<u4").tobytes())
            at = ((offsets - offsets[0]) // width * 4).tolist()
            crc = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
            yield pa.record_batch([crc if c == "ids_crc32" else batch.column(c) for c in names], names)

    return pieces.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """PIECES' columns, derived from the sequences as written; `how` as sequences() takes it."""
    return digests(durable(sequences(docs, tokenizer, **how), "sequences", "zstd"))
