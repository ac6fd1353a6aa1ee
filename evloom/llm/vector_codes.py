"""Vector code compression: product codes with codebooks fitted by integer rounds, entries found by exponion search.

A part starts at its previous entry a, at squared distance d of it. Any entry as near as a lies within
2 * sqrt(d) of a, so a's list of the other entries, sorted by distance, is scanned while its squared
distances are at most 4 * d, and no further. All distances are whole numbers; of equal ones the lower
index wins.

Vectors travel in blocks: ids, labels, whole-number components (16 bits where they fit) and present codes
of up to BLOCK vectors in a row. A round reads the blocks, finds the entries, writes them with the new codes
and the block's sums by entry; the sums alone are read again and added up in Spark. Codebooks, some
thousand numbers, come to the driver and go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, durable, removed

BLOCK = 4096
SCALE = 4096
#: Components beyond this are refused: squared distances and sums must be exact in 64 bits.
MOST = 1 << 26
BLOCKS = "ids array<long>, labels array<string>, components binary, codes binary, sums array<long>"


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and their floor(4096 * x) as rows."""
    at = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)))]).astype(np.int64)
    flat = vectors.flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    kept = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    size = np.diff(at)
    widths = np.unique(size[kept])
    if not len(widths):
        return kept, np.zeros((0, 0), np.int64)
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and of {widths[-1]} components")
    values = np.floor(x[np.repeat(kept, size)] * SCALE)  # times a power of two: exact
    if len(values) and np.abs(values).max() > MOST:
        raise ValueError(f"a component lies beyond {MOST // SCALE}")
    return kept, values.astype(np.int64).reshape(-1, int(widths[0]))


class Codebooks:
    """Entries by part, and for each entry the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # parts x entries x width
        gap = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)
        self.near = np.argsort(gap, axis=2, kind="stable")
        self.gap = np.take_along_axis(gap, self.near, 2)

    def assign(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every part, from the previous ones, and its squared distance. x: vectors x parts x width."""
        parts, n = self.entries.shape[:2]
        best, least = codes.astype(np.int64), np.empty(codes.shape, np.int64)
        for p in range(parts):
            own, book = np.ascontiguousarray(x[:, p]), self.entries[p]
            start = codes[:, p].astype(np.int64)
            d = ((own - book[start]) ** 2).sum(1)
            to, dist, radius = start.copy(), d.copy(), 4 * d
            live = np.arange(len(own))
            for j in range(n):
                live = live[self.gap[p, start[live], j] <= radius[live]]  # lists ascend: what is out stays out
                if not len(live):
                    break
                entry = self.near[p, start[live], j]
                e = ((own[live] - book[entry]) ** 2).sum(1)
                better = (e < dist[live]) | ((e == dist[live]) & (entry < to[live]))
                to[live[better]], dist[live[better]] = entry[better], e[better]
            best[:, p], least[:, p] = to, dist
        return best.astype(np.uint8), least

    def sums(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """By part and entry: how many, then the sum of each component."""
        parts, n, width = self.entries.shape
        out = np.zeros((parts * n, width + 1), np.int64)
        slot = (codes.astype(np.int64) + np.arange(parts) * n).reshape(-1)
        order = np.argsort(slot, kind="stable")
        has, first = np.unique(slot[order], return_index=True)
        out[has, 0] = np.diff(np.append(first, len(slot)))
        if len(has):
            out[has, 1:] = np.add.reduceat(x.reshape(-1, width)[order], first, axis=0)
        return out.reshape(-1)

    def moved(self, sums: np.ndarray) -> Codebooks:
        """Each entry at the floor of its parts' mean; unused ones stay."""
        by = sums.reshape(*self.entries.shape[:2], -1)
        n = by[:, :, :1]
        return Codebooks(np.where(n > 0, by[:, :, 1:] // np.maximum(n, 1), self.entries))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def packed(x: np.ndarray) -> bytes:
    """Components in two bytes each, or in four where a block needs it."""
    small = not x.size or x.min() >= -32768 and x.max() <= 32767
    return x.astype("<i2" if small else "<i4").tobytes()


def unpacked(data: bytes, n: int, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * parts * width else "<i4").astype(np.int64).reshape(n, parts, width)


def first_entries(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the `entries` kept vectors of least id (of one id: of the least components); none if none is kept."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("v").isNotNull() & ~bad).select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return None
    _, x = whole(pa.array([r.v for r in rows], pa.list_(pa.float64())))
    if not x.shape[1] or x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components can't be cut into {parts} equal parts")
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()


def put_in_blocks(vectors: DataFrame, book: Codebooks) -> DataFrame:
    """BLOCKS of (id, label, v), coded from the first entry on."""
    parts, _, width = book.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                kept, x = whole(rows.column("v"))
                if not len(x):
                    continue
                if x.shape[1] != parts * width:
                    raise ValueError(f"vectors of {x.shape[1]} and of {parts * width} components")
                only = pa.array(kept)
                yield block(book, rows.column("id").filter(only), rows.column("label").filter(only), x.reshape(len(x), parts, width), np.zeros((len(x), parts), np.uint8))

    return vectors.select("id", "label", "v").mapInArrow(run, BLOCKS)


def block(book: Codebooks, ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: np.ndarray, data: bytes | None = None) -> pa.RecordBatch:
    codes, _ = book.assign(x, codes)
    sums = book.sums(x, codes)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    return pa.record_batch(
        [one(ids, pa.int64()), one(labels, pa.string()), pa.array([packed(x) if data is None else data], pa.binary()), pa.array([codes.tobytes()], pa.binary()), one(pa.array(sums), pa.int64())],
        ["ids", "labels", "components", "codes", "sums"],
    )


def held(batches: Iterator[pa.RecordBatch], book: Codebooks) -> Iterator[tuple]:
    """ids, labels, components, codes, packed components of each block."""
    parts, _, width = book.entries.shape
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
            data = batch.column("components")[k].as_py()
            codes = np.frombuffer(batch.column("codes")[k].as_py(), np.uint8).reshape(len(ids), parts)
            yield ids, labels, unpacked(data, len(ids), parts, width), codes, data


def coded_again(blocks: DataFrame, book: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, codes, data in held(batches, book):
            yield block(book, ids, labels, x, codes, data)

    return blocks.mapInArrow(run, BLOCKS)


def moved(blocks: DataFrame, book: Codebooks) -> Codebooks:
    """The next codebooks, from the blocks' sums, added up in Spark."""
    rows = blocks.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(len(rows), np.int64)
    for r in rows:
        sums[r.k] = r.s
    return book.moved(sums)


def rows_of(blocks: DataFrame, book: Codebooks) -> DataFrame:
    """vec_id, code, error, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, codes, _ in held(batches, book):
            codes, error = book.assign(x, codes)
            text = codes.tobytes().hex()
            step = 2 * codes.shape[1]
            code = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.record_batch([ids, pa.array(code, pa.string()), pa.array(error.sum(1)), labels], ["vec_id", "code", "error", "label"])

    return blocks.select("ids", "labels", "components", "codes").mapInArrow(run, "vec_id long, code string, error long, label string")


def vector_codes(
    vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of `vectors`.

    Null vectors, and those with a null or non-finite component: dropped. Fewer kept rows than `entries`:
    as many entries. Null id: kept, but behind all others for the first entries; repeated ids and rows:
    each coded, the first entries of one id by ascending components. Null labels: one label. Equal
    distances: the lower index. Kept vectors of unequal lengths, of a length that `parts` doesn't divide,
    or with a component beyond 16384 (integers must be exact): an error. Empty table, or none kept: no
    rows. Up to 256 entries. Other columns, whatever their names, are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    first = first_entries(own, parts, entries)
    if first is None:
        return own.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    book = Codebooks(first)
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    blocks = durable(put_in_blocks(raw, book), "blocks")
    for _ in range(1, rounds):
        book, past = moved(blocks, book), blocks
        blocks = durable(coded_again(past, book), "blocks")
        removed(past)
    book = moved(blocks, book)
    rows = durable(rows_of(blocks, book), "codes")
    removed(blocks)
    by_label = durable(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "labels")
    met = rows.join(checked(by_label, 160), F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in DuckDB SQL, all entries compared."""
    out = [
        f"""k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM (SELECT r, v, unnest(range(0, {parts})) AS p FROM k))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM p WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT r, p, x, d.d AS d, d.e AS e FROM (SELECT r, p.p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS d FROM p JOIN b{i} b ON b.p = p.p GROUP BY r, p.p))""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT p, e, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY j) AS c FROM (SELECT p, e, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM d{i}) GROUP BY ALL) GROUP BY p, e)""")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON s.p = b.p AND s.e = b.e)")
    out.append(f"f AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM d{rounds} GROUP BY r)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f ON f.r = k.r, h"
