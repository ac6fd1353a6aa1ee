"""Benchmark decontamination: test n-grams as a hash set that goes to every task, against all windows of the texts.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of anything beyond ASCII. An item gives
its windows of `n` words, one with fewer words a single window. The set is a sorted array of 64-bit
hashes with a table of bytes before it; a hit counts once its words equal the window's, byte by byte.

The set is sent in blocks of at most BLOCK_BYTES of normalised items (a longer item is cut into pieces
that overlap by n - 1 words), so what a task holds doesn't grow with the benchmark. One block, which takes
some 60,000 items, is one pass over the texts without a shuffle; with more, each block is a pass that
gives only its hits, and these are put together by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices, texts_of
from .common import bytes_of, durable

#: Normalised items that one pass holds; windows take some ten times as much in a task.
BLOCK_BYTES = 8 << 20
#: Words of a piece of a long item.
PIECE = 4096
SPANS = "array<struct<lo:long,hi:long,start:long,end:long>>"
FOUND = f"struct<n_words:long,spans:{SPANS},items:array<long>>"
#: Bytes to word bytes: lower case for A-Z, a space for all other ASCII but digits and letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_P, _Q, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def compact(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that lie one behind the other: buffer, starts, ends, text, origin.

    buffer: the folded words with a space behind each; starts, ends: each word's place there; text: the
    number of its text; origin: its first byte in `raw`. at: where each text begins and the last ends.
    """
    b = np.frombuffer(raw.translate(FOLD), np.uint8)
    inside = b != 32
    first, last = inside.copy(), inside.copy()
    edges = at[(at > 0) & (at < len(b))]
    first[1:] &= ~inside[:-1]
    first[edges] |= inside[edges]
    last[:-1] &= ~inside[1:]
    last[edges - 1] |= inside[edges - 1]
    origin, stop = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    starts = np.cumsum(np.concatenate([[0], stop - origin + 1]))[:-1] if len(origin) else np.zeros(0, np.int64)
    ends = starts + (stop - origin)
    buffer = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    keep = np.ones(len(buffer), bool)
    keep[ends] = False
    buffer[keep] = b[inside]
    return buffer, starts, ends, np.searchsorted(at, origin, "right") - 1, origin


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words of over 64 bytes by BLAKE2."""
    size = ends - starts
    out = size.astype(np.uint64)
    order = np.argsort(size, kind="stable")
    lo, far = 0, int(np.searchsorted(size[order], 64, "right"))
    h = out[order]
    for j in range(int(size[order[far - 1]]) if far else 0):
        lo = int(np.searchsorted(size[order], j, "right"))
        h[lo:far] = (h[lo:far] + buffer[starts[order[lo:far]] + j]) * _P
    for i in range(far, len(order)):
        w = order[i]
        h[i] = np.uint64(int.from_bytes(hashlib.blake2b(buffer[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), "little"))
    h ^= h >> np.uint64(29)
    out[order] = h * _M
    return out


def window_hashes(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, the hash of each k successive words), for the sizes asked, ascending."""
    h = words.copy()
    for k in range(1, max(sizes, default=0) + 1):
        if k > 1:
            if len(words) < k:
                return
            h = h[: len(words) - k + 1] * _Q + words[k - 1 :]
        if k in sizes:
            mixed = h ^ (h >> np.uint64(31))
            yield k, mixed * _M + np.uint64(k)


class Windows:
    """The distinct windows of a block of items: hashes in order, and where each one's words stand."""

    def __init__(self, ids: list[int | None], texts: list[bytes], n: int):
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.buffer, starts, ends, text, _ = compact(b"".join(texts), at)
        words = word_hashes(self.buffer, starts, ends)
        count = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
        sizes = np.minimum(count, n)[text]  # the window that begins at a word, by its item
        found = []
        for k, h in window_hashes(words, sorted({int(s) for s in sizes})):
            i = np.nonzero((sizes[: len(h)] == k) & (text[: len(h)] == text[k - 1 :]))[0]
            found.append((h[i], starts[i], ends[i + k - 1], np.full(len(i), k), text[i]))
        h, lo, hi, k, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 4
        own: dict[tuple[int, bytes], int] = {}
        entry = np.array([own.setdefault((int(a), self.buffer[b:c].tobytes()), len(own)) for a, b, c in zip(h, lo, hi, strict=True)], np.int64)
        _, one = np.unique(entry, return_index=True)
        order = np.argsort(h[one], kind="stable")
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        one = one[order]
        self.hashes, self.lo, self.hi, self.k = h[one], lo[one], hi[one], k[one]
        self.sizes = sorted({int(x) for x in self.k})
        pairs = np.unique(np.stack([rank[entry], item], 1), axis=0) if len(entry) else np.zeros((0, 2), np.int64)
        self.item = [ids[i] for i in pairs[:, 1]]
        self.items_at = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        self.bits = max(12, int(len(one)).bit_length() + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.slot(self.hashes)] = True

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the number of the window of every verified hit."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, h in window_hashes(word_hashes(buffer, starts, ends), self.sizes):
            i = np.nonzero(self.seen[self.slot(h)])[0]
            i = i[text[i] == text[i + k - 1]]
            lo, hi = np.searchsorted(self.hashes, h[i], "left"), np.searchsorted(self.hashes, h[i], "right")
            i, e = np.repeat(i, hi - lo), np.repeat(lo, hi - lo) + within(hi - lo)
            same = (self.k[e] == k) & (self.hi[e] - self.lo[e] == ends[i + k - 1] - starts[i])
            i, e = i[same], e[same]
            for a in range(0, len(i), 1 << 14):  # some MB of compared bytes at a time
                x, y = i[a : a + (1 << 14)], e[a : a + (1 << 14)]
                size = self.hi[y] - self.lo[y]
                step = within(size)
                equal = buffer[np.repeat(starts[x], size) + step] == self.buffer[np.repeat(self.lo[y], size) + step]
                good = np.logical_and.reduceat(equal, np.cumsum(size) - size)
                out.append((x[good], y[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def within(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def found_in(windows: Windows, raw: bytes, at: np.ndarray) -> list[tuple[int, list[dict], list[int]]]:
    """For each text: its number of words, its spans of hit words (first and behind the last, as words and
    as bytes of the text), the ids of items with occurring windows."""
    n = len(at) - 1
    buffer, starts, ends, text, origin = compact(raw, at)
    first, e = windows.hits(buffer, starts, ends, text)
    out = [(int(c), [], []) for c in np.bincount(text, minlength=n)] if len(text) else [(0, [], []) for _ in range(n)]
    if not len(first):
        return out
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, first + windows.k[e], -1)
    hit = np.cumsum(depth[:-1]) > 0
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
    closes[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
    zero = np.searchsorted(text, np.arange(n))  # the first word of each text
    for i, j in zip(np.nonzero(opens)[0].tolist(), np.nonzero(closes)[0].tolist(), strict=True):
        t = int(text[i])
        out[t][1].append({"lo": i - int(zero[t]), "hi": j + 1 - int(zero[t]), "start": int(origin[i] - at[t]), "end": int(origin[j] + ends[j] - starts[j] - at[t])})
    for t, w in np.unique(np.stack([text[first], e], 1), axis=0).tolist():
        out[t][2].extend(x for x in windows.item[windows.items_at[w] : windows.items_at[w + 1]] if x is not None)
    return [(w, spans, sorted(set(items))) for w, spans, items in out]


def texts_at(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 of a string array as one buffer, and where each text begins; null is empty."""
    data, at = bytes_of(text.cast(pa.binary()).fill_null(b""))
    return memoryview(data)[at[0] : at[-1]].tobytes(), at - at[0]


def pieces(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, words (bytes) of the items with a word: folded words with single spaces, long items cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, out = [], []
                for i, t in zip(part.column("item_id").to_pylist(), texts_of(part), strict=True):
                    words = t.encode().translate(FOLD).split(b" ")
                    words = [w for w in words if w]
                    for a in range(0, max(len(words) - n + 1, bool(words)), PIECE):
                        ids.append(i)
                        out.append(b" ".join(words[a : a + PIECE + n - 1]))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["item_id", "words"])

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    return durable(rows.mapInArrow(run, "item_id long, words binary"), "windows")


def blocks(benchmark: DataFrame, n: int, id_col: str, text_col: str, most: int) -> Iterator[Windows]:
    """The sets of windows, one a block of about `most` bytes; one comes to the driver at a time."""
    rows = pieces(benchmark, n, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum(F.length("words") + 16), F.lit(0)).alias("b")).first().b
    count = max(1, -(-total // most))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(count))
    for k in range(count):
        own = rows.where(block == k).collect()
        yield Windows([r.item_id for r in own], [bytes(r.words) for r in own], n)


def finder(windows: Windows):
    """FOUND of a text column."""

    def run(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.record_batch([text], ["text"])):
            out += [{"n_words": w, "spans": s, "items": i} for w, s, i in found_in(windows, *texts_at(part.column("text")))]
        span = pa.struct([(x, pa.int64()) for x in ("lo", "hi", "start", "end")])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.int64()))]))

    return F.arrow_udf(run, FOUND)


def united(spans: pa.Array) -> pa.Array:
    """Spans from several passes, those that touch or overlap as one."""
    out = []
    for own in spans.to_pylist():
        one: list[dict] = []
        for s in sorted(own, key=lambda s: (s["lo"], s["hi"])):
            if one and s["lo"] <= one[-1]["hi"]:
                if s["hi"] > one[-1]["hi"]:
                    one[-1] |= {"hi": s["hi"], "end": s["end"]}
            else:
                one.append(dict(s))
        out.append(one)
    return pa.array(out, spans.type)


def uncovered(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the bytes of their spans."""
    out = []
    for t, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        raw, kept, at = t.encode(), [], 0
        for s in own:
            kept.append(raw[at : s["start"]])
            at = s["end"]
        out.append((b"".join(kept) + raw[at:]).decode())
    return pa.array(out, pa.string())


def scanned(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text: str, most: int) -> DataFrame:
    """d (a row of `docs`), f (FOUND) for every row. One block: one pass, rows in place. More: a pass a block
    over the numbered rows, which gives hits alone; they are put together by row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    sets = blocks(benchmark, n, item_col, item_text, most)
    windows, more = next(sets), next(sets, None)
    if more is None:
        return docs.select(whole, finder(windows)(F.col(f"`{text_col}`")).alias("f"))
    rows = durable(docs.select(F.monotonically_increasing_id().alias("row"), whole), "numbered")
    text = rows.select("row", F.col(f"d.`{text_col}`").alias("text"))
    found = durable(text.select("row", finder(windows)("text").alias("f")), "found")
    while more is not None:
        own = text.select("row", finder(more)("text").alias("f")).where(F.size("f.spans") > 0)
        found, more = found.unionByName(durable(own, "found")), next(sets, None)
    lists = found.groupBy("row").agg(F.max("f.n_words").alias("n_words"), F.flatten(F.collect_list("f.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"))
    one = lists.select("row", "n_words", F.when(F.size("spans") > 0, F.arrow_udf(united, SPANS)("spans")).otherwise(F.col("spans")).alias("spans"), "items")
    return rows.join(one, "row").select("d", F.struct("n_words", "spans", "items").alias("f"))


def n_hit() -> Column:
    return F.aggregate("f.spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (words [lo, hi) and bytes
    [start, end) of the text), items for every row of `docs`.

    Null or empty text, or none but marks: no words, no hits; the hash is that of the empty string. Null
    id: passed on. Repeated rows: each scanned. Items: null or empty texts have no window; repeated rows
    with one id count once; windows of an item without id are hits, and no item. Windows that overlap or
    touch: one span, each word counted once. Very long texts and items: whole. Empty tables: no rows, or
    no hits. Other columns, whatever their names, are not read.
    """
    rows = scanned(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, n, "text", item_col, item_text, most)
    names = F.array_join(F.array_sort(F.transform("f.items", lambda x: x.cast("string"))), ",")
    return rows.select(
        "d.doc_id", "f.n_words", n_hit().alias("n_hit"), F.size("f.items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.size("f.spans") > 0).alias("contaminated"), "f.spans", "f.items",
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 10, most_percent: int = 50, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of `docs` with their hit spans cut out of the text (n_chars, if there, to match), but for
    rows of whose words over `most_percent` percent are hit: these go (at 0, every contaminated row does).

    Null text stays null. A share equal to the limit stays. All else as in contamination(); other columns
    as they were, whatever their names.
    """
    rows = scanned(docs, benchmark, n, text_col, item_col, item_text, most).where(100 * n_hit() <= most_percent * F.col("f.n_words"))
    hit, text = F.size("f.spans") > 0, F.col(f"d.`{text_col}`")
    put = {text_col: F.when(hit, F.col("t")).otherwise(text)}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(hit, F.length("t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    out = rows.select("d", "f", F.arrow_udf(uncovered, "string")(F.coalesce(text, F.lit("")), "f.spans").alias("t"))
    return out.select(*[put.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


#: contamination()'s digest columns in DuckDB SQL, windows as text.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bg AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM bw WHERE len(ws) > 0)),
dg AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bg) WHERE len(ws) >= k)),
ht AS MATERIALIZED (SELECT doc_id, dg.k, i, item_id FROM dg JOIN bg ON bg.k = dg.k AND bg.g = dg.g),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM ht) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM ht) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id"""
