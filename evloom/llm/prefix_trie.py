"""Conversation prefix trie: turn arrays sorted globally by range, longest common prefixes of neighbours,
and a stack that sweeps their intervals into nodes.

A turn is a symbol of 20 bytes (128 bits of the SHA-256 of its role and text, and the text's length), a
conversation the string of its symbols, so texts stay where they are read. Sorted by these strings, the
members of a node are neighbours, and neighbours' common prefixes say where a node opens and closes. Each
row is told its common prefix with the row before and the row behind it, across partitions too; then any
stretch of rows can be swept for itself: what a stretch adds to a node's counts (members, children, leaves,
saved bytes) is a sum over its rows. Nodes inside a stretch are whole; stacks that are open where it begins
or ends give parts, which are added up by the hash of the prefix.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, durable, groups

#: Bytes of a turn: its digest, and the length of its text in UTF-8.
SYMBOL, DIGEST = 20, 16
NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
SWEPT = f"kind int, node binary, parent binary, parent_conv_id long, {NODE}, ends_sha256 string, chunk long, at long, ids binary"
#: Children that wait for their parent; beyond, they are joined to it like those of a node that crosses stretches.
WAITING = 4096
#: Ids in a row of what a crossing node's members end with.
PIECE = 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()
WHOLE, CHILD, PART, ENDS = range(4)


def common(a: bytes, b: bytes) -> int:
    """Turns that two conversations begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // SYMBOL
    lo, hi = 0, n // SYMBOL  # alike up to lo, not up to hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[: mid * SYMBOL] == b[: mid * SYMBOL]:
            lo = mid
        else:
            hi = mid
    return lo


def turn_symbols(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, tie, symbol of every turn with a conversation. Equal turn numbers come by role and text:
    only theirs are sorted, so that no other text is shuffled."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    symbol = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.unhex(symbol).alias("symbol"), role.alias("role"), text.alias("text")
    )
    plain = durable(rows.select("conv", "turn", "symbol"), "turns")
    tied = plain.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("a"), F.max("symbol").alias("b")).where("n > 1 and a <> b").select(F.col("conv").alias("c"), F.col("turn").alias("t"))
    tied = durable(tied, "tied")
    if tied.isEmpty():
        return plain.withColumn("tie", F.lit(0).cast("long"))
    met = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    own = rows.join(tied, met, "left_semi").distinct().withColumn("tie", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")).cast("long"))
    own = own.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("symbol").alias("s"), "tie")
    out = plain.join(own, met & (F.col("symbol") == F.col("s")), "left")
    return out.select("conv", "turn", "symbol", F.coalesce("tie", F.lit(0)).cast("long").alias("tie"))


def turn_arrays(symbols: DataFrame) -> DataFrame:
    """base, conv, key: a conversation's symbols in order, as they stream by, sorted; base: conv - conv % 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in groups(batches, ["conv"]):
            data = part.column("symbol").to_pylist()
            ends = [*at[1:].tolist(), part.num_rows]
            keys = [b"".join(data[a:b]) for a, b in zip(at.tolist(), ends, strict=True)]
            yield pa.record_batch([part.column("base").take(pa.array(at)), part.column("conv").take(pa.array(at)), pa.array(keys, pa.binary())], ["base", "conv", "key"])

    own = symbols.withColumn("base", F.col("conv") - F.col("conv") % 5).withColumn("has", F.col("turn").isNotNull())
    own = own.repartition("conv").sortWithinPartitions("conv", "has", "turn", "tie")
    return own.select("base", "conv", "symbol").mapInArrow(run, "base long, conv long, key binary")


def rebuilt(arrays: DataFrame) -> DataFrame:
    """conv, key: the first h turns of the base, then the own ones after the first h; h = crc32(conv) % 9."""
    arrays = durable(arrays, "arrays")
    heads = arrays.where("conv = base").select(F.col("base").alias("b"), F.substring("key", 1, 8 * SYMBOL).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9 * SYMBOL).cast("int")
    met = arrays.join(heads, F.col("base") == F.col("b"), "left").withColumn("h", h)
    head = F.coalesce(F.expr("substring(head, 1, h)"), F.lit(b""))
    return met.select("conv", F.concat(head, F.expr("substring(key, h + 1, length(key))")).alias("key"))


def neighbours(keys: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """chunk, at, conv, key, before, behind in global order of (key, conv): turns in common with the rows
    before and behind, -1 at a partition's ends; and for these ends, by chunk, what they have in common
    with the rows across. Two numbers a partition come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # a row waits for the one behind it
        at = 0
        for batch in batches:
            out = []
            for chunk, conv, key in zip(batch.column("chunk").to_pylist(), batch.column("conv").to_pylist(), batch.column("key").to_pylist(), strict=True):
                met = common(last[3], key) if last else -1
                if last:
                    out.append((*last, met))
                last, at = (chunk, at, conv, key, met), at + 1
            if out:
                yield rows(out)
        if last:
            yield rows([(*last, -1)])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "at", "conv", "key", "before", "behind"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, bytes] | None = None
        for batch in batches:
            out = []
            for chunk, key in zip(batch.column("chunk").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if last and last[0] != chunk:
                    out.append((last[0], chunk, common(last[1], key)))
                last = (chunk, key)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])

    ordered = keys.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("chunk"), "conv", "key")
    told = durable(ordered.mapInArrow(run, "chunk long, at long, conv long, key binary, before int, behind int"), "ordered")
    ends = told.where("before = -1 or behind = -1").select("chunk", "at", "key").repartition(1).sortWithinPartitions("chunk", "at")
    met: dict[int, list[int]] = {}
    for r in ends.mapInArrow(across, "a long, b long, n long").collect():
        met.setdefault(r.a, [-1, -1])[1] = r.n
        met.setdefault(r.b, [-1, -1])[0] = r.n
    return told, {k: (a, b) for k, (a, b) in met.items()}


class Node:
    """An open node: what the rows of this stretch add to it."""

    __slots__ = ("bytes", "children", "conv", "ends", "entered", "hashed", "leaves", "n", "saved", "waiting")

    def __init__(self, size: int, entered: bool, hashed: bytes | None = None):
        self.bytes, self.entered, self.hashed = size, entered, hashed  # hashed: its prefix's, if it is put together later
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = array("q"), []


class Sweep:
    """Rows of one stretch after another; take() gives the rows of SWEPT that are ready."""

    def __init__(self):
        self.stack: list[Node] = []
        self.key, self.place = b"", None
        self.out: list[tuple] = []

    def prefixes(self, depth: int) -> list[bytes]:
        """Hashes of the open key's prefixes of 0 to `depth` turns."""
        h, out = hashlib.sha256(), []
        for d in range(depth + 1):
            out.append(h.digest())
            h.update(self.key[d * SYMBOL : (d + 1) * SYMBOL])
        return out

    def name(self, depth: int) -> None:
        """Marks the open nodes down to `depth` as such that are put together by their hashes."""
        if self.stack[depth].hashed is None:
            for node, h in zip(self.stack, self.prefixes(depth), strict=False):
                node.hashed = h

    def close(self) -> None:
        """The deepest open node is done in this stretch."""
        depth = len(self.stack) - 1
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        own = node.saved + node.n * node.bytes - (node.bytes if node.entered else 0)
        counts = (node.conv, depth, node.n, node.children, node.leaves, own)
        if node.hashed is None:
            ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else EMPTY
            parent.waiting.append((*counts, ends))
            self.out += [(WHOLE, None, None, node.conv, *x, None, None, None) for x in node.waiting]
            if len(parent.waiting) >= WAITING:
                self.name(depth - 1)
                self.flush(parent)
        else:
            self.flush(node)
            chunk, at = self.place
            self.out.append((PART, node.hashed, parent.hashed if parent else None, None, *counts, None, None, None, None))
            for a in range(0, len(node.ends), PIECE):
                ids = node.ends[a : a + PIECE]
                self.out.append((ENDS, node.hashed, None, None, None, depth, None, None, None, None, None, chunk, at - len(node.ends) + a, ids.tobytes()))
        if parent:
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
            parent.n, parent.leaves, parent.saved = parent.n + node.n, parent.leaves + node.leaves, parent.saved + own

    def flush(self, node: Node) -> None:
        self.out += [(CHILD, None, node.hashed, None, *x, None, None, None) for x in node.waiting]
        node.waiting = []

    def row(self, place: tuple[int, int], conv: int, key: bytes, before: int, behind: int) -> None:
        size = len(key) // SYMBOL
        if self.place is None or place != (self.place[0], self.place[1] + 1):
            self.end()  # not the row behind the last one: a stretch begins; what is open before it goes by hash
            self.key, keep = key, -1
            names = self.prefixes(before) if before >= 0 else []
        else:
            keep, names = before, []
            while len(self.stack) > keep + 1:
                self.close()
            self.key = key
        self.place = place
        for d in range(keep + 1, size + 1):
            length = int.from_bytes(key[d * SYMBOL - SYMBOL + DIGEST : d * SYMBOL], "big") if d else 0
            entered = d > before
            self.stack.append(Node(length, entered, names[d] if d < len(names) else None))
            if entered and d:
                self.stack[d - 1].children += 1
        top = self.stack[size]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
        if behind < size:
            top.leaves += 1
        self.open = behind

    def end(self) -> None:
        """The stretch ends: nodes that go on behind it, and their open ancestors, go by hash."""
        if self.stack:
            if self.open >= 0:
                self.name(self.open)
            elif self.stack[0].hashed is None:
                self.name(0)
            while self.stack:
                self.close()

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int64(), pa.binary()]
        rows, self.out = self.out, []
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SWEPT.split(", ")])


def swept(told: DataFrame, ends: dict[int, tuple[int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for batch in batches:
            for chunk, at, conv, key, before, behind in zip(*[batch.column(c).to_pylist() for c in ("chunk", "at", "conv", "key", "before", "behind")], strict=True):
                sweep.row((chunk, at), conv, key, ends.get(chunk, (-1, -1))[0] if before < 0 else before, ends.get(chunk, (-1, -1))[1] if behind < 0 else behind)
                if len(sweep.out) >= 8192:
                    yield sweep.take()
        sweep.end()
        yield sweep.take()

    return durable(told.select("chunk", "at", "conv", "key", "before", "behind").mapInArrow(run, SWEPT), "swept")


def ends_of(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of nodes put together: their ids in order, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(",".join(map(str, array("q", ids))).encode())
            yield named(out)
        if now is not None:
            yield named([(now, h.hexdigest())])

    def named(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])

    own = rows.where(F.col("kind") == ENDS).select("node", "chunk", "at", "ids").repartition("node").sortWithinPartitions("node", "chunk", "at")
    return own.select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def trie_of(keys: DataFrame) -> DataFrame:
    """The nodes over (conv, key)."""
    rows = swept(*neighbours(keys))
    parts = rows.where(F.col("kind") == PART).groupBy("node").agg(
        F.first("parent", True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    parts = parts.join(ends_of(rows), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    parts = durable(parts, "stitched")
    up = parts.select(F.col("node").alias("above"), F.col("conv_id").alias("up"))
    below = checked(up, 160)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = rows.where(F.col("kind") == WHOLE).select(*columns)
    child = rows.where(F.col("kind") == CHILD).drop("parent_conv_id").join(below, F.col("parent") == F.col("above")).withColumnRenamed("up", "parent_conv_id").select(*columns)
    crossing = parts.join(below, F.col("parent") == F.col("above"), "left").withColumnRenamed("up", "parent_conv_id").select(*columns)
    return whole.unionByName(child).unionByName(crossing)


def prefix_trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every node, the textless root included. rebuild: conversations start with turns of
    their base (rebuilt()); else as they are.

    Null conv_id: such turns are in no conversation. Null turn: before all others; equal turns of a
    conversation come by role and text, repeated rows are turns of their own. Null role or text: empty.
    A conversation left without turns ends at the root. Empty table: no conversations, no nodes. Other
    columns, whatever their names, are not read. Texts of any length: 20 bytes of a turn are kept; the
    turns of one conversation are a row of these.
    """
    arrays = turn_arrays(turn_symbols(turns, conv_col, turn_col, role_col, text_col))
    return trie_of(rebuilt(arrays) if rebuild else arrays.select("conv", "key"))


#: The same in DuckDB SQL; crc32 bit by bit, nodes as lists of turns.
ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS ts,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM t GROUP BY c),
r AS MATERIALIZED (SELECT o.c, list_concat(coalesce(b.ts, [])[:o.h], o.ts[o.h + 1:]) AS ts FROM o LEFT JOIN o b ON b.c = o.c - o.c % 5),
p AS (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r),
n AS MATERIALIZED (SELECT d, sha256(to_json(ts[:d])::VARCHAR) AS k, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN octet_length(encode(ts[d].text)) ELSE 0 END) AS b,
  any_value(CASE WHEN d > 0 THEN sha256(to_json(ts[:d - 1])::VARCHAR) END) AS up, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ts) = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
ch AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT n.k, n.k AS above, n.up, n_children IS NULL AS leaf, (n_convs - 1) * b AS saved FROM n LEFT JOIN ch ON ch.k = n.k),
w AS (SELECT above, leaf, saved, up FROM a UNION ALL SELECT n.k, w.leaf, w.saved, n.up FROM w JOIN n ON n.k = w.up),
s AS (SELECT above AS k, count_if(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM w GROUP BY above)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN ch ON ch.k = n.k LEFT JOIN n q ON q.k = n.up"""
