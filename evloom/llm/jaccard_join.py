"""Exact n-gram Jaccard join with set-relation skipping.

Sets of word shingles are joined through an index of their prefixes (rare shingles first, so that a
frequent passage is indexed only by sets made of little else). Equal sets are one class, and only
classes are indexed. Relations between sets are used twice:

* Index skipping. A list of the index is laid out in blocks of entries of one size and one position.
  Whether two entries may belong to linked sets depends on both alone, so blocks are compared, never
  entries; blocks of sizes that cannot meet are passed over by binary search, blocks whose position
  leaves too little by one comparison. A block that has been reached needs no comparison again, so a
  long list falls into stretches of what blocks connect, without its pairs. The sets of a stretch are
  held against each other by sketches (how many shingles of a set fall into each of about n / 8 ranges, 32 at least,
  of hashes; the lesser counts of two sets bound their intersection), and again what has been reached
  is not compared twice, so it gives a link a set at most. What short lists give are pairs; they are
  held against sketches, too. So nothing is connected for sharing a frequent shingle alone.
* Answer skipping. What these links connect is a group; links lie within groups only. In a group one
  set leads: its intersections are computed, and those of all other pairs are derived from them by
  what each set lacks of the leader and has besides (sums over small differences).

So a group of n near copies costs n links and differences, in tiles of a bounded size; pairs are
counted in a task and never emitted. The answer is exact whatever the filters let through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices, texts_of
from .common import bytes_of, checked, durable, groups, small_batches
from .components import components
from .shingles import shingle_sets

SETS = "doc_id long, n long, cid long, prefix array<long>, sketch binary"
#: Frequent shingles: the most that are told apart (8 bytes each to every task), and from how many sets on.
HOT, HOT_FROM = 1 << 19, 16
#: Shingles counted at a time in a task.
COUNTED = 1 << 20
#: Entries of a list, and sets and shingles of a group, that a task takes at a time; longer ones are
#: cut into parts by hash, and every two parts meet in a task.
LIST, TILE, TILE_SHINGLES = 1 << 14, 1 << 10, 1 << 20
#: Lists of up to so many entries are compared entry by entry, all lists of a batch at once.
SHORT = 64
#: Bytes of sketches compared at a time.
PACE = 1 << 22
#: The count of a sketch that stands for itself and all greater ones.
MOST = 255
#: Columns of a matrix of differences at a time; shingles in up to so many differences are counted in pairs.
COLUMNS, FEW = 2048, 24


def needed(n_a, n_b, percent: int):
    """The least intersection with which 100 * intersection >= percent * union."""
    return -(-(n_a + n_b) * percent // (100 + percent))


def meets(n_a, rest_a, n_b, rest_b, percent: int):
    """Whether two entries of a list can belong to linked sets: by size, and by what is left of each
    set from the shingle on."""
    sizes = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    return sizes & (np.minimum(rest_a, rest_b) >= needed(n_a, n_b, percent))


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles and the rows found to hold them, the most frequent last. They order
    the index and tell which lists to cut: what isn't found here costs time, never a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            at = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0] if len(x) else np.zeros(0, int)
            count = np.diff(np.append(at, len(x)))
            often = count > 1
            return pa.record_batch([pa.array(x[at][often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for part in slices(batch, most=1 << 20):
                for s in shingle_sets(texts_of(part), k):
                    held.append(s)
                    n += len(s)
                    if n > COUNTED:
                        yield out()
                        held, n = [], 0
        yield out()

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    top = counts.orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].copy(), top["n"].to_numpy(np.int64)[::-1].copy()


def class_of(s: np.ndarray) -> int:
    """The number of a set's class: a 64-bit hash of the whole set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of a power of two of equal ranges; MOST for MOST and more."""
    bits = max(5, (len(s) // 8).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), MOST).astype(np.uint8).tobytes()


def bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the intersections can't exceed, from the sketches of sets (a row each, of either width)."""
    x, y = (np.where(z == MOST, 1 << 40, z.astype(np.int64)) for z in (x, y))
    width = min(x.shape[1], y.shape[1])
    x, y = (z.reshape(len(z), width, -1).sum(2) for z in (x, y))
    return np.minimum(x, y).sum(1)


def sets_of(docs: DataFrame, hot: np.ndarray, k: int, percent: int) -> DataFrame:
    """SETS' columns for every row: cid is a hash of the whole set (null: empty set), prefix the
    shingles that a linked set must meet, in the index's order, sketch the set's sketch."""
    order = np.argsort(hot.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((hot.view(np.uint64)[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                n, cid, prefix, sketches = [], [], [], []
                for s in shingle_sets(texts_of(part), k):
                    n.append(len(s))
                    if not len(s):
                        cid.append(None)
                        prefix.append(None)
                        sketches.append(None)
                        continue
                    cid.append(class_of(s))
                    sketches.append(sketch(s))
                    keep = len(s) - (percent * len(s) + 99) // 100 + 1
                    at = np.searchsorted(known, s)
                    often = known[np.minimum(at, len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
                    rare = s[~often]
                    if len(rare) < keep:
                        late = s[often][np.argsort(rank[at[often]])]
                        rare = np.concatenate([rare, late[: keep - len(rare)]])
                    prefix.append(rare[:keep].view(np.int64))
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], [x.split()[0] for x in SETS.split(", ")])

    return docs.mapInArrow(run, SETS)


def long_lists(entries: DataFrame, hot: np.ndarray, counts: np.ndarray) -> DataFrame | None:
    """token, m of the lists of over LIST entries, which are among the shingles found in so many rows;
    None, if none is."""
    most = hot[counts > LIST].tolist()
    if not most:
        return None
    some = durable(entries.sparkSession.createDataFrame([(x,) for x in most], "token long"), "frequent")
    return durable(entries.join(checked(some, 80), "token").groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LIST), "long")


def dealt(rows: DataFrame, parts: Column) -> DataFrame:
    """`rows` with part (of `parts`, by cid's hash), i and j: a row stands in every pair of parts that
    holds its own, so that every two rows of a key meet in a task, and none takes more than two parts."""
    rows = rows.withColumn("parts", parts.cast("long")).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    pair = lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j"))
    pairs = F.when(F.col("parts") == 1, F.array(pair(F.lit(0).cast("long")))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), pair))
    return rows.withColumn("at", F.explode(pairs)).select("*", "at.i", "at.j").drop("at")


def reachable(n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """For each entry of a list the number of the stretch that sizes and positions connect it with; -1: nothing."""
    order = np.lexsort((rest, n))
    n, rest = n[order], rest[order]
    begin = np.nonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (rest[1:] != rest[:-1])]))[0]
    size = np.diff(np.append(begin, len(n)))
    bn, br = n[begin], rest[begin]
    own = meets(bn, br, bn, br, percent) & (size > 1)  # the entries of such a block meet each other
    of, left, stack, root = np.where(own, np.arange(len(begin)), -1), np.arange(len(begin)), [], 0
    while len(left):
        if stack:
            p = stack.pop()
        else:
            p, left = left[0], left[1:]
            root = p
        lo = np.searchsorted(bn[left], -(-bn[p] * percent // 100))
        hi = np.searchsorted(bn[left], bn[p] * 100 // percent, "right")
        near = left[lo:hi]
        hit = meets(bn[p], br[p], bn[near], br[near], percent)
        if hit.any():
            got = near[hit]
            left = np.concatenate([left[:lo], near[~hit], left[hi:]])
            stack.extend(got.tolist())
            of[p] = of[got] = root
    out = np.empty(len(n), np.int64)
    out[order] = np.repeat(of, size)
    return out


def connections(entries: DataFrame, long: DataFrame | None, percent: int) -> DataFrame:
    """a, b, long: distinct pairs of classes that meet in short lists (not long), and the members b of
    stretches a of long lists; equal stretches of several lists are one, named by a hash of their members.
    entries: token, cid, n, pos; they cross the network once, to their list (or to the pairs of its parts)."""

    def links(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        ends = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y]
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        new = np.concatenate([[True], (ends[1:] != ends[:-1]).any(1)]) if len(ends) else np.zeros(0, bool)
        ends = ends[new]
        return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(np.zeros(len(ends), bool))], ["a", "b", "long"])

    def members(cid: np.ndarray, stretch: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((cid, stretch))[np.count_nonzero(stretch < 0) :]
        cid, stretch = cid[order], stretch[order]
        cuts = np.nonzero(np.diff(stretch))[0] + 1
        names = np.array([class_of(x) for x in np.split(cid, cuts)], np.int64)
        of = np.repeat(names, np.diff(np.concatenate([[0], cuts, [len(cid)]])))
        return pa.record_batch([pa.array(of), pa.array(cid), pa.array(np.ones(len(cid), bool))], ["a", "b", "long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, ["token", "at"]):
            size = np.diff(np.append(begin, rows.num_rows))
            several = np.repeat(size > 1, size)
            cid, both = (rows.column(c).to_numpy()[several] for c in ("cid", "both"))
            n, size = both >> 32, size[size > 1]
            rest, begin = n - (both & 0xFFFFFFFF), np.cumsum(size) - size
            if not len(size):
                continue
            short = np.repeat(size <= SHORT, size)
            of = np.repeat(np.arange(len(size)), size)[short]
            c, m, r = cid[short], n[short], rest[short]
            for lag in range(1, SHORT):
                at = np.nonzero(of[lag:] == of[:-lag])[0]
                if not len(at):
                    break
                at = at[meets(m[at + lag], r[at + lag], m[at], r[at], percent)]
                yield links(c[at], c[at + lag])
            for k in np.nonzero(size > SHORT)[0]:
                at = slice(begin[k], begin[k] + size[k])
                yield members(cid[at], reachable(n[at], rest[at], percent))

    both = (F.shiftleft("n", 32) + F.col("pos")).alias("both")
    if long is None:
        lists = entries.select("token", F.lit(0).cast("long").alias("at"), "cid", both)
    else:
        cut = dealt(entries.join(checked(long, 80), "token"), F.ceil(F.col("m") / LIST))
        rest = entries.join(checked(long, 80), "token", "left_anti")
        lists = rest.select("token", F.lit(0).cast("long").alias("at"), "cid", both).unionByName(cut.select("token", (F.shiftleft("i", 32) + F.col("j")).alias("at"), "cid", both))
    found = lists.repartition("token", "at").sortWithinPartitions("token", "at").mapInArrow(run, "a long, b long, long boolean")
    return found.distinct()


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            sides = [bytes_of(batch.column(c)) for c in ("s", "t")]
            wide = [np.diff(at) for _, at in sides]
            keep = np.zeros(len(n), bool)
            for v, w in set(zip(*[x.tolist() for x in wide], strict=True)):
                own = np.nonzero((wide[0] == v) & (wide[1] == w))[0]
                x, y = (np.frombuffer(data, np.uint8)[at[own][:, None] + np.arange(k)] for (data, at), k in zip(sides, (v, w), strict=True))
                keep[own] = bounds(x, y) >= needed(n[own], m[own], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one, two = (classes.select(F.col("cid").alias(k), F.col("n").alias(n), F.col("sketch").alias(s)) for k, n, s in (("a", "n", "s"), ("b", "m", "t")))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def spanned(n: np.ndarray, data: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of links, one a set at most, that connect all of the sets (ascending by size,
    their sketches in `data` from `at` on) which sizes and sketches let link. What has been reached is
    compared with what hasn't been only."""
    wide = np.diff(at)
    begin = np.nonzero(np.concatenate([[True], wide[1:] != wide[:-1]]))[0]  # the width grows with the size
    end = np.append(begin[1:], len(n))
    rows = [data[at[b] : at[e]].reshape(e - b, wide[b]) for b, e in zip(begin, end, strict=True)]
    left, sizes, stack, out = np.arange(len(n)), n, [], []
    while len(left):
        if stack:
            p = stack.pop()
        else:
            p, left, sizes = left[0], left[1:], sizes[1:]
        lo, hi = np.searchsorted(sizes, -(-n[p] * percent // 100)), np.searchsorted(sizes, n[p] * 100 // percent, "right")
        near, mine = left[lo:hi], data[at[p] : at[p + 1]]
        most, plain = np.zeros(len(near), np.int64), mine.max() < MOST
        for b, e, own in zip(begin, end, rows, strict=True):
            x, y = np.searchsorted(near, [b, e])
            step = max(1, PACE // own.shape[1])
            for k in range(x, y, step):
                some = near[k : min(y, k + step)] - b
                # Of neighbours nothing is copied.
                those = own[some[0] : some[-1] + 1] if some[-1] - some[0] + 1 == len(some) else own[some]
                most[k : k + len(some)] = np.minimum(those, mine).sum(1, dtype=np.int64) if plain and len(mine) == own.shape[1] else bounds(mine[None, :], those)
        hit = most >= needed(n[p], n[near], percent)
        if hit.any():
            got = near[hit]
            left = np.concatenate([left[:lo], near[~hit], left[hi:]])
            sizes = n[left]
            stack.extend(got.tolist())
            out.append((np.full(len(got), p), got))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def alike(stretches: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect all classes of a stretch (a, b) of a long list which their sketches let link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, ["a"]):
            cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
            data, at = bytes_of(rows.column("sketch"))
            every = np.frombuffer(data, np.uint8)
            found = [(x + lo, y + lo) for lo, hi in zip(begin, np.append(begin[1:], len(n)), strict=True) for x, y in [spanned(n[lo:hi], every, at[lo : hi + 1], percent)]]
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            yield pa.record_batch([pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y]))], ["a", "b"])

    rows = stretches.select("a", F.col("b").alias("cid")).join(classes.select("cid", "n", "sketch"), "cid")
    return rows.repartition("a").sortWithinPartitions("a", "n", "cid").mapInArrow(run, "a long, b long")


def together(token: np.ndarray, member: np.ndarray, m: int) -> np.ndarray:
    """How many tokens every two of m members have in common (the diagonal doesn't count)."""
    order = np.lexsort((member, token))
    token, member = token[order], member[order]
    begin = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0] if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(token)))
    of, own = np.repeat(np.arange(len(begin)), count), np.repeat(count, count)
    out = np.zeros(m * m, np.int64)
    few = (own > 1) & (own <= FEW)
    t, x = of[few], member[few]
    for lag in range(1, FEW):
        same = t[lag:] == t[:-lag]
        if not same.any():
            break
        out += np.bincount(x[:-lag][same] * m + x[lag:][same], minlength=m * m)
    out = out.reshape(m, m)
    out = out + out.T
    many = np.nonzero(count > FEW)[0]
    for lo in range(0, len(many), COLUMNS):
        cols = many[lo : lo + COLUMNS]
        d = np.zeros((m, len(cols)), np.float32)
        for k, c in enumerate(cols):
            d[member[begin[c] : begin[c] + count[c]], k] = 1
        out += (d @ d.T).astype(np.int64)
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two of `sets` (ascending), each derived from those with the
    leader by the differences of both (the diagonal doesn't count)."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    every, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # The set whose shingles most of the others hold leads.
    leader = int((np.bincount(owner, weights=count[token], minlength=m) / sizes).argmax())
    place = np.full(len(every), -1)
    mine = token[owner == leader]
    place[mine] = np.arange(len(mine))
    at = place[token]
    kept = np.bincount(owner[at >= 0], minlength=m)  # the leader's answers
    lacks = len(mine) - kept
    out = len(mine) - lacks[:, None] - lacks[None, :]
    touched = np.nonzero(np.bincount(at[at >= 0], minlength=len(mine)) < m - 1)[0]  # lacked by two sets or more
    column = np.full(len(mine) + 1, -1)
    for lo in range(0, len(touched), COLUMNS):
        cols = touched[lo : lo + COLUMNS]
        column[:] = -1
        column[cols] = np.arange(len(cols))
        has = column[at] >= 0  # at is -1 outside of the leader, and the last column is none
        d = np.ones((m, len(cols)), np.float32)
        d[owner[has], column[at[has]]] = 0
        out += (d @ d.T).astype(np.int64)
    added = (at < 0) & (count[token] > 1)
    return out + together(token[added], owner[added], m)


def least_reached(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix, the least name that it reaches."""
    out, done = names.copy(), np.zeros(len(names), bool)
    for i in range(len(names)):
        if not done[i]:
            reach = np.zeros(len(names), bool)
            reach[i] = True
            front = np.array([i])
            while len(front):
                new = linked[front].any(0) & ~reach
                reach |= new
                front = np.nonzero(new)[0]
            out[reach] = names[reach].min()
            done |= reach
    return out


def answers(members: DataFrame, percent: int) -> DataFrame:
    """cid, parts, links (rows of other classes that link, of this pair of parts), peer (the least class
    reached in it) for the sets of each group: comp, cid, n_rows, s, parts, part, i, j."""
    names = ["cid", "parts", "links", "peer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in groups(batches, ["comp", "i", "j"]):
            cid, n_rows, parts, part, i, j = (rows.column(c).to_numpy() for c in ("cid", "n_rows", "parts", "part", "i", "j"))
            data, at = bytes_of(rows.column("s"))
            every = np.frombuffer(data, "<u8", (at[-1] - at[0]) // 8, at[0])
            at = (at - at[0]) // 8
            links, peer = np.zeros(len(cid), np.int64), cid.copy()
            for lo, hi in zip(begin, np.append(begin[1:], len(cid)), strict=True):
                sets = [every[at[r] : at[r + 1]] for r in range(lo, hi)]
                n = np.array([len(x) for x in sets])
                same = intersections(sets)
                linked = 100 * same >= percent * (n[:, None] + n[None, :] - same)
                np.fill_diagonal(linked, False)
                peer[lo:hi] = least_reached(linked, cid[lo:hi])
                if i[lo] != j[lo]:  # links within a part count where it meets itself
                    linked &= part[lo:hi, None] != part[None, lo:hi]
                links[lo:hi] = linked @ n_rows[lo:hi]
            yield pa.record_batch([pa.array(x) for x in (cid, parts, links, peer)], names)

    keys = ["comp", "i", "j"]
    return members.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(run, "cid long, parts long, links long, peer long")


def rebuilt(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """cid, s: the sets of `members` (cid, doc_id), built again from the texts, one a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                sets = [s for s in shingle_sets(texts_of(part), k) if len(s)]
                yield pa.record_batch([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "s"])

    ids = durable(members.select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    there = docs.join(checked(ids, 80), docs["doc_id"].eqNullSafe(ids["wanted"]), "left_semi").select("text")
    # Other texts under a wanted id are left out by the join with members.
    return there.mapInArrow(run, "cid long, s binary").groupBy("cid").agg(F.first("s").alias("s"))


def jaccard_join(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of `docs`.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set has the distinct k-word shingles, or
    the whole sequence as one where there are fewer words. Sets link when 100 * intersection >=
    percent * union. component_id: the least id reachable by links, the row's own included. n_links:
    the other rows that the row links with, copies among them.

    Null or empty text, or no words: an empty set, linked with nothing. Null id: not a least id (a
    component of null ids only has a null one). Repeated rows: equal sets, linked with each other.
    Ties in size, position or frequency: nothing hangs on them. Very long texts: whole. Empty table:
    no rows. Other columns, whatever their names, are not read. Shingles and sets are told apart by
    64-bit hashes. Raises where components need more than 60 rounds (components.py).
    """
    small_batches(docs.sparkSession)
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    hot, counts = frequent(docs, k)
    sets = durable(sets_of(docs, hot, k, percent), "prefixes")
    classes = sets.where("cid is not null").groupBy("cid")
    slim = durable(classes.agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.first("sketch").alias("sketch")), "classes")
    entries = classes.agg(F.min("n").alias("n"), F.first("prefix").alias("prefix")).select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    met = durable(connections(entries, long_lists(entries, hot, counts), percent), "connections")
    edges = durable(plausible(met.where("not long"), slim, percent).unionByName(alike(met.where("long"), slim, percent)).distinct(), "plausible")
    group = components(edges).select(F.col("node").alias("cid"), F.col("label").alias("comp"))
    members = durable(group.join(slim.drop("sketch"), "cid"), "members")

    size = members.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).alias("c"))
    placed = members.join(size, "comp").join(rebuilt(docs, members, k), "cid").select("comp", "cid", "n_rows", "s", "c")
    tiles = dealt(placed, F.col("c")).select("comp", "i", "j", "cid", "n_rows", "parts", "part", "s")
    found = durable(answers(tiles, percent), "answers")
    # Groups of one tile are settled in it; those of several are put together by their tiles' links.
    across = durable(found.where("parts > 1 and cid != peer").select(F.col("cid").alias("a"), F.col("peer").alias("b")).distinct(), "across")
    own = found.groupBy("cid").agg(F.sum("links").alias("links"), F.max("parts").alias("parts"), F.min("peer").alias("peer"))
    if across.limit(1).count():
        label = components(across).select(F.col("node").alias("cid"), "label")
        own = own.join(label, "cid", "left").withColumn("peer", F.when(F.col("parts") > 1, F.coalesce("label", "cid")).otherwise(F.col("peer")))
    own = durable(own.join(members.select("cid", "doc_id"), "cid").select("cid", "doc_id", "links", "peer"), "own")
    least = own.groupBy("peer").agg(F.min("doc_id").alias("component_id"))
    own = own.join(least, "peer").select("cid", "links", "component_id")

    # Classes of one row without links need no answer.
    told = slim.join(own, "cid", "left").where("n_rows > 1 or links is not null")
    told = durable(told.select("cid", F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("least"), (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links")), "told")
    out = sets.select("doc_id", "n", "cid").join(told, "cid", "left")
    alone = F.col("n_links").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one row of each component, that of the least id; all columns as they were.

    Rows with a null id stay. Rows that repeat an id stay or go together, but of those with equal
    texts one stays. Null texts, ties, long texts and empty tables: as in jaccard_join(). Columns may
    have any names.
    """
    found = durable(jaccard_join(docs, id_col=id_col, text_col=text_col, **how), "near")
    gone = durable(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    out = docs.join(checked(gone, 16), docs[id_col] == gone["gone"], "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        tagged = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h"))
        rest = tagged.where(F.col(f"d.`{id_col}`").isNull()).select("d")
        once = tagged.where(F.col(f"d.`{id_col}`").isNotNull()).groupBy(F.col(f"d.`{id_col}`").alias("i"), "h").agg(F.first("d").alias("d")).select("d")
        out = once.unionByName(rest).select([F.col(f"d.`{c}`").alias(c) for c in docs.columns])
    return out
