"""Intervals, islands, windows of frames and coverage. Intervals are half-open [s, e)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(s: Column, e: Column) -> Column:
    return s.isNotNull() & e.isNotNull() & ~F.isnan(s.cast("double")) & ~F.isnan(e.cast("double")) & (s >= 0) & (s < e) & (e.cast("double") < F.lit(float("inf")))


def checked_intervals(rows: DataFrame, s: str = "s", e: str = "e") -> DataFrame:
    """`rows`, or an error at the first interval that is not one."""
    return rows.where(F.when(valid(F.col(s), F.col(e)), True).otherwise(F.raise_error(F.lit("not an interval")).cast("boolean")))


def merge(rows: DataFrame, key: str, s: str = "s", e: str = "e") -> DataFrame:
    """key, s, e, n: intervals merged where they overlap strictly; touching ones stay apart."""
    order = Window.partitionBy(key).orderBy(s, e)
    ahead = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("new", F.when(ahead.isNull() | (F.col(s) >= ahead), 1).otherwise(0))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = opened.withColumn("island", island).groupBy(key, "island")
    return grouped.agg(F.min(s).alias("s"), F.max(e).alias("e"), F.count(F.lit(1)).alias("n")).drop("island")


def uncovered_gap(rows: DataFrame, key: str, s: str = "s", e: str = "e") -> DataFrame:
    """key, gap: the largest stretch between intervals that none covers; 0 if there is none."""
    ahead = F.max(e).over(Window.partitionBy(key).orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("open", F.col(s) - ahead).groupBy(key).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("open"), F.lit(0.0))).alias("gap"))


def monotonic(rows: DataFrame, key: str, seq: str, t: str) -> DataFrame:
    """Adds verdict by arrival: null, backward (earlier than any before), duplicate (equal to the latest) or kept."""
    ahead = F.max(t).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    why = F.when(F.col(t).isNull(), "null").when(F.col(t) < ahead, "backward").when(F.col(t) == ahead, "duplicate").otherwise("kept")
    return rows.withColumn("verdict", why)


def equidistant(rank: Column, n: Column, k: int = 4) -> Column:
    """Whether the row of this rank (from 1) is among k evenly spaced ones of n; all are, if n <= k."""
    picks = [F.round(F.lit(i) * (n - 1) / F.lit(float(k - 1))) + 1 for i in range(k)]
    chosen = picks[0] == rank
    for p in picks[1:]:
        chosen = chosen | (p == rank)
    return (n < k) | chosen


def capsules(frames: DataFrame, key: str, t: str, width: float, k: int = 4, tail: float = 0.0) -> DataFrame:
    """Tumbling windows [i * width, (i + 1) * width) of distinct times, with k evenly spaced frames
    each: key, idx, s, e, n_frames, pts (k times, nulls at the end), valid (k flags). The last window
    of a key ends at its last time + `tail` if that is sooner."""
    seen = frames.where(F.col(t).isNotNull()).select(key, F.col(t).alias("t")).distinct().withColumn("idx", F.floor(F.col("t") / width))
    w = Window.partitionBy(key, "idx")
    ranked = seen.withColumn("r", F.row_number().over(w.orderBy("t"))).withColumn("n", F.count(F.lit(1)).over(w))
    picked = ranked.groupBy(key, "idx").agg(
        F.array_sort(F.collect_list(F.when(equidistant(F.col("r"), F.col("n"), k), F.col("t")))).alias("pts"), F.max("n").alias("n_frames"), F.max("t").alias("last")
    )
    final = F.max("idx").over(Window.partitionBy(key)) == F.col("idx")
    end = (F.col("idx") + 1) * F.lit(width)
    kept = F.size("pts")
    return picked.select(
        key, "idx", (F.col("idx") * F.lit(width)).alias("s"), F.when(final & F.lit(tail > 0), F.least(end, F.col("last") + tail)).otherwise(end).alias("e"), "n_frames",
        F.concat("pts", F.array_repeat(F.lit(None).cast("double"), k - kept)).alias("pts"),
        F.concat(F.array_repeat(F.lit(True), kept), F.array_repeat(F.lit(False), k - kept)).alias("valid"),
    )


def runs(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """key, value, first, last, n of maximal runs of equal values in sequence."""
    order = Window.partitionBy(key).orderBy(seq)
    numbered = rows.withColumn("a", F.row_number().over(order)).withColumn("b", F.row_number().over(Window.partitionBy(key, value).orderBy(seq)))
    grouped = numbered.groupBy(key, value, (F.col("a") - F.col("b")).alias("island"))
    return grouped.agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def adjacent_gaps(rows: DataFrame, key: str, t: str) -> DataFrame:
    """key, n, max_gap, mean_gap between successive times."""
    step = rows.withColumn("d", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t)))
    return step.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("max_gap"), F.avg("d").alias("mean_gap"))


def points_in(points: DataFrame, groups: DataFrame, key: str, t: str = "t", s: str = "s", e: str = "e") -> DataFrame:
    """The columns of both for each point that lies in an interval [s, e) of its key.

    They meet by (key, level, bucket). A level's buckets are a power of two wide, an interval goes to the
    level just over its length and so into two or three buckets, a point into one bucket of each level that
    there is: no row meets all rows of its key, and a key with many is spread over many tasks. The levels
    (powers of two among the intervals' lengths, some tens) are found by a job of their own.
    """
    least = lambda x: F.ceil(F.log2(x)).cast("int")
    known = groups.where(valid_order(F.col(s), F.col(e))).withColumn("_level", least(F.col(e).cast("double") - F.col(s).cast("double")))
    levels = sorted(r["_level"] for r in known.select("_level").distinct().collect())
    at = lambda x, level: F.floor(x.cast("double") / F.pow(F.lit(2.0), level))
    spread = known.select("*", F.explode(F.sequence(at(F.col(s), F.col("_level")), at(F.col(e), F.col("_level")))).alias("_bucket"))
    pairs = F.array(*[F.struct(F.lit(v).alias("_level"), at(F.col(t), F.lit(v)).alias("_bucket")) for v in levels]) if levels else F.array().cast("array<struct<_level:int,_bucket:bigint>>")
    placed = points.where(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))).select("*", F.explode(pairs).alias("_p")).select("*", F.col("_p._level").alias("_level"), F.col("_p._bucket").alias("_bucket")).drop("_p")
    met = placed.join(spread, [key, "_level", "_bucket"]).where((F.col(t) >= F.col(s)) & (F.col(t) < F.col(e)))
    return met.drop("_level", "_bucket")


def valid_order(s: Column, e: Column) -> Column:
    """s < e, both finite."""
    x, y = s.cast("double"), e.cast("double")
    return F.coalesce((x < y) & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), F.lit(False))


def coverage(caps: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """key, idx, mask: bit j is set where at least two distinct valid times of a capsule lie in the
    key's group j (groups: key, j, s, e)."""
    points = caps.select(key, "idx", F.explode(F.array_distinct(F.filter(F.transform(F.arrays_zip("pts", "valid"), lambda x: F.when(x["valid"], x["pts"])), lambda x: x.isNotNull()))).alias("t"))
    hit = points_in(points, groups.select(key, "j", "s", "e"), key)
    bits = hit.groupBy(key, "idx", "j").agg(F.countDistinct("t").alias("n")).where("n >= 2")
    masks = bits.groupBy(key, "idx").agg(F.bit_or(F.expr("shiftleft(1, cast(j as int))")).alias("mask"))
    return caps.select(key, "idx").join(masks, [key, "idx"], "left").select(key, "idx", F.coalesce("mask", F.lit(0)).alias("mask"))


def packet_coverage(selected: DataFrame, masks: DataFrame, key: str, item: str) -> DataFrame:
    """key, covered: the union of the masks of the selected items; an unknown item is an error."""
    met = selected.join(masks, [key, item], "left")
    known = F.when(F.col("mask").isNull(), F.raise_error(F.lit("unknown item")).cast("int")).otherwise(F.col("mask"))
    return met.groupBy(key).agg(F.bit_or(known).alias("covered"))


def covers(masks: DataFrame, key: str, item: str, n_groups: int) -> DataFrame:
    """key, best: for every union of masks, from 0 to all groups, the fewest items that give it (size,
    ids; ties by ids; size over the number of items where nothing does).

    Of items with the same mask only the least id can be in an answer, so a key has at most
    2**n_groups - 1 candidates however many items it has, and one fold over them settles all unions.
    """
    full = (1 << n_groups) - 1
    least = masks.groupBy(key, "mask").agg(F.min(item).alias("id"))
    few = least.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("mask") > 0, F.struct(F.col("id").cast("long").alias("id"), "mask")))).alias("few"))
    none = "array(named_struct('size', 0, 'ids', cast(array() as array<bigint>)))"
    start = f"concat({none}, array_repeat(named_struct('size', {2 * full}, 'ids', cast(array() as array<bigint>)), {full}))"
    grown = f"transform(filter(sequence(0, {full}), s -> (s | c.mask) = t), s -> named_struct('size', st[s].size + 1, 'ids', concat(st[s].ids, array(c.id))))"
    return few.select(key, F.expr(f"aggregate(few, {start}, (st, c) -> transform(sequence(0, {full}), t -> array_min(concat(array(st[t]), {grown}))))").alias("best"))


def greatest_cover(cap: int | None = None) -> Column:
    """Of covers()'s best: struct(bits, size, ids, mask) of most groups by at most `cap` items, then of fewest items, then by ids."""
    most = F.transform("best", lambda x, t: F.struct((-F.bit_count(t)).alias("bits"), x["size"].alias("size"), x["ids"].alias("ids"), t.alias("mask")))
    return F.array_min(F.filter(most, lambda x: x["size"] <= (F.size("best") - 1 if cap is None else F.lit(cap))))


def minimal_cover(masks: DataFrame, key: str, item: str, n_groups: int = 4) -> DataFrame:
    """key, ids, covered, size, complete: the fewest items that cover most groups; ties by ids."""
    found = covers(masks, key, item, n_groups).select(key, greatest_cover().alias("b"))
    return found.select(key, F.col("b.ids").alias("ids"), F.col("b.mask").alias("covered"), F.col("b.size").alias("size"), (F.col("b.mask") == (1 << n_groups) - 1).alias("complete"))


def capped_cover(masks: DataFrame, relevance: DataFrame, key: str, item: str, n_groups: int = 4, cap: int = 6) -> DataFrame:
    """key, ids, stored, feasible, minimum_size, covered, access: the smallest cover of all groups, or what
    covers most within `cap` items, filled up to the cap by relevance (key, item, rank).

    stored: the items together cover all; feasible: within the cap; access: what was chosen does.
    """
    full = (1 << n_groups) - 1
    order = Window.partitionBy(key).orderBy("rank")
    near = relevance.join(masks.select(key, item, "mask"), [key, item]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap + n_groups)
    near = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", F.col(item).cast("long").alias("id"), "mask"))).alias("near"))
    found = covers(masks, key, item, n_groups).select(key, greatest_cover(cap).alias("b"), F.get("best", F.lit(full))["size"].alias("least")).join(near, key, "left")
    more = F.slice(F.filter(F.coalesce("near", F.array().cast("array<struct<r:int,id:bigint,mask:int>>")), lambda x: ~F.array_contains("b.ids", x["id"])), 1, F.lit(cap) - F.col("b.size"))
    out = found.withColumn("more", more).withColumn("covered", F.aggregate("more", F.col("b.mask"), lambda m, x: m.bitwiseOR(x["mask"])))
    stored = F.col("least") <= full
    return out.select(
        key, F.concat("b.ids", F.transform("more", lambda x: x["id"])).alias("ids"), stored.alias("stored"), (F.col("least") <= min(cap, full)).alias("feasible"),
        F.when(stored, F.col("least")).alias("minimum_size"), "covered", (F.col("covered") == full).alias("access"),
    )
