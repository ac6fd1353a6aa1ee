"""Intervention packages: evidence groups, distractors in evidence-free time, one replacement at a time.

A distractor is four true times of one stretch that no evidence interval touches, over a span as near
as can be to the median evidence length, and never so placed that the distractors still to come find
no room. All of it is windows and joins by key: every start in a stretch has two ends to offer (the last
within the span, by a range frame over times divided by the span, and the one behind it), and three
rounds of ranking take one window each and split its stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from ..session import settled
from .intervals import equidistant, points_in

DISTRACTORS = 3
PACKAGE = "key long, built boolean, reason string, grp int, is_gold boolean, pts array<double>, group_id string"


def micros(t: Column) -> Column:
    return F.round(t * 1e6).cast("long")


def flagged(frames: DataFrame, groups: DataFrame) -> DataFrame:
    """key, t, grp: distinct times with the evidence group that holds them, if any."""
    times = frames.select("key", "t").distinct()
    held = points_in(times, groups.select("key", "grp", "s", "e"), "key").select("key", "t", "grp")
    return times.join(held, ["key", "t"], "left")


def evidence(times: DataFrame, groups: DataFrame) -> DataFrame:
    """key, grp, n, pts: the times of each group, four evenly spaced ones picked."""
    w = Window.partitionBy("key", "grp")
    own = times.where("grp is not null").select("key", "t", "grp", F.row_number().over(w.orderBy("t")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    found = own.groupBy("key", "grp").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(equidistant(F.col("r"), F.col("n")), F.col("t")))).alias("pts"))
    return groups.select("key", "grp").join(found, ["key", "grp"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def free(times: DataFrame, plan: DataFrame) -> DataFrame:
    """key, run, pos, t, n, span, within: stretches of four free times or more. within: the last place
    whose time is no further away than the span."""
    ahead = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy("key", "run")
    out = times.withColumn("run", F.count("grp").over(ahead)).where("grp is null").join(plan.select("key", "span"), "key")
    out = out.withColumn("pos", F.row_number().over(run.orderBy("t")) - 1).withColumn("n", F.count(F.lit(1)).over(run)).where("n >= 4")
    near = run.orderBy("x").rangeBetween(Window.currentRow, 1)
    return out.withColumn("x", F.col("t") / F.col("span")).withColumn("within", F.max("pos").over(near)).select("key", "run", "pos", "t", "n", "span", "within")


def windows(stretches: DataFrame, seed: int) -> DataFrame:
    """key, run, a, b, dev, tie: the windows that a distractor may take, and what ranks them."""
    ends = F.array_distinct(F.array(F.greatest(F.col("pos") + 3, F.col("within")), F.greatest(F.col("pos") + 3, F.col("within") + 1)))
    starts = stretches.select("key", "run", F.col("pos").alias("a"), F.col("t").alias("ta"), "span", F.explode(ends).alias("b"))
    met = starts.join(stretches.select("key", "run", F.col("pos").alias("b"), F.col("t").alias("tb")), ["key", "run", "b"])
    tie = hash_order(seed, F.col("key"), micros(F.col("ta")), micros(F.col("tb")))
    return met.select("key", "run", "a", "b", F.abs(F.col("tb") - F.col("ta") - F.col("span")).alias("dev"), tie.alias("tie"))


def room(lo: Column, hi: Column) -> Column:
    """The distractors that places lo to hi have room for."""
    return F.floor((hi - lo + 1) / 4)


def taken(stretches: DataFrame, seed: int) -> DataFrame:
    """key, k, run, a, b: the windows of the k-th distractors, from 0."""
    offers = settled(windows(stretches, seed), "offers")
    opened = stretches.groupBy("key", "run").agg(F.lit(0).cast("long").alias("lo"), (F.max("n") - 1).alias("hi"))
    lo, hi, a, b = (F.col(x) for x in ("lo", "hi", "a", "b"))
    order = Window.partitionBy("key").orderBy("dev", "tie", "run", "a", "b")
    out = None
    for k in range(DISTRACTORS):
        total = opened.groupBy("key").agg(F.sum(room(lo, hi)).alias("room"))
        fits = offers.join(opened, ["key", "run"]).where((a >= lo) & (b <= hi)).join(total, "key")
        fits = fits.where(F.col("room") - room(lo, hi) + room(lo, a - 1) + room(b + 1, hi) >= DISTRACTORS - 1 - k)
        best = settled(fits.withColumn("r", F.row_number().over(order)).where("r = 1").select("key", "run", "a", "b"), "taken")
        out = best.withColumn("k", F.lit(k)) if out is None else out.unionByName(best.withColumn("k", F.lit(k)))
        inside = best.select("key", F.col("run").alias("taken"), "a", "b")
        split = (F.col("run") == F.col("taken")) & (a >= lo) & (b <= hi)
        piece = lambda x, y: F.struct(x.cast("long").alias("lo"), y.cast("long").alias("hi"))
        pieces = F.when(split, F.array(piece(lo, a - 1), piece(b + 1, hi))).otherwise(F.array(piece(lo, hi)))
        opened = settled(opened.join(inside, "key").select("key", "run", F.explode(pieces).alias("p")).select("key", "run", "p.*").where(hi - lo >= 3), "open")
    return out


def packages(frames: DataFrame, gold: DataFrame, key: str, seed: int = 17) -> DataFrame:
    """PACKAGE's rows for each key of `gold`: its evidence groups by start, then three distractors; or a
    row with the reason why there's none. frames: (key, t); gold: (key, s, e), merged."""
    frames = frames.select(F.col(key).cast("long").alias("key"), F.col("t").cast("double").alias("t"))
    by = Window.partitionBy("key")
    groups = gold.select(F.col(key).cast("long").alias("key"), "s", "e").withColumn("grp", (F.row_number().over(by.orderBy("s")) - 1).cast("int")).withColumn("m", F.count(F.lit(1)).over(by))
    plan = groups.groupBy("key").agg(F.max("m").alias("m"), F.percentile(F.col("e") - F.col("s"), 0.5).alias("span"))
    times = settled(flagged(frames, groups), "times")
    own = settled(evidence(times, groups), "evidence")
    stretches = settled(free(times, plan), "stretches")
    chosen = taken(stretches, seed)
    step = lambda i: (F.col("a") + F.round(F.lit(i) * (F.col("b") - F.col("a")) / F.lit(3.0))).cast("int")
    at = chosen.select("key", "k", "run", F.explode(F.array(*[step(i) for i in range(4)])).alias("pos"))
    others = at.join(stretches.select("key", "run", "pos", "t"), ["key", "run", "pos"]).groupBy("key", "k").agg(F.array_sort(F.collect_list("t")).alias("pts"))

    state = plan.join(own.groupBy("key").agg(F.min("n").alias("least")), "key")
    state = state.join(chosen.groupBy("key").agg(F.count(F.lit(1)).alias("found")), "key", "left")
    why = F.when(~F.col("m").between(2, 4), "merged_group_count_outside_2_to_4").when(F.col("least") < 4, "evidence_group_has_fewer_than_four_distinct_pts")
    why = why.when(F.coalesce("found", F.lit(0)) < DISTRACTORS, "fewer_than_three_disjoint_distractor_groups").otherwise("")
    state = state.select("key", "m", why.alias("reason"))
    rows = own.select("key", "grp", F.lit(True).alias("is_gold"), "pts").join(state, "key")
    rows = rows.unionByName(others.join(state, "key").select("key", (F.col("m") + F.col("k")).cast("int").alias("grp"), F.lit(False).alias("is_gold"), "pts", "m", "reason"))
    name = F.substring(hash_order(seed, F.col("key"), F.array_join(F.transform("pts", lambda p: micros(p).cast("string")), ",")), 1, 16)
    good = rows.where("reason = ''").select("key", F.lit(True).alias("built"), "reason", "grp", "is_gold", "pts", name.alias("group_id"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("grp", "int"), ("is_gold", "boolean"), ("pts", "array<double>"), ("group_id", "string"))]
    return good.unionByName(state.where("reason <> ''").select("key", F.lit(False).alias("built"), "reason", *none))


def conditions(built: DataFrame) -> DataFrame:
    """key, condition, groups, replaced: Full, Key-i, Irrel-1, Irrel-2 and Blind. The last distractor
    stands in for one group at a time, so a packet is all groups but one; in order of time, then id."""
    own = F.struct(F.col("pts")[0].alias("start"), "group_id", "grp")
    good = built.where("built").groupBy("key").agg(F.array_sort(F.collect_list(own)).alias("all"), F.max("grp").alias("spare"), F.count_if("is_gold").cast("int").alias("m"))
    without = lambda x: F.transform(F.filter("all", lambda g: g["grp"] != x), lambda g: g["grp"])
    named = lambda name, groups, replaced: F.struct(name.alias("condition"), groups.alias("groups"), replaced.cast("int").alias("replaced"))
    keys = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: named(F.concat(F.lit("Key-"), (i + 1).cast("string")), without(i), i))
    irrel = F.transform(F.array(F.lit(0), F.lit(1)), lambda j: named(F.concat(F.lit("Irrel-"), (j + 1).cast("string")), without(F.col("m") + j), F.col("m") + j))
    ends = F.array(named(F.lit("Full"), without(F.col("spare")), F.lit(None)), named(F.lit("Blind"), F.array().cast("array<int>"), F.lit(None)))
    return good.select("key", F.explode(F.concat(ends, keys, irrel)).alias("c")).select("key", "c.*")


def one_replaced(made: DataFrame) -> DataFrame:
    """Conditions that don't differ from Full in exactly one group (Full and Blind aside): none, if all is well."""
    full = made.where("condition = 'Full'").select("key", F.col("groups").alias("whole"))
    met = made.where("condition not in ('Full', 'Blind')").join(full, "key")
    return met.where((F.size(F.array_except("whole", "groups")) != 1) | (F.size(F.array_except("groups", "whole")) != 1)).select("key", "condition")


def hidden_copies(made: DataFrame, built: DataFrame, contents: DataFrame) -> DataFrame:
    """key, condition, n_shared, valid for each condition with a group replaced: the contents of the
    removed group that the packet still shows. contents: (key, t, h), h a hash of what a time shows."""
    shown = built.where("built").select("key", "grp", F.explode("pts").alias("t")).join(contents.select("key", "t", "h"), ["key", "t"]).select("key", "grp", "h").distinct()
    swaps = made.where("replaced is not null")
    kept = swaps.select("key", "condition", F.explode("groups").alias("grp")).join(shown, ["key", "grp"]).select("key", "condition", "h").distinct()
    gone = swaps.select("key", "condition", F.col("replaced").alias("grp")).join(shown, ["key", "grp"]).select("key", "condition", "h")
    shared = gone.join(kept, ["key", "condition", "h"]).groupBy("key", "condition").agg(F.count(F.lit(1)).alias("n"))
    out = swaps.select("key", "condition").join(shared, ["key", "condition"], "left")
    return out.select("key", "condition", F.coalesce("n", F.lit(0)).alias("n_shared"), F.col("n").isNull().alias("valid"))
