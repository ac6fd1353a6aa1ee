"""Covers, ledgers, planned results and the like, on literal vectors and against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evloom.functions import scalars
from evloom.operators import evaluation as ev
from evloom.operators import intervals as iv
from evloom.operators import ledger as lg
from evloom.operators import retrieval as rt
from evloom.operators import sampling as sp


def capped(spark, masks, order, n_groups, cap):
    m = spark.createDataFrame([(1, i, x) for i, x in masks.items()], "k long, i long, mask int")
    r = spark.createDataFrame([(1, i, n) for n, i in enumerate(order)], "k long, i long, rank int")
    return iv.capped_cover(m, r, "k", "i", n_groups, cap).first()


def test_capped_cover_on_fixed_vectors(spark):
    # Five items with masks 1, 2, 4, 3, 0 and what must come out of them.
    masks = {1: 1, 2: 2, 3: 4, 4: 3, 5: 0}
    r = capped(spark, masks, [5, 1, 2, 3, 4], 3, 3)
    assert (r.minimum_size, r.ids, r.access, r.stored, r.feasible) == (2, [3, 4, 5], True, True, True)
    r = capped(spark, masks, [1, 2, 3, 4, 5], 3, 1)
    assert (r.stored, r.feasible, r.ids, r.covered) == (True, False, [4], 3)
    r = capped(spark, masks | {3: 0}, [1, 2, 3, 4, 5], 3, 6)
    assert (r.stored, r.minimum_size, r.access) == (False, None, False)


def test_covers_equal_brute_force(spark):
    rng = random.Random(43)
    banks = {k: {i: rng.randrange(16) for i in range(8)} for k in range(30)}
    m = spark.createDataFrame([(k, i, x) for k, b in banks.items() for i, x in b.items()], "k long, i long, mask int")
    union = lambda b, s: __import__("functools").reduce(lambda x, i: x | b[i], s, 0)
    for cap in (2, 4):
        got = {r.k: r for r in iv.capped_cover(m, m.select("k", "i", F.col("i").alias("rank")), "k", "i", 4, cap).collect()}
        for k, b in banks.items():
            subsets = [s for n in range(5) for s in itertools.combinations(range(8), n)]
            full = [s for s in subsets if union(b, s) == 15]
            best = min((s for s in subsets if len(s) <= cap), key=lambda s: (-union(b, s).bit_count(), len(s), s))
            chosen = (list(best) + [i for i in range(8) if i not in best])[:cap]
            r = got[k]
            assert (r.stored, r.minimum_size) == (bool(full), min(map(len, full), default=None))
            assert (r.ids, r.covered, r.access) == (chosen, union(b, chosen), union(b, chosen) == 15)
            assert r.feasible == (bool(full) and min(map(len, full)) <= cap)


REQUEST = "ledger long, n long, phase string, question string, method string, role string, condition string, input_tokens long, max_output_tokens long, output_tokens long, error string, physical boolean, done boolean"


def requests(spark, rows):
    base = {"ledger": 1, "phase": "E2", "question": "q1", "method": "R2", "role": "answer", "condition": "", "input_tokens": 1000, "max_output_tokens": 96, "output_tokens": None, "error": None, "physical": True, "done": True}
    names = [f.split()[0] for f in REQUEST.split(", ")]
    return spark.createDataFrame([tuple((base | {"n": n} | r)[c] for c in names) for n, r in enumerate(rows)], REQUEST)


def refusals(spark, rows, caps=None):
    return [r.refusal for r in lg.reserve(requests(spark, rows), "ledger", ["ledger", "n"], caps).orderBy("n").collect()]


def test_ledger_holds_its_caps(spark):
    assert refusals(spark, [{"input_tokens": 8192, "max_output_tokens": 1}, {"input_tokens": 8096, "output_tokens": 96}, {"input_tokens": 4001}, {"input_tokens": 3900}, {"input_tokens": 1}]) == ["request tokens", None, "method tokens", None, "method calls"]
    # An unknown output is charged as reserved; a known one as it is.
    assert refusals(spark, [{"input_tokens": 6000, "max_output_tokens": 2000, "output_tokens": 10}, {"input_tokens": 6000, "max_output_tokens": 278}]) == [None, None]
    assert refusals(spark, [{"input_tokens": 6000, "max_output_tokens": 2000}, {"input_tokens": 4200, "max_output_tokens": 96}]) == [None, "method tokens"]
    assert refusals(spark, [{"method": "R0"}, {"method": "R0", "role": "judge"}, {"method": "R0"}, {"method": "Rstar"}, {"method": "R*"}, {"method": "X"}]) == [None, None, "method calls", None, "method calls", "unknown method"]
    few = lg.Caps(physical={"total": 3, "core": 2, "E3": 1, "D0": 1, "RESERVE": 1})
    rows = [{"phase": "D0"}, {"phase": "D0"}, {"phase": "E3"}, {"phase": "E3"}, {"phase": "E1"}, {"phase": "E1"}, {"phase": "E1", "physical": False}]
    assert refusals(spark, rows, few) == [None, "physical D0", None, "physical E3", None, "physical total", None]
    two = [{"ledger": k % 2, "phase": "D0"} for k in range(6)]  # ledgers know nothing of each other
    assert refusals(spark, two, few) == [None, None] + ["physical D0"] * 4


def test_ledger_entries_and_replay(spark):
    rows = requests(spark, [{"output_tokens": 50}, {"output_tokens": 97}, {"method": "R1", "error": "x"}, {"method": "R1", "done": False, "physical": False}, {"role": "judge", "output_tokens": 5}])
    made = lg.with_attempts(lg.finalized(lg.reserve(lg.checked_requests(rows, "ledger", "n"), "ledger", ["n"]).drop("refusal")), "ledger", ["n"])
    made = spark.createDataFrame(made.collect(), made.schema)
    assert [(r.state, r.charged, r.attempt) for r in made.orderBy("n").collect()] == [("complete", 1050, 1), ("budget_violation", 1097, 2), ("failed", 1096, 1), ("reserved", 1096, 2), ("complete", 1005, 1)]
    cost = {r.method: r for r in lg.method_cost(made, ["method"]).collect()}
    assert (cost["R2"].logical_calls, cost["R2"].logical_tokens, cost["R2"].failed_calls) == (2, 2147, 1)
    assert (cost["R1"].physical_calls, cost["R1"].cache_saved_calls, cost["R1"].unknown_output_calls) == (1, 1, 2)
    total = lg.summary(made, []).first()
    assert (total.logical_calls, total.physical_calls, total.judge_logical_tokens, total.budget_violations, total.pending_requests) == (5, 4, 1005, 1, 1)
    assert lg.replayed(made, "ledger", ["n"]).count() == 5
    for spoiled, why in ((made.withColumn("attempt", F.lit(1)), "attempts"), (made.withColumn("charged", F.lit(1)), "states"), (made.withColumn("input_tokens", F.lit(9000).cast("long")), "refused")):
        with pytest.raises(Exception, match=why):
            lg.replayed(spoiled, "ledger", ["n"]).collect()


def test_requests_outside_of_their_domain_are_errors(spark):
    for row, why in (({"phase": "E9"}, "phase or role"), ({"role": None}, "phase or role"), ({"input_tokens": -1}, "negative"), ({"n": 0}, "repeated")):
        with pytest.raises(Exception, match=why):
            lg.checked_requests(requests(spark, [{}, row]), "ledger", "n").collect()


def test_planned_results_are_checked(spark):
    planned = spark.createDataFrame([("q1", "v1"), ("q2", "v1")], "q string, v string")
    rows = lambda *x: spark.createDataFrame(list(x), "q string, v string, status string, citations_legal boolean")
    got = ev.planned_results(planned, rows(("q1", "v1", "complete", True)), ["q"], ["v"]).orderBy("q").collect()
    assert [tuple(r[c] for c in ("q", "v", "status", "citations_legal")) for r in got] == [("q1", "v1", "complete", True), ("q2", "v1", "missing", False)]
    for bad, why in ((rows(("q9", "v1", "complete", True)), "unplanned"), (rows(("q1", "v1", "ok", True), ("q1", "v1", "ok", True)), "repeated"), (rows(("q1", "v2", "ok", True)), "disagrees on v")):
        with pytest.raises(Exception, match=why):
            ev.planned_results(planned, bad, ["q"], ["v"]).collect()


def test_a_short_pool_and_repeated_items_are_errors(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(5)], "id long, s long")
    assert sp.stratified_take(rows, "s", "id", 5).count() == 5
    with pytest.raises(Exception, match="fewer than 6"):
        sp.stratified_take(rows, "s", "id", 6).collect()
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    with pytest.raises(ValueError, match="two rows"):
        rt.topk(items, items.limit(1), 1, 2)


def test_scalars(spark):
    df = spark.createDataFrame([("Key-2", 1.0, [3, 1, 3], [1, 3], 42, "0f"), ("Full", -1.0, [1], [1, 2], 7, "00")], "c string, d double, a array<int>, b array<int>, n int, h string")
    got = df.select(
        scalars.condition_family(F.col("c")), scalars.outcome(F.col("d")), scalars.same_set(F.col("a"), F.col("b")), scalars.padded_number(F.col("n")), scalars.hash_parity(F.col("h")), scalars.domain_order(F.col("c"), ["Full", "Key-1"]),
    ).collect()
    assert [tuple(r) for r in got] == [("Key", "positive", True, "000042", 1, 3), ("Full", "negative", False, "000007", 0, 1)]
    pooled = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [True, True, False]), ([[1.0, 0.0]], [False])], "v array<array<double>>, ok array<boolean>").select(scalars.mean_pool(F.col("v"), F.col("ok")).alias("p")).collect()
    assert pooled[0].p == pytest.approx([0.5**0.5] * 2)
    assert pooled[1].p is None


def test_micro_and_macro_means(spark):
    df = spark.createDataFrame([("g", "u", 1.0), ("g", "u", 1.0), ("g", "w", 0.0)], "g string, u string, x double")
    assert tuple(ev.micro_macro(df, "g", "u", "x").first()) == ("g", pytest.approx(2 / 3), 0.5, 3, 2)
    d = spark.createDataFrame([("q", "a", None), ("q", "b", True), ("r", "a", None)], "u string, h string, f boolean")
    assert [tuple(r) for r in ev.disagreeing(d, "u", ["h", "f"]).collect()] == [("q", "h")]
