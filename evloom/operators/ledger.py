"""Request ledgers: reservations under caps, what is charged, roll-ups, and replay of a stored ledger.

A request is reserved before it is made, at its input plus the most it may put out; a refused one leaves
no trace in what follows, so admission is a fold in order, ledger by ledger. Ledgers come sorted from
Spark and pass through in batches; what is kept of one is a few counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import charged

PHASES, ROLES = ("D0", "RESERVE", "E1", "E2", "E3"), ("answer", "control", "judge")
FIELDS = "phase string, question string, method string, role string, input_tokens long, max_output_tokens long, output_tokens long, error string, physical boolean"


@dataclass(frozen=True)
class Caps:
    """Tokens of a request and of a method's requests, and requests by kind."""

    request_tokens: int = 8192
    method_tokens: int = 12288
    method_calls: dict[str, int] = field(default_factory=lambda: {"R0": 1, "R1": 2, "R2": 2, "R*": 1})
    physical: dict[str, int] = field(default_factory=lambda: {"total": 1800, "core": 1400, "E3": 400, "D0": 50, "RESERVE": 100})


def canonical_method(name: str | None) -> str | None:
    return "R*" if name == "Rstar" else name


class Fold:
    """One ledger so far: physical requests by kind, and calls and tokens of each question's methods."""

    def __init__(self, caps: Caps):
        self.caps = caps
        self.physical: Counter = Counter()
        self.calls: Counter = Counter()
        self.tokens: Counter = Counter()

    def refusal(self, r: dict) -> str | None:
        """Why a request isn't admitted, or None."""
        caps, reserved = self.caps, r["input_tokens"] + r["max_output_tokens"]
        if reserved > caps.request_tokens:
            return "request tokens"
        if r["phase"] == "E2" and r["role"] != "judge":
            key = (r["question"], r["method"])
            if r["method"] not in caps.method_calls:
                return "unknown method"
            if self.calls[key] >= caps.method_calls[r["method"]]:
                return "method calls"
            if self.tokens[key] + reserved > caps.method_tokens:
                return "method tokens"
        if r["physical"]:
            for kind in kinds_of(r["phase"]):
                if self.physical[kind] >= caps.physical[kind]:
                    return f"physical {kind}"
        return None

    def add(self, r: dict) -> None:
        if r["physical"]:
            self.physical.update(kinds_of(r["phase"]))
        if r["phase"] == "E2" and r["role"] != "judge":
            key = (r["question"], r["method"])
            self.calls[key] += 1
            self.tokens[key] += r["input_tokens"] + (r["max_output_tokens"] if r["output_tokens"] is None else r["output_tokens"])


def kinds_of(phase: str) -> list[str]:
    """The counts that a physical request of a phase belongs to."""
    return ["total", "E3" if phase == "E3" else "core", *([phase] if phase in ("D0", "RESERVE") else [])]


def checked_requests(rows: DataFrame, ledger: str, request: str) -> DataFrame:
    """`rows`, or an error at the first that breaks the domain: phase and role of the lists above, counts
    from 0 on, a request id once in a ledger."""
    known = F.col("phase").isin(*PHASES) & F.col("role").isin(*ROLES)
    counts = (F.col("input_tokens") >= 0) & (F.col("max_output_tokens") >= 0) & F.coalesce(F.col("output_tokens") >= 0, F.lit(True))
    once = F.count(F.lit(1)).over(Window.partitionBy(ledger, request)) == 1
    why = F.when(~F.coalesce(known, F.lit(False)), "invalid phase or role").when(~F.coalesce(counts, F.lit(False)), "token counts must not be negative").when(~once, "repeated request id")
    told = rows.withColumn("_why", why)
    return told.where(F.when(F.col("_why").isNull(), True).otherwise(F.raise_error(F.col("_why")).cast("boolean"))).drop("_why")


def reserve(rows: DataFrame, ledger: str, order: list[str], caps: Caps | None = None) -> DataFrame:
    """Adds refusal (null: admitted) to requests (FIELDS' columns) taken in order, ledger by ledger. A
    request's output counts as known (null: its whole reservation) before the next is taken."""
    caps = caps or Caps()
    names = [f.split()[0] for f in FIELDS.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = object(), Fold(caps)
        for batch in batches:
            out = []
            for own, r in zip(batch.column(ledger).to_pylist(), batch.select(names).to_pylist(), strict=True):
                if own != now:
                    now, fold = own, Fold(caps)
                r["method"] = canonical_method(r["method"])
                why = fold.refusal(r)
                if why is None:
                    fold.add(r)
                out.append(why)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "refusal"])

    return rows.repartition(ledger).sortWithinPartitions(ledger, *order).mapInArrow(run, f"{schema}, refusal string")


def finalized(rows: DataFrame) -> DataFrame:
    """Adds state and charged to admitted requests (with done: whether the answer is in): a request
    without an answer is reserved, one that put out more than its reservation a budget violation."""
    over = F.coalesce(F.col("output_tokens") > F.col("max_output_tokens"), F.lit(False))
    state = F.when(~F.col("done"), "reserved").when(over, "budget_violation").when(F.col("error").isNotNull(), "failed").otherwise("complete")
    return rows.withColumn("state", state).withColumn("charged", charged(F.col("input_tokens"), F.col("output_tokens"), F.col("max_output_tokens")))


def with_attempts(rows: DataFrame, ledger: str, order: list[str]) -> DataFrame:
    """Adds attempt: the how manyeth admitted request of its phase, question, method, condition and role."""
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(ledger, "phase", "question", "method", "condition", "role").orderBy(*order)))


def method_cost(entries: DataFrame, by: list[str]) -> DataFrame:
    """Roll-up of finalized entries but the judge's."""
    physical = F.col("physical")
    return entries.where("role <> 'judge'").groupBy(*by).agg(
        F.count(F.lit(1)).alias("logical_calls"), F.sum("charged").alias("logical_tokens"), F.count_if(physical).alias("physical_calls"),
        F.coalesce(F.sum(F.when(physical, F.col("charged"))), F.lit(0)).alias("physical_tokens"), F.count_if(~physical).alias("cache_saved_calls"),
        F.count_if(F.col("output_tokens").isNull()).alias("unknown_output_calls"), F.count_if(F.col("state").isin("failed", "budget_violation")).alias("failed_calls"),
    )


def summary(entries: DataFrame, by: list[str]) -> DataFrame:
    """Roll-up of all finalized entries."""
    physical, late = F.col("physical"), F.col("phase") == "E3"
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("logical_calls"), F.count_if(physical).alias("physical_calls"), F.count_if(physical & ~late).alias("core_physical_calls"),
        F.count_if(physical & late).alias("e3_physical_calls"), total(F.col("charged")).alias("logical_tokens"), total(F.when(physical, F.col("charged"))).alias("physical_tokens"),
        total(F.when(F.col("role") == "judge", F.col("charged"))).alias("judge_logical_tokens"), F.count_if(F.col("state") == "budget_violation").alias("budget_violations"),
        F.count_if(F.col("state") == "reserved").alias("pending_requests"),
    )


def replayed(stored: DataFrame, ledger: str, order: list[str], caps: Caps | None = None) -> DataFrame:
    """The entries of stored ledgers (with attempt, state and charged as stored), or an error where they
    could not have come about: a request that the caps refuse, or another attempt, state or charge."""
    again = with_attempts(finalized(reserve(stored.drop("attempt", "state", "charged"), ledger, order, caps)), ledger, order)
    keys = [ledger, *order]
    kept = stored.select(*keys, *[F.col(c).alias(f"stored_{c}") for c in ("attempt", "state", "charged")])
    met = again.join(kept, keys)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    why = F.when(F.col("refusal").isNotNull(), F.concat(F.lit("refused: "), "refusal")).when(~same("attempt"), "attempts are inconsistent").when(~(same("state") & same("charged")), "states are inconsistent")
    return met.where(F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean"))).drop("refusal", "stored_attempt", "stored_state", "stored_charged")
