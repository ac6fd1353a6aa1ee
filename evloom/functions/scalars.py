"""Scalar expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUCCESS = ("complete", "ok", "success")


def hash_order(seed: int | str, *parts: Column) -> Column:
    """The hexadecimal SHA-256 of "seed:part:..."; sorting by it, then by id, is the seeded order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; unequal lengths, zero and non-finite vectors are errors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    bad = (F.size(a) != F.size(b)) | (norm == 0) | F.isnan(norm) | (norm == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("cosine needs finite nonzero vectors of one length")).cast("double")).otherwise(dot(a, b) / norm)


def score(status: Column, verdict: Column, parse_ok: Column, truncated: Column, abstained: Column, answer: Column) -> Column:
    """1 where a final row counts as correct, else 0; nulls follow the evaluation's rules."""
    blank = F.coalesce(F.trim(answer) == "", F.lit(False)) | F.coalesce(abstained, F.lit(False))
    good = F.coalesce(status.isin(*SUCCESS), F.lit(False)) & F.coalesce(verdict == "correct", F.lit(False))
    return F.when(~blank & good & F.coalesce(parse_ok, F.lit(True)) & ~F.coalesce(truncated, F.lit(False)), 1).otherwise(0)


def charged(input_tokens: Column, output_tokens: Column, max_output: Column) -> Column:
    """Tokens of a ledger entry; unknown output counts as its full reservation."""
    return input_tokens + F.coalesce(output_tokens, max_output)


def safe_path(path: Column) -> Column:
    return path.rlike(r"^videos/[A-Za-z0-9_-]+\.(mp4|mkv|webm|avi|mov)$")


def canonical_id(video_id: Column, source: Column, marked: str) -> Column:
    """The id without a leading "v_" where its source is `marked`."""
    return F.when((source == marked) & video_id.startswith("v_"), F.substring(video_id, 3, 2_000_000)).otherwise(video_id)


def normalised_text(text: Column) -> Column:
    """Words in lower case, joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def padded(values: Column, width: int, kind: str) -> Column:
    """An array filled with nulls up to `width`."""
    return F.concat(values, F.array_repeat(F.lit(None).cast(kind), F.greatest(F.lit(0), F.lit(width) - F.size(values))))


#: The causes of a failure, in the order in which they are asked for.
CAUSES = (
    "frontend_or_data_not_captured", "known_path_not_stored", "read_budget_infeasible", "method_execution_or_parse_failure",
    "observed_repairable_read_gap", "consumer_representation_or_injection_unresolved", "success", "insufficient_diagnostic_information",
)


def failure_category(captured: Column, stored: Column, feasible: Column, executed: Column, wrong: Column, reference_right: Column, access: Column, unresolved: Column) -> Column:
    """The first cause that applies, in the order of the evidence's way to the answer."""
    tests = [~captured, ~stored, ~feasible, ~executed, wrong & reference_right & ~access, wrong & unresolved, ~wrong]
    out = F.when(tests[0], CAUSES[0])
    for test, cause in zip(tests[1:], CAUSES[1:], strict=False):
        out = out.when(test, cause)
    return out.otherwise(CAUSES[-1])


def condition_family(condition: Column) -> Column:
    """Full, Key, Irrel or Blind of Key-2 and the like."""
    return F.split_part(condition, F.lit("-"), F.lit(1))


def outcome(difference: Column) -> Column:
    return F.when(difference > 0, "positive").when(difference < 0, "negative").when(difference == 0, "zero")


def domain_order(value: Column, domain: list[str]) -> Column:
    """The place of a value in a domain's own order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in domain]), value), F.lit(0)), F.lit(len(domain) + 1))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def padded_number(n: Column, width: int = 6) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def hash_parity(h: Column) -> Column:
    """Whether a hexadecimal hash is odd."""
    return F.conv(F.substring(h, -1, 1), 16, 10).cast("int") % 2


def mean_pool(vectors: Column, valid: Column) -> Column:
    """The mean of the valid vectors of an array, at length one; null without any."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), valid.alias("ok")), lambda x: x["ok"]), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, 1 << 30), F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: F.try_divide(x, F.sqrt(dot(total, total))))
