"""Strict parsing of JSON that a model wrote: one object, at most one fence around it, exact types.

VARIANT keeps the types that from_json() would coerce. It also rejects repeated keys and NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def json_object(text: Column) -> Column:
    """The text as VARIANT, or null unless it is one JSON object, fenced or not."""
    clean = F.trim(text, F.lit(" \t\n\r"))
    for head in (FENCE + "json\n", FENCE + "\n"):
        inner = F.trim(F.substring(clean, len(head) + 1, 2_000_000_000), F.lit(" \t\n\r"))
        fenced = clean.startswith(head) & clean.endswith(FENCE) & (F.length(clean) >= len(head) + 3)
        clean = F.when(fenced, F.trim(F.substring(inner, F.lit(1), F.length(inner) - 3), F.lit(" \t\n\r"))).otherwise(clean)
    value = F.try_parse_json(clean)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def kind(value: Column, path: str) -> Column:
    """The type at a path as text; null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def strings(value: Column, path: str) -> Column:
    """The array of strings at a path; null where it is anything else."""
    found = kind(value, path)
    return F.when(found.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.try_variant_get(value, path, "array<variant>"), lambda v: F.is_variant_null(v)), F.lit(False)), F.try_variant_get(value, path, "array<string>"))


def answer(text: Column, allowed: Column) -> Column:
    """struct(parse_ok, answer, citations, citations_legal, abstained)."""
    value = json_object(text)
    said = F.when(kind(value, "$.answer") == "STRING", F.try_variant_get(value, "$.answer", "string"))
    cited = strings(value, "$.citations")
    ok = F.coalesce(said.isNotNull() & cited.isNotNull(), F.lit(False))
    plain = F.trim(said, F.lit(" \t\n\r"))
    none = F.array().cast("array<string>")
    return F.struct(
        ok.alias("parse_ok"),
        F.when(ok, plain).otherwise("").alias("answer"),
        F.when(ok, cited).otherwise(none).alias("citations"),
        (ok & (F.size(F.array_except(F.coalesce(cited, none), allowed)) == 0)).alias("citations_legal"),
        (ok & (plain == "")).alias("abstained"),
    )


def control(text: Column, fallback: Column, limit: int) -> Column:
    """struct(queries, parse_ok, normalized_from_string): 1 to `limit` queries, else the fallback."""
    value = json_object(text)
    single = F.coalesce(kind(value, "$.queries") == "STRING", F.lit(False))
    found = F.when(single, F.array(F.try_variant_get(value, "$.queries", "string"))).otherwise(strings(value, "$.queries"))
    plain = F.transform(found, lambda q: F.trim(q, F.lit(" \t\n\r")))
    ok = F.coalesce((F.size(found) >= 1) & (F.size(found) <= limit) & F.forall(plain, lambda q: q != ""), F.lit(False))
    return F.struct(F.when(ok, F.array_distinct(plain)).otherwise(F.array(F.trim(fallback))).alias("queries"), ok.alias("parse_ok"), (ok & single).alias("normalized_from_string"))


def verdicts(text: Column, expected: Column) -> Column:
    """array of struct(id, verdict, parse_ok), one for each expected id, in their order. An unknown or
    repeated id makes the whole batch uncertain, a missing or ill-formed item itself."""
    rows = F.try_variant_get(json_object(text), "$.results", "array<variant>")
    item = F.transform(
        rows,
        lambda v: F.struct(
            F.when(kind(v, "$.id") == "STRING", F.try_variant_get(v, "$.id", "string")).alias("id"),
            F.when(kind(v, "$.verdict") == "STRING", F.try_variant_get(v, "$.verdict", "string")).alias("verdict"),
            F.when(kind(v, "$.reason") == "STRING", F.trim(F.try_variant_get(v, "$.reason", "string"))).alias("reason"),
        ),
    )
    ids = F.transform(item, lambda x: x["id"])
    known = F.forall(ids, lambda i: i.isNotNull() & F.array_contains(expected, i))
    whole = F.coalesce(known & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))
    good = F.filter(item, lambda x: F.coalesce(x["verdict"].isin("correct", "incorrect", "uncertain") & (x["reason"] != ""), F.lit(False)))

    def of(i: Column) -> Column:
        own = F.filter(good, lambda x: x["id"] == i)
        ok = whole & F.coalesce(F.size(own) == 1, F.lit(False))
        return F.struct(i.alias("id"), F.when(ok, F.try_element_at(own, F.lit(1))["verdict"]).otherwise("uncertain").alias("verdict"), ok.alias("parse_ok"))

    return F.transform(expected, of)
