"""Scans and sinks for JSON, JSON lines, CSV, pinned files and role exports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON value; anything that doesn't parse is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines without blank ones; a path that isn't there is empty, if that is allowed."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines; the commit protocol makes it whole or absent."""
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sorted_fields(value: Column, kind: DataType) -> Column:
    """A value whose structs, at any depth, have their fields in the order of their names."""
    if isinstance(kind, StructType):
        inner = F.struct(*[sorted_fields(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    return value


def canonical(df: DataFrame) -> DataFrame:
    """One column, json: each row with its fields in the order of their names, at any depth, compact."""
    return df.select(F.to_json(F.struct(*[sorted_fields(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)])).alias("json"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pinned(spark: SparkSession, path: str, sha256: str, most: int = 16 << 20) -> DataFrame:
    """content of a file, or an error unless its hash is the stated one and its size within the limit; a
    larger file isn't read."""
    found = spark.read.format("binaryFile").load(path)
    if found.select("length").where(F.col("length") > most).limit(1).count():
        raise ValueError("file is larger than the limit")
    good = F.sha2("content", 256) == sha256
    return found.where(F.when(good, True).otherwise(F.raise_error(F.lit("file is not the pinned one")).cast("boolean"))).select("content")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, a byte order mark in front of it or not."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def ratio(text: Column) -> Column:
    """struct(hits, of) of a text such as 11／48, with a full-width slash or a plain one; null if it isn't one."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^([0-9]+)\s*[／/]\s*([0-9]+)$", k).try_cast("long")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("hits"), part(2).alias("of")))


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that are there, in the order of the names."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def nested_fields(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """`df` with only the named fields left in an array of structs."""
    return df.withColumn(array, F.transform(array, lambda x: F.struct(*[x[c].alias(c) for c in names])))


def small_rows(df: DataFrame, most: int) -> list:
    """All rows of a report; an error, if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes {most} rows at most")
    return rows


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *small_rows(df, most)]
    return "".join(f"| {' | '.join(map(cell, row))} |\n" for row in lines)


def html_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as an HTML table."""
    row = lambda values, tag: "<tr>" + "".join(f"<{tag}>{'' if v is None else html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    return "<table>" + row(df.columns, "th") + "".join(row(r, "td") for r in small_rows(df, most)) + "</table>"


def export_roles(df: DataFrame, path: str, hidden: list[str]) -> None:
    """A folder for each role, without the hidden columns."""
    df.drop(*hidden).write.mode("overwrite").partitionBy("role").json(path)
