import json

import pytest
from pyspark.sql import functions as F

from evloom.functions import model_json
from evloom.plans import catalogue, experiments, reports, sources, streams, trials  # noqa: F401
from evloom.sources import files
from evloom.streaming import windows


def test_lines_json_csv_and_pins(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_lines(spark, str(lines), "a long").collect()) == [1, 2]
    assert files.read_lines(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    whole = tmp_path / "b.json"
    whole.write_text('[\n {"a": 1},\n {"a": 5}\n]')
    assert sorted(r.a for r in files.read_json(spark, str(whole), "a long").collect()) == [1, 5]
    table = tmp_path / "c.csv"
    table.write_text("﻿x,y\n1,11／48\n", encoding="utf-8")
    assert files.read_csv(spark, str(table)).first().asDict() == {"x": "1", "y": "11／48"}
    sha = files.file_hashes(spark, str(whole)).first().sha256
    assert bytes(files.pinned(spark, str(whole), sha).first().content) == whole.read_bytes()
    with pytest.raises(Exception, match="not the pinned one"):
        files.pinned(spark, str(whole), "0" * 64).collect()


def test_canonical_and_roles(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "dev")], "b long, a string, role string")
    assert json.loads(files.canonical(df).first().json) == {"a": "x", "b": 1, "role": "dev"}
    assert list(json.loads(files.canonical(df).first().json)) == ["a", "b", "role"]
    files.export_roles(df, str(tmp_path / "out"), ["a"])
    assert spark.read.json(str(tmp_path / "out")).columns == ["b", "role"]
    files.append_lines(df, str(tmp_path / "log"))
    files.append_lines(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_nested_values_reports_and_ratios(spark, tmp_path):
    df = spark.createDataFrame([(1, [{"z": 1, "a": {"y": 2, "b": 3}}], None)], "q long, l array<struct<z:int,a:struct<y:int,b:int>>>, n struct<b:int,a:int>")
    assert files.canonical(df).first().json == '{"l":[{"a":{"b":3,"y":2},"z":1}],"q":1}'
    assert files.present(df, ["n", "none", "q"]).columns == ["n", "q"]
    assert files.nested_fields(df, "l", ["z"]).first().l[0].asDict() == {"z": 1}
    rows = spark.createDataFrame([("11／48",), ("3/4",), ("x",), (None,)], "t string")
    assert [r.r and tuple(r.r) for r in rows.select(files.ratio(F.col("t")).alias("r")).collect()] == [(11, 48), (3, 4), None, None]
    small = spark.createDataFrame([("a|b", None), ("<c>", 2)], "x string, y long")
    assert files.markdown(small) == "| x | y |\n| --- | --- |\n| a\\|b |  |\n| <c> | 2 |\n"
    assert "<td>&lt;c&gt;</td><td>2</td>" in files.html_table(small)
    with pytest.raises(ValueError, match="1 rows at most"):
        files.markdown(small, 1)
    big = tmp_path / "big"
    big.write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="larger than the limit"):
        files.pinned(spark, str(big), "0" * 64, most=99)


def test_stream_of_ordered_times(spark, tmp_path):
    schema = "k long, n long, t double"
    for part in ([(1, 1, 1.0), (1, 2, 1.0), (1, 3, None)], [(1, 4, 2.0), (2, 5, 9.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), schema)
    got = windows.drain(windows.ordered_times(stream, "k", "n", "t"), "timed", "update", str(tmp_path / "c3"))
    assert {r.key: (r.kept, r.nulls, r.duplicates) for r in got.orderBy("kept").collect()} == {1: (2, 1, 1), 2: (1, 0, 0)}
    spark.createDataFrame([(2, 6, 3.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="is before"):
        windows.drain(windows.ordered_times(stream, "k", "n", "t"), "timed2", "update", str(tmp_path / "c4"))


def test_tumbling_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), events.schema)
    got = windows.drain(windows.tumbling(stream, "user_id", "ts", "1 day"), "tumbled", "append", str(tmp_path / "c1"))
    batch = events.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("s"), "n")
    last = events.agg(F.max("ts").alias("m")).first().m
    closed = {(r.user_id, r.s, r.n) for r in batch.collect() if (last - r.s).days >= 1}
    assert closed == {(r.user_id, r.s, r.n) for r in got.collect()}


@pytest.mark.parametrize(
    ("text", "ok"),
    [('{"answer": "x", "citations": []}', True), ('```json\n{"answer": "x", "citations": ["a"]}\n```', True), ('{"answer": 3, "citations": []}', False), ("{'answer': 'x'}", False),
     ('so: {"answer": "x", "citations": []}', False), ('[{"answer": "x"}]', False), ('{"answer": "x"}', False), ("", False), ('{"answer": "x", "citations": null}', False), ('{"answer": "x", "citations": [null]}', False)],
)
def test_answers(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(model_json.answer(F.col("t"), F.array(F.lit("a"))).alias("a")).first().a.parse_ok is ok


def test_null_text_is_no_answer(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(model_json.answer(F.col("t"), F.array(F.lit("a"))).alias("a")).first().a.parse_ok is False


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_run(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
