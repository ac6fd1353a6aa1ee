"""Queries of table functions, batches for a judge, and tensors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import register_tables
from ..operators import sampling as sp
from ..session import settled, table
from ..sources import arrays
from .catalogue import ORACLE, query, spans


@query(ORACLE["interval_merge"])
def interval_merge_udtf(spark, sf_dir):
    """interval_merge as a table function in SQL."""
    register_tables(spark)
    view = f"intervals_{uuid.uuid4().hex}"
    spans(spark, sf_dir).select(F.col("user_id").alias("key"), "s", "e").createOrReplaceTempView(view)
    return spark.sql(f"SELECT key AS user_id, s, e, n FROM merge_intervals(TABLE(SELECT * FROM {view}) PARTITION BY key ORDER BY (s, e))")


@query("""
SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN 'uncertain' WHEN length(text) % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS verdict, length(text) % 7 <> 0 AS parse_ok FROM documents""")
def judge_round_trip(spark, sf_dir):
    """Documents shuffled into anonymous batches of four, judged as JSON, parsed by a table function and
    joined back: whatever the shuffle, each verdict comes to its own document."""
    register_tables(spark)
    blind, mapping = sp.anonymous_batches(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")), "doc_id")
    mapping = settled(mapping, "mapping")
    verdict = F.when(F.col("size") % 2 == 0, "correct").otherwise("incorrect")
    item = F.struct("anon", F.to_json(F.struct(F.col("anon").alias("id"), verdict.alias("verdict"), F.when(F.col("size") % 7 == 0, " ").otherwise("because").alias("reason"))).alias("json"))
    held = blind.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("r"))  # four rows a batch
    view = f"judged_{uuid.uuid4().hex}"
    held.select("batch", F.col("r.anon").alias("ids"), F.concat(F.lit('```json\n{"results": ['), F.array_join("r.json", ", "), F.lit("]}\n```")).alias("text")).createOrReplaceTempView(view)
    found = spark.sql(f"SELECT b.batch, j.id AS anon, j.verdict, j.parse_ok FROM {view} b, LATERAL judge_items(b.text, b.ids) j")
    return sp.joined_back(found, mapping, "doc_id")


@query("SELECT vec_id, embedding, len(embedding) AS n_components, 4 * len(embedding) AS n_bytes FROM embeddings")
def tensor_round_trip(spark, sf_dir):
    """Embeddings as tensors, written and read back."""
    held = settled(table(spark, sf_dir, "embeddings").select("vec_id", arrays.tensor(F.col("embedding")).alias("t")), "tensors")
    return held.select("vec_id", arrays.flat(F.col("t")).alias("embedding"), F.element_at("t.shape", 1).cast("long").alias("n_components"), F.length("t.data").cast("long").alias("n_bytes"))
