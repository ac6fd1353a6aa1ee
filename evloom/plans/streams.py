"""Queries that run as streams over the tables, read to their end, with the SQL of their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reservoirs as rs
from ..operators.requests import answered
from ..session import own_dir, table
from ..streaming import requests as rq
from ..streaming import stateful as st
from .catalogue import ORACLE, query

#: Slots of a user's reservoir, and the bytes that an event may take.
K, CAP, SEED = 6, 44, 17
PAYLOAD = """'{"id":' || event_id || ',"type":"' || event_type || '","v":' || floor(value)::BIGINT || '}'"""
HELD = ", ".join(f"last_value(CASE WHEN slot = {j} THEN payload END IGNORE NULLS) OVER w AS s{j}" for j in range(K))
STEPS = f"""
ev AS (SELECT user_id AS key, ts, event_id AS item, {PAYLOAD} AS payload FROM events),
fi AS (SELECT *, octet_length(encode(payload)) <= {CAP} AS fits FROM ev),
nu AS (SELECT *, CASE WHEN fits THEN sum(fits::BIGINT) OVER (PARTITION BY key ORDER BY ts, item ROWS UNBOUNDED PRECEDING)::BIGINT END AS n FROM fi),
dr AS (SELECT *, CASE WHEN n <= {K} THEN n - 1 ELSE ('0x' || substring(sha256('{SEED}:' || key || ':' || n), 1, 15))::BIGINT % n END AS taken FROM nu),
sl AS (SELECT *, CASE WHEN taken < {K} THEN taken END::INT AS slot FROM dr)"""
AUDIT = f"""
WITH {STEPS}, he AS (SELECT *, {HELD} FROM sl WINDOW w AS (PARTITION BY key ORDER BY ts, item ROWS UNBOUNDED PRECEDING))
SELECT key, item, n, slot, CASE WHEN n IS NOT NULL THEN sha256('{{"seen":' || n || ',"slots":[' || concat_ws(',', {", ".join(f"s{j}" for j in range(K))}) || ']}}') END AS prefix_hash FROM he"""


def payloads(rows):
    return rows.withColumn("payload", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('","v":'), F.floor("value").cast("string"), F.lit("}")))


def event_stream(spark, sf_dir):
    """The events table as a stream with a marker of its end. The path is a pattern, since a stream takes a
    single file only by one (a folder either way)."""
    return st.ended(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]"), "ts")


def folders(spark, what):
    base = f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


@query(AUDIT)
def reservoir_audit(spark, sf_dir):
    """Each user's reservoir event by event, with the hash of what it holds."""
    return rs.reservoir_steps(payloads(table(spark, sf_dir, "events")), "user_id", "ts", "event_id", "payload", K, CAP, SEED)


@query(AUDIT)
def stream_reservoir(spark, sf_dir):
    """The same as a stream with slots and counts as state."""
    stream = st.reservoir_stream(payloads(event_stream(spark, sf_dir)), "user_id", "ts", "event_id", "payload", K, CAP, SEED)
    return st.drained(stream, *folders(spark, "reservoir"))


@query(f"""
WITH {STEPS}, la AS (SELECT key, slot, max_by(payload, n) AS payload FROM sl WHERE slot IS NOT NULL GROUP BY ALL)
SELECT key, count(*) AS slots, sum(octet_length(encode(payload)))::BIGINT AS bytes, max(octet_length(encode(payload)))::BIGINT AS largest FROM la GROUP BY key""")
def stream_state_usage(spark, sf_dir):
    """What the stream's durable state holds, read from the state store and held against its bounds."""
    out, checkpoint = folders(spark, "usage")
    st.drained(st.reservoir_stream(payloads(event_stream(spark, sf_dir)), "user_id", "ts", "event_id", "payload", K, CAP, SEED), out, checkpoint)
    return st.checked_usage(st.slot_usage(spark, checkpoint), K, CAP)


@query(ORACLE["capsules_tumbling"])
def stream_capsules(spark, sf_dir):
    """capsules_tumbling as a stream; a user's last window closes by a timer."""
    stream = st.capsule_stream(event_stream(spark, sf_dir), "user_id", "ts", 86400.0, tail=60.0, idle=400 * 86400.0)
    return st.drained(stream, *folders(spark, "capsules")).withColumnRenamed("key", "user_id")


# Requests: order comments as prompts to a client that counts

PROMPT = "'answer ' || o_orderpriority || ' ' || o_orderkey % 97"


def counting_client():
    """Answers in reverse, a token a character; refuses every prompt that ends on 13."""

    def ask(prompt: str) -> tuple[str, int]:
        if prompt.endswith(" 13"):
            raise TimeoutError("no answer")
        return prompt[::-1], len(prompt)

    return ask


def prompts(rows):
    return rows.withColumn("prompt", F.concat(F.lit("answer "), "o_orderpriority", F.lit(" "), (F.col("o_orderkey") % 97).cast("string")))


@query(f"""
WITH q AS (SELECT o_orderkey::VARCHAR AS key, {PROMPT} AS prompt FROM orders)
SELECT key, CASE WHEN prompt LIKE '% 13' THEN 'failed' ELSE 'complete' END AS state, CASE WHEN prompt NOT LIKE '% 13' THEN reverse(prompt) END AS response, 100 + CASE WHEN prompt LIKE '% 13' THEN 50 ELSE length(prompt) END AS charged FROM q""")
def stream_requests(spark, sf_dir):
    """Orders as a stream of requests, reserved before they are called."""
    root = folders(spark, "requests")[0]
    rows = prompts(spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]"))
    asked = rows.select(F.col("o_orderkey").cast("string").alias("key"), "prompt", F.lit(100).cast("long").alias("input_tokens"), F.lit(50).cast("long").alias("max_output_tokens"))
    rq.answer_stream(asked, root, counting_client)
    return rq.request_ledger(spark, root).select("key", "state", "response", "charged")


@query(f"""
WITH q AS (SELECT o_orderkey, {PROMPT} AS prompt FROM orders)
SELECT o_orderkey, prompt, sha256(chr(31) || prompt) AS request_key, CASE WHEN prompt LIKE '% 13' THEN 'failed' ELSE 'complete' END AS state, CASE WHEN prompt NOT LIKE '% 13' THEN reverse(prompt) END AS response, prompt NOT LIKE '% 13' AS cached FROM q""")
def request_cache(spark, sf_dir):
    """The answers of a second run, all from the cache but for what failed."""
    root, rows = folders(spark, "cache")[0], prompts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).drop("o_orderpriority")
    answered(rows, "prompt", counting_client, root)
    return answered(rows, "prompt", counting_client, root).select("o_orderkey", "prompt", "request_key", "state", "response", "cached")
