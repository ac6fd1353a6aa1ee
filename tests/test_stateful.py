"""Streams with state: several micro-batches, rows out of order, restarts, kills, limits and deadlines."""

import os
import random
import subprocess
import sys
import textwrap
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evloom.operators import intervals as iv
from evloom.operators import requests as cache
from evloom.operators import reservoirs as rs
from evloom.streaming import requests as rq
from evloom.streaming import stateful as st

SCHEMA = "user_id long, ts timestamp, event_id long, payload string"


def events(seed=1, users=4, n=240):
    """Rows in the order of time, gaps of up to 5 seconds."""
    rng = random.Random(seed)
    t, rows = 1_700_000_000.0, []
    for i in range(n):
        t += rng.choice([0, 0.25, 0.5, 5])
        rows.append((rng.randrange(users), t, i, "p" * rng.choice([3, 4, 5, 40])))
    return rows


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "user_id long, t double, event_id long, payload string").selectExpr("user_id", "timestamp_micros(cast(t * 1e6 as long)) as ts", "event_id", "payload")
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def marker(spark, path):
    spark.sql("select cast(null as bigint) as user_id, timestamp'2200-01-01 00:00:00' as ts, cast(null as bigint) as event_id, cast(null as string) as payload").coalesce(1).write.mode("append").parquet(path)


def parts(rows, n=4):
    """The rows in n files, those within a file and up to two seconds apart out of order."""
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r[1] + rng.random() * 2)
    return [mixed[k * len(mixed) // n : (k + 1) * len(mixed) // n] for k in range(n)]


def test_capsule_stream_equals_batch(spark, tmp_path):
    """Four micro-batches and a restart between them; the last windows close by timers."""
    rows, src = events(), str(tmp_path / "in")
    run = lambda: st.drained(st.capsule_stream(stream(spark, src), "user_id", "ts", 2.0, tail=0.5, idle=1e6, late="10 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    first, second, *rest = parts(rows)
    write(spark, first, src)
    write(spark, second, src)
    before = run().count()
    for p in rest:
        write(spark, p, src)
    marker(spark, src)
    got = run()
    batch = iv.capsules(spark.createDataFrame([(r[0], r[1]) for r in rows], "key long, t double"), "key", "t", 2.0, tail=0.5)
    assert 0 < before < got.count()
    names = batch.columns
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.select(*names).collect()))
    assert plain(got) == plain(batch)


def test_reservoir_stream_equals_steps_and_a_fold(spark, tmp_path):
    rows, src = events(2), str(tmp_path / "in")
    for p in parts(rows):
        write(spark, p, src)
    marker(spark, src)
    got = st.drained(st.reservoir_stream(stream(spark, src), "user_id", "ts", "event_id", "payload", 3, 20, 7, late="10 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = spark.createDataFrame(rows, "user_id long, t double, event_id long, payload string")
    steps = rs.reservoir_steps(batch, "user_id", "t", "event_id", "payload", 3, 20, 7)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, steps.collect()), key=str)

    import hashlib

    want, seen, slots = [], {}, {}
    for u, _, i, p in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if len(p) > 20:  # over the cap: refused, and not counted
            want.append((u, i, None, None, None))
            continue
        n = seen[u] = seen.get(u, 0) + 1
        at = n - 1 if n <= 3 else rs.draw(7, u, n)
        if at < 3:
            slots.setdefault(u, {})[at] = p
        held = ",".join(slots[u][j] for j in sorted(slots[u]))
        want.append((u, i, n, at if at < 3 else None, hashlib.sha256(f'{{"seen":{n},"slots":[{held}]}}'.encode()).hexdigest()))
    assert sorted(map(tuple, steps.collect()), key=str) == sorted(want, key=str)
    assert any(w[2] is None for w in want)
    usage = st.slot_usage(spark, str(tmp_path / "ck"))
    assert {r.key: (r.slots, r.bytes) for r in st.checked_usage(usage, 3, 20).collect()} == {u: (len(s), sum(map(len, s.values()))) for u, s in slots.items()}
    with pytest.raises(Exception, match="more slots than allowed"):
        st.checked_usage(usage, 2, 20).collect()
    final = {(r.key, r.slot): r.payload for r in rs.reservoir_slots(batch, "user_id", "t", "event_id", "payload", 3, 20, 7).collect()}
    assert final == {(u, j): p for u, s in slots.items() for j, p in s.items()}


def test_watched_stream_ends_by_its_deadline_or_its_end(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, events()[:10], src)
    writer = lambda: st.reservoir_stream(stream(spark, src), "user_id", "ts", "event_id", "payload", 3, 20).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
    began = time.monotonic()
    assert st.watched(writer(), finished=lambda q: False, deadline=6, poll=0.5) == "deadline"
    assert time.monotonic() - began < 40
    write(spark, events()[10:20], src)
    seen = lambda q: any(p.numInputRows for p in q.recentProgress)
    assert st.watched(writer(), finished=seen, deadline=60, poll=0.5) == "finished"


def test_request_cache_calls_once(spark, tmp_path):
    log = tmp_path / "calls"

    def make():
        def ask(p):
            with open(log, "a") as f:
                f.write(p + "\n")
            if p == "bad":
                raise ValueError("refused")
            return p.upper(), len(p)

        return ask

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "id int, prompt string")
    first = {r.id: (r.state, r.response, r.cached) for r in cache.answered(rows, "prompt", make, str(tmp_path / "c")).collect()}
    assert first == {1: ("complete", "A", False), 2: ("complete", "B", False), 3: ("complete", "A", False), 4: ("failed", None, False), 5: ("failed", None, False)}
    assert sorted(log.read_text().split()) == ["a", "b", "bad"]
    again = {r.id: (r.state, r.response, r.cached) for r in cache.answered(rows.where("id <> 4"), "prompt", make, str(tmp_path / "c")).collect()}
    assert again == {1: ("complete", "A", True), 2: ("complete", "B", True), 3: ("complete", "A", True), 5: ("failed", None, False)}
    assert len(log.read_text().split()) == 3
    other = cache.answered(rows.where("id = 1"), "prompt", make, str(tmp_path / "c"), model="another")
    assert [r.cached for r in other.collect()] == [False]
    assert spark.read.parquet(str(tmp_path / "c/failures")).count() == 1


STREAM = """
import os, sys
from evloom.session import local_session
from evloom.streaming import requests as rq
root, src, log, kill = sys.argv[1:5]
def make():
    def ask(p):
        with open(log, "a") as f:
            f.write(p + "\\n")
        if p == kill:
            os.kill(int(os.environ["DRIVER"]), 9)
            import time; time.sleep(30)
        return p, 5
    return ask
os.environ["DRIVER"] = str(os.getpid())
s = local_session(cpus=2, memory="1g")
rq.answer_stream(s.readStream.schema(rq.RESERVED).option("maxFilesPerTrigger", 1).parquet(src), root, make)
"""


def test_killed_request_stream_charges_nothing_twice(spark, tmp_path):
    """Killed in the midst of its second micro-batch; what was reserved there is never called again."""
    src, root, log = str(tmp_path / "in"), str(tmp_path / "root"), tmp_path / "calls"
    for a in (0, 4, 8):
        rows = [(f"k{i}", f"p{i}", 10, 20) for i in range(a, a + 4)] + ([("k1", "p1", 10, 20)] if a else [])
        spark.createDataFrame(rows, rq.RESERVED).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in the order of their times
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    command = [sys.executable, "-c", textwrap.dedent(STREAM), root, src, str(log)]
    killed = subprocess.run([*command, "p5"], env=env, capture_output=True, text=True, timeout=180)
    assert killed.returncode == -9, killed.stderr[-1000:]
    time.sleep(3)
    subprocess.run([*command, "none"], env=env, capture_output=True, text=True, timeout=180, check=True)
    subprocess.run([*command, "none"], env=env, capture_output=True, text=True, timeout=180, check=True)
    calls = log.read_text().split()
    assert len(calls) == len(set(calls))
    got = {r.key: (r.state, r.charged) for r in rq.request_ledger(spark, root).collect()}
    assert got == {f"k{i}": ("unresolved", 30) if 4 <= i < 8 else ("complete", 15) for i in range(12)}


def test_task_tried_again_calls_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "key string, prompt string").coalesce(1)
    got = cache.called(rows, lambda: lambda p: (p, 1), once=True).select("key", "state", F.coalesce("error", F.lit("")).alias("e")).collect()
    assert {(r.key, r.state, r.e) for r in got} == {("a", "complete", ""), ("b", "failed", "no prompt")}
