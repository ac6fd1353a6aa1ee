"""Every registered query with SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

from evloom import session
from evloom.plans import catalogue, experiments, reports, sources, streams, trials  # noqa: F401


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(cols).collect()), key=repr)
    found = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_runs_without_the_llm_folder(tmp_path):
    """In a process of its own, on a copy without the training-data folders and the pipeline."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "evloom", tmp_path / "evloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from evloom.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLE); print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(catalogue.QUERIES), done.stderr


def test_tables_settle(spark):
    """One folder an application, whether spark.checkpoint.dir names it or not."""
    first = session.shared_dir(spark)
    assert first == session.shared_dir(spark)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        assert first == session._FOLDERS[spark.sparkContext.applicationId]
    assert session.settled(spark.range(3), "three").count() == 3
    session.discard(spark)


def test_folder_without_the_setting():
    """The same in a process whose Spark has no settings file."""
    code = """
import os, sys
from evloom import session
s = session.local_session(cpus=1, memory="1g")
assert s.conf.get("spark.checkpoint.dir", None) is None
t = session.settled(s.range(3), "three")
assert t.count() == 3 and t.inputFiles()[0].startswith(session.shared_dir(s))
session.discard(s)
"""
    with tempfile.TemporaryDirectory() as empty:
        env = os.environ | {"SPARK_CONF_DIR": empty, "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
        done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
