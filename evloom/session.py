"""Session factory and table loader."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "evloom", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: By application, the folder made for its tables where spark.checkpoint.dir is unset.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names. Only where that is
    unset and one machine runs all, a temporary folder is made, one an application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _FOLDERS:
            _FOLDERS[own] = "file://" + tempfile.mkdtemp(prefix="evloom-")
        found = _FOLDERS[own]
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/evloom/{spark.sparkContext.applicationId}"


def settled(df: DataFrame, what: str = "t", codec: str | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: lineage ends there, and losing an
    executor loses none of it. discard() removes what an application has written."""
    path = f"{own_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Removes all tables that settled() wrote for this application; results not yet written are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
