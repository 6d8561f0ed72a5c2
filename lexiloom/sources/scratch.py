"""Scratch tables in the folder that all executors share: lineage ends there, on storage that outlives executors. What an
application leaves there goes when it ends."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a table for lookups.
ROW_GROUP_BYTES = 4 << 20
#: Setting by which a query's shuffle files go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PASSING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may go without: it gets a
    temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(sc, "_lexiloom_scratch", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = Path(tempfile.mkdtemp(prefix="lexiloom-")).as_uri()
            sc._lexiloom_scratch = base
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own scratch folder, which goes when the application ends."""
    sc, base = spark.sparkContext, shared_dir(spark)
    own = getattr(sc, "_lexiloom_session", None)
    if own is None or not own.startswith(base):
        own = f"{base}/lexiloom/{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        p = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._lexiloom_session = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """Writes df to a fresh folder of the shared one and returns its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def write_sorted(df: DataFrame, path: str, by: str) -> None:
    """Writes df to path in ranges of `by`, each sorted and with a bloom filter, so that looking one value up reads the one row
    group that may hold it, and mostly none if there is no such value."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, by).sortWithinPartitions(by).write
    # A filter's size follows its values; without that each takes a megabyte, however few they are.
    out = out.option(f"parquet.bloom.filter.enabled#{by}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option(f"parquet.bloom.filter.candidates.number#{by}", 12)
    out.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = written(df, name)
    if _PASSING:
        _PASSING[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing(spark: SparkSession):
    """What is staged within goes at its end, and the shuffle files of each query within go with that query. What is to stay must be
    written, not planned, by then."""
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    _PASSING.append([])
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)
        for path in _PASSING.pop():
            delete(spark, path)


def bucketed(df: DataFrame, name: str, by: list[str], session: SparkSession, buckets: int) -> str:
    """Writes df to the shared folder in buckets of `by`, one file each, and returns the name of session's table over them. df is
    exchanged for that only where it isn't dealt by `by` already. Joins on `by` in a session of as many shuffle partitions leave
    the table where it is. Drop the table when done with it; the files go with the application."""
    path, table = scratch_path(df.sparkSession, name), f"lexiloom_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", path).saveAsTable(f"{session.catalog.currentDatabase()}.{table}")
    return table
