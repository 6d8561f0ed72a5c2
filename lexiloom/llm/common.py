"""What the training-data operators share: scratch tables, shipped code, small file helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.scratch import scratch_path, shared_dir, staged

__all__ = ["scratch_path", "shared_dir", "staged"]

#: The code points that part words in every word count of this subpackage.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_lexiloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="lexiloom-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(out))
    sc._lexiloom_shipped = True


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a folder of the shared store; works in workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def word_count(text: Column) -> Column:
    """Number of maximal runs outside SPACES; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def env_cores(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, salts: int = 16) -> DataFrame:
    """left join right on a column, right having a row a value: rows of left of a very common value are spread, by another
    column of theirs, over as many tasks."""
    salt = fresh(left.select(*left.columns, *[F.lit(0).alias(c) for c in right.columns if c not in left.columns]), "_salt")
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(many, [on, salt]).drop(salt)


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
