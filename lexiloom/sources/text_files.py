"""Text corpora: folders of .txt files, or a table whose rows stand for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


GLOB = "*.[tT][xX][tT]"
#: Bytes of a table's files whose texts a task cuts and counts.
SPLIT_BYTES = 16 << 20


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, text) of all .txt files under path, in any letter case, whole; path may be one file; a path that isn't
    there gives no rows."""
    if not _there(spark, path):
        return spark.createDataFrame([], "path string, file_name string, text string")
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=GLOB)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the same files in the order of their paths; no text is read."""
    if not _there(spark, path):
        return spark.createDataFrame([], "path string, bytes long")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(path)
    return df.select("path", F.col("length").alias("bytes")).orderBy("path")


def _bytes(spark: SparkSession, files: list[str]) -> int:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def spread(docs: DataFrame, most: int | None = None) -> DataFrame:
    """docs over as many partitions as there are cores at least, and up to `most` bytes of its files in each: a table of few splits
    would leave cores idle, and what a task counts of a large split outgrows its memory, is sorted and spilled."""
    spark, most = docs.sparkSession, most or SPLIT_BYTES
    wanted = max(spark.sparkContext.defaultParallelism, -(-_bytes(spark, docs.inputFiles()) // most))
    # Dealt by hash, as dealing rows out in turn has Spark sort the texts first.
    return docs.repartition(wanted, *docs.columns) if docs.rdd.getNumPartitions() < wanted else docs


def documents_as_files(docs: DataFrame) -> DataFrame:
    """(file_name, text): a row of documents stands for the file doc_<id>.txt."""
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.coalesce("text", F.lit("")).alias("text"))


def upload(files: DataFrame, folder: str) -> DataFrame:
    """Copies files (file_name, text) to a landing folder, replacing those of the same names; (file_name, bytes) as written.
    Each is written beside its place and moved there, so a reader never sees half a file. Of equal names the last text in
    binary order stays; a name with a slash lies in a folder of its own. The folder must be one that executors reach by pyarrow's file systems."""
    from pyspark.sql import functions as F

    def write(batches):
        import uuid
        from urllib.parse import unquote, urlparse

        import pyarrow as pa
        from pyarrow import fs

        if "://" in folder and not folder.startswith("file:"):
            system, base = fs.FileSystem.from_uri(folder)
        else:
            system, base = fs.LocalFileSystem(), unquote(urlparse(folder).path) if folder.startswith("file:") else folder
        system.create_dir(base, recursive=True)
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, text in zip(names, texts):
                tmp = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(tmp, compression=None) as out:
                    out.write(text.encode("utf-8", "replace"))
                if "/" in name:
                    system.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                system.move(tmp, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())], names=["file_name", "bytes"])

    one = files.groupBy("file_name").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return one.mapInArrow(write, "file_name string, bytes long")
