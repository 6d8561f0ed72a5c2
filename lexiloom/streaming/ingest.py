"""Word and n-gram counts kept up to date as files arrive, by Structured Streaming; each micro-batch is one atomic import."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.store import Store


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, **trigger):
    """Starts a query that imports .txt files as they appear in folder. A batch that is run again changes nothing, as
    the store knows its files. trigger: as of DataStreamWriter.trigger, availableNow by default."""
    store.build()
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    write = named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store.import_files(df) and None)
    return write.trigger(**(trigger or {"availableNow": True})).start()
