"""Single words are looked up in one row group."""

from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import counts, lookups, model
from lexiloom.sources.scratch import scratch_path
from lexiloom.sources.store import Store


def read(df):
    """(rows that came back, rows that the scan read)."""
    got = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return got, leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_reads_one_row_group(spark, sf):
    plain = model.dictionary(counts.word_counts(X.regex_sentence_tokens(spark.read.parquet(f"{sf}/documents.parquet"))))
    words = lookups.for_lookups(plain)
    total, files = words.count(), {f: n for f, n in words.groupBy(F.input_file_name()).count().collect()}
    assert len(files) > 2
    for row in words.sample(0.001, seed=1).limit(5).collect():
        for df in (lookups.by_value(words, row.word_value), lookups.by_id(words, row.word_id)):
            got, scanned = read(df)
            assert got == [row] and scanned <= max(files.values()) < total
    missing = [read(lookups.by_value(words, f"{r.word_value}0zz"))[1] for r in words.sample(0.001, seed=2).limit(10).collect()]
    assert missing.count(0) > len(missing) / 2  # the bloom filters know
    assert lookups.word_id(words, "no such word").first().word_id == -1


def test_a_store_is_looked_up_so(spark, sf):
    store = Store(spark, scratch_path(spark, "looked-up"))
    store.build()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store.import_files(docs.select(F.col("doc_id").cast("string").alias("file_name"), "text"))
    ids = store.table("ids")
    word = ids.orderBy("word_id").limit(1000).collect()[-1].word_value
    got, scanned = read(ids.filter(F.col("word_value") == word))
    assert len(got) == 1 and scanned < ids.count()
    assert lookups.by_value(store.table("words"), word).first().word_id == got[0].word_id
