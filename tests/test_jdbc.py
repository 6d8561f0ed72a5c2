"""The model in a database that Spark brings along."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import counts, model
from lexiloom.sources.jdbc import Addition, Database
from lexiloom.sources.scratch import staged


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", text="varchar(1000)", driver="org.apache.derby.jdbc.EmbeddedDriver")
    d.build()
    d.build()  # what is there stays
    return d


def suffixes(spark, sf, part):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(f"doc_id % 100 = {part}")
    return staged(counts.suffix_counts(X.regex_sentence_tokens(docs)), "suffixes")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip(spark, sf, db):
    parts = [suffixes(spark, sf, p) for p in (0, 1)]
    for p, s in enumerate(parts):
        db.add_counts(s, spark.createDataFrame([(f"f{p}.txt", 7), ("both.txt", 1)], "file_name string, word_count long"))
    sents = X.regex_sentence_tokens(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 100 < 2"))
    words = db.table("words", "word_id", rows=100)
    assert words.rdd.getNumPartitions() > 3 and words.count() == words.select("word_id").distinct().count()
    assert rows(words.select("word_value", "total_occurrences", "start_sentence_count", "end_sequence_count")) == rows(counts.word_counts(sents))
    ids = words.select("word_value", "word_id")
    pairs, triplets = db.table("word_pairs", "sequence_id", rows=2000), db.table("trigram_sequence", "sequence_id")
    assert rows(pairs.drop("sequence_id")) == rows(model.word_pairs(counts.ngram_counts(sents, 2), ids))
    assert rows(triplets.drop("sequence_id")) == rows(model.trigram_sequence(counts.ngram_counts(sents, 3), ids))
    assert rows(db.table("source_file").select("file_name", "word_count")) == [("both.txt", 2), ("f0.txt", 7), ("f1.txt", 7)]
    db.clear()
    assert db.table("words", "word_id").count() == 0 and db.table("words").count() == 0


def test_all_or_nothing(spark, db):
    words = spark.createDataFrame([("it's", 2, 1, 0), ('a "b"', 1, 0, 1)], "word_value string, total_occurrences long, start_sentence_count long, end_sequence_count long")
    good = Addition("words", words, ["word_value"], words.columns[1:])
    bad = Addition("word_pairs", words.select(F.lit(98).alias("preceding_word_id"), F.lit(99).alias("following_word_id"), F.lit(1).alias("occurrence_count"), F.lit(0).alias("bi_end_frequency")).limit(1), ["preceding_word_id", "following_word_id"], ["occurrence_count", "bi_end_frequency"])
    with pytest.raises(Py4JJavaError):
        db.add(good, bad)  # no such words
    assert db.table("words").count() == 0
    with pytest.raises(Exception):
        db.add(good._replace(df=words.unionByName(words)))  # a key twice
    assert db.table("words").count() == 0
    db.add(good)
    db.add(good, good)
    assert sorted((r.word_value, r.total_occurrences) for r in db.table("words").collect()) == [('a "b"', 3), ("it's", 6)]
    left = spark.read.format("jdbc").options(url=db.url, query="select tablename from sys.systables where tablename like 'STAGE%'").load()
    assert left.count() == 0
