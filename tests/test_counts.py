"""Counts of all orders from one exchange; n-grams counted by ids."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import counts, model
from lexiloom.plans import registry
from lexiloom.sources.scratch import staged
from lexiloom.sources.text_files import spread


@pytest.fixture(scope="module")
def sents(spark, sf):
    return staged(X.regex_sentence_tokens(spread(spark.read.parquet(f"{sf}/documents.parquet"))), "sents")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_orders_from_one_exchange(spark, sents):
    s = counts.suffix_counts(sents)
    assert rows(counts.words_of(s)) == rows(counts.word_counts(sents))
    assert rows(counts.bigrams_of(s)) == rows(counts.ngram_counts(sents, 2))
    assert rows(counts.trigrams_of(s)) == rows(counts.ngram_counts(sents, 3))
    none = spark.createDataFrame([([],)], "toks array<string>")
    assert counts.suffix_counts(none).count() == 0
    one = counts.suffix_counts(spark.createDataFrame([(["a"],), (["a", "b"],)], "toks array<string>"))
    assert rows(counts.words_of(one)) == [("a", 2, 2, 1), ("b", 1, 0, 1)] and rows(counts.bigrams_of(one)) == [("a", "b", 1, 1)] and counts.trigrams_of(one).count() == 0


@pytest.mark.parametrize("most", [model.BROADCAST_WORDS, 500, 0])
def test_counts_by_ids(sents, most):
    """All words broadcast, only frequent ones, or none."""
    words = staged(model.dictionary(counts.word_counts(sents)), "words")
    assert rows(model.coded_pairs(sents, words, most)) == rows(model.word_pairs(counts.ngram_counts(sents, 2), words))
    assert rows(model.coded_triplets(sents, words, most)) == rows(model.trigram_sequence(counts.ngram_counts(sents, 3), words))
    less = words.filter(F.col("word_value") > "m")
    assert rows(model.coded_pairs(sents, staged(less, "less"), most)) == rows(model.word_pairs(counts.ngram_counts(sents, 2), less))


def exchanged(spark, make):
    """Bytes that exchanges wrote while make ran, and its exchanges with more rows than half of the tokens."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).apply(i) for i in range(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).size())]}
    before = stages()
    make().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(b for i, b in stages().items() if i not in before)


def test_ids_halve_what_is_exchanged(spark, sents):
    words = staged(model.dictionary(counts.word_counts(sents)), "words")
    strings = exchanged(spark, lambda: counts.ngram_counts(sents, 3))
    ids = exchanged(spark, lambda: model.coded_counts(sents, words, 3))
    assert 0 < 2 * ids < strings


def test_small_tables_are_spread(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert spread(d).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(d.repartition(9)).rdd.getNumPartitions() == 9
    assert registry.QUERIES["words_pairs_triplets"](spark, sf).filter("n = 3").count() == counts.ngram_counts(X.regex_sentence_tokens(d), 3).count()


def test_sentences_are_cut_once_for_each_query(spark, sf):
    """A filter on tokens, pushed below them, would cut every sentence twice."""
    for name in ("trigram_counts", "word_counts_regex", "second_word_totals"):
        assert registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_tokens_equal_stripped_pieces(spark):
    import random
    import re

    import regex

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abZ9'.,!-_ \t\n\x0b\u00a0\u2028éßİΣ½٣\u0301😀") for _ in range(rnd.randrange(60))) for _ in range(2000)] + ["a." * 100_000 + "b"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", X.tokens(F.col("s")).alias("t")).collect()
    strip = lambda t: regex.sub(r"^[^\p{L}\p{Nd}']+|[^\p{L}\p{Nd}']+$", "", t)
    for r in got:
        assert r.t == [w.lower() for p in re.split(r"[ \t\n\x0b\f\r]+", texts[r.i]) if (w := strip(p))], texts[r.i][:80]


def test_no_task_cuts_much_more_than_a_split(spark, sf, monkeypatch):
    """One large file is one split, whose counts would outgrow a task's memory; few of its bytes go to each task."""
    from pyspark.sql import functions as F

    from lexiloom.plans import registry
    from lexiloom.sources import text_files

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cores, want = spark.sparkContext.defaultParallelism, registry._grams(spark, sf, 3).agg(F.count("*"), F.sum("cnt"), F.bit_xor(F.xxhash64("w1", "w2", "w3", "cnt", "ends"))).first()
    monkeypatch.setattr(text_files, "SPLIT_BYTES", 10_000)
    got = text_files.spread(docs.select("doc_id", "text"))
    assert got.rdd.getNumPartitions() >= max(cores + 1, 290_257 // 10_000)
    assert got.exceptAll(docs.select("doc_id", "text")).isEmpty() and got.count() == docs.count()
    assert registry._grams(spark, sf, 3).agg(F.count("*"), F.sum("cnt"), F.bit_xor(F.xxhash64("w1", "w2", "w3", "cnt", "ends"))).first() == want
