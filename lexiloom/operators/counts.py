"""Counts over sentences of tokens (key, sent, toks). Sums meet map-side first, so frequent words don't skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import ngram_rows, positions

_flag = F.count_if


def _at(sents: DataFrame, *more: str) -> DataFrame:
    """more, toks, pos: a row per token. Exploding tokens themselves would have the engine ask first whether there are any, and cut
    each sentence twice."""
    return sents.select(*more, "toks", F.explode(positions(F.size("toks") - 1)).alias("pos"))


def token_stream(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent, pos, n, word), a row per token."""
    return _at(sents, key, "sent").select(key, "sent", F.size("toks").alias("n"), "pos", F.get("toks", "pos").alias("word"))


def word_counts(sents: DataFrame) -> DataFrame:
    """word, total, starts and ends: how often it is a word, the first and the last of its sentence."""
    t = _at(sents).select(F.size("toks").alias("n"), "pos", F.get("toks", "pos").alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("total"), _flag(F.col("pos") == 0).alias("starts"), _flag(F.col("pos") == F.col("n") - 1).alias("ends"))


def ngram_counts(sents: DataFrame, n: int) -> DataFrame:
    """w1 .. wn, cnt, ends."""
    words = [f"w{k + 1}" for k in range(n)]
    return ngram_rows(sents, n).groupBy(*words).agg(F.count("*").alias("cnt"), _flag(F.col("is_end")).alias("ends"))


def suffix_counts(sents: DataFrame) -> DataFrame:
    """w1, w2, w3, cnt, starts, ends: every token with the two that follow it in its sentence, null beyond its end; starts are
    those that begin a sentence, ends the triplets that end one. Words, pairs and triplets are sums over these, so one
    exchange of tokens serves all orders; `words_of`, `bigrams_of` and `trigrams_of` exchange only what was counted."""
    size = F.size("toks")
    rows = _at(sents).select(*[F.get("toks", F.col("pos") + k).alias(f"w{k + 1}") for k in range(3)], (F.col("pos") == 0).alias("first"), (F.col("pos") + 3 == size).alias("last"))
    return rows.groupBy("w1", "w2", "w3").agg(F.count("*").alias("cnt"), _flag(F.col("first")).alias("starts"), _flag(F.col("last")).alias("ends"))


def _without(word: str):
    return F.sum(F.when(F.col(word).isNull(), F.col("cnt")).otherwise(F.lit(0).cast("long")))


def words_of(suffixes: DataFrame) -> DataFrame:
    """As word_counts."""
    return suffixes.groupBy(F.col("w1").alias("word")).agg(F.sum("cnt").alias("total"), F.sum("starts").alias("starts"), _without("w2").alias("ends"))


def bigrams_of(suffixes: DataFrame) -> DataFrame:
    """As ngram_counts of two words."""
    return suffixes.filter("w2 is not null").groupBy("w1", "w2").agg(F.sum("cnt").alias("cnt"), _without("w3").alias("ends"))


def trigrams_of(suffixes: DataFrame) -> DataFrame:
    """As ngram_counts of three words; no exchange."""
    return suffixes.filter("w3 is not null").select("w1", "w2", "w3", "cnt", "ends")


def sentence_lengths(sents: DataFrame) -> DataFrame:
    return sents.groupBy(F.size("toks").cast("long").alias("n_tokens")).agg(F.count("*").alias("n_sentences"))


def document_stats(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: sentences, tokens and distinct words."""
    per = _at(sents, key).select(key, F.get("toks", "pos").alias("word")).groupBy(key, "word").agg(F.count("*").alias("c"))
    words = per.groupBy(key).agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_words"))
    return words.join(sents.groupBy(key).agg(F.count("*").alias("n_sentences")), key)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Additive upsert: counts of equal keys add up; neither side is changed where the other has nothing."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in old.columns if c not in keys])


def upserted_one(table: DataFrame, row: dict, keys: list[str]) -> DataFrame:
    """The additive upsert of a single row; a count that isn't positive counts as one, an end count as it is."""
    row = {k: (1 if k in ("total", "cnt") and v <= 0 else v) for k, v in row.items()}
    return merged(table, table.sparkSession.createDataFrame([row], table.schema), keys)
