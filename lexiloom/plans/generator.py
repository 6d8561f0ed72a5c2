"""One call from a stored model, a strategy's name and seeds to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import rendered, rendered_length, seed_words
from lexiloom.operators import generate, lookups, model
from lexiloom.sources.store import Store


def generate_sentences(store: Store, algo: str, seeds: list[str] | DataFrame | None = None, most: int = generate.MAX_TOKENS, stop: str | None = None, run: str = "0") -> DataFrame:
    """seed_id, sentence, n_words: a sentence per seed text, or one without a seed if none is given. seeds: texts, or a frame
    (seed_id, seed)."""
    spark, step, words = store.spark, generate.algorithm(algo), store.words()
    texts = seeds if isinstance(seeds, DataFrame) else spark.createDataFrame([(i, s) for i, s in enumerate(seeds or [""])], "seed_id int, seed string")
    pos = texts.select("seed_id", F.posexplode(seed_words(F.col("seed"))).alias("pos", "word"))
    if step in (generate.bi_greedy, generate.bi_weighted):
        known = lookups.first_known(pos, store.table("words")).select("seed_id", F.col("word").alias("w1"))
        best = generate.weighted_start(words, run) if step is generate.bi_weighted else words.orderBy(F.col("starts").desc(), "word").limit(1).select("word")
        start = texts.select("seed_id").join(known, "seed_id", "left").crossJoin(F.broadcast(best)).select("seed_id", F.coalesce("w1", "word").alias("w1"))
        walks = step(start, store.table("bigrams"), most, stop, run)
    else:
        at = lambda i: F.max(F.when(F.col("pos") == i, F.col("word")))
        pairs = texts.select("seed_id").join(pos.groupBy("seed_id").agg(at(0).alias("w1"), at(1).alias("w2")), "seed_id", "left")
        drawn = {"second": generate.weighted_second_words(lookups.beginning(store.table("trigrams"), pairs), run), "run": run} if step is generate.tri_weighted else {}
        start = lookups.trigram_start(pairs, store.table("trigrams"), rows=store.rows("trigrams"), **drawn).filter("start1 is not null").select("seed_id", F.col("start1").alias("w1"), F.col("start2").alias("w2"))
        walks = step(start, store.table("trigrams"), most, stop, run)
    got = texts.select("seed_id").join(walks, "seed_id", "left").select("seed_id", F.coalesce(rendered(F.col("words")), F.lit("")).alias("sentence"))
    return got.withColumn("n_words", rendered_length(F.col("sentence")))


def generate_from_ids(store: Store, algo: str, ids: list[int], most: int = generate.MAX_TOKENS, stop: str | None = None, run: str = "0") -> DataFrame:
    """The same from word ids; an id without a word is shown as ?."""
    words = store.table("words").filter(F.col("word_id").isin(ids[:2]))  # two ids at most
    found = {r.word_id: r.word_value for r in words.select("word_id", "word_value").collect()}
    spark, step = store.spark, generate.algorithm(algo)
    w = [found.get(i, "?") for i in ids[:2]]
    if step in (generate.bi_greedy, generate.bi_weighted):
        walks = step(spark.createDataFrame([(0, w[0])], "seed_id int, w1 string"), store.table("bigrams"), most, stop, run)
    else:
        second = w[1] if len(w) > 1 else None
        seeds = spark.createDataFrame([(0, w[0], second)], "seed_id int, w1 string, w2 string")
        drawn = {"second": generate.weighted_second_words(lookups.beginning(store.table("trigrams"), seeds), run), "run": run} if step is generate.tri_weighted else {}
        seeds = lookups.trigram_start(seeds, store.table("trigrams"), rows=store.rows("trigrams"), **drawn).select("seed_id", F.col("start1").alias("w1"), F.col("start2").alias("w2"))
        walks = step(seeds, store.table("trigrams"), most, stop, run)
    return walks.select("seed_id", rendered(F.col("words")).alias("sentence"))


def report(store: Store) -> DataFrame:
    """Rows and totals of the stored tables."""
    one = lambda name, col: store.table(name).agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum(col), F.lit(0)).alias("total"))
    grams = store.gram_totals().selectExpr("stack(2, 'bigrams', pairs, pair_total, 'trigrams', triplets, triplet_total) as (`table`, `rows`, total)")
    return one("source_file", "word_count").unionByName(one("words", "total_occurrences")).unionByName(grams)


def top_words(store: Store, k: int = 10) -> DataFrame:
    return model.top_k(store.words().select("word", "total"), "word", "total", k)
