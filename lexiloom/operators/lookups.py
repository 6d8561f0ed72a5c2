"""Lookups by word and id, seed resolution, and the anti join that leaves out imported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.model import best_second_words, second_word_totals
from lexiloom.sources.scratch import scratch_path, staged, write_sorted

#: First words of seeds up to which they are broadcast, after they were counted.
BROADCAST_FIRSTS = 100_000
#: First words up to which they are named in a filter, which reads only where they may be.
NAMED_FIRSTS = 1000


def for_lookups(words: DataFrame, name: str = "dictionary") -> DataFrame:
    """A dictionary, written so that `word_id`, `by_value` and `by_id` read a row group of it: ids follow the words' order,
    so both are sorted. A store's words are kept that way."""
    path = scratch_path(words.sparkSession, name)
    write_sorted(words, path, "word_value")
    return words.sparkSession.read.schema(words.schema).parquet(path)


def word_id(words: DataFrame, value: str) -> DataFrame:
    """One row: the id, or -1."""
    return words.filter(F.col("word_value") == value).agg(F.coalesce(F.max("word_id"), F.lit(-1)).alias("word_id"))


def word_ids(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (word_value); rows of words that it names. A join, never a list of literals."""
    return words.join(wanted.select("word_value").distinct(), "word_value", "left_semi")


def by_value(words: DataFrame, value: str) -> DataFrame:
    return words.filter(F.col("word_value") == value)


def by_id(words: DataFrame, ident: int) -> DataFrame:
    return words.filter(F.col("word_id") == ident)


def identified(files: DataFrame) -> DataFrame:
    """file_name, text, path, digest: path is the name where there is none, a null text is empty; digest is the text's SHA-256. Files
    of one name in different folders are different files, and so are different texts of one path."""
    text = F.coalesce("text", F.lit(""))
    path = F.col("path") if "path" in files.columns else F.col("file_name")
    return files.select("file_name", text.alias("text"), path.alias("path"), F.sha2(text.cast("binary"), 256).alias("digest"))


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of files (file_name, text[, path]) those that the manifest (path, digest, or files again) lacks; equal ones once."""
    known = manifest if "digest" in manifest.columns else identified(manifest)
    key = ["path", "digest"]
    return identified(files).join(known.select(*key), key, "left_anti").dropDuplicates(key)


def first_known(seeds: DataFrame, words: DataFrame, key: str = "seed_id") -> DataFrame:
    """seeds (key, pos, word). Per key with a known word: the first of them and its id."""
    known = seeds.join(words.select(F.col("word_value").alias("word"), "word_id"), "word")
    return known.groupBy(key).agg(F.min(F.struct("pos", "word", "word_id")).alias("m")).select(key, F.col("m.word").alias("word"), F.col("m.word_id").alias("word_id"))


def topped_up(seeds: DataFrame, words: DataFrame, needed: int, key: str = "seed_id") -> DataFrame:
    """key, ids (as text, in order): distinct known seeds, then start candidates, then the first words, up to needed."""
    mine = seeds.join(words.select(F.col("word_value").alias("word"), "word_id"), "word").groupBy(key, "word_id").agg(F.min("pos").alias("pos"))
    mine = mine.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word_id"))), lambda x: x.word_id).alias("own"))
    best = words.filter("start_sentence_count > 0").orderBy(F.col("start_sentence_count").desc(), "word_value").limit(needed)
    more = words.orderBy("word_value").limit(2 * needed)
    pack = lambda df, *order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "word_id"))), lambda x: x.word_id).alias("ids"))
    rest = pack(best, (-F.col("start_sentence_count")).alias("c"), "word_value").select(F.col("ids").alias("s")).crossJoin(pack(more, "word_value").select(F.col("ids").alias("m")))
    every = seeds.select(key).distinct().join(mine, key, "left").crossJoin(F.broadcast(rest))  # rest is one row of needed ids
    ids = F.slice(F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<int>")), "s", "m")), 1, needed)
    return every.select(key, F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


def beginning(trigrams: DataFrame, seeds: DataFrame) -> DataFrame:
    """The trigrams that begin with the first word of a seed."""
    firsts = staged(seeds.select("w1").distinct(), "firsts")
    if firsts.count() <= NAMED_FIRSTS:
        return trigrams.filter(F.col("w1").isin([r.w1 for r in firsts.collect() if r.w1 is not None]))
    return trigrams.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_FIRSTS else firsts, "w1", "left_semi")


def trigram_start(seeds: DataFrame, trigrams: DataFrame, key: str = "seed_id", second: DataFrame | None = None, run: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """seeds (key, w1, w2): their first two words or null. Per key the start pair: (w1, w2) if it is a context, else w1
    with its second word (second (w1, w2), by default the best), else the first context of all, or one drawn by run. That one is
    looked for only where a seed needs it, in rows (trigrams that may repeat) if given."""
    near = staged(second_word_totals(beginning(trigrams, seeds)), "seconds")
    contexts = near.select("w1", "w2").withColumn("ok", F.lit(True))
    second = best_second_words(near.withColumnRenamed("total", "cnt")) if second is None else second
    best = second.select("w1", F.col("w2").alias("best"))
    pair_of = F.struct("w1", "w2")
    drawn = F.min(pair_of) if run is None else F.min(F.struct(F.md5(F.concat_ws("|", F.lit(run), "w1", "w2").cast("binary")).alias("h"), "w1", "w2"))
    got = staged(seeds.join(contexts, ["w1", "w2"], "left").join(best, "w1", "left"), "starts")
    every = trigrams if rows is None else rows
    if got.filter("ok is null and best is null").isEmpty():
        every = every.limit(0)
    first = every.agg(drawn.alias("d")).select(F.struct("d.w1", "d.w2").alias("f"))
    got = got.crossJoin(F.broadcast(first))  # first is one row
    pair: Column = F.when(F.col("ok"), F.struct("w1", "w2")).when(F.col("best").isNotNull(), F.struct("w1", F.col("best").alias("w2"))).otherwise(F.col("f"))
    return got.select(key, pair.alias("p")).select(key, F.col("p.w1").alias("start1"), F.col("p.w2").alias("start2"))
