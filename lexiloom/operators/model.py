"""The n-gram model's tables: dense ids, id-keyed pairs and triplets, ranked followers, starts, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import ngram_rows, packed_key
from lexiloom.sources.scratch import staged

PREFIX = 3  # characters of a word that choose its block of ids
MANY = 4096  # followers above which a context's are summed in parts
BROADCAST_WORDS = 500_000  # words of a dictionary up to which it is broadcast
BROADCAST_CONTEXTS = 100_000  # contexts up to which they are broadcast, after they were counted
BLOCK = 256  # entries of a cell of the index for draws


def dictionary(words: DataFrame) -> DataFrame:
    """words (word, total, starts, ends). Adds word_id: 1, 2, .. in the order of the words, which is binary order. Blocks of
    words of one prefix are numbered apart and shifted by what comes before, so no task ranks all words."""
    head = F.substring("word", 1, PREFIX)
    sizes = words.groupBy(head.alias("prefix")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("prefix", before.alias("before"))
    own = words.withColumn("prefix", head).withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy("word")))
    return own.join(shift, "prefix").select((F.col("before") + F.col("r")).cast("int").alias("word_id"), F.col("word").alias("word_value"), F.col("total").alias("total_occurrences"), F.col("starts").alias("start_sentence_count"), F.col("ends").alias("end_sequence_count"))


def extended_dictionary(old: DataFrame, new_words: DataFrame) -> DataFrame:
    """Ids of old stay; words it lacks get the next ids, in their order."""
    top = old.agg(F.coalesce(F.max("word_id"), F.lit(0)).alias("top"))
    fresh = dictionary(new_words.join(old.select(F.col("word_value").alias("word")), "word", "left_anti"))
    return old.unionByName(fresh.crossJoin(F.broadcast(top)).withColumn("word_id", (F.col("word_id") + F.col("top")).cast("int")).drop("top"))


def _with_ids(grams: DataFrame, words: DataFrame, names: dict[str, str]) -> DataFrame:
    for word, name in names.items():
        ids = words.select(F.col("word_value").alias(word), F.col("word_id").alias(name))
        grams = grams.join(ids, word)  # inner: what has no id is dropped
    return grams


def word_pairs(bigrams: DataFrame, words: DataFrame) -> DataFrame:
    got = _with_ids(bigrams, words, {"w1": "preceding_word_id", "w2": "following_word_id"})
    return got.select("preceding_word_id", "following_word_id", F.col("cnt").alias("occurrence_count"), F.coalesce("ends", F.lit(0)).alias("bi_end_frequency"))


def trigram_sequence(trigrams: DataFrame, words: DataFrame) -> DataFrame:
    got = _with_ids(trigrams, words, {"w1": "first_word_id", "w2": "second_word_id", "w3": "third_word_id"})
    return got.select("first_word_id", "second_word_id", "third_word_id", F.col("cnt").alias("follows_count"), F.coalesce("ends", F.lit(0)).alias("tri_end_frequency"))


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, at most `most`: all of a count or none. A row a count is what meets in one task."""
    per = words.groupBy("total_occurrences").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("total_occurrences").desc()).rowsBetween(Window.unboundedPreceding, 0))
    least = per.select("total_occurrences", upto.alias("n")).filter(F.col("n") <= most).agg(F.min("total_occurrences").alias("least"))
    return words.join(F.broadcast(least), F.col("total_occurrences") >= F.col("least")).drop("least")  # least is one row


def coded_counts(sents: DataFrame, words: DataFrame, n: int, most: int = BROADCAST_WORDS) -> DataFrame:
    """id1 .. idn, cnt, ends of the n-grams of sentences (.., toks); words is a staged dictionary. Tokens get their ids where they are read,
    and n-grams are counted on ids packed in one or two integers, so no string is exchanged.

    Up to `most` words are broadcast, after they were counted. Where there are more, those most frequent are; an n-gram with another
    word, of which there are few, is counted by its words and gets its ids afterwards. Words that the dictionary lacks drop
    their n-grams."""
    every = words.count() <= most
    head = (words if every else _frequent(words, most)).select("word_value", "word_id")
    w, ids = [f"w{k + 1}" for k in range(n)], [f"id{k + 1}" for k in range(n)]
    rows = ngram_rows(sents, n)
    for a, b in zip(w, ids):
        rows = rows.join(F.broadcast(head.select(F.col("word_value").alias(a), F.col("word_id").alias(b))), a, "inner" if every else "left")
    known = F.lit(True)
    for b in ids:
        known = known & F.col(b).isNotNull()
    packs = [packed_key(F.col(ids[0]), F.col(ids[1])).alias("p")] + [F.col(b) for b in ids[2:]]
    rare = [] if every else [F.when(~known, F.col(a)).alias(a) for a in w]
    keys = ["p", *ids[2:], *([] if every else w)]
    if not every:
        packs = [F.when(known, c).alias(name) for c, name in zip(packs, keys)]
    got = rows.select(*packs, *rare, "is_end").groupBy(*keys).agg(F.count("*").alias("cnt"), F.count_if("is_end").alias("ends"))
    unpacked = [F.shiftright("p", 32).cast("int").alias("id1"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("id2"), *ids[2:], "cnt", "ends"]
    if every:
        return got.select(*unpacked)
    got = staged(got, "coded")
    late = _with_ids(got.filter("p is null").select(*w, "cnt", "ends"), words, dict(zip(w, ids))).select(*ids, "cnt", "ends")
    return got.filter("p is not null").select(*unpacked).unionByName(late)


def coded_pairs(sents: DataFrame, words: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """As word_pairs, from sentences."""
    return coded_counts(sents, words, 2, most).select(F.col("id1").alias("preceding_word_id"), F.col("id2").alias("following_word_id"), F.col("cnt").alias("occurrence_count"), F.col("ends").alias("bi_end_frequency"))


def coded_triplets(sents: DataFrame, words: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """As trigram_sequence, from sentences."""
    got = coded_counts(sents, words, 3, most)
    return got.select(F.col("id1").alias("first_word_id"), F.col("id2").alias("second_word_id"), F.col("id3").alias("third_word_id"), F.col("cnt").alias("follows_count"), F.col("ends").alias("tri_end_frequency"))


def ranked_followers(grams: DataFrame, context: list[str], word: str, top: int | None = None) -> DataFrame:
    """context, word, cnt, rank: by count, then word. With top, only so many per context; Spark then cuts each map
    side's groups too, so a frequent context doesn't carry all of its followers into one task."""
    w = Window.partitionBy(*context).orderBy(F.col("cnt").desc(), word)
    out = grams.select(*context, word, "cnt", F.row_number().over(w).cast("long").alias("rank"))
    return out if top is None else out.filter(F.col("rank") <= top)


def follower_lists(ranked: DataFrame, context: list[str], word: str) -> DataFrame:
    """context, cands: the followers in the order of their ranks."""
    return ranked.groupBy(*context).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))), lambda x: x[word]).alias("cands"))


def _many_followers(rows: DataFrame, context: list[str], many: int) -> tuple[DataFrame, int]:
    """(context, total) of the contexts of more than `many` followers, and how many these are: as their followers are more than
    `many` times as many, few. They are marked for broadcast once counted."""
    per = rows.groupBy(*context).agg(F.sum("cnt").alias("total"), F.count("*").alias("_n")).filter(F.col("_n") > many).drop("_n")
    per = staged(per, "many")
    n = per.count()
    return (F.broadcast(per) if n <= BROADCAST_CONTEXTS else per), n


def cumulative(grams: DataFrame, context: list[str], word: str, many: int = MANY, stored: bool = False) -> DataFrame:
    """context, word, cnt, cum (running sum by rank), total (of the context) and nth (the rank). stored: grams is read from files as
    it is, so no copy of it is made.

    Contexts of up to `many` followers are summed by a window each, from one exchange. Those of a context with more are set
    apart and parted by count and first characters, numbered within their part, and shifted by what the parts before hold; the
    parts, not the followers, are what meets in one task."""
    rows = grams.select(*context, word, "cnt")
    rows = rows if stored else staged(rows, "grams")
    heavy, n = _many_followers(rows, context, many)
    whole = Window.partitionBy(*context)
    ranks = whole.orderBy(F.col("cnt").desc(), word)
    light = rows.join(heavy, context, "left_anti") if n else rows
    light = light.select(*context, word, "cnt", F.sum("cnt").over(ranks.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("cnt").over(whole).alias("total"), F.row_number().over(ranks).cast("long").alias("nth"))
    return light.unionByName(_in_parts(rows.join(heavy, context), context, word)) if n else light


def _in_parts(rows: DataFrame, context: list[str], word: str) -> DataFrame:
    """As cumulative, of rows (context, word, cnt, total) whose contexts have many followers."""
    apart = rows.withColumns({"_c": F.col("cnt"), "_p": F.substring(word, 1, PREFIX)})
    own = Window.partitionBy(*context, "_c", "_p").orderBy(word)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    numbered = apart.repartition(*context, "_c", "_p").select(*apart.columns, F.sum("cnt").over(upto).alias("cum"), F.row_number().over(own).alias("nth"))
    parts = apart.groupBy(*context, "_c", "_p").agg(F.count("*").alias("k"))
    down, across = Window.partitionBy(*context).orderBy(F.col("_c").desc()), Window.partitionBy(*context, "_c").orderBy("_p")
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = parts.groupBy(*context, "_c").agg(F.sum("k").alias("k"))
    counts = counts.select(*context, "_c", before(F.col("k"), down).alias("_k0"), before(F.col("k") * F.col("_c"), down).alias("_v0"))
    shift = parts.select(*context, "_c", "_p", before(F.col("k"), across).alias("_k1")).join(counts, [*context, "_c"])
    got = numbered.join(shift, [*context, "_c", "_p"])
    cum = F.col("cum") + F.col("_v0") + F.col("_k1") * F.col("_c")
    return got.select(*context, word, "cnt", cum.alias("cum"), "total", (F.col("nth") + F.col("_k0") + F.col("_k1")).cast("long").alias("nth"))


def weighted_index(grams: DataFrame, context: list[str], word: str, size: int = BLOCK, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(tops, blocks): what a draw by weight looks up; no cell holds more than `size` entries.

    blocks: context, block, total, cands: the followers ranked block * size + 1 and on, as (cum, w) in that order. tops, only for
    contexts of more than one block: context, lo, hi, total, parts: (hi, block) of `size` blocks whose sums lie in lo .. hi."""
    return _in_blocks(cumulative(grams, context, word, many), context, word, size)


def _in_blocks(c: DataFrame, context: list[str], word: str, size: int) -> tuple[DataFrame, DataFrame]:
    of = lambda n, k: F.floor(n / F.lit(k)).cast("long")
    blocks = c.groupBy(*context, of(F.col("nth") - 1, size).alias("block")).agg(
        F.first("total").alias("total"), F.min(F.col("cum") - F.col("cnt")).alias("lo"), F.max("cum").alias("hi"), F.array_sort(F.collect_list(F.struct("cum", F.col(word).alias("w")))).alias("cands")
    )
    blocks = staged(blocks, "blocks")
    tops = blocks.filter("block > 0 or hi < total").groupBy(*context, of(F.col("block"), size).alias("top"))
    tops = tops.agg(F.first("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("hi", "block"))).alias("parts")).drop("top")
    return tops, blocks.select(*context, "block", "total", "cands")


def draw_index(grams: DataFrame, context: list[str], word: str, size: int = BLOCK, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, tops, blocks). lists: context, total, cands: all followers of a context of up to `size`, as (-cnt, w) in no order, from
    one exchange; who draws sorts them, as draws meet few of the contexts. tops and blocks, as of weighted_index: contexts of more."""
    rows = grams.select(*context, word, "cnt")
    rows = rows if stored else staged(rows, "grams")
    heavy, n = _many_followers(rows, context, size)
    light = rows.join(heavy, context, "left_anti") if n else rows
    lists = light.repartition(*context).groupBy(*context).agg(F.sum("cnt").alias("total"), F.collect_list(F.struct((-F.col("cnt")).alias("n"), F.col(word).alias("w"))).alias("cands"))
    return lists, *weighted_index(rows.join(heavy.select(*context), context, "left_semi"), context, word, size)


def ordered_blocks(words: DataFrame, count: str, value: str, prefix: int = PREFIX) -> DataFrame:
    """words (word, count, ..). Adds, in the order of count descending and word: nth and cum, the row number and the running
    sum of value. Ranked apart are words of the same count and first characters, as very many share a small count; what
    comes before such a block is summed over blocks, a count at a time."""
    rows = words.withColumn("prefix", F.substring("word", 1, prefix))
    blocks = rows.groupBy(F.col(count).alias("c"), "prefix").agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    counts = blocks.groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    down, across = Window.orderBy(F.col("c").desc()), Window.partitionBy("c").orderBy("prefix")
    counts = counts.select(F.col("c").alias("c0"), before("n", down).alias("n0"), before("v", down).alias("v0"))
    shift = blocks.select("c", "prefix", before("n", across).alias("n1"), before("v", across).alias("v1")).join(counts, F.col("c") == F.col("c0"))
    shift = shift.select(F.col("c").alias("_c"), F.col("prefix").alias("_p"), (F.col("n0") + F.col("n1")).alias("_n"), (F.col("v0") + F.col("v1")).alias("_v"))
    own = Window.partitionBy(count, "prefix").orderBy("word").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(count, "prefix").orderBy("word"))).withColumn("cum", F.sum(value).over(own))
    got = rows.join(shift, (rows[count] == shift._c) & (rows.prefix == shift._p))
    return got.select(*words.columns, (F.col("nth") + F.col("_n")).cast("long").alias("nth"), (F.col("cum") + F.col("_v")).cast("long").alias("cum"))


def start_candidates(words: DataFrame) -> DataFrame:
    """word, starts, rank of the words that begin a sentence."""
    return ordered_blocks(words.filter("starts > 0").select("word", "starts"), "starts", "starts").select("word", "starts", F.col("nth").alias("rank"))


def second_word_totals(trigrams: DataFrame) -> DataFrame:
    return trigrams.groupBy("w1", "w2").agg(F.sum("cnt").alias("total"))


def best_second_words(trigrams: DataFrame) -> DataFrame:
    """w1, w2, total: for each first word the second with the largest total, ties by word. An aggregate, no window."""
    best = F.min(F.struct((-F.col("total")).alias("t"), F.col("w2")))
    return second_word_totals(trigrams).groupBy("w1").agg(best.alias("b")).select("w1", F.col("b.w2").alias("w2"), (-F.col("b.t")).alias("total"))


def top_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), key).limit(k)
