"""Target-distribution importance resampling: documents drawn by how much likelier their words are under a target.

Features are the runs of 1 to n consecutive words of a text, joined by one space; each falls into a bucket, the CRC-32 of its
bytes modulo the number of buckets. The corpus and the target are each counted by bucket; a bucket's gain is the smoothed log
ratio of the two, in thousandths and floored, a document's weight the sum over its features, and its score the weight plus
Gumbel noise from a hash of its id, so that the highest scores are a sample without replacement.

Words and CRCs come from a byte automaton over the buffers of Arrow strings, without an object a word: a table of 256 entries
says which bytes belong to words (letters and digits of ASCII, A-Z as a-z, and every byte from 128 on), differences of
neighbours say where words begin and end, and the table-driven CRC steps over all words at once, a byte of each at a time.

Counts are summed within a task first, so a task sends a row a bucket at most. Gains are one number a bucket, bounded by
that parameter, and are broadcast. Ranks come from ranges of scores that are numbered apart and shifted by the sizes of
those before.

Defined cases: null and empty texts, and those without a word, have no features and weight 0; they can be drawn only if
least_words is 0. A null id makes its noise from an empty string and comes after all others of its score; repeated ids are
rows like others, and have the same noise. An empty target leaves all gains to the smoothing. Long texts and long words only
take longer; empty tables give no rows. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, parts_for, ship, staged, table, trim

N, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of text handled at once; and the length from which a word's last bytes are left to zlib's CRC.
BLOCK_BYTES, LONG = 2 << 20, 128
#: Scores a range holds, about, when documents are ranked.
RANGE_ROWS = 1_000_000


def crc_table():
    """The CRC-32's table, from its polynomial."""
    import numpy as np

    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def byte_classes():
    """1 for bytes of words, 0 for others; and what each byte counts as."""
    import numpy as np

    kind, fold = np.zeros(256, np.int8), np.arange(256, dtype=np.uint8)
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = 1
    fold[65:91] += 32
    return kind, fold


class Automaton:
    def __init__(self, n: int = N, buckets: int = BUCKETS):
        self.n, self.buckets, self.table = n, buckets, crc_table()
        self.kind, self.fold = byte_classes()

    def words(self, data, offs):
        """(starts, stops, first): of all words, and the number of each document's first, with how many there are at the end."""
        import numpy as np

        kind = self.kind[data]
        # Documents lie side by side; a word that reaches a border ends there, and another begins.
        change = np.diff(kind, prepend=np.int8(0), append=np.int8(0))
        begins, ends = change == 1, change == -1
        inner = offs[(offs > 0) & (offs < len(data))]
        glued = inner[(kind[inner - 1] == 1) & (kind[inner] == 1)] if len(inner) else inner
        begins[glued] = ends[glued] = True
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        return starts, stops, np.searchsorted(starts, offs)

    def advance(self, state, data, starts, stops):
        """The states after the bytes data[start:stop], for all words at once. The words go by length, so that at each step
        those with bytes left are the first ones."""
        import zlib

        import numpy as np

        size = stops - starts
        order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
        at, out = starts[order], state[order].copy()
        left = np.searchsorted(-size[order].clip(max=LONG), -np.arange(LONG), "left")  # how many are longer than k
        for k in range(int(min(size.max(initial=0), LONG))):
            c = left[k]
            out[:c] = self.table[(out[:c] ^ data[at[:c] + k]) & 255] ^ (out[:c] >> 8)
        back = np.empty_like(out)
        back[order] = out
        for i in np.flatnonzero(size > LONG):
            back[i] = zlib.crc32(data[starts[i] + LONG : stops[i]].tobytes(), int(back[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        return back

    def features(self, texts):
        """Yields (i, j, words, doc, bucket) for ranges i:j of the documents of an Arrow array: words of each, then a row a feature."""
        import numpy as np

        from lexiloom.llm import textvec as tv

        data, offs = tv.buffers(texts)
        for i, j in tv.blocks(offs, BLOCK_BYTES):
            part, o = self.fold[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
            starts, stops, first = self.words(part, o)
            count = np.diff(first)
            doc = np.repeat(np.arange(j - i), count)
            state = self.advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), part, starts, stops)
            docs, buckets = [doc], [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(self.buckets)]
            last = first[doc + 1]
            at = np.arange(len(starts))
            for k in range(1, self.n):
                on = at + k < last[at]
                at, state = at[on], state[on]
                state = self.table[(state ^ 32) & 255] ^ (state >> 8)  # the space between
                state = self.advance(state, part, starts[at + k], stops[at + k])
                docs.append(doc[at])
                buckets.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(self.buckets))
            yield i, j, count, np.concatenate(docs), np.concatenate(buckets)


def bucket_counts(texts: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of all features of a table's texts; a bucket without features has no row."""
    ship(texts.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        auto, total = Automaton(n, buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for *_, bucket in auto.features(b.column(0)):
                total += np.bincount(bucket, minlength=buckets)
            trim()
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "count"])

    return texts.select(text).mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, from counts (bucket, count). What comes to the driver is a row a bucket."""
    s, t = ([0] * buckets for _ in range(2))
    for counts, out in ((corpus, s), (target, t)):
        for r in counts.toLocalIterator():
            out[r["bucket"]] = r["count"]
    import math

    every_s, every_t = sum(s), sum(t)
    ratio = lambda a, b: (float(a + 1) * float(every_s + buckets)) / (float(b + 1) * float(every_t + buckets))
    return [math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(t, s)]


def weighted(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """Per row of docs: key, n_words, n_features, weight."""
    spark = docs.sparkSession
    ship(spark)
    held, buckets = spark.sparkContext.broadcast(gain), len(gain)  # one number a bucket
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        auto, g = Automaton(n, buckets), np.array(held.value, np.int64)
        for b in batches:
            cols = [np.zeros(b.num_rows, np.int64) for _ in range(3)]
            for i, j, words, doc, bucket in auto.features(b.column(1)):
                cols[0][i:j], cols[1][i:j], cols[2][i:j] = words, np.bincount(doc, minlength=j - i), _sums(doc, g[bucket], j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names=[key, "n_words", "n_features", "weight"])
            trim()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def _sums(doc, values, n: int):
    """Exact sums of whole numbers by document."""
    import numpy as np

    order = np.argsort(doc, kind="stable")
    run = np.append(0, np.cumsum(values[order]))
    stop = np.cumsum(np.bincount(doc, minlength=n))
    return run[stop] - run[np.append(0, stop[:-1])]


def scored(docs: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs (key, weight, ..). Adds score: the weight and Gumbel noise of the key, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return docs.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def drawn(rows: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (key, n_words, score, ..), staged. Adds rank: 1, 2, .. for the highest scores of percent of the rows with enough
    words, equal scores by key; null for the rest."""
    fit = rows.filter(F.col("n_words") >= least_words)
    n = fit.count()
    part, line, before, nth = (fresh(rows, c) for c in ("_part", "_line", "_before", "_nth"))
    # The line parts rows that are equal in all else, so that no range holds more than its share of them.
    order = (F.col("score").desc(), F.col(key).asc_nulls_last(), F.col(line))
    ranges = max(parts_for(rows.sparkSession), n // RANGE_ROWS + 1)
    cut = staged(fit.withColumn(line, F.monotonically_increasing_id()).repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), "score-ranges")
    # A row a range.
    shift = cut.groupBy(part).agg(F.count("*").alias(nth)).select(part, F.coalesce(F.sum(nth).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    ranked = cut.withColumn(nth, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(shift), part)
    rank = F.col(before) + F.col(nth)
    ranked = ranked.select(*rows.columns, F.when(rank <= n * percent // 100, rank).cast("long").alias("rank"))
    return ranked.unionByName(rows.filter(F.coalesce(F.col("n_words"), F.lit(0)) < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of docs: key, n_words, n_features, weight, score and rank, null for those not drawn."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, text, n, buckets), buckets)
    return drawn(staged(scored(weighted(docs, gain, key, text, n), key, seed), "scored"), key, percent, least_words)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = rf"""
with tab as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
dw as (select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents),
bw as (select unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
hx as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
ids as materialized (select w, (xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000)::bigint as bucket from hx, tab),
s as (select bucket, count(*)::bigint as s from dw join ids using (w) group by 1),
t as (select bucket, count(*)::bigint as t from bw join ids using (w) group by 1),
every as (select (select coalesce(sum(s), 0) from s)::double as es, (select coalesce(sum(t), 0) from t)::double as et),
gain as (select b.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (es + 10000)) / ((coalesce(s, 0) + 1)::double * (et + 10000))))::bigint as gain
  from (select unnest(range(10000)) as bucket) b left join s using (bucket) left join t using (bucket), every),
per as (select doc_id, count(*)::bigint as n_features, sum(gain)::bigint as weight from dw join ids using (w) join gain using (bucket) group by 1),
sc as (select d.doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score from documents d left join per on d.doc_id = per.doc_id),
rk as (select doc_id, row_number() over (order by score desc, doc_id)::bigint as r, (10 * count(*) over () // 100)::bigint as most from sc where n_features >= 20)
select sc.doc_id, n_features, weight, score, case when r <= most then r end as rank from sc left join rk on sc.doc_id = rk.doc_id"""
