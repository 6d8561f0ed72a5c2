"""op12 against a brute-force version with zlib's CRC, word by word."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from lexiloom.llm import importance as I

TEXTS = [
    None, "", "  ", "A", "Ab cd-ef 12", "É é Éa ñandú", "x" * 1000 + " " + "y" * 127 + " " + "z" * 128 + " " + "w" * 129, "a b " * 30, "...!!", "日本語 の 文 " * 9, "tail",
    "tail", "0a9Z_z", "the cat sat on the mat " * 8, "\u0000a\u007fb\u0080c", "mid " * 25,
]
TARGET = ["the cat sat on the mat", "Tail a b", None, "É"]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, target, n, buckets, percent, least):
    feats = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    s, t = (Counter(b for x in xs for b in feats(x)) for xs in ([x for _, x in docs], target))
    es, et = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (es + buckets) / ((s[b] + 1) * (et + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in feats(x))
        rows.append([i, len(words(x)), len(feats(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n, buckets, percent, least", [(1, 10_000, 10, 20), (3, 97, 50, 2), (2, 10_000, 100, 0)])
def test_equals_brute_force(spark, n, buckets, percent, least):
    docs = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, score int, _part string").repartition(3)
    to = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = I.resampled(df, to, n=n, buckets=buckets, percent=percent, least_words=least)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, TARGET, n, buckets, percent, least)


def test_repeated_null_and_empty(spark):
    kind = "doc_id long, text string"
    to = spark.createDataFrame([], "text string")
    assert I.resampled(spark.createDataFrame([], kind), to).count() == 0
    docs = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    got = I.resampled(spark.createDataFrame(docs, kind), to, percent=60, least_words=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, [], 1, I.BUCKETS, 60, 2)


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = I.op12_importance_resampling(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(I.OP12_SQL).fetchall())
    assert got.columns == con.sql(I.OP12_SQL).columns
