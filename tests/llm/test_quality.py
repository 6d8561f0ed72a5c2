"""op11: features against slow ones, the prior against the truth, the risk's minimum, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import quality as Q

TEXTS = [None, "", "a", "Aa b!! B 12", "the the the cat\nsat. the", "é | ü | ß\n", "x" * 5000, "ab " * 4000]


def slow(t):
    t = (t or "").encode()
    kind = [next((i + 1 for i, c in enumerate(Q.CLASSES) if b in c), 0) for b in t]
    out = np.zeros(Q.WIDTH)
    for a, b, c in zip(kind, kind[1:], kind[2:]):
        out[(a * Q.KINDS + b) * Q.KINDS + c] += 1 / (len(kind) - 2)
    words = [w.lower() for w in t.split()]
    n = max(len(words), 1)
    out = np.sqrt(out)
    marks = [next((i + 1 for i, c in enumerate(Q.CLASSES) if w[-1] in c), 0) in (8, 10) for w in words]
    out[Q.RUNS :] = sum(a == b for a, b in zip(words, words[1:])) / n, (len(words) - len(set(words))) / n, sum(marks) / n, min(sum(map(len, words)) / n / 20, 2)
    return out


@pytest.mark.parametrize("block, docs", [(1 << 20, 512), (10, 2)])
def test_features(monkeypatch, block, docs):
    monkeypatch.setattr(Q, "BLOCK_BYTES", block)
    monkeypatch.setattr(Q, "BLOCK_DOCS", docs)
    got = np.concatenate([x for _, _, x in Q.features(pa.array(TEXTS))])
    assert np.allclose(got, [slow(t) for t in TEXTS], atol=1e-5)


def drawn(rng, n, share):
    one = rng.random(n) < share
    return (rng.normal(0, 1, (n, 6)) + np.where(one, 2.0, -2.0)[:, None] * [1, 1, 0, 0, 0, 0]).astype(np.float32), one


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_and_risk(share):
    """Classes two apart in two of six directions: the prior is found, and texts are told apart without negatives."""
    rng = np.random.default_rng(5)
    p, (u, _) = drawn(rng, 2000, 1.0)[0], drawn(rng, 4000, share)
    model = Q.fitted(p, u)
    assert abs(model.prior - share) < 0.08
    x, one = drawn(rng, 4000, share)
    score = Q.sigmoid(x @ np.array(model.weights) + model.constant)
    assert ((score >= 0.5) == one).mean() > 0.96
    # The risk is not negative: the second part of it can't have been driven far below zero.
    lost = lambda z: np.log1p(np.exp(z)).mean()
    at = lambda z: z @ np.array(model.weights) + model.constant
    assert lost(at(u)) - model.prior * lost(at(p)) > -0.05


def test_held_out(spark, sf):
    """Labels of the held-out rows, of a table larger than the tests' usual one."""
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in Q.op11_pu_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    rows = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = ([s for s, q in rows if q == x] for x in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.98 and np.mean([s >= 0.3 for s in good]) > 0.99


def test_edges(spark):
    kind = "doc_id long, text string, score int, _text string"
    rows = [(1, "A fine text.", 1, "x"), (1, "A fine text.", 1, "x"), (None, "Another one.", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (4, "junk | junk | junk", 1, "x"), (5, "z" * 200_000, 1, "x")]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1), (4, None)], "doc_id long, label int")
    trusted, other = Q.samples(docs, labels)
    assert [tuple(r) for r in trusted.collect()] == [(1, "A fine text.")]
    assert sorted(r.doc_id for r in other.collect()) == [3, 4, 5]
    assert Q.samples(docs, labels, 1, 2)[1].count() == 2
    got = Q.judged(docs, Q.learned(docs, labels)).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in Q.judged(docs, Q.learned(docs, labels.limit(0))).collect()} == {0.0}
    assert Q.judged(docs.limit(0), Q.learned(docs.limit(0), labels)).count() == 0
    every = labels.unionByName(docs.select("doc_id", F.lit(0).alias("label")))
    assert Q.samples(docs, every)[1].count() == 4  # none without a label: all stand in
