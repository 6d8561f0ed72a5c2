"""op9 against figures and brute force."""

import collections
import math

import pytest

from lexiloom.llm import katz


def test_discounts_stay_good_turing_on_corpora_with_copies():
    """Counts of counts of words and pairs of the training documents of sf0.1: n5 is high for n4, as copies make it."""
    words = [207344, 59772, 25017, 14274, 13493, 7080, 5515, 4389, 3635, 3381, 2349, 2063, 1753, 1571, 1461, 1158, 990, 871, 778, 781]
    pairs = [1579638, 246704, 51653, 21705, 18939, 7580, 5397, 3840, 3021, 2722, 1804, 1503, 1294, 1180, 955, 743, 731, 536, 558, 540]
    for n in (words, pairs):
        got, common = katz.discounts(n), 6 * n[5] / n[0]
        raw = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, 6)]
        assert raw[3] > 1 and got[:3] == pytest.approx(raw[:3])
        assert all(0 < d < 1 for d in got) and got == sorted(got)
    exact = [1e6 / r**3 for r in range(1, 21)]
    assert katz.slope(exact) == pytest.approx(-3)
    assert katz.discounts([*exact[:3], 1, *exact[4:]])[3:] == pytest.approx(katz.discounts(exact)[3:], rel=0.2)
    gaps = katz.discounts([50, 9, 0, 2, 0, 0, 1])
    assert all(0 < d < 1 for d in gaps) and gaps != katz.discounts([0] * 20)


def test_fallback_is_logged(caplog):
    assert katz.discounts([3, 0, 0, 0, 0, 0]) == [(r - 0.5) / r for r in range(1, 6)]
    assert "(c - 1/2) / c" in caplog.text


def brute(texts, learned):
    """Scores by dictionaries, from the definition in the docstring."""
    rows = [[*t.split(), None] for t in texts]
    uni, pair = collections.Counter(), collections.Counter()
    for row, on in zip(rows, learned):
        if on:
            uni.update(row)
            pair.update(zip([None, *row], row))
    n, count = sum(uni.values()), lambda c: [sum(x == r for x in c.values()) for r in range(1, 21)]
    d1, d2 = katz.discounts(count(uni)), katz.discounts(count(pair))
    left = sum((1 - d1[c - 1]) * c for c in uni.values() if c <= 5) / n
    assert left > 0
    p = lambda w: uni[w] * (d1[uni[w] - 1] if uni[w] <= 5 else 1) / n if uni[w] else left
    after = collections.defaultdict(dict)
    for (h, w), c in pair.items():
        after[h][w] = c

    def score(h, w):
        if not uni[h]:
            return p(w)
        below = uni[h] + (0 if any(c <= 5 for c in after[h].values()) else 1)
        part = {x: c * (d2[c - 1] if c <= 5 else 1) / below for x, c in after[h].items()}
        return part[w] if w in part else p(w) * (1 - sum(part.values())) / (1 - sum(p(x) for x in part))

    return [sum(math.log10(score(h, w)) for h, w in zip([None, *row], row)) for row in rows]


@pytest.mark.parametrize("parts", ["4", "64"])
def test_scores_equal_brute_force(spark, parts):
    """Also with so many parts that a history of one token is as many as a part should hold."""
    import random

    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(360)]
    texts = [" ".join(words[i : i + 12]) for i in range(0, 360, 12)] + ["w1 new w2 w1 w3", "", "w2 w2 w7 other w1"]
    learned = [i % 5 > 0 and i < 30 for i in range(33)]
    docs = spark.createDataFrame([(i, on, not on, t) for i, (t, on) in enumerate(zip(texts, learned))], "doc_id long, train boolean, held_out boolean, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r.score for r in katz.scored(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i] for i in range(33)] == pytest.approx(brute(texts, learned))


def brute3(texts, learned):
    """The model of order 3 by dictionaries: (score of each text, P of a token after two, learned words)."""
    rows = [[*t.split(), None] for t in texts]
    uni, pair, triple = collections.Counter(), collections.Counter(), collections.Counter()
    for row, on in zip(rows, learned):
        if on:
            before = [None, None, *row]
            uni.update(row)
            pair.update(zip(before[1:], row))
            triple.update(zip(before, before[1:], row))
    n, count = sum(uni.values()), lambda c: [sum(x == r for x in c.values()) for r in range(1, 21)]
    d1, d2, d3 = (katz.discounts(count(c)) for c in (uni, pair, triple))
    left = sum((1 - d1[c - 1]) * c for c in uni.values() if c <= 5) / n
    p1 = lambda w: uni[w] * (d1[uni[w] - 1] if uni[w] <= 5 else 1) / n if uni[w] else left

    def level(grams, d, lower):
        after = collections.defaultdict(dict)
        for g, c in grams.items():
            after[g[:-1]][g[-1]] = c
        memo = {}

        def of(h):
            if h not in memo:
                below = sum(after[h].values()) + (0 if any(c <= 5 for c in after[h].values()) else 1)
                part = {w: c * (d[c - 1] if c <= 5 else 1) / below for w, c in after[h].items()}
                memo[h] = part, (1 - sum(part.values())) / (1 - sum(lower(h, w) for w in part))
            return memo[h]

        def p(h, w):
            if h not in after:
                return lower(h, w)
            part, alpha = of(h)
            return part[w] if w in part else alpha * lower(h, w)

        return p

    p2 = level(pair, d2, lambda h, w: p1(w))
    p3 = level(triple, d3, lambda h, w: p2(h[1:], w))
    score = [sum(math.log10(p3((a, b), w)) for a, b, w in zip([None, None, *row], [None, *row], row)) for row in rows]
    return score, p3, list(uni)


def corpus():
    import random

    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(900)]
    texts = [" ".join(words[i : i + 15]) for i in range(0, 900, 15)] + ["w1 new w2 w1 w3", "", "w2 w2 w7 other w1", "w1 w1 w1 w1 w1 w1 w1 w1 w1"] * 2
    return texts, [i % 5 > 0 for i in range(len(texts))]


@pytest.mark.parametrize("parts", [1, 128])
def test_order_three_equals_brute_force(spark, parts):
    """With so many parts that histories lie in several, too."""
    texts, learned = corpus()
    want, p, words = brute3(texts, learned)
    docs = spark.createDataFrame([(i, on, False, t) for i, (t, on) in enumerate(zip(texts, learned))], "doc_id long, train boolean, held_out boolean, text string")
    got = {r.doc_id: r for r in katz.scored(docs, order=3, parts=parts).collect()}
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want)
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())
    for h in ((None, None), ("w1", "w1"), ("w1", "w2"), (None, "w1"), ("no", "w1"), ("w9", "such")):
        assert sum(p(h, w) for w in words) + p(h, "a word never seen") == pytest.approx(1)


def test_stored_model_scores_another_corpus(spark, tmp_path):
    texts, learned = corpus()
    want, p, _ = brute3(texts, learned)
    docs = spark.createDataFrame([(i, on, False, t) for i, (t, on) in enumerate(zip(texts, learned))], "doc_id long, train boolean, held_out boolean, text string")
    model = katz.learned(docs, (tmp_path / "model").as_uri(), parts=4)
    new = docs.filter(~docs.train).union(spark.createDataFrame([(900, True, True, "w1 w2 never w1 w1")], docs.schema))
    got = {r.doc_id: r.score for r in katz.scored(new, model=model).collect()}
    assert len(got) == learned.count(False) + 1 and all(got[i] == pytest.approx(want[i]) for i in got if i < 900)
    row = ["w1", "w2", "never", "w1", "w1", None]
    assert got[900] == pytest.approx(sum(math.log10(p((a, b), w)) for a, b, w in zip([None, None, *row], [None, *row], row)))
    rows = katz.probabilities(spark, model).collect()
    per = collections.defaultdict(float)
    for r in rows:
        per[r.u, r.v] += r.probability
    assert len(per) > 50 and all(0 < x < 1 for x in per.values()) and all(r.backoff > 0 for r in rows)


@pytest.mark.parametrize("passes", [1, 3])
def test_triples_go_out_a_share_of_the_parts_at_a_time(spark, monkeypatch, passes):
    """So only that share is on disk at once; and what the batches were needed for goes before texts are summed up."""
    from pathlib import Path
    from urllib.parse import urlparse

    from lexiloom.sources.scratch import scratch_path

    texts, learned = corpus()
    docs = spark.createDataFrame([(i, on, False, t) for i, (t, on) in enumerate(zip(texts, learned))], "doc_id long, train boolean, held_out boolean, text string")
    seen, top_parts = [], katz.top_parts
    monkeypatch.setattr(katz, "PASSES", passes)
    monkeypatch.setattr(katz, "top_parts", lambda *a: (got := top_parts(*a), seen.append({r.part for r in got.collect()} - {-1}))[0])
    before = {p for p in Path(urlparse(scratch_path(spark, "x")).path).parent.glob("katz-*")}
    df = katz.scored(docs, order=3, parts=8)
    left = {p.name.rsplit("-", 1)[0] for p in Path(urlparse(scratch_path(spark, "x")).path).parent.glob("katz-*") if p not in before}
    assert left == {"katz-parts"}
    assert len(seen) == passes and sum(len(s) for s in seen) == len(set().union(*seen)) and all(len(s) <= -(-8 // passes) for s in seen)
    assert [r.score for r in sorted(df.collect())] == pytest.approx(brute3(texts, learned)[0])


def test_any_number_of_parts_shares_hashes_evenly(spark):
    """So parts grow in number as the tokens do, and not in steps of two."""
    import numpy as np

    n = 90_000
    assert (np.bincount(katz.part_of(np.arange(n), 9)) > 0.9 * n / 9).all() and len(set(katz.part_of(np.arange(n), 9).tolist())) == 9
    texts, learned = corpus()
    docs = spark.createDataFrame([(i, on, False, t) for i, (t, on) in enumerate(zip(texts, learned))], "doc_id long, train boolean, held_out boolean, text string")
    assert [r.score for r in sorted(katz.scored(docs, order=3, parts=9).collect())] == pytest.approx(brute3(texts, learned)[0])
