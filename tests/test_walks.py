"""Walks against slow ones made step by step; the index for draws; stop words and runs as values."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import generate, model
from lexiloom.plans import generator
from lexiloom.sources.scratch import scratch_path
from lexiloom.sources.store import Store


def grams(n, words=60, size=9000, seed=3):
    rnd = random.Random(seed)
    pick = lambda: min(int(rnd.expovariate(0.12)), words - 1)
    text = [f"w{pick():02}" for _ in range(size)]
    return Counter(zip(*[text[i:] for i in range(n)]))


def frame(spark, counts):
    n = len(next(iter(counts)))
    return spark.createDataFrame([(*g, c, 0) for g, c in counts.items()], ", ".join(f"w{i + 1} string" for i in range(n)) + ", cnt long, ends long")


def ranked(counts):
    lists = defaultdict(list)
    for g, c in counts.items():
        lists[g[:-1]].append((-c, g[-1]))
    return {k: [(w, -c) for c, w in sorted(v)] for k, v in lists.items()}


def roll(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def draw(cands, r):
    r %= sum(c for _, c in cands)
    for w, c in cands:
        r -= c
        if r < 0:
            return w


def slow(seed, start, lists, weighted, most=20, stop=None, run="0"):
    bi, words, used = len(start) == 1, list(start), set()
    for step in range(100):
        if len(words) >= max(len(start), most) or (stop is not None and step and words[-1] == stop):
            break
        cands = lists.get(tuple(words[-len(start) :]))
        if not cands:
            break
        if weighted:
            tries = [draw(cands, roll(seed, run, step, t)) for t in range(1 if bi else 10)]
            fit = [x for x in tries if (x not in words if bi else x not in words[-2:] and (*words[-2:], x) not in used)]
        else:
            fit = [w for w, _ in cands if not (len(words) > 1 and w == words[-2]) and (words[-1], w) not in used] if bi else [w for w, _ in cands if w not in words[-2:] and (*words[-2:], w) not in used]
            if bi and fit and fit[0] == words[-1]:
                break
        if not fit:
            break
        used.add((*words[-len(start) :], fit[0]))
        words.append(fit[0])
    return words


@pytest.mark.parametrize("order, weighted", [(2, False), (2, True), (3, False), (3, True)])
@pytest.mark.parametrize("stop, run", [(None, "0"), ("w03", "it's | 7")])
def test_walks_equal_slow_ones(spark, order, weighted, stop, run):
    counts = grams(order)
    lists = ranked(counts)
    starts = {f"s{i}": k for i, k in enumerate(sorted(lists)[:80])}
    seeds = spark.createDataFrame([(s, *k) for s, k in starts.items()], "seed_id string, " + ", ".join(f"w{i + 1} string" for i in range(order - 1)))
    step = {(2, False): generate.bi_greedy, (2, True): generate.bi_weighted, (3, False): generate.tri_greedy, (3, True): generate.tri_weighted}[order, weighted]
    want = {s: slow(s, k, lists, weighted, 20, stop, run) for s, k in starts.items()}
    # With cells of three followers, contexts have many blocks, and blocks more than one top.
    more = {"block": 3} if weighted and stop is None else {}
    assert {r.seed_id: r.words for r in step(seeds, frame(spark, counts), stop=stop, run=run, **more).collect()} == want
    assert max(map(len, want.values())) > 3


def test_running_sums_in_parts(spark):
    """A context's sums don't depend on whether it is parted."""
    counts = grams(2, words=400, size=20_000)
    want = {}
    for (w,), cands in ranked(counts).items():
        cum = 0
        for nth, (x, c) in enumerate(cands):
            cum += c
            want[w, x] = (c, cum, sum(c for _, c in cands), nth + 1)
    for many in (model.MANY, 8, 1):
        assert {(r.w1, r.w2): (r.cnt, r.cum, r.total, r.nth) for r in model.cumulative(frame(spark, counts), ["w1"], "w2", many).collect()} == want
    tops, blocks = model.weighted_index(frame(spark, counts), ["w1"], "w2", size=5, many=8)
    assert max(blocks.select(F.max(F.size("cands"))).first()[0], tops.select(F.max(F.size("parts"))).first()[0]) == 5
    assert blocks.agg(F.sum(F.size("cands"))).first()[0] == len(counts) and tops.filter("lo >= hi").count() == 0


def test_words_with_apostrophes_and_settings(spark):
    names = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before = [spark.conf.get(k) for k in names]
    pairs = spark.createDataFrame([("i", "don't", 2, 0), ("don't", "know", 3, 0), ("know", "it's", 1, 0), ("it's", '"x', 1, 0)], "w1 string, w2 string, cnt long, ends long")
    seeds = spark.createDataFrame([(0, "i")], "seed_id int, w1 string")
    said = lambda **k: generate.bi_greedy(seeds, pairs, **k).first().words
    assert said(stop="DON'T") == ["i", "don't"] and said(stop="it's") == ["i", "don't", "know", "it's"] and said(stop="i")[-1] == '"x'
    assert generate.bi_weighted(seeds, pairs, stop="don't", run="o'clock {x}").first().words == ["i", "don't"]
    assert [spark.conf.get(k) for k in names] == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexiloom_")]


def test_lists_stay_where_they_are(spark):
    """In the recursion's session a walk's rows are moved to the bucketed lists; there is no exchange over these."""
    from lexiloom.sources.scratch import bucketed

    own = generate._session(spark, 20)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = int(own.conf.get("spark.sql.shuffle.partitions"))
    table = bucketed(frame(spark, grams(2)), "lists", ["w1"], own, n)
    rows = own.createDataFrame([(f"w{i:02}",) for i in range(50)], "w1 string")
    plan = own.table(table).join(rows, "w1")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    own.sql(f"drop table {table}")


def test_stored_words_with_apostrophes(spark):
    """Through the store and the public call: a stop word with an apostrophe, and a cleared store."""
    store = Store(spark, scratch_path(spark, "walks"))
    store.build()
    files = spark.createDataFrame([("a.txt", "I don't know it's late. I don't care. Don't stop now.")], "file_name string, text string")
    assert store.import_files(files) == 1
    got = generator.generate_sentences(store, "bi_greedy", ["I"], stop="don't").first()
    assert (got.sentence, got.n_words) == ("i don't", 2)
    assert generator.generate_sentences(store, "tri-weighted", ["i don't"], stop="know").first().sentence in ("i don't know", "i don't care")
    store.clear()
    assert {(r.table, r.rows, r.total) for r in generator.report(store).collect()} == {(t, 0, 0) for t in ("source_file", "words", "bigrams", "trigrams")}
    assert store.import_files(files) == 1


def test_few_walks_read_the_contexts_where_they_stand(spark, monkeypatch):
    """No index of the whole model is made for few walks, and the other way gives the same."""
    def whole(*args):
        raise AssertionError("all contexts were bucketed")

    pairs, seeds = frame(spark, grams(2)), spark.createDataFrame([(0, "w01"), (1, "w07"), (2, "none")], "seed_id int, w1 string")
    said = lambda: {r.seed_id: r.words for r in generate.bi_weighted(seeds, pairs).collect()}
    monkeypatch.setattr(generate, "FEW", -1)
    many = said()
    monkeypatch.setattr(generate, "FEW", 1000)
    monkeypatch.setattr(generate, "bucketed", whole)
    assert said() == many and len(many) == 3


def test_lists_for_draws_are_exchanged_once(spark):
    """Of a stored table of n-grams: no copy, one exchange for counting, order and buckets together; larger contexts lie in blocks."""
    from lexiloom.sources.scratch import staged

    counts = grams(3)
    lists, tops, blocks = model.draw_index(staged(frame(spark, counts), "grams"), ["w1", "w2"], "w3", size=5, stored=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lists.repartition(n, "w1", "w2")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    small = {k: len(v) for k, v in ranked(counts).items() if len(v) <= 5}
    assert {(r.w1, r.w2): len(r.cands) for r in lists.collect()} == small and 0 < len(small) < len(ranked(counts))
    assert blocks.agg(F.sum(F.size("cands"))).first()[0] == len(counts) - sum(small.values()) and tops.count() > 0


def test_a_context_is_fetched_once(spark, monkeypatch):
    """Few walks read the n-grams of a context when the first of them comes there, and not again."""
    met = []
    monkeypatch.setattr(generate, "written", lambda df, name, f=generate.written: (name == "contexts" and met.extend(r.w1 for r in df.select("w1").distinct().collect())) or f(df, name))
    pairs = spark.createDataFrame([(a, b, 1, 0) for a, b in zip("abcd", "bcde")], "w1 string, w2 string, cnt long, ends long")
    seeds = spark.createDataFrame([(0, "a"), (1, "b")], "seed_id int, w1 string")
    assert {r.seed_id: "".join(r.words) for r in generate.bi_greedy(seeds, pairs).collect()} == {0: "abcde", 1: "bcde"}
    assert sorted(met) == list("abcd")


def test_what_many_walks_leave(spark, monkeypatch):
    """Of each walk its last row stays, and of what was staged for the index nothing."""
    import glob

    monkeypatch.setattr(generate, "FEW", -1)
    before = set(glob.glob(scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0] + "/*"))
    seeds = spark.createDataFrame([(f"s{i}", f"w{i:02}") for i in range(12)], "seed_id string, w1 string")
    said = {r.seed_id: r.words for r in generate.bi_weighted(seeds, frame(spark, grams(2)), stop="w03", block=3).collect()}
    assert said == {f"s{i}": slow(f"s{i}", (f"w{i:02}",), ranked(grams(2)), True, 20, "w03") for i in range(12)}
    left = set(glob.glob(scratch_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0] + "/*")) - before
    assert {f.rsplit("/", 1)[1].split("-")[0] for f in left} <= {"seeds", "walks", "lists", "tops", "blocks"}
    assert sum(spark.read.parquet(f).count() for f in left if "/walks-" in f and glob.glob(f + "/done=*")) == 12
