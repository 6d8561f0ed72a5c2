"""op1: large families, repeated ids, null ids, against brute force."""

import random

import pytest

from lexiloom.llm import minhash

from .test_pipeline import shingles, similarity


def brute(texts):
    """Component of each text by all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a].keys() & sets[b].keys()) > 0.4 * len(sets[a]) and similarity(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile", [8, 1024])
def test_families_of_every_size(spark, monkeypatch, tile):
    """Groups of near copies, and texts near some of a group only, in one and in many tiles."""
    monkeypatch.setattr(minhash.node_links, "__defaults__", (tile,))
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for size, edits in ((45, 2), (30, 6), (18, 9), (8, 14)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(20)]
    rng.shuffle(texts)
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in minhash.deduplicated(docs).collect()) == sorted(set(want))


def test_texts_under_one_id_are_judged_by_themselves(spark, tmp_path):
    text = lambda s: " ".join(f"{s}{i}" for i in range(50))
    rows = [(1, text("a")), (2, text("a") + " end"), (2, text("b")), (3, text("b")), (2, text("c")), (2, text("c")), (4, "..."), (4, None), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in minhash.deduplicated(docs).collect()))
    assert got == sorted([(1, text("a")), (2, text("b")), (2, text("c")), (4, "..."), (4, ""), (0, text("a")), (0, text("a"))])
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = minhash.op1_probminhash_dedup(spark, str(tmp_path)).collect()
    assert sum(r.doc_id is None and r.class_id is None for r in out) == 2 and len(out) == 6
