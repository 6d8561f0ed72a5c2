"""op8 at the full edit limit, for every kind of edit, against exact distances."""

import random

import pyarrow as pa

from lexiloom.llm import decontaminate
from lexiloom.llm import textvec as tv


def nearest(item, text):
    """(least edits of item to a passage of text, its first end), by Sellers."""
    row, best = list(range(len(item) + 1)), (len(item), 0)
    for at, w in enumerate(text, 1):
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, (new[-1], at))
    return best


def test_leaks_equal_brute_force_at_the_limit():
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((15, 40, 59, 100, 200, 300))]
    docs = []
    for _, text in items:
        for kind in ("drop", "add", "mixed", "swap", "over"):
            w = text.split()
            k = len(w) // 5
            if kind in ("drop", "over"):
                for x in sorted(rng.sample(range(1, len(w) - 1), k + (kind == "over")), reverse=True):
                    del w[x]
            elif kind == "add":
                for _ in range(k):
                    w.insert(rng.randrange(1, len(w)), word())
            else:
                for n in range(k):
                    at = rng.randrange(1, len(w) - 1)
                    w[at : at + (n % 3 != 1 or kind == "swap")] = [word()] * (n % 3 != 2 or kind == "swap")
            near = text.split()
            near[3] = "other"
            # Every other one holds a nearer passage too, and one that repeats words of the item for long.
            more = [near, text.split()[:9] * 40] if len(docs) % 2 else []
            docs.append([word() for _ in range(30)] + w + [word() for _ in range(30)] + sum(more, []))
    finder = decontaminate.Finder(items)
    got, want = {}, {}
    for _, _, h, first in tv.hashed(pa.array([" ".join(d) for d in docs]), finder.alphabet):
        got = {(d, i): (edits, end) for d, i, edits, end in finder.leaks(h, first)}
    for d, text in enumerate(docs):
        for i, item in items:
            best = nearest(item.split(), text)
            if best[0] <= len(item.split()) // 5:
                want[d, i] = best
    assert len(want) >= 4 * len(items) and got == want


def test_short_items_are_matched_exactly(spark):
    docs = spark.createDataFrame([(1, "say Yes and No, then"), (2, "yes. and no"), (3, "yes and, so no"), (4, "maybe"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes and no"), (2, "Maybe!"), (3, ""), (4, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, items, min_words=1).collect()} == {(1, 1, 0), (2, 1, 0), (4, 2, 0)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items, min_words=1).collect()) == [3, 5]


def test_long_items_take_bounded_memory():
    """500 items of 20 words and one of 30,000."""
    import tracemalloc

    rng = random.Random(2)
    text = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    items = [(i, " ".join(text(20))) for i in range(500)]
    long = text(30_000)
    near = [w for i, w in enumerate(long) if i % 997]  # 31 words are left out
    docs = [" ".join(text(40) + near + text(40)), " ".join(text(30)) + " " + items[7][1]]
    tracemalloc.start()
    finder = decontaminate.Finder([*items, (500, " ".join(long))])
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    found = [x for _, _, h, first in tv.hashed(pa.array(docs), finder.alphabet) for x in finder.leaks(h, first)]
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert {(d, i) for d, i, _, _ in found} == {(0, 500), (1, 7)} and min(e for _, i, e, _ in found if i == 500) == 31
