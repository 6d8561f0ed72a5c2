"""op3's mix row by row: null ids in several sources, repeated ids with different texts, hot sources."""

import collections

from lexiloom.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_an_id_of_their_own_get_what_was_sampled(spark):
    text = lambda n, t: " ".join([t] * n)
    rows = [(None, text(40, f"a{i}"), "en", "a", 1) for i in range(5)] + [(None, text(40, f"b{i}"), "en", "b", 2) for i in range(3)]
    rows += [(None, text(20, f"c{i}"), "en", "c", 3) for i in range(9)] + [(None, text(40, "a0"), "de", "a", 4)] * 2
    rows += [(7, text(30, "x"), "en", "a", 1), (7, text(30, "y"), "en", "b", 1), (7, text(30, "z"), "en", None, 1), (7, text(10, "y"), "en", "b", 1), (8, None, None, "a", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    words = lambda rows: collections.Counter()
    sampled = mixing.sampled(docs).collect()
    want, got = words(sampled), words(rows)
    for r in sampled:
        want[r.source] += r.copies * r.size
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    out = out.collect()
    for r in out:
        got[r.source] += len((r.text or "").split())
    assert +got == +want
    goal = {r.source: r.target for r in sampled}
    assert all(abs(got[s] - t) <= 80 for s, t in goal.items())
    most = collections.Counter((r.doc_id, r.text, r.source) for r in out)
    have = collections.Counter((r[0], r[1], r[3]) for r in rows)
    assert all(n <= 3 * have[k] for k, n in most.items())
    per = collections.Counter()
    for r in sampled:
        per[r.doc_id, r.size, r.source] += r.copies
    assert collections.Counter((r.doc_id, len((r.text or "").split()), r.source) for r in out) == +per
