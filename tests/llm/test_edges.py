"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import chat, decontaminate, embedding_dedup, katz, language_id, minhash, mixing, token_files, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, size int, copies string, _id string, rejected string, _turn int"
WORDS = [f"w{hashlib.md5(str(i).encode()).hexdigest()[:6]}" for i in range(400)]
LONG = " ".join(WORDS[i * 7 % 400] for i in range(30_000))


def odd_docs(spark):
    near = " ".join(WORDS[:60])
    rows = [
        (1, near, "en", "a"), (2, near, "en", "a"), (3, near + " extra", None, "a"), (4, None, "en", None), (5, "", "de", None), (6, "  \n", None, "b"),
        (7, "!!! ... ???", "en", "b"), (8, LONG, "en", "a"), (9, "short one", "de", "b"), (None, near, "en", "a"), (10, " ".join(WORDS[100:160]), "en", "c"),
        (10, " ".join(WORDS[100:160]), "en", "c"), (11, "short one", "de", None),
    ]
    return spark.createDataFrame([(*r, None, 1, 2, "x", "y", "z", 3) for r in rows], DOCS)


def test_minhash(spark):
    d = odd_docs(spark)
    got = {r.doc_id: r.class_id for r in minhash.classes(d).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 9}
    kept = minhash.deduplicated(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]
    assert minhash.classes(d.limit(0)).count() == 0 and minhash.deduplicated(d.limit(0)).count() == 0


def test_mixing(spark):
    d = odd_docs(spark)
    got = mixing.sampled(d).collect()
    assert len(got) == 13 and {r.size for r in got if r.doc_id in (4, 5, 6)} == {0}
    assert all(r.copies <= 3 and r.target <= 3 * r.source_size for r in got)
    goal = {r.source: r.target for r in got}
    assert sum(goal.values()) == pytest.approx(sum({r.source: r.source_size for r in got}.values()), abs=1e-6) or any(t == 3 * s for t, s in ((r.target, r.source_size) for r in got))
    out = mixing.mixed(d)
    assert out.columns == d.columns
    assert mixing.mixed(d.limit(0)).count() == 0 and mixing.sampled(d.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark, sf):
    got = mixing.sampled(spark.read.parquet(f"{sf}/documents.parquet"))
    longest = got.agg(F.max("size")).first()[0]
    for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("w"), F.first("target").alias("t")).collect():
        assert abs(r.w - r.t) <= 2 * longest


def test_language(spark):
    d = odd_docs(spark)
    model = language_id.learned_dictionaries(d.filter("lang is not null"))
    assert sorted(model) == ["de", "en"] and all(len(x) <= language_id.DICT_BYTES for x in model.values())
    got = language_id.identified(d, model).collect()
    assert len(got) == 13
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    kept = language_id.accepted(d, model)
    assert kept.columns == d.columns and not {4, 5, 6, 7} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in language_id.identified(d, {}).collect()} == {"und"}
    assert language_id.learned_dictionaries(d.limit(0)) == {} and language_id.identified(d.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    r = language_id.op4_language_id(spark, sf).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] >= 0.9


def test_decontamination(spark):
    item = " ".join(WORDS[200:240])
    edited = item.split(" ")
    edited[5], edited[20] = "changed", "too"
    del edited[30]
    texts = [f"{LONG} {item.upper()}! tail", "before " + " ".join(edited), None, "", "the and", item[: len(item) // 2], " ".join(WORDS[300:340])]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _scanned int")
    items = spark.createDataFrame([(7, item, 0), (8, None, 0), (9, "the and", 0), (7, item, 1)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(None, 7, 0), (1, 7, 3)}
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == 7


def test_decontamination_recall_and_blocks(spark, sf):
    """Against exact edit distances, computed for every window of a text."""
    import random

    rng = random.Random(3)
    items = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{sf}/benchmark.parquet").collect())]
    docs = []
    for n, (i, t) in enumerate(items * 3):
        w = t.split()
        for _ in range(int(len(w) * 0.15)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        docs.append((n, " ".join(rng.choices(WORDS, k=50) + w + rng.choices(WORDS, k=50)), i))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, it).collect()}
    want = {(n, i) for n, _, i in docs}
    assert len(want & got) >= 0.99 * len(want)
    blocks = list(decontaminate.item_blocks(it, 300))
    assert len(blocks) > 1 and sum(blocks, []) == items


def test_embeddings(spark):
    near = [1.0] * 8
    rows = [
        (1, near, "x"), (2, near, "x"), (3, [2.0] * 8, "x"), (4, [1.0] * 7 + [1.2], "x"), (5, [1.0] * 7 + [-9.0], "x"), (6, None, "x"), (7, [], "x"), (8, [0.0] * 8, "x"),
        (9, [float("nan")] * 8, "x"), (10, [1.0, None], "x"), (11, [1.0] * 4, "x"), (None, near, "x"), (12, [float("inf")] * 8, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False)}
    assert all(got[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 12)) and got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    """Links of hard pairs, about the threshold, against brute force; a small window makes the passes matter."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    v = np.concatenate([base, base + 0.35 * rng.standard_normal((300, 16))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    got = np.zeros(600, int)
    for r in embedding_dedup.near_duplicates(df, window=8).collect():
        got[r.vec_id] = r.n_links
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()


def test_url_rules(spark):
    urls = [
        "http://a.example.com/en/700", "https://EXAMPLE.com/en/1?x#y", "x", None, "", "http://com/en/", "http://notexample.com/en/7", "http://b.net/de/8", "http://example.net/de/81",
        "ftp://u.org", "http://h.io/ads/x.js", "http://h.io/a?gclid=1", "http://h.io/EN/", "a://b://c/d", "http://h.io/x\n/y",
    ]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r"), (None, urls[0], "r")], "page_id long, url string, rule string")
    rows = url_rules.judge_urls(df).collect()
    assert len(rows) == len(urls) + 2 and sum(r.rule == "example.com/en/7" for r in rows) == 3
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == ("example.com", "/en/1", "com/en/", "block") and got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2] == "com/en/" and got[6][2] == "com/en/" and got[7][2:] == ("net/de/", "block") and got[8][2:] == ("example.net/de/8", "block")
    assert got[9] == ("u.org", "", None, "allow") and got[10][3] == "block" and got[11][3] == "block" and got[12][3] == "allow" and got[13][:2] == ("b:", "//c/d")
    assert got[14][1] == "/x\n/y"
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_rare_tokens(spark):
    urls = spark.createDataFrame([("http://www.shop.com/x",), ("http://www.shop.com/y",), ("http://rare.com/z",)], "url string")
    index = {r.name: r.token for r in url_rules.rarest_token_index(spark, urls, [url_rules.prefix_rule("block", "www.rare.com/a/"), url_rules.pattern_rule("block", "any", "x")]).collect()}
    assert index == {"www.rare.com/a/": "a", "any": ""}


def test_chat(spark):
    rows = [(1, 1, "assistant", r"a \l <turn:user> </turn>"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x\\"), (None, 0, "assistant", "n"), (3, 0, "us>er", "é😀")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    back = {r.conv_id: r for r in chat.parsed(chat.formatted(chat.canonical_rows(df))).collect()}
    assert [tuple(t) for t in back[1].read_turns] == [("user", ""), ("user", ""), ("assistant", rows[0][3])]
    assert back[1].loss_text == rows[0][3] and back[2].read_turns[0].text == "x\\" and back[None].loss_text == "n" and tuple(back[3].read_turns[0]) == ("us>er", "é😀")
    assert chat.canonical_rows(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    import json

    ua = [("user", "q"), ("assistant", "a")]
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", ua),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "share", ua),
        ([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "bare", ua),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", ua),
        ({"instruction": "do", "input": "q", "output": "a"}, "instruction_input", [("user", "do\nq"), ("assistant", "a")]),
        ({"instruction": "q", "output": "a"}, "instruction", ua),
        ({"system": "s", "instruction": "q", "input": "", "output": "a"}, "system_instruction", [("system", "s"), *ua]),
        ({"question": "q", "answer": "a"}, "question_answer", ua),
        ({"other": 1}, None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(98, None), (99, "{no json")], "i int, j string")
    got = {r.i: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None) for r in chat.canonical_json(df, "j").collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)} | {98: (None, None), 99: (None, None)}
    assert chat.fingerprint_of(spark.createDataFrame([], "messages array<struct<role:string,content:string>>")) == chat.fingerprint(chat.LAYOUTS[0].paths)


def test_warc(spark):
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a/1", big), (3, "http://a/2 b\r\nX: y", big), (9, None, big), (4, "http://s", small), (2, "http://s", small), (1, "http://e", None), (6, "http://a/1", big), (6, "http://a/1", big), (None, "http://n", big), (8, "http://w", "WARC/1.0\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    folder, manifest = warc.write_captures(df, archive_bytes=600)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == 30
    records = warc.read_records(spark, folder, manifest)
    caps = warc.assemble(records)
    assert caps.filter("response is not null and request is not null and size(metadata) = 1").count() == caps.count() == 10
    got = warc.resolve_revisits(caps).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted([(r[0] or 0, len((r[2] or "").encode()), sha(r[2]), "revisit" if r[2] == big and r[0] != 3 else "response", 3 if r[2] == big and r[0] != 3 else None) for r in rows], key=repr)
    assert sorted([(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == want
    back = {r.t: bytes(r.p).decode() for r in caps.select(F.col("metadata")[0]["fields"]["page_id"].alias("t"), F.col("response.payload").alias("p")).filter("p is not null").collect()}
    assert back["3"] == big and back["8"] == rows[-1][2]
    folder, manifest = warc.write_captures(df.limit(0))
    assert warc.assemble(warc.read_records(spark, folder, manifest)).count() == 0


def test_warc_chains(spark):
    rec = "record_id string, record_type string, concurrent_to string"
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "q1"), ("r2", "response", "q2"), ("q2", "request", None), ("m9", "metadata", None)]
    got = {r.capture_id: (r.response.record_id if r.response else None, r.request.record_id if r.request else None, sorted(m.record_id for m in r.metadata)) for r in warc.assemble(spark.createDataFrame(rows, rec)).collect()}
    assert got == {"r1": ("r1", "q1", ["m1"]), "r2": ("r2", "q2", []), "m9": (None, None, ["m9"])}


def test_token_shards(spark):
    from tokenizers import Tokenizer

    d, path = odd_docs(spark), token_files.default_tokenizer()
    rows = [(r.doc_id, r.text) for r in d.collect()]
    tok = Tokenizer.from_file(path)
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    at, want = 0, []
    for i, x in ids:
        want.append((i, at, len(x), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in x))))
        at += len(x)
    got = [tuple(r) for r in token_files.encoded(d, path).orderBy("start").collect()]
    assert got == want
    assert token_files.encoded(d.limit(0), path).count() == 0


def test_range_coder():
    import numpy as np

    from lexiloom.llm import range_coder as rc

    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 127, 700, 20_000):
        for ids in (rng.integers(0, 49_408, n), np.full(n, 49_407), np.minimum(rng.zipf(1.2, n), 49_407)):
            b = rc.encode_block(ids, 49_408)
            assert (rc.decode_block(b[: rc.HEAD.size], b[rc.HEAD.size :]) == ids).all()
    broken = bytearray(b)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rc.decode_block(bytes(broken[: rc.HEAD.size]), bytes(broken[rc.HEAD.size :]))


def test_katz_edges(spark):
    got = {r.doc_id: r for r in katz.scored(katz.training_view(odd_docs(spark))).filter("doc_id <> 10 or doc_id is null").collect()}
    assert len(got) == 11 and got[4].n_tokens == got[5].n_tokens == got[6].n_tokens == 1 and got[8].n_tokens == 30_001
    assert all(r.score < 0 and r.base_score < 0 for r in got.values()) and not got[None].held_out
    assert katz.scored(katz.training_view(odd_docs(spark).limit(0))).count() == 0
    none = katz.scored(odd_docs(spark).selectExpr("doc_id", "false train", "false held_out", "coalesce(text, '') text")).collect()
    assert len(none) == 13 and all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_components_and_jaccard(spark):
    import numpy as np

    from lexiloom.llm.graph import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (202, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = (np.sort(rng.choice(30, 12, False)).astype(np.uint64) for _ in range(2))
        wa, wb = rng.integers(1, 4, 12), rng.integers(1, 4, 12)
        A, B = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
        want = sum(1 / sum(max(A.get(x, 0) / A[d], B.get(x, 0) / B[d]) for x in {*A, *B}) for d in A if d in B)
        assert minhash.probability_jaccard(a, wa, b, wb) == pytest.approx(want)
