"""The pipeline against brute force, stage by stage and in whole, on a small fixture."""

import collections
import re
import zlib

import pytest

import corpus_pipeline
from lexiloom.llm import language_id, mixing, token_files

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}


def similarity(a, b):
    if a == b and a:
        return 1.0
    return sum(1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in {*a, *b}) for d in a if d in b)


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))


def least_edits(item, text):
    """Of item to any passage of text (Sellers)."""
    row, best = list(range(len(item) + 1)), len(item)
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


@pytest.fixture(scope="module")
def fixture(spark, sf, tmp_path_factory):
    """The first documents of the table with their benchmark, as a folder of tables."""
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2500").orderBy("doc_id").limit(90)
    rows = [tuple(r) for r in docs.collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()
    extra = [(900, None, "en", "src0", 0), (901, rows[3][1], "en", "src0", 1), (902, rows[5][1] + " one more word", rows[5][2], None, 1), (903, rows[0][1] + " " + item.text, "en", "src1", 1), rows[2]]
    spark.createDataFrame(rows + extra, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, fixture):
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    items = [words(r.text) for r in spark.read.parquet(f"{fixture}/benchmark.parquet").collect()]
    now = docs
    model = language_id.Classifier(language_id.learned_dictionaries(language_id.training_rows(docs)))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        path = f"{fixture}/stage-{n}"
        stage(spark, now, fixture).write.parquet(path)
        now = spark.read.parquet(path)
        after = now.collect()
        if name == "language_id":
            want = [r.doc_id for r in before if (p := model.predict(r.text))[0] != "und" and p[2] >= language_id.MARGIN]
            assert sorted(r.doc_id for r in after) == sorted(want)
        elif name == "minhash_dedup":
            sets = {r.doc_id: shingles(r.text) for r in before}
            parent = {i: i for i in sets}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and len(sets[a].keys() & sets[b].keys()) > 0.4 * len(sets[a]) and similarity(sets[a], sets[b]) >= 0.8:
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
            assert sorted(r.doc_id for r in after) == sorted(i for i in sets if root(i) == i)
        elif name == "decontaminate":
            bad = {r.doc_id for r in before if any(len(i) >= 5 and least_edits(i, words(r.text)) <= len(i) // 5 for i in items)}
            assert 903 in bad or not any(r.doc_id == 903 for r in before)
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
        elif name == "mix_sources":
            take = {r.doc_id: r.copies for r in mixing.sampled(spark.createDataFrame(before, COLUMNS)).collect()}
            assert collections.Counter(r.doc_id for r in after) == collections.Counter({i: c for i, c in take.items() if c})
        else:
            from tokenizers import Tokenizer

            tok, at, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
            for r in sorted(before, key=lambda r: r.doc_id):
                ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
                want.append((r.doc_id, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
                at += len(ids)
            assert sorted(map(tuple, after), key=lambda r: r[1]) == want
            last = {tuple(r) for r in after}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    assert {tuple(r) for r in corpus_pipeline.run(spark, fixture).collect()} == last


def test_odd_documents(spark, sf, tmp_path):
    """Null ids in two sources, ids with several texts, a very long text; nothing but what a stage is for goes."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text and 200 < len(r.text) < 1500][:24]
    rows = [(None, r.text, r.lang, f"s{i % 2}", i) for i, r in enumerate(docs[:8])] + [(7, r.text, r.lang, "s0", i) for i, r in enumerate(docs[8:16])]
    rows += [(100 + i, r.text, r.lang, None, i) for i, r in enumerate(docs[16:])] + [(200, " ".join(r.text for r in docs[16:]) * 12, "en", "s1", 0), (None, None, None, None, None), (8, "", None, "s2", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage is in any of these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    key = lambda r: (r.doc_id, r.text, r.source)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = collections.Counter(map(key, now.collect()))
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/odd-{n}")
        now = spark.read.parquet(f"{tmp_path}/odd-{n}")
        if name == "token_output":
            assert now.count() == before.total()
            break
        after = collections.Counter(map(key, now.collect()))
        if name == "decontaminate":
            assert after == before
        if name == "minhash_dedup":
            assert set(after) <= set(before) and all(after[k] == c for k, c in before.items() if k[0] is None)
            texts = [t for i, t, _ in before if i is not None]
            seen = [shingles(t) for t in texts]
            alone = [t for t, a in zip(texts, seen) if all(a is b or similarity(a, b) < 0.8 for b in seen if len(a.keys() & b.keys()) > 0.4 * len(a))]
            assert {t for t in alone} <= {t for i, t, _ in after if i is not None}
        if name == "mix_sources":
            goal = {r.source: r.target for r in mixing.sampled(spark.createDataFrame([(*k, None) for k, c in before.items() for _ in range(c)], "doc_id long, text string, source string, x int")).collect()}
            got, longest = collections.Counter(), max(len(t.split()) for _, t, _ in before)
            for (_, t, s), c in after.items():
                assert c <= 3 * before[_, t, s]
                got[s] += c * len(t.split())
            assert all(abs(got[s] - t) <= longest + 1 for s, t in goal.items())


def test_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", COLUMNS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
