import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import counts, generate, lookups, model
from lexiloom.plans.generator import generate_from_ids, generate_sentences, report, top_words
from lexiloom.sources.store import Store
from lexiloom.sources.text_files import documents_as_files, text_files

from .test_tokens import SAMPLE, WORDS


@pytest.fixture(scope="module")
def sample(spark):
    s = X.jdk_sentence_tokens(spark.createDataFrame([(0, SAMPLE)], "doc_id long, text string")).cache()
    return counts.word_counts(s).cache(), counts.ngram_counts(s, 2).cache(), counts.ngram_counts(s, 3).cache()


def walks(df):
    return {r.seed_id: " ".join(r.words) for r in df.collect()}


def test_greedy_walks(spark, sample):
    words, bi, tri = sample
    seeds = spark.createDataFrame([(w, w) for w in ("the", "i", "this", "test", "very")], "seed_id string, w1 string")
    assert walks(generate.bi_greedy(seeds, bi)) == {"the": "the house is a test", "i": "i am happy", "this": "this is a test", "test": "test", "very": "very happy"}
    pairs = [("the", "house"), ("i", "am"), ("a", "test"), ("this", "is")]
    seeds = spark.createDataFrame([(f"{a} {b}", a, b) for a, b in pairs], "seed_id string, w1 string, w2 string")
    want = {"the house": "the house is old", "i am": "i am happy", "a test": "a test", "this is": "this is a test"}
    assert walks(generate.tri_greedy(seeds, tri)) == want
    one = spark.createDataFrame([("s", "the", "house")], "seed_id string, w1 string, w2 string")
    assert walks(generate.tri_greedy(one, tri, most=1)) == {"s": "the house"}
    the = spark.createDataFrame([("s", "the")], "seed_id string, w1 string")
    assert walks(generate.bi_greedy(the, bi, stop="IS")) == {"s": "the house is"}
    assert walks(generate.bi_greedy(the, bi, stop="the", most=3)) == {"s": "the house is"}


def test_weighted_walks(spark, sf):
    s = X.regex_sentence_tokens(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    words, bi, tri = counts.word_counts(s), counts.ngram_counts(s, 2).cache(), counts.ngram_counts(s, 3).cache()
    seeds = generate.start_rows(words).orderBy("seed_id").limit(40)
    known = {(r.w1, r.w2) for r in bi.select("w1", "w2").collect()}
    got = walks(generate.bi_weighted(seeds, bi, run="x"))
    for w in (v.split(" ") for v in got.values()):
        assert len(w) <= 20 and len(set(w)) == len(w) and all(p in known for p in zip(w, w[1:]))
    assert got == walks(generate.bi_weighted(seeds, bi, run="x")) != walks(generate.bi_weighted(seeds, bi, run="y"))
    triples = {(r.w1, r.w2, r.w3) for r in tri.select("w1", "w2", "w3").collect()}
    for w in (v.split(" ") for v in walks(generate.tri_weighted(generate.start_rows(words, tri).orderBy("seed_id").limit(40), tri)).values()):
        t = list(zip(w, w[1:], w[2:]))
        assert all(x in triples and x[2] != x[1] and x[2] != x[0] for x in t) and len(set(t)) == len(t)


def test_names_of_algorithms():
    assert generate.algorithm("bi-greedy") is generate.bi_greedy and generate.algorithm("TRI_WEIGHTED") is generate.tri_weighted
    assert generate.algorithm("greedy") is generate.tri_greedy and generate.algorithm(None) is generate.tri_greedy


def test_dictionary_is_dense_and_extends(spark, sample):
    d = model.dictionary(sample[0])
    assert [(r.word_id, r.word_value) for r in d.orderBy("word_id").collect()] == list(enumerate(sorted(WORDS), 1))
    more = spark.createDataFrame([("zeta", 1, 0, 0), ("the", 1, 0, 0), ("beta", 1, 0, 0)], "word string, total long, starts long, ends long")
    got = {r.word_value: r.word_id for r in model.extended_dictionary(d, more).collect()}
    assert got["beta"] == 12 and got["zeta"] == 13 and got["the"] == sorted(WORDS).index("the") + 1


def test_lookups(spark, sample):
    d = model.dictionary(sample[0])
    assert lookups.word_id(d, "nothing").first().word_id == -1
    assert lookups.by_value(d, "test").first().total_occurrences == 4
    assert lookups.by_id(d, 1).first().word_value == "a"
    pos = spark.createDataFrame([(0, 0, "nope"), (0, 1, "is"), (0, 2, "the")], "seed_id int, pos int, word string")
    assert lookups.first_known(pos, d).first().word == "is"
    ids = lookups.topped_up(pos, d, 4).first().ids.split(" ")
    names = {r.word_id: r.word_value for r in d.collect()}
    assert [names[int(i)] for i in ids] == ["is", "the", "i", "this"]


def test_merge_equals_build(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    part = lambda k: counts.ngram_counts(X.regex_sentence_tokens(docs.filter(F.pmod("doc_id", F.lit(2)) == k)), 2)
    whole = counts.ngram_counts(X.regex_sentence_tokens(docs), 2)
    both = counts.merged(part(0), part(1), ["w1", "w2"])
    assert both.exceptAll(whole).count() == 0 and whole.exceptAll(both).count() == 0


def test_store(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("I am happy. I am very happy!\n", encoding="utf-8")
    (tmp_path / "in/sub/b.TXT").write_text("The house is old.\n", encoding="utf-8")
    (tmp_path / "in/c.md").write_text("not read", encoding="utf-8")
    files = text_files(spark, str(tmp_path / "in"))
    assert [r.file_name for r in files.collect()] == ["a.txt", "b.TXT"]
    assert text_files(spark, str(tmp_path / "missing")).count() == 0
    store = Store(spark, str(tmp_path / "store"))
    store.build()
    assert store.import_files(files) == 2 and store.import_files(files) == 0
    (tmp_path / "in/d.txt").write_text("The house is very old.", encoding="utf-8")
    assert store.import_files(text_files(spark, str(tmp_path / "in"))) == 1
    assert {r["table"]: (r.rows, r.total) for r in report(store).collect()}["words"] == (8, 16)
    assert [r.file_id for r in store.history().collect()][0] == 3
    assert store.word_pairs().agg(F.sum("occurrence_count")).first()[0] == 12
    assert store.trigram_sequence().agg(F.sum("follows_count")).first()[0] == 8
    assert top_words(store, 1).first().total == 2
    got = [r.sentence for r in generate_sentences(store, "bi_greedy", ["nope the house", "i"]).orderBy("seed_id").collect()]
    assert got == ["the house is old", "i am happy"]
    assert generate_sentences(store, "tri-greedy", ["the house"]).first().sentence.startswith("the house is")
    assert generate_sentences(store, "bi_weighted").first().n_words >= 1
    ids = {r.word_value: r.word_id for r in store.table("words").collect()}
    assert generate_from_ids(store, "bi_greedy", [ids["i"]]).first().sentence == "i am happy"
    assert generate_from_ids(store, "bi_greedy", [999]).first().sentence == "?"
    store.clear()
    assert store.table("words").count() == 0
    assert generate_sentences(store, "tri_greedy", ["the"]).first().sentence == ""


def test_words_only_import_can_be_completed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.build()
    f = documents_as_files(spark.createDataFrame([(1, "A b c. D e.")], "doc_id long, text string"))
    assert store.import_files(f, words_only=True) == 1
    assert store.table("bigrams").count() == 0 and store.table("words").count() == 5
    assert store.import_files(f) == 0
    assert store.table("bigrams").agg(F.sum("cnt")).first()[0] == 3 and store.table("words").agg(F.sum("total_occurrences")).first()[0] == 5
    assert store.import_files(f) == 0 and store.table("bigrams").agg(F.sum("cnt")).first()[0] == 3


def test_streaming_import(spark, tmp_path):
    from lexiloom.streaming.ingest import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("One two. Three.", encoding="utf-8")
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        q = follow(spark, str(tmp_path / "in"), store, str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert store.table("words").count() == 3
    (tmp_path / "in/b.txt").write_text("Two.", encoding="utf-8")
    follow(spark, str(tmp_path / "in"), store, str(tmp_path / "ck")).awaitTermination(120)
    assert {r.word: r.total for r in store.words().collect()} == {"one": 1, "two": 2, "three": 1}
