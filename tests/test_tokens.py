import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import counts

SAMPLE = "This is a test, test, test, test.\nI am happy. I am very happy!\nThe house is old. The house is very old.\n"
WORDS = {
    "a": (1, 0, 0), "am": (2, 0, 0), "happy": (2, 0, 2), "house": (2, 0, 0), "i": (2, 2, 0), "is": (3, 0, 0), "old": (2, 0, 2),
    "test": (4, 0, 1), "the": (2, 2, 0), "this": (1, 1, 0), "very": (2, 0, 0),
}


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("split", [X.regex_sentence_tokens, X.jdk_sentence_tokens])
def test_golden_counts(spark, split):
    s = split(docs(spark, SAMPLE)).cache()
    assert {r.word: (r.total, r.starts, r.ends) for r in counts.word_counts(s).collect()} == WORDS
    assert {r.n_tokens: r.n_sentences for r in counts.sentence_lengths(s).collect()} == {3: 1, 4: 2, 5: 1, 7: 1}
    pairs = {(r.w1, r.w2): (r.cnt, r.ends) for r in counts.ngram_counts(s, 2).collect()}
    assert len(pairs) == 13 and pairs["test", "test"] == (3, 1) and pairs["house", "is"] == (2, 0) and pairs["am", "happy"] == (1, 1)
    triples = {(r.w1, r.w2, r.w3): (r.cnt, r.ends) for r in counts.ngram_counts(s, 3).collect()}
    assert len(triples) == 11 and triples["test", "test", "test"] == (2, 1) and triples["the", "house", "is"] == (2, 0)


def test_edges_of_tokens(spark):
    cases = {'"Hello,"': "hello", "'tis": "'tis", "--": None, "$3.14!": "3.14", "“Été”": "été", "e-mail": "e-mail", "dogs'": "dogs'", "'": "'", "½": None, "a b": "a b"}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", X.tokens(F.col("c")).alias("t"))
    assert {r.c: (r.t[0] if r.t else None) for r in df.collect()} == cases


def test_jdk_sentences(spark):
    cases = {
        "Mr. Smith went. he said": 2, "e.g. this is": 1, "hi!there you": 2, "x. 1 y": 1, "x. (y) z": 2, "no dots\nnew line": 1,
        "wait... What": 2, "U.S. Army": 2, "a! b": 2,
    }
    got = X.jdk_sentence_tokens(docs(spark, *cases)).groupBy("doc_id").count().collect()
    assert {list(cases)[r.doc_id]: r["count"] for r in got} == cases


def by_iterator(spark, texts):
    """Token lists per sentence by java.text.BreakIterator itself."""
    import re

    import regex

    it = spark._jvm.java.text.BreakIterator.getSentenceInstance(spark._jvm.java.util.Locale.US)
    for text in texts:
        it.setText(text)
        cuts, at = [], it.first()
        while (nxt := it.next()) != -1:
            cuts.append((at, nxt))
            at = nxt
        u = text.encode("utf-16-le")
        sents = [[t for c in re.split(r"[ \t\n\x0b\f\r]+", u[2 * a : 2 * b].decode("utf-16-le", "replace")) if (t := regex.sub(r"^[^\p{L}\p{Nd}']+|[^\p{L}\p{Nd}']+$", "", c).lower())] for a, b in cuts]
        yield [s for s in sents if s]


def by_pattern(spark, texts):
    got = {}
    for r in X.jdk_sentence_tokens(docs(spark, *texts)).collect():
        got.setdefault(r.doc_id, {})[r.sent] = r.toks
    return [[got[i][k] for k in sorted(got[i])] if i in got else [] for i in range(len(texts))]


def test_jdk_sentences_against_the_iterator(spark, sf):
    """Every text of three tables, whole."""
    texts = [r.text for t in ("documents", "benchmark", "conversations") for r in spark.read.parquet(f"{sf}/{t}.parquet").select("text").distinct().collect() if r.text]
    assert len(texts) > 300 and by_pattern(spark, texts) == list(by_iterator(spark, texts))


def test_jdk_sentences_of_random_signs(spark):
    """Texts made of a character of each class of the rules, mostly full stops, spaces and marks."""
    import random

    rnd, some = random.Random(7), "..  !?\")(#-,1aBéÉ\u65e5\u0301\n\t|;:&«»“”’…½\u00a0\u2028\u2029\U0001f600\U00010410\u00ad\uff0e\u3002"
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(1, 40))) for _ in range(2500)]
    assert by_pattern(spark, texts) == list(by_iterator(spark, texts))


def test_jdk_plan_has_no_python(spark):
    plan = X.jdk_sentence_tokens(docs(spark, "a")).toDF("a", "b", "c")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_invariants(spark, sf):
    s = X.regex_sentence_tokens(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    n, tokens, two, three = s.select(F.count("*"), F.sum(F.size("toks")), F.count_if(F.size("toks") >= 2), F.count_if(F.size("toks") >= 3)).first()
    w = counts.word_counts(s).agg(F.sum("total"), F.sum("starts"), F.sum("ends")).first()
    assert tuple(w) == (tokens, n, n)
    b = counts.ngram_counts(s, 2).agg(F.sum("cnt"), F.sum("ends")).first()
    assert tuple(b) == (tokens - n, two)
    assert counts.ngram_counts(s, 3).agg(F.sum("ends")).first()[0] == three


def test_null_and_empty_texts(spark):
    s = X.regex_sentence_tokens(docs(spark, None, "", "   ", "!!! ..."))
    assert s.count() == 0 and counts.word_counts(s).count() == 0
    assert X.jdk_sentence_tokens(docs(spark, None, "", "?!")).count() == 0


def test_small_functions(spark):
    r = spark.range(1).select(X.packed_key(F.lit(3), F.lit(-1)).alias("k"), X.rendered_length(F.lit("")).alias("n"), X.rendered(F.array(F.lit("a"), F.lit(None))).alias("s"), X.seed_words(F.lit("  The  House ")).alias("w")).first()
    assert (r.k, r.n, r.s, r.w) == ((3 << 32) | 0xFFFFFFFF, 1, "a ?", ["the", "house"])
