"""Imports: files of one name, imports at the same time, what an import writes, and how deltas are merged."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import lookups
from lexiloom.plans.generator import report
from lexiloom.sources import store as S
from lexiloom.sources.text_files import listed, text_files, upload


@pytest.fixture
def store(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "store"))
    s.build()
    return s


def put(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.with_suffix(".txt").write_text(text, encoding="utf-8")


def totals(store):
    return {r.word: r.total for r in store.words().collect()}


def test_one_name_in_two_folders(spark, tmp_path, store):
    put(tmp_path / "in", a__x="One aa.", b__x="Two bb.")
    files = text_files(spark, str(tmp_path / "in"))
    assert store.import_files(files) == 2 and store.import_files(files) == 0
    assert totals(store) == {"one": 1, "aa": 1, "two": 1, "bb": 1}
    assert store.import_files(files.unionByName(files)) == 0
    put(tmp_path / "in", a__x="One aa cc.")  # another text is another file
    assert store.import_files(text_files(spark, str(tmp_path / "in"))) == 1 and totals(store)["one"] == 2
    assert [r.path.rsplit("/", 2)[1] for r in listed(spark, str(tmp_path / "in")).collect()] == ["a", "b"]
    assert listed(spark, str(tmp_path / "none")).count() == 0
    plan = text_files(spark, str(tmp_path / "in"))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_repeated_rows_and_null_texts(spark, store):
    files = spark.createDataFrame([("a", "One."), ("a", "One."), ("a", "Two."), ("b", None)], "file_name string, text string")
    assert store.import_files(files) == 3 and totals(store) == {"one": 1, "two": 1}
    assert store.table("source_file").count() == 3
    assert sorted(r.file_id for r in store.table("source_file").collect()) == [1, 2, 3]
    assert lookups.new_files(files, store.table("source_file")).count() == 0
    assert lookups.new_files(files, files.limit(0)).count() == 3


def test_imports_at_the_same_time(spark, store, monkeypatch):
    """Both start from the same version: the second to come finds its number taken, and imports on top of the first."""
    both, publish, taken = threading.Barrier(2, timeout=300), S.Store._publish, []

    def meeting(self, number, named):
        if not getattr(seen, "done", False):
            seen.done = True
            both.wait()
        ok = publish(self, number, named)
        taken.append(ok)
        return ok

    seen = threading.local()
    monkeypatch.setattr(S.Store, "_publish", meeting)
    frames = [spark.createDataFrame([(f"f{i}", f"Shared word. Own{i} here.")], "file_name string, text string") for i in (1, 2)]
    got = [0, 0]

    def run(i):
        got[i] = store.import_files(frames[i])

    threads = [threading.Thread(target=run, args=(i,)) for i in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert got == [1, 1] and sorted(taken) == [False, True, True]
    assert totals(store) == {"shared": 2, "word": 2, "own1": 1, "own2": 1, "here": 2}
    ids = [r.word_id for r in store.table("words").collect()]
    assert sorted(ids) == list(range(1, 6)) and sorted(r.file_id for r in store.history().collect()) == [1, 2]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_what_an_import_writes_follows_the_import(spark, sf, store):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_name"), "text")
    store.import_files(files)
    before = size(store.path)
    store.import_files(spark.createDataFrame([("one", "A few words. Only a few.")], "file_name string, text string"))
    assert size(store.path) - before < 0.1 * before


def test_deltas_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    for i in range(5):
        assert store.import_files(spark.createDataFrame([(f"f{i}", f"Same words. Own{i}.")], "file_name string, text string")) == 1
    named = store._now()[1]
    assert sorted(level for _, level in named["bigrams"]) == [0, 0, 1]
    assert totals(store)["same"] == 5 and store.table("bigrams").filter("w1 = 'same'").first().cnt == 5
    there = {f for f in os.listdir(f"{store.path}/data") if f.startswith("bigrams")}
    assert {f.split("/")[1] for f, _ in named["bigrams"]} <= there
    store.clear()
    assert {r["rows"] for r in report(store).collect()} == {0} and store.import_files(spark.createDataFrame([("f0", "Same.")], "file_name string, text string")) == 1


def test_uploads(spark, tmp_path):
    folder = str(tmp_path / "a%25 b")  # a plain path is not a URI
    files = spark.createDataFrame([("x.txt", "old"), ("x.txt", "older"), ("in/y.TXT", None)], "file_name string, text string")
    assert sum(r.bytes for r in upload(files, folder).collect()) == 5
    assert (tmp_path / "a%25 b/x.txt").read_text() == "older" and (tmp_path / "a%25 b/in/y.TXT").read_text() == ""


def test_data_without_a_version(spark, tmp_path):
    (tmp_path / "s/data").mkdir(parents=True)
    with pytest.raises(ValueError):
        S.Store(spark, str(tmp_path / "s")).build()
    with pytest.raises(ValueError):
        S.Store(spark, str(tmp_path / "t")).table("words")


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path / "in", a="The house is old. The house is very old.", b="I am happy.")
    at = ["--store", str(tmp_path / "s")]
    cli.main(["import", str(tmp_path / "in"), *at])
    assert "2 new files" in capsys.readouterr().out
    cli.main(["import", str(tmp_path / "in"), "--words-only", *at])
    assert "0 new files" in capsys.readouterr().out
    cli.main(["generate", "--algo", "bi-greedy", "--seed", "I", "--stop", "am", *at])
    assert capsys.readouterr().out == "i am (2)\n"
    cli.main(["generate", "--seed", "the house", "--max", "3", *at])
    assert capsys.readouterr().out == "the house is (3)\n"
    cli.main(["generate", "--algo", "bi_weighted", "--run", "it's", *at])
    assert capsys.readouterr().out.count("\n") == 1
    cli.main(["history", *at])
    assert "a.txt" in capsys.readouterr().out
    cli.main(["tokens", str(tmp_path / "in"), "-k", "1"])
    out = capsys.readouterr().out
    assert "12" in out and "house" in out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_texts_are_looked_up_only_where_some_are_known(spark, store, monkeypatch):
    """Where all files are new their texts meet no join, however many they are; triplets are written once, as counts of suffixes."""
    frame, met = type(spark.range(0)), []
    monkeypatch.setattr(frame, "join", lambda self, other, *a, f=frame.join, **b: met.append("text" in self.columns) or f(self, other, *a, **b))
    monkeypatch.setattr(S, "BROADCAST_FILES", 0)
    rows = [("a", "One two three."), ("b", "One two three four.")]
    assert store.import_files(spark.createDataFrame(rows, "file_name string, text string")) == 2 and not any(met)
    assert store.import_files(spark.createDataFrame([*rows, ("c", "Two three four. End.")], "file_name string, text string")) == 1 and any(met)
    assert {(r.w1, r.w2, r.w3): (r.cnt, r.ends) for r in store.table("trigrams").collect()} == {("one", "two", "three"): (2, 1), ("two", "three", "four"): (2, 2)}
    assert store.table("trigrams").columns == ["w1", "w2", "w3", "cnt", "ends"] and totals(store)["end"] == 1


def test_pairs_and_triplets_are_one_delta(spark, store):
    """An import writes what pairs and triplets are sums of once; deltas of a store that kept both apart count too."""
    files = lambda *rows: spark.createDataFrame(list(rows), "file_name string, text string")
    assert store.import_files(files(("a", "One two three. One two. Two."), ("b", "One two three four."))) == 2
    assert len({f.rsplit("-", 1)[0] for f in os.listdir(f"{store.path}/data")} & {"bigrams", "trigrams"}) == 0
    number, named = store._now()
    old = {"bigrams": spark.createDataFrame([("one", "two", 5, 1), ("x", "y", 1, 1)], S.SCHEMAS["bigrams"]), "trigrams": spark.createDataFrame([("one", "two", "three", 2, 1)], S.SCHEMAS["trigrams"])}
    assert store._publish(number + 1, {t: named[t] + ([store._write(old[t], t)] if t in old else []) for t in S.SCHEMAS})
    assert store.import_files(files(("c", "Two three."))) == 1
    assert {(r.w1, r.w2): (r.cnt, r.ends) for r in store.table("bigrams").collect()} == {("one", "two"): (8, 2), ("two", "three"): (3, 2), ("three", "four"): (1, 1), ("x", "y"): (1, 1)}
    assert {(r.w1, r.w2, r.w3): (r.cnt, r.ends) for r in store.table("trigrams").collect()} == {("one", "two", "three"): (4, 2), ("two", "three", "four"): (1, 1)}
    assert {(r["table"], r["rows"], r["total"]) for r in report(store).collect()} >= {("bigrams", 4, 13), ("trigrams", 2, 5)}
