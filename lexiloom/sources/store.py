"""The model's tables as sums of deltas: Parquet folders that are only ever added, and numbered version files that name them.

An import writes what it adds, so its bytes follow the import and not the store; counts of equal keys add up on reading. Once
FAN deltas of a level are there they become one of the next, so a row is rewritten a few times at most. A version is one
small file, which can be made only once: who comes second with a number reads the other's version and imports again on top of
it, so imports at the same time both count, and a failed one leaves nothing."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import jdk_sentence_tokens
from lexiloom.operators import counts, lookups, model
from lexiloom.schema import SOURCE_FILE
from lexiloom.sources.scratch import ROW_GROUP_BYTES, staged, write_sorted
from lexiloom.sources.text_files import spread

#: Counts are stored by word, ids beside them; id-keyed tables are made from these on reading.
SCHEMAS = {
    "source_file": SOURCE_FILE.simpleString()[7:-1].replace(":", " ") + ", path string, digest string",
    "ids": "word_id int, word_value string",
    "counts": "word_value string, total_occurrences bigint, start_sentence_count bigint, end_sequence_count bigint",
    "bigrams": "w1 string, w2 string, cnt bigint, ends bigint",
    "trigrams": "w1 string, w2 string, w3 string, cnt bigint, ends bigint",
    "words_only": "path string, digest string, cnt bigint",  # files whose n-grams are still to be counted: sums above 0
}
#: What adds up, by its key; the other tables' rows are there once.
KEYS = {"counts": ["word_value"], "bigrams": ["w1", "w2"], "trigrams": ["w1", "w2", "w3"], "words_only": ["path", "digest"]}
#: Tables in which single words are looked up.
SORTED = {"ids": "word_value", "counts": "word_value"}
#: Folders that are deltas of both pairs and triplets: counts of suffixes, of which both are sums, sorted by first word.
SUFFIXES = "bigrams-trigrams"
SUFFIX_SCHEMA = "w1 string, w2 string, w3 string, cnt bigint, starts bigint, ends bigint"
FAN = 8
TRIES = 20
#: Files up to which their names and digests are broadcast to find their texts.
BROADCAST_FILES = 100_000


def _added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._file("versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self) -> int | None:
        return max(self._numbers(), default=None)

    def _named(self, number: int) -> dict[str, list]:
        """Each table's deltas as [folder, level]."""
        return json.loads(self.spark.read.text(str(self._file(f"versions/{number}")[1]), wholetext=True).first()[0])

    def _now(self) -> tuple[int, dict[str, list]]:
        if (v := self.version()) is None:
            raise ValueError("the store has not been built")
        return v, self._named(v)

    def build(self) -> None:
        """Empty tables, if there are none. Data without a version is no empty store, and is left alone."""
        if self.version() is None:
            fs, p = self._file("data")
            if fs.exists(p):
                raise ValueError(f"{self.path} has data but no version that names it")
            self._publish(1, {n: [] for n in SCHEMAS})

    def clear(self) -> None:
        for _ in range(TRIES):
            if self._publish((self.version() or 0) + 1, {n: [] for n in SCHEMAS}):
                return
        raise RuntimeError("the store changes too often")

    def _publish(self, number: int, named: dict[str, list]) -> bool:
        """Makes a version of that number, in one step; False if there is one. What the version before the last replaced goes."""
        jvm = self.spark._jvm
        fs, p = self._file(f"versions/{number}")
        _, tmp = self._file(f"tmp-{uuid.uuid4().hex}")
        fs.mkdirs(p.getParent())
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(named).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # where a rename would replace, a link doesn't
                place = lambda x: jvm.java.nio.file.Paths.get(x.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(place(p), place(tmp))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(tmp, False)
        if {number - 1, number - 2} <= set(self._numbers()):
            folders = lambda v: {f for deltas in v.values() for f, _ in deltas}
            for f in folders(self._named(number - 2)) - folders(self._named(number - 1)) - folders(named):
                fs.delete(self._file(f)[1], True)
        return True

    def _write(self, df: DataFrame, name: str, level: int = 0) -> list:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        if name in SORTED:
            write_sorted(df, f"{self.path}/{folder}", SORTED[name])
        elif name == SUFFIXES:  # so that n-grams of a few first words lie in few row groups
            df.sortWithinPartitions("w1").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/{folder}")
        else:
            df.write.parquet(f"{self.path}/{folder}")
        return [folder, level]

    def _read(self, schema: str, deltas: list) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f, _ in deltas])

    def _rows(self, name: str, deltas: list) -> DataFrame:
        """What is to be summed up."""
        if not deltas:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name != "bigrams":
            rows = self._read(SCHEMAS[name], deltas)
            return rows.filter("w3 is not null") if name == "trigrams" else rows  # suffixes have those of fewer words too
        both = [d for d in deltas if SUFFIXES in d[0]]
        rows = [self._read(SCHEMAS[name], own)] if (own := [d for d in deltas if d not in both]) else []
        if both:
            ends = F.when(F.col("w3").isNull(), F.col("cnt")).otherwise(F.lit(0).cast("bigint")).alias("ends")
            rows.append(self._read(SCHEMAS["trigrams"], both).filter("w2 is not null").select("w1", "w2", "cnt", ends))
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def _sum(self, name: str, deltas: list) -> DataFrame:
        rows = self._rows(name, deltas)
        if name not in KEYS or not deltas or len(deltas) == 1 and (name != "bigrams" or SUFFIXES not in deltas[0][0]):
            return rows
        return _added_up(rows, KEYS[name])

    def _merged(self, name: str, deltas: list, done: dict[str, list]) -> list:
        """FAN deltas of one level become one of the next; done: what those of pairs and triplets together became, by their names."""
        for kind in (True, False):
            for level in range(max((k for _, k in deltas), default=-1) + 1):
                same = [d for d in deltas if d[1] == level and (SUFFIXES in d[0]) == kind]
                if len(same) < FAN:
                    continue
                one = done.get(str(same)) if kind else self._write(self._sum(name, same), name, level + 1)
                if one is None:
                    one = done[str(same)] = self._write(_added_up(self._read(SUFFIX_SCHEMA, same), ["w1", "w2", "w3"]), SUFFIXES, level + 1)
                deltas = [d for d in deltas if d not in same] + [one]
        return deltas

    def table(self, name: str) -> DataFrame:
        """words (with ids), or one of SCHEMAS."""
        named = self._now()[1]
        if name == "words":
            return self._sum("ids", named["ids"]).join(self._sum("counts", named["counts"]), "word_value").select("word_id", *SCHEMAS["counts"].replace(" string", "").replace(" bigint", "").split(", "))
        return self._sum(name, named[name])

    def rows(self, name: str) -> DataFrame:
        """As table, but with a row for each delta that has it: for what repeated rows don't change."""
        return self._rows(name, self._now()[1][name])

    def gram_totals(self) -> DataFrame:
        """pairs, pair_total, triplets, triplet_total: how many there are, and the sums of their counts. Deltas are dealt by pairs, once,
        and both orders are counted there."""
        named = self._now()[1]
        pairs = self._rows("bigrams", [d for d in named["bigrams"] if SUFFIXES not in d[0]])
        none = F.lit(None).cast("string")
        if both := [d for d in named["bigrams"] if SUFFIXES in d[0]]:
            pairs = pairs.select("w1", "w2", none.alias("w3"), "cnt", F.lit(True).alias("p"), F.lit(False).alias("t"))
            pairs = pairs.unionByName(self._read(SCHEMAS["trigrams"], both).filter("w2 is not null").select("w1", "w2", "w3", "cnt", F.lit(True).alias("p"), F.col("w3").isNotNull().alias("t")))
        else:
            pairs = pairs.select("w1", "w2", none.alias("w3"), "cnt", F.lit(True).alias("p"), F.lit(False).alias("t"))
        if own := [d for d in named["trigrams"] if SUFFIXES not in d[0]]:
            pairs = pairs.unionByName(self._rows("trigrams", own).select("w1", "w2", "w3", "cnt", F.lit(False).alias("p"), F.lit(True).alias("t")))
        of = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("cnt"))), F.lit(0)).cast("bigint")
        one = pairs.repartition("w1", "w2").groupBy("w1", "w2", "w3").agg(F.max("p").alias("p"), F.max("t").alias("t"), of("p").alias("pc"), of("t").alias("tc"))
        two = one.groupBy("w1", "w2").agg(F.max("p").cast("int").alias("p"), F.count_if("t").alias("t"), F.sum("pc").alias("pc"), F.sum("tc").alias("tc"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return two.agg(total("p").alias("pairs"), total("pc").alias("pair_total"), total("t").alias("triplets"), total("tc").alias("triplet_total"))

    def import_files(self, files: DataFrame, words_only: bool = False, split=jdk_sentence_tokens) -> int:
        """files (file_name, text[, path]); path is the file's name if not given. Adds the files that the manifest lacks, by
        path and digest of the text; returns how many. A file that came as words only gets its n-grams when it comes again
        without that."""
        for _ in range(TRIES):
            number, named = self._now()
            n, added = self._imported(named, lookups.identified(files), words_only, split)
            if not added:
                return n
            done: dict[str, list] = {}
            if self._publish(number + 1, {t: self._merged(t, named[t] + added.get(t, []), done) for t in SCHEMAS}):
                return n
            for deltas in added.values():
                for f, _ in deltas:
                    fs, p = self._file(f)
                    fs.delete(p, True)
        raise RuntimeError("the store changes too often")

    def _imported(self, named: dict, files: DataFrame, words_only: bool, split) -> tuple[int, dict[str, list]]:
        """(files that are new, deltas). Only names and digests are compared and sorted, never texts."""
        key = ["path", "digest"]
        # One row a file, whatever repeats.
        given = staged(files.groupBy(*key).agg(F.min("file_name").alias("file_name"), F.count("*").alias("times")), "given")
        fresh = staged(given.join(self._sum("source_file", named["source_file"]).select(*key), key, "left_anti"), "fresh")
        waiting = self._sum("words_only", named["words_only"]).filter("cnt > 0") if not words_only and named["words_only"] else None
        late = staged(given.join(waiting.select(*key), key, "left_semi"), "late") if waiting is not None else None
        n = fresh.count()
        if not n and (late is None or late.isEmpty()):
            return 0, {}
        out = {}

        def suffixes(keys: DataFrame, name: str):
            """(sentences, counts of suffixes, their delta): of the triplets, unless only words are wanted."""
            texts, count = spread(files), keys.count()
            if count < given.count():  # else all of them are wanted, and no text is looked up
                texts = texts.join(F.broadcast(keys.select(*key)) if count <= BROADCAST_FILES else keys.select(*key), key, "left_semi")
            if keys.filter("times > 1").take(1):
                texts = texts.dropDuplicates(key)
            texts = texts.select(F.concat("digest", "path").alias("file"), "text")
            sents = staged(split(texts, "file", "text"), name)
            every = counts.suffix_counts(sents)
            if words_only:
                return sents, staged(every, f"{name}-counts"), None
            delta = self._write(every, SUFFIXES)
            return sents, self.spark.read.schema(every.schema).parquet(f"{self.path}/{delta[0]}"), delta

        grams = []
        if n:
            sents, every, delta = suffixes(fresh, "sentences")
            grams.append(delta)
            words = staged(counts.words_of(every), "words")
            out["counts"] = [self._write(words.toDF("word_value", "total_occurrences", "start_sentence_count", "end_sequence_count"), "counts")]
            ids = self._sum("ids", named["ids"])
            top = ids.agg(F.coalesce(F.max("word_id"), F.lit(0)).alias("top"))  # one row
            new = model.dictionary(words.join(ids.select(F.col("word_value").alias("word")), "word", "left_anti"))
            out["ids"] = [self._write(new.crossJoin(F.broadcast(top)).select((F.col("word_id") + F.col("top")).cast("int").alias("word_id"), "word_value"), "ids")]
            out["source_file"] = [self._write(self._numbered(named, fresh, sents), "source_file")]
            if words_only:
                out["words_only"] = [self._write(fresh.select(*key, F.lit(1).cast("bigint").alias("cnt")), "words_only")]
        if late is not None and not late.isEmpty():
            grams.append(suffixes(late, "late-sentences")[2])
            out["words_only"] = [self._write(late.select(*key, F.lit(-1).cast("bigint").alias("cnt")), "words_only")]
        if not words_only:
            out["bigrams"], out["trigrams"] = list(grams), list(grams)
        return n, out

    def _numbered(self, named: dict, fresh: DataFrame, sents: DataFrame) -> DataFrame:
        """Manifest rows of new files, numbered in the order of their paths, in blocks as words are."""
        top = self._sum("source_file", named["source_file"]).agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))  # one row
        sizes = sents.groupBy("file").agg(F.sum(F.size("toks")).cast("bigint").alias("word_count"))
        rows = fresh.select("file_name", "path", "digest", F.concat("path", "digest").alias("word"), F.concat("digest", "path").alias("file"), F.lit(1).alias("one"))
        rows = model.ordered_blocks(rows, "one", "one", prefix=8).join(sizes, "file", "left").crossJoin(F.broadcast(top))
        return rows.select(
            (F.col("nth") + F.col("top")).cast("int").alias("file_id"), "file_name", F.coalesce("word_count", F.lit(0)).cast("bigint").alias("word_count"),
            F.current_timestamp().alias("import_timestamp"), "path", "digest",
        )

    def history(self) -> DataFrame:
        """The manifest, latest import first."""
        return self.table("source_file").orderBy(F.col("import_timestamp").desc(), "file_id")

    def word_pairs(self) -> DataFrame:
        return model.word_pairs(self.table("bigrams"), self.table("words"))

    def trigram_sequence(self) -> DataFrame:
        return model.trigram_sequence(self.table("trigrams"), self.table("words"))

    def words(self) -> DataFrame:
        """word, total, starts, ends."""
        return self.table("counts").toDF("word", "total", "starts", "ends")
