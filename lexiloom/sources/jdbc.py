"""The model in a relational database: parallel reads with bounds found from the table, and additive writes in one commit.

Counts are first written by Spark, in parallel, to staging tables that have the final tables' keys; then one transaction on
the driver adds them to the final tables and fills ids in, and only its commit changes anything. A partition that is written
twice violates a staging key and fails the write before anything was added. Statements are those every database has."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import counts

ROWS = 1_000_000  # of a partition when a table is read
TRIES = 5
#: The tables and their columns; {text} is the type of words and names.
TABLES = {
    "source_file": "file_id int generated always as identity primary key, file_name {text} not null unique, word_count bigint not null, import_timestamp timestamp default current_timestamp not null",
    "words": "word_id int generated always as identity primary key, word_value {text} not null unique, total_occurrences bigint not null, start_sentence_count bigint not null, end_sequence_count bigint not null",
    "word_pairs": "sequence_id int generated always as identity primary key, preceding_word_id int not null references words(word_id) on delete cascade, following_word_id int not null references words(word_id) on delete cascade, occurrence_count bigint not null, bi_end_frequency bigint not null, unique (preceding_word_id, following_word_id)",
    "trigram_sequence": "sequence_id int generated always as identity primary key, first_word_id int not null references words(word_id) on delete cascade, second_word_id int not null references words(word_id) on delete cascade, third_word_id int not null references words(word_id) on delete cascade, follows_count bigint not null, tri_end_frequency bigint not null, unique (first_word_id, second_word_id, third_word_id)",
}


class Addition(NamedTuple):
    """Rows to be added to a table. df has keys and sums under the table's names; by_word names, for each key that is an id, the
    column of df that has its word instead."""

    table: str
    df: DataFrame
    keys: list[str]
    sums: list[str]
    by_word: dict[str, str] = {}


class Database:
    def __init__(self, spark: SparkSession, url: str, text: str = "varchar(255)", **options: str):
        """options: as of Spark's JDBC source, user, password and driver among them."""
        self.spark, self.url, self.text, self.options = spark, url, text, options

    def _connected(self, work):
        jvm = self.spark._jvm
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        info = jvm.java.util.Properties()
        for k, v in self.options.items():
            info.setProperty(k, v)
        con = jvm.java.sql.DriverManager.getConnection(self.url, info)
        try:
            con.setAutoCommit(False)
            got = work(con)
            con.commit()
            return got
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    def run(self, *statements: str) -> None:
        """All of them or none."""

        def work(con):
            s = con.createStatement()
            for x in statements:
                s.executeUpdate(x)
            s.close()

        self._connected(work)

    def build(self) -> None:
        """The tables that are not there yet."""

        def names(con):
            found, rows = set(), con.getMetaData().getTables(None, None, "%", None)
            while rows.next():
                found.add(rows.getString("TABLE_NAME").lower())
            return found

        there = self._connected(names)
        self.run(*[f"create table {n} ({c.format(text=self.text)})" for n, c in TABLES.items() if n not in there])

    def clear(self) -> None:
        self.run(*[f"delete from {n}" for n in ("trigram_sequence", "word_pairs", "words", "source_file")])

    def _source(self):
        return self.spark.read.format("jdbc").options(url=self.url, **self.options)

    @staticmethod
    def _lower(df: DataFrame) -> DataFrame:
        return df.toDF(*[c.lower() for c in df.columns])  # some databases give names in capitals

    def table(self, name: str, column: str | None = None, rows: int = ROWS) -> DataFrame:
        """A table, read in parts of about `rows` rows by a whole-number column, whose bounds are asked for first."""
        if column is None:
            return self._lower(self._source().option("dbtable", name).load())
        low, high, n = self._source().option("query", f"select min({column}) as lo, max({column}) as hi, count(*) as n from {name}").load().first()
        parts = max(1, min(-(-n // rows), (high or 0) - (low or 0) + 1))
        return self._lower(self._source().options(dbtable=name, partitionColumn=column, lowerBound=low or 0, upperBound=(high or 0) + 1, numPartitions=parts).load())

    def add(self, *additions: Addition) -> None:
        """Adds counts to the tables: sums of known keys grow, new keys come in; all tables in one commit. Additions come in the
        order given, so words go before what refers to them."""
        staging = [f"stage_{uuid.uuid4().hex[:20]}" for _ in additions]
        try:
            for a, s in zip(additions, staging):
                keys = [a.by_word.get(k, k) for k in a.keys]
                kinds = [f"{k} {self.text if a.df.schema[k].dataType.simpleString() == 'string' else 'int'} not null" for k in keys] + [f"{c} bigint not null" for c in a.sums]
                self.run(f"create table {s} ({', '.join(kinds)}, primary key ({', '.join(keys)}))")
                a.df.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in a.sums]).write.format("jdbc").options(url=self.url, dbtable=s, **self.options).mode("append").save()
            statements = [x for a, s in zip(additions, staging) for x in self._adding(a, s)]
            for attempt in range(TRIES):
                try:
                    return self.run(*statements)
                except Py4JJavaError:  # another writer brought the same new keys, or holds them
                    if attempt + 1 == TRIES:
                        raise
        finally:
            for s in staging:
                try:
                    self.run(f"drop table {s}")
                except Py4JJavaError:  # it was not made
                    pass

    @staticmethod
    def _adding(a: Addition, stage: str) -> list[str]:
        words = [f"join words i{n} on i{n}.word_value = s.{w}" for n, w in enumerate(a.by_word.values())]
        at = {k: f"i{n}.word_id" for n, k in enumerate(a.by_word)}
        source = f"{stage} s {' '.join(words)}"
        same = " and ".join(f"{at.get(k, f's.{k}')} = {a.table}.{k}" for k in a.keys)
        grown = ", ".join(f"{c} = {c} + (select s.{c} from {source} where {same})" for c in a.sums)
        new = ", ".join([*[at.get(k, f"s.{k}") for k in a.keys], *[f"s.{c}" for c in a.sums]])
        return [
            f"update {a.table} set {grown} where exists (select 1 from {source} where {same})",
            f"insert into {a.table} ({', '.join([*a.keys, *a.sums])}) select {new} from {source} where not exists (select 1 from {a.table} where {same})",
        ]

    def add_counts(self, suffixes: DataFrame, files: DataFrame | None = None) -> None:
        """What counts.suffix_counts says of texts, staged, and their manifest rows (file_name, word_count), in one commit."""
        words = counts.words_of(suffixes).toDF("word_value", "total_occurrences", "start_sentence_count", "end_sequence_count")
        pairs = counts.bigrams_of(suffixes).withColumnsRenamed({"cnt": "occurrence_count", "ends": "bi_end_frequency"})
        triplets = counts.trigrams_of(suffixes).withColumnsRenamed({"cnt": "follows_count", "ends": "tri_end_frequency"})
        named = [] if files is None else [Addition("source_file", files, ["file_name"], ["word_count"])]
        self.add(
            *named, Addition("words", words, ["word_value"], words.columns[1:]),
            Addition("word_pairs", pairs, ["preceding_word_id", "following_word_id"], ["occurrence_count", "bi_end_frequency"], {"preceding_word_id": "w1", "following_word_id": "w2"}),
            Addition("trigram_sequence", triplets, ["first_word_id", "second_word_id", "third_word_id"], ["follows_count", "tri_end_frequency"], {"first_word_id": "w1", "second_word_id": "w2", "third_word_id": "w3"}),
        )
