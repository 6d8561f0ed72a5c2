"""Language identification by compression: the language whose raw-content dictionary compresses a text best.

For each language a zstandard raw-content dictionary is cut from a bounded sample of labelled texts. A text is
encoded, in whole, block by block against every language's dictionary; the language with the fewest bytes wins. A
text is rejected where the runner-up comes within `margin` of the winner, or where there is nothing to go by.

The sample is the only bound: SAMPLE_TEXTS texts a language, those with the smallest MD5 of their id; of texts longer
than SAMPLE_CHARS characters SAMPLE_PIECES pieces, spread evenly from the first to the last character, that make
SAMPLE_CHARS together; texts are taken up in that order while a language's dictionary stays within DICT_BYTES. Every text is classified in whole, in blocks of BLOCK_BYTES, so that
a long text's own history doesn't take the dictionary's place.

Defined cases: text null, empty or without any letter gives `und`, score 0, rejected; so does everything if no
labelled text was given. Ties go to the language first by code point. Null ids are classified but never learned
from; repeated rows each get a row; very long texts only take longer. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_mod, ship, staged, table

SAMPLE_TEXTS = 128
SAMPLE_CHARS, SAMPLE_PIECES = 768, 3
DICT_BYTES = 96 * 1024
#: Ids of the sample up to which it is broadcast.
BROADCAST_IDS = 100_000
BLOCK_BYTES = 4096
LEVEL = 5
#: The runner-up must need so much more than the winner, else the text is rejected.
MARGIN = 0.002
#: Leads below this are measured again, against FINE pieces of each dictionary.
CLOSE, FINE = 0.02, 6
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    """What is encoded: the whole text in lower case, each run of other characters than letters as one space."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def spread(text, chars: int = SAMPLE_CHARS, pieces: int = SAMPLE_PIECES):
    """A column: the whole text if it is short, else pieces from all over it, chars characters in all."""
    each, n = chars // pieces, F.length(text)
    at = lambda i: (F.floor((n - each) * F.lit(i) / F.lit(max(pieces - 1, 1))) + 1).cast("int")
    return F.when(n <= chars, text).otherwise(F.concat_ws(" ", *[F.substring(text, at(i), F.lit(each)) for i in range(pieces)]))


def learned_dictionaries(train: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, most: int = DICT_BYTES) -> dict[str, bytes]:
    """train: (doc_id, text, lang). The languages' dictionaries; what comes to the driver is bounded by the number of
    languages times DICT_BYTES. Ids are picked first, without their texts; the limit per language is applied before
    the shuffle as well as after it."""
    rank = Window.partitionBy("lang").orderBy("h", "doc_id")
    usable = train.filter("lang is not null and text is not null and doc_id is not null")
    ids = usable.select("lang", "doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    picked = staged(ids.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= texts).select("lang", "doc_id", "h").distinct(), "language-sample")
    # The ids are joined, not listed; they are broadcast where they are known to be few.
    few = picked.count() <= BROADCAST_IDS
    some = usable.select("lang", "doc_id", "text").join(F.broadcast(picked) if few else picked, ["lang", "doc_id"])
    samples: dict[str, set[tuple[str, str]]] = {}
    for r in some.select("lang", "h", spread(F.col("text"), chars).alias("text")).toLocalIterator():
        samples.setdefault(r.lang, set()).add((r.h, r.text))
    out = {}
    for lang, rows in sorted(samples.items()):
        parts, size = [], 0
        for part in (folded(t) for _, t in sorted(rows)):
            if size + len(part) + 1 <= most:
                parts.append(part)
                size += len(part) + 1
        out[lang] = b" ".join(parts)
    return out


class Classifier:
    """Encodes texts against each language's dictionary; built once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK_BYTES, level: int = LEVEL):
        import zstandard as z

        dictionaries = {x: d or b" " for x, d in dictionaries.items()}
        self.langs, self.block, self.dictionaries = sorted(dictionaries), block, dictionaries
        self.fine = None
        self.params = params = z.ZstdCompressionParameters.from_level(level, source_size=block, dict_size=DICT_BYTES, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.coders = [z.ZstdCompressor(dict_data=self._dict(z, dictionaries[x], params), compression_params=params) for x in self.langs]

    @staticmethod
    def _dict(z, content: bytes, params):
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return d

    def finer_sizes(self, text: bytes) -> list[int]:
        """For close calls, as sizes are whole bytes: the sum over FINE pieces of each dictionary, and the whole."""
        import zstandard as z

        if self.fine is None:
            pieces = {x: [d[i * len(d) // FINE : (i + 1) * len(d) // FINE] or b" " for i in range(FINE)] for x, d in self.dictionaries.items()}
            self.fine = [[z.ZstdCompressor(dict_data=self._dict(z, p, self.params), compression_params=self.params) for p in pieces[x]] for x in self.langs]
        parts = [text[i : i + self.block] for i in range(0, len(text), self.block)]
        return [a + sum(len(c.compress(p)) for c in coders for p in parts) for a, coders in zip(self.sizes(text), self.fine)]

    def sizes(self, text: bytes) -> list[int]:
        parts = [text[i : i + self.block] for i in range(0, len(text), self.block)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score in [0, 1], margin): score is the winner's lead over the runner-up, scaled so that a lead of
        a fifth or more is 1."""
        import regex

        if not text or not self.langs or not regex.search(r"\p{L}", text):
            return UNKNOWN, 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        data = folded(text)
        for measure in (self.sizes, self.finer_sizes):
            sizes = measure(data)
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min(s for i, s in enumerate(sizes) if i != best)
            margin = (second - sizes[best]) / max(second, 1)
            if margin >= CLOSE:
                break
        return self.langs[best], min(1.0, margin * 5), margin


def identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row of docs: the columns keep, then lang_pred, score, rejected."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(dictionaries)  # bounded: languages times DICT_BYTES
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        import pyarrow as pa

        model = Classifier(held.value)
        for b in batches:
            got = [model.predict(x.as_py()) for x in b.column(len(keep))]
            cols = [b.column(i) for i in range(len(keep))] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[2] < margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs (text among its columns) whose language isn't rejected."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(dictionaries)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        model = Classifier(held.value)
        for b in batches:
            got = [model.predict(x.as_py()) for x in b.column(at)]
            keep = [i for i, g in enumerate(got) if g[0] != UNKNOWN and g[2] >= margin]
            if keep:
                yield b.take(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents whose crc32 of the id is not 2 modulo 4."""
    return docs.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned_dictionaries(training_rows(docs))
    held = docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))
    return identified(held, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
