"""Token-ID output: texts to ids of a public tokenizer, written as range-coded shards in the order of the document ids.

Documents are dealt by range of doc_id, so shard k holds smaller ids than shard k + 1, and a task writes its range as
one shard: blocks of BLOCK ids of `range_coder`, each followed by the index of the documents that end in it. Shards
are named by a fresh token; the manifest that Spark commits says which ones count, so repeated tasks do no harm.
Reading yields every document's ids, or a digest of them.

A text's ids are those of the tokenizers library for the whole text. The tokenizer here drops white space before it
splits, so a text's ids are the ids of its parts between ASCII white space (and before a closing mark), one after
another; parts are looked up in a per-worker table, by their hash and then byte for byte, and new ones go through the
library. `by_words=False` turns that off for tokenizers without the property: then each text goes through the library
as a whole. The tokenizer's file is named on the driver and opened by the workers, so it must lie at the same path there.

Defined cases: null and empty texts have the end id alone; null ids come first; rows that repeat an id are documents
one after another, ordered by a hash of the text; very long texts span blocks; an empty table gives no shard and no
row; other columns are ignored.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import filesystem, parts_for, scratch_path, ship, staged, table, trim

END_ID = 2
BLOCK = 1 << 21
#: Texts are cut into parts of so many bytes together at a time; a worker holds some thirty times that meanwhile.
BATCH_BYTES = 4 << 20
#: Words a worker keeps with their ids.
KEPT_WORDS = 2_000_000
#: Texts that go through the library at a time.
CALL = 4096
MAGIC = b"LXTOKEN1"
INDEX = struct.Struct("<II")


def split_marks(data, s, e):
    """Words that end in a letter and one of .,;:!? become two; the tokenizer splits there too, as no part of its
    pattern spans a letter and such a mark. Letters here are ASCII ones and the Latin ones of two bytes, but for U+0130,
    whose lower case ends in a combining dot, which goes with the mark."""
    import numpy as np

    size = e - s
    at = np.flatnonzero((size >= 2) & np.isin(data[e - 1], np.frombuffer(b".,;:!?", np.uint8)))
    if not len(at):
        return s, e
    one = data[e[at] - 2]
    ascii_letter = ((one | 32) >= 97) & ((one | 32) <= 122)
    two = data[np.maximum(e[at] - 3, 0)]
    latin = (size[at] >= 3) & (two >= 0xC3) & (two <= 0xC9) & (one >= 0x80) & (one < 0xC0) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ~((two == 0xC4) & (one == 0xB0))
    at = at[ascii_letter | latin]
    stop = e.copy()
    stop[at] -= 1
    return np.insert(s, at + 1, e[at] - 1), np.insert(stop, at + 1, e[at])


def same_words(a, at_a, size_a, b, at_b, size_b) -> bool:
    """Whether all words of a (at, size) equal those of b, byte for byte; both buffers end in eight spare bytes."""
    import numpy as np

    if not np.array_equal(size_a, size_b):
        return False
    left, right = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (a, b))  # eight bytes from each place on
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    size = size_a
    while len(size):
        if ((left[at_a] ^ right[at_b]) & masks[np.minimum(size, 8)]).any():
            return False
        on = np.flatnonzero(size > 8)
        at_a, at_b, size = at_a[on] + 8, at_b[on] + 8, size[on] - 8
    return True


class WordTokenizer:
    """ids of many texts at once, by way of a table of words."""

    def __init__(self, path: str, by_words: bool = True, keep: int = KEPT_WORDS):
        import os

        import numpy as np
        from tokenizers import Tokenizer

        from lexiloom.llm import textvec as tv

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; waiting threads cost time
        self.tok, self.by_words, self.keep = Tokenizer.from_file(path), by_words, keep
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        # A special string, cut out of a text before anything else is done to it, parts the words of one call.
        special = [(i, t.content) for i, t in sorted(self.tok.get_added_tokens_decoder().items()) if not t.normalized and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = special[0] if special else (None, None)
        self.exact, self.folded = tv.spaced(lower=False), tv.spaced()
        self._forget(np)

    def _forget(self, np):
        self.words, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.text, self.size = np.zeros(8, np.uint8), np.zeros(0, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _library_words(self, np, words: list[bytes]):
        """(ids, how many each word has) of words, many of them in a text."""
        if self.mark is None or b"<|" in b" ".join(words):
            got = self.library([w.decode("utf-8", "replace") for w in words])
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        mark = self.mark.encode()
        joined = [mark.join(words[i : i + 64]).decode("utf-8", "replace") for i in range(0, len(words), 64)]
        flat = np.concatenate([np.array([*x, self.mark_id], np.uint32) for x in self.library(joined)])
        ends = np.flatnonzero(flat == self.mark_id)
        if len(ends) != len(words):
            raise ValueError("the tokenizer gave more special ids than its text had")
        return flat[flat != self.mark_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, np, new, data, s, e):
        """Adds words (their hashes, and where they stand in data)."""
        if len(self.words) + len(new) > self.keep:
            self._forget(np)
        ids, counts = [], []
        for i in range(0, len(new), CALL):
            got, n = self._library_words(np, [data[a:b].tobytes() for a, b in zip(s[i : i + CALL].tolist(), e[i : i + CALL].tolist())])
            ids.append(got)
            counts.append(n)
        count = np.concatenate(counts)
        start = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, *ids])
        size = e - s
        at = len(self.text) - 8 + np.cumsum(size) - size
        own = data[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)]
        self.text = np.concatenate([self.text[:-8], own, np.zeros(8, np.uint8)])
        order = np.argsort(new, kind="stable")
        to = np.searchsorted(self.words, new[order])
        self.words = np.insert(self.words, to, new[order])
        for name, value in (("start", start), ("count", count), ("at", at), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), to, value[order].astype(getattr(self, name).dtype)))

    def encode(self, texts, end: int | None = None):
        """(ids, counts): of an Arrow array of strings; counts per text, with the end id."""
        import numpy as np
        import pandas as pd

        from lexiloom.llm import textvec as tv

        tail = [] if end is None else [end]

        def whole():
            got = [x + tail for x in self.library([t or "" for t in texts.to_pylist()])]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

        if not self.by_words:
            return whole()
        data, offs = tv.buffers(texts)
        # Case is folded by the tokenizer, but not in its special strings, which begin with <.
        alphabet = self.exact if (data == 60).any() else self.folded
        data = np.concatenate([data if alphabet is self.exact else tv.FOLD[data], np.zeros(8, np.uint8)])
        hs, ss, es, firsts, base = [], [], [], [np.zeros(1, np.int64)], 0
        for i, j in tv.blocks(offs):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, e, _ = tv.words(part, o, alphabet)
            s, e = split_marks(part, s, e)
            first = np.searchsorted(s, o)
            hs.append(tv.word_hashes(part, s, e, alphabet))
            ss.append(s + offs[i])
            es.append(e + offs[i])
            firsts.append(first[1:] + base)
            base += len(s)
        h, s, e, first = np.concatenate(hs), np.concatenate(ss), np.concatenate(es), np.concatenate(firsts)
        code, uniq = pd.factorize(h)
        uniq = np.asarray(uniq, np.uint64)
        where = np.empty(len(uniq), np.int64)
        where[code] = np.arange(len(h))
        known = np.searchsorted(self.words, uniq)
        missing = np.flatnonzero(self.words[np.minimum(known, max(len(self.words) - 1, 0))] != uniq) if len(self.words) else np.arange(len(uniq))
        if len(missing):
            before = len(self.words)
            self._learn(np, uniq[missing], data, s[where[missing]], e[where[missing]])
            if len(self.words) < before + len(missing):  # the table was begun anew
                known = np.searchsorted(self.words, uniq)
                gone = np.flatnonzero(self.words[np.minimum(known, len(self.words) - 1)] != uniq)
                if len(gone):
                    self.keep = max(self.keep, len(uniq) + 1)
                    self._learn(np, uniq[gone], data, s[where[gone]], e[where[gone]])
            known = np.searchsorted(self.words, uniq)
        row = known[code]
        if not same_words(data, s, e - s, self.text, self.at[row], self.size[row]):
            return whole()  # two words share a hash
        start, count = self.start[row], self.count[row].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(total[first])
        n = int(total[-1])
        out = self.flat[np.arange(n) + np.repeat(start - total[:-1], count)]
        if end is not None:
            out = np.insert(out, total[first[1:]], end)
            per_text = per_text + 1
        return out.astype(np.uint32), per_text


_MODELS: dict = {}


def tokenizer_for(path: str, by_words: bool) -> WordTokenizer:
    """One per worker process, kept across its tasks."""
    if (path, by_words) not in _MODELS:
        _MODELS[path, by_words] = WordTokenizer(path, by_words)
    return _MODELS[path, by_words]


def pieces(b):
    """Slices of a batch (doc_id, text) of about BATCH_BYTES of text, for texts may be long."""
    lo = 0
    while lo < b.num_rows:
        hi, size = lo, 0
        while hi < b.num_rows and (hi == lo or size < BATCH_BYTES):
            size += len(b.column(1)[hi].as_buffer() or b"") if b.column(1)[hi].is_valid else 0
            hi += 1
        yield b.slice(lo, hi - lo)
        lo = hi


class ShardWriter:
    """Appends documents to a shard; holds a block of ids and the index of a block."""

    def __init__(self, out, vocab: int):
        self.out, self.vocab, self.ids, self.n, self.docs = out, vocab, [], 0, []
        self.size, self.tokens = out.write(MAGIC) or len(MAGIC), 0

    def add(self, doc_ids, ids, counts):
        """doc_ids: list of int or None; a document's end is put down in the block that holds its last id."""
        import numpy as np

        end = self.tokens + np.cumsum(counts)
        self.docs += zip(doc_ids, counts.tolist(), end.tolist())
        self.ids.append(ids)
        self.n += len(ids)
        self.tokens += len(ids)
        while self.n >= BLOCK:
            flat = np.concatenate(self.ids)
            self._block(flat[:BLOCK], self.tokens - self.n + BLOCK)
            self.ids, self.n = [flat[BLOCK:]], self.n - BLOCK

    def _block(self, ids, upto: int):
        import zlib

        import numpy as np

        from lexiloom.llm import range_coder as rc

        k = 0
        while k < len(self.docs) and self.docs[k][2] <= upto:
            k += 1
        ended, self.docs = self.docs[:k], self.docs[k:]
        null = np.array([d[0] is None for d in ended], np.uint8)
        raw = np.array([d[0] or 0 for d in ended], "<i8").tobytes() + np.array([d[1] for d in ended], "<i8").tobytes() + null.tobytes()
        index = zlib.compress(raw, 1)
        data = rc.encode_block(ids, self.vocab) + INDEX.pack(k, len(index)) + struct.pack("<I", zlib.crc32(index)) + index
        self.out.write(data)
        self.size += len(data)

    def finish(self):
        import numpy as np

        if self.n or self.docs:
            self._block(np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32), self.tokens)
        self.out.close()


def read_shard(stream):
    """Yields (doc_id or None, ids) for the documents of a shard, in order; holds a block, and a document."""
    import zlib

    import numpy as np

    from lexiloom.llm import range_coder as rc

    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("this is no shard of token ids")
    rest: list = []
    while head := stream.read(rc.HEAD.size):
        ids = rc.decode_block(head, stream.read(rc.block_size(head)))
        k, size = INDEX.unpack(stream.read(INDEX.size))
        crc = struct.unpack("<I", stream.read(4))[0]
        index = stream.read(size)
        if zlib.crc32(index) != crc:
            raise ValueError("an index of a shard is damaged")
        raw = zlib.decompress(index)
        doc_ids, counts, null = np.frombuffer(raw, "<i8", k), np.frombuffer(raw, "<i8", k, 8 * k), np.frombuffer(raw, np.uint8, k, 16 * k)
        at = 0
        for i in range(k):
            need = int(counts[i]) - sum(map(len, rest))
            rest.append(ids[at : at + need])
            at += need
            yield None if null[i] else int(doc_ids[i]), np.concatenate(rest) if len(rest) > 1 else rest[0]
            rest = []
        if at < len(ids):
            rest.append(ids[at:])


def write_shards(docs: DataFrame, tokenizer: str, end: int = END_ID, to: str | None = None, by_words: bool = True, shards: int | None = None) -> tuple[str, DataFrame]:
    """Writes (doc_id, text) and returns (folder, manifest: shard, path, docs, tokens, bytes), shards in order."""
    spark = docs.sparkSession
    ship(spark)
    to = to or scratch_path(spark, "tokens")
    n = shards or parts_for(spark)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        model = tokenizer_for(tokenizer, by_words)
        fs, base = filesystem(to)
        writer, name, docs_in = None, "", 0
        for b in batches:
            for part in pieces(b):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{uuid.uuid4().hex}.lxt"
                    writer = ShardWriter(fs.open_output_stream(f"{base}/{name}", compression=None), model.vocab)
                ids, counts = model.encode(part.column(1), end)
                writer.add(part.column(0).to_pylist(), ids, counts)
                docs_in += part.num_rows
                del ids, counts
                trim()
        if writer is not None:
            writer.finish()
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, name, docs_in, writer.tokens, writer.size)], names=["shard", "path", "docs", "tokens", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("_h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_h")).select("doc_id", "text")
    return to, staged(dealt.mapInArrow(run, "shard long, path string, docs long, tokens long, bytes long"), "token-manifest")


def shard_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Reads the shards back. One row per document: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    named = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0))).select("path", "base")

    def run(batches):
        import zlib

        import pyarrow as pa

        fs, base = filesystem(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list = []
                pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for doc, ids in read_shard(stream):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return named.repartition(parts_for(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    folder, manifest = write_shards(docs, tokenizer, end)
    return shard_digests(docs.sparkSession, folder, manifest)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), default_tokenizer())
