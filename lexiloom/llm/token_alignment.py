"""Alignment of two tokenizers' tokens over the same bytes, and how often ids of one meet ids of the other.

A is a byte-level BPE of the tokenizers library and reads a space and the text; B is a sentencepiece model, which adds that
space itself. Each token covers bytes; where a token of A and one of B end together, the bytes are cut into groups. Tokens
of one group are linked. A pair of ids counts once for every document that links it.

How it is done: texts go through Arrow in blocks of BLOCK_BYTES. A block is cut at spaces that neither tokenizer can
cross (after a character that is no white space), and each different segment is tokenised once. DuckDB, in the task, holds
the two tokenizers' intervals as tables: an ASOF join finds the last end of B at or before each end of A, a window sum over
the common ends numbers the groups, a range (ASOF) join puts tokens of B into them, and links are grouped by segment and
then by document. What a block says is written once: a row a document, with its pairs as numbers into the block's own list.
The lists' counts meet in Spark, and each block gets back the totals of just its own pairs. Nothing here grows with the
corpus but rows: a task holds one block, or one document where that is longer.

Defined cases: texts that are null, empty, or that either tokenizer doesn't give back byte for byte (a literal U+2581, say)
have no tokens: zeros, and '' for the digest; they count for no pair. Repeated rows and null ids are documents like
others, a row each. Very long texts are a block of their own; very long groups are linked by their different ids with
multiplicities, never token by token. An empty table gives no rows. Other columns are ignored. The tokenizers' files are
named on the driver and opened by the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import ship, spread_join, staged, table, trim

BLOCK_BYTES = 2 << 20
#: Bytes that are given to a tokenizer at a time.
CALL_BYTES = 1 << 15
#: Segments whose alignment a worker keeps.
KNOWN = 300_000
#: The splitter of byte-level BPE. A fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SQL_GROUPS = """
create or replace temp table ga as
select seg, s, id, coalesce(sum(cut) over (order by s rows between unbounded preceding and 1 preceding), 0)::bigint as g
from (select a.*, coalesce(a.e = b.e, false)::int as cut from a asof left join b on a.e >= b.e);
create or replace temp table span as select g, min(s) as lo, any_value(seg) as seg from ga group by g;
create or replace temp table gb as select b.s, b.id, span.g from b asof join span on b.s >= span.lo;
"""
_SQL_SEGMENTS = """
select seg, sum(na)::bigint as n_a, sum(nb)::bigint as n_b, count(*)::bigint as n_groups, sum(na * nb)::bigint as n_links
from (select g, any_value(seg) as seg, count(*) as na from ga group by g) join (select g, count(*) as nb from gb group by g) using (g) group by seg order by seg
"""
_SQL_PAIRS = """
create or replace temp table links as
select seg, pa.id as a, pb.id as b, sum(pa.m * pb.m)::bigint as m
from (select seg, g, id, count(*) as m from ga group by all) pa join (select g, id, count(*) as m from gb group by all) pb using (g) group by all;
insert into pair select a, b, (select count(*) from pair) + row_number() over (order by a, b) - 1 from (select distinct a, b from links) anti join pair using (a, b);
create or replace temp table fresh as select links.seg, pair.p, links.m from links join pair using (a, b);
"""
_SQL_DOCUMENTS = """
select doc, list(p order by p) as pairs, list(m order by p) as times
from (select o.doc, n.p, sum(o.times * n.m)::bigint as m from (select doc, seg, count(*) as times from occurrence group by all) o join (from numbered union all from fresh) n using (seg) group by all) group by doc order by doc
"""


def segment_starts(data, offs):
    """Where segments of the documents data[offs[i]:offs[i + 1]] start: at their starts, and at each space behind a byte
    from ! to ~ or behind a character of two bytes that begins with C3 to DF (never white space)."""
    import numpy as np

    at = np.flatnonzero(data == 32)
    at = at[at >= 1]
    before = data[at - 1]
    lead = data[np.maximum(at - 2, 0)]
    ok = ((before > 32) & (before < 127)) | ((before >= 128) & (lead >= 0xC3) & (lead <= 0xDF))
    start = np.zeros(len(data) + 1, bool)
    start[at[ok]] = start[offs[:-1]] = True
    return np.flatnonzero(start[:-1])


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.space = self.b.piece_to_id("▁")
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        named = {t.content for t in self.a.get_added_tokens_decoder().values()}
        a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            a[i] = piece.encode() if piece in named else bytes(byte_of[c] for c in piece)
        b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.fast = self._by_ranks(path_a, a)
        self.bytes_of = []
        for pieces in (a, b):
            size = np.array([len(p) for p in pieces], np.int64)
            self.bytes_of.append((size, np.cumsum(size) - size, np.frombuffer(b"".join(pieces), np.uint8)))

    @staticmethod
    def _by_ranks(path: str, pieces: list[bytes]):
        """The same byte-level BPE in tiktoken, which is several times faster; None unless the file's merges are in the
        order of the ids they make, as then the lowest id is the first merge, and its splitter is the usual one."""
        import json

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and sorted(model["vocab"].values())[:256] == list(range(256))
        if not in_order or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or any(len(p) != 1 for p in pieces[:256]):
            return None
        ranks = {p: i for i, p in enumerate(pieces[: 256 + len(merges)])}
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def _ids(self, which: int, texts: list[str]) -> list[list[int]]:
        if which == 0 and self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        if which == 0:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # It adds the space in front itself, but not to an empty text.
        return [ids or [self.space] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _same(self, which: int, ids, data) -> bool:
        import numpy as np

        size, at, flat = self.bytes_of[which]
        n = size[ids]
        if n.sum() != len(data):
            return False
        back = flat[np.repeat(at[ids] - (np.cumsum(n) - n), n) + np.arange(len(data))]
        return bool((back == data).all())

    def tokens(self, which: int, data, starts, stops, joinable):
        """(ids, ends, bad) of segments that lie one after another in data: ids in order, the byte at which each ends, and
        which segments aren't given back (they have no tokens). Runs of joinable segments are encoded as one text, as
        their borders part tokens anyway; where such a text isn't given back its segments are tried one by one."""
        import numpy as np

        n, runs, i = len(starts), [], 0
        # A run holds joinable segments, and one that isn't only at its end.
        stop_run = np.flatnonzero(~joinable)
        while i < n:
            j = int(np.searchsorted(starts, starts[i] + CALL_BYTES, "right"))
            k = stop_run[np.searchsorted(stop_run, i)] + 1 if np.searchsorted(stop_run, i) < len(stop_run) else n
            j = max(i + 1, min(j, k, n))
            runs.append((i, j))
            i = j
        text = lambda lo, hi: data[lo:hi].tobytes().decode()
        got, out, ends, bad = self._ids(which, [text(starts[i], stops[j - 1]) for i, j in runs]), [], [], np.zeros(n, bool)
        size = self.bytes_of[which][0]

        def keep(ids, lo):
            out.append(ids)
            ends.append(lo + np.cumsum(size[ids]))

        for (i, j), ids in zip(runs, got):
            ids = np.asarray(ids, np.int64)
            if self._same(which, ids, data[starts[i] : stops[j - 1]]):
                keep(ids, starts[i])
                continue
            for s, one in zip(range(i, j), self._ids(which, [text(starts[s], stops[s]) for s in range(i, j)])):
                one = np.asarray(one, np.int64)
                bad[s] = not self._same(which, one, data[starts[s] : stops[s]])
                if not bad[s]:
                    keep(one, starts[s])
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return flat(out), flat(ends), bad


class Aligner:
    """Aligns the texts of a block. What was found for the first KNOWN segments is kept for later blocks; results don't
    depend on it."""

    FIGURES = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, path_a: str, path_b: str, known: int = KNOWN):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.tok, self.con, self.most = Tokenizers(path_a, path_b), duckdb.connect(), known
        self.con.execute("set threads = 1; set temp_directory = ''; set memory_limit = '700MB'")
        self.con.execute("create temp table pair (a int, b int, p bigint); create temp table numbered (seg bigint, p bigint, m bigint); create temp table fresh (seg bigint, p bigint, m bigint)")
        self.segments, self.names, self.bad, self.kept = pa.array([], pa.large_string()), [], np.zeros(0, bool), 0
        self.figures = {c: np.zeros(0, np.int64) for c in self.FIGURES}

    def _rendered(self, n: int, base: int) -> list[str]:
        """The groups of n new segments, as `a1,a2|b1;a3|b2,b3`; '' for those without tokens."""
        import numpy as np

        t = self.con.execute("select g, false as b, s, id, seg from ga union all select g, true, s, id, -1 from gb").fetchnumpy()
        order = np.lexsort((t["s"], t["b"], t["g"]))
        g, b, ids, seg = (t[c][order] for c in ("g", "b", "id", "seg"))
        names = np.full(n, "", object)
        if not len(g):
            return names.tolist()
        seg = np.maximum.accumulate(seg)  # a group's tokens of B follow those of A, and segments ascend
        change = lambda x: np.append(x[1:] != x[:-1], True)
        marks = np.select([change(seg), change(g), change(b)], [3, 2, 1], 0)
        flat = [""] * (2 * len(g))
        flat[::2], flat[1::2] = map(str, ids.tolist()), map(",|;\n".__getitem__, marks.tolist())
        names[seg[change(seg)] - base] = "".join(flat).split("\n")[:-1]
        return names.tolist()

    def _learn(self, new) -> None:
        """new: segments that aren't known, as Arrow strings."""
        import numpy as np
        import pyarrow as pa

        from lexiloom.llm import textvec as tv

        base, n = len(self.segments), len(new)
        words, cut = tv.buffers(new)
        lo, hi = cut[:-1], cut[1:]
        last, lead = words[hi - 1], words[np.maximum(hi - 2, 0)]
        joinable = ((last > 32) & (last < 127)) | ((last >= 128) & (lead >= 0xC3) & (lead <= 0xDF))
        bad, spans = np.zeros(n, bool), []
        for which in (0, 1):
            ids, ends, off = self.tok.tokens(which, words, lo, hi, joinable)
            bad |= off
            spans.append((ids, ends, np.searchsorted(hi, ends, "left")))
        for name, which in (("a", 0), ("b", 1)):
            ids, ends, of = spans[which]
            on = ~bad[of]
            self.con.register(f"{name}_in", pa.table({"seg": of[on] + base, "s": (ends - self.tok.bytes_of[which][0][ids])[on], "e": ends[on], "id": ids[on].astype(np.int32)}))
            self.con.execute(f"create or replace temp table {name} as select * from {name}_in")
        self.con.execute(_SQL_GROUPS)
        per = self.con.execute(_SQL_SEGMENTS).fetchnumpy()
        for c in self.FIGURES:
            more = np.zeros(n, np.int64)
            more[per["seg"] - base] = per[c]
            self.figures[c] = np.append(self.figures[c], more)
        self.names += self._rendered(n, base)
        self.bad = np.append(self.bad, bad)
        self.con.execute(_SQL_PAIRS)
        self.segments = pa.concat_arrays([self.segments, new])

    def _keep(self) -> None:
        """Once enough is known, what a block brought goes with it."""
        if len(self.segments) <= self.most:
            self.con.execute("insert into numbered from fresh")
            self.kept = len(self.segments)
        self.con.execute("delete from fresh")
        self.segments, self.names, self.bad = self.segments.slice(0, self.kept), self.names[: self.kept], self.bad[: self.kept]
        self.figures = {c: x[: self.kept] for c, x in self.figures.items()}

    def block(self, texts):
        """texts: Arrow strings, none null or empty. (figures, pairs, times, (a, b, documents)): figures has n_a, n_b,
        n_groups, n_links and groups_sha256 of each; pairs and times are lists of lists, the numbers of its pairs and how
        often it links them; then the block's pairs and how many of its documents link each."""
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from lexiloom.llm import textvec as tv

        data, offs = tv.buffers(pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        start = segment_starts(data, offs)
        edges = np.append(start, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        at = pc.index_in(pieces.dictionary, self.segments)
        if at.null_count:
            self._learn(pieces.dictionary.filter(at.is_null()))
            at = pc.index_in(pieces.dictionary, self.segments)
        seg, n = at.to_numpy().astype(np.int64)[pieces.indices.to_numpy()], len(texts)
        doc = np.searchsorted(offs, start, "right") - 1
        lost = np.zeros(n, bool)
        lost[doc[self.bad[seg]]] = True
        fine = ~lost[doc]
        figures = {c: np.bincount(doc[fine], x[seg[fine]], n).astype(np.int64) for c, x in self.figures.items()}
        first, named = np.searchsorted(doc, np.arange(n + 1)), seg.tolist()
        figures["groups_sha256"] = ["" if lost[d] else hashlib.sha256(";".join([self.names[i] for i in named[first[d] : first[d + 1]]]).encode()).hexdigest() for d in range(n)]
        self.con.register("occurrence", pa.table({"doc": doc[fine], "seg": seg[fine]}))
        mine = self.con.sql(_SQL_DOCUMENTS).to_arrow_table()
        pairs, times, empty = [[]] * n, [[]] * n, np.zeros(0, np.int64)
        flat = [mine.column(i).combine_chunks() for i in (1, 2)]
        # The block's own numbers for its pairs, in place of the worker's.
        number = flat[0].flatten().to_numpy() if mine.num_rows else empty
        here = np.bincount(number) > 0
        used, number = np.flatnonzero(here), (np.cumsum(here) - 1)[number]
        cuts = flat[0].offsets.to_numpy()[1:-1] if mine.num_rows else []
        for d, p, m in zip(mine.column(0).to_pylist(), np.split(number, cuts), np.split(flat[1].flatten().to_numpy(), cuts) if mine.num_rows else ()):
            pairs[d], times[d] = p, m
        self.con.register("used", pa.table({"p": used}))
        ids = self.con.execute("select a, b from pair join used using (p) order by p").fetchnumpy()
        self._keep()
        return figures, pairs, times, (ids["a"], ids["b"], np.bincount(number, minlength=len(used)))


#: The worker's aligner, by its tokenizers; it outlives a task where Spark keeps the worker.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_BLOCKS = "block bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<bigint>, a array<int>, b array<int>, docs array<bigint>"


def blocks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """A row a document (key as id): figures, the numbers of its pairs in the block's list with their multiplicities; a
    block's first row carries the list. Not staged."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from lexiloom.llm import textvec as tv

        ints = lambda xs, t: pa.array(xs, pa.list_(t))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for i, j in tv.blocks(tv.buffers(texts)[1], size):
                part, n = texts.slice(i, j - i), j - i
                on = np.flatnonzero(pc.binary_length(part).to_numpy(zero_copy_only=False) > 0)
                cols = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
                sha, pairs, times, own = np.full(n, "", object), [None] * n, [None] * n, None
                if len(on):
                    if (path_a, path_b) not in _ALIGNERS:
                        _ALIGNERS.clear()
                        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
                    figures, p, m, own = _ALIGNERS[path_a, path_b].block(part.take(pa.array(on)))
                    for c in cols:
                        cols[c][on] = figures[c]
                    sha[on] = figures["groups_sha256"]
                    for k, x, y in zip(on.tolist(), p, m):
                        pairs[k], times[k] = x, y
                first = [ints([own[k]] + [None] * (n - 1) if own else [None] * n, t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), batch.column(0).slice(i, n), *[pa.array(cols[c]) for c in cols], pa.array(sha, pa.string()), ints(pairs, pa.int32()), ints(times, pa.int64()), *first],
                    names=["block", "id", *cols, "groups_sha256", "pairs", "times", "a", "b", "docs"],
                )
                block += 1
                trim()

    return rows.mapInArrow(run, _BLOCKS.format(kind=rows.schema["id"].dataType.simpleString()))


def _pairs_of(staged_blocks: DataFrame) -> DataFrame:
    """(block, n, pair, docs): a row for each pair of a block; pair is A's id and B's in one long."""
    listed = staged_blocks.filter("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("n", "x"))
    return listed.select("block", "n", F.shiftleft(F.col("x.a").cast("long"), 32).bitwiseOR(F.col("x.b").cast("long")).alias("pair"), F.col("x.docs").alias("docs"))


def _counts_of(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): documents that link it, and whether no pair of the same A id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, count, best): how many documents link id a of A with id b of B."""
    got = _counts_of(_pairs_of(staged(blocks(docs, path_a, path_b, key, text), "alignment")))
    return got.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count", "best")


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: key, n_a, n_b, n_groups, n_links, n_best (its links whose pair no other of the same A id exceeds),
    count_sum (the counts of its links' pairs) and groups_sha256."""
    rows = staged(blocks(docs, path_a, path_b, key, text, size), "alignment")
    pairs = staged(_pairs_of(rows), "alignment-pairs")
    # A common pair is in every block's list: those rows are spread by block.
    back = spread_join(pairs.select("block", "n", "pair"), staged(_counts_of(pairs), "alignment-counts"), "pair", "block").select("block", "n", "count", "best")
    kind = rows.schema["id"].dataType.simpleString()
    kept = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def scored(left, right):
        import numpy as np
        import pyarrow as pa

        number = right.column("n").to_numpy()
        count, best = np.zeros(number.max(initial=-1) + 1, np.int64), np.zeros(number.max(initial=-1) + 1, np.int64)
        count[number], best[number] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        lists = [left.column(c).combine_chunks() for c in ("pairs", "times")]
        size = np.diff(lists[0].offsets.to_numpy()) if left.num_rows else np.zeros(0, np.int64)
        p, m = (x.flatten().to_numpy() for x in lists)
        run = lambda v: np.append(0, np.cumsum(v))
        stop = np.cumsum(size)
        total = lambda v: run(v)[stop] - run(v)[stop - size]
        cols = {"n_best": total(m * best[p]), "count_sum": total(m * count[p])}
        return pa.table([left.column("id"), *[left.column(c) for c in kept], *[pa.array(x.astype(np.int64)) for x in cols.values()]], names=[key, *kept, *cols])

    out = f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return rows.drop("a", "b", "docs").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, out)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aligned(table(spark, sf_dir, "documents"), *default_tokenizers())
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
