"""A Katz backoff language model, learned from a corpus and applied to every text of it, or of another.

*Model.* Tokens are words (between ASCII white space, A-Z lower-cased) and one end a text; before a text stand two ends.
Of order 3, P(w | u v) = d3(c) c(u v w) / c(u v) if the triple was learned, else alpha(u v) P(w | v), or P(w | v) where
u v was never learned as a history; P(w | v) likewise from pairs and P(w); P(w) = d1(c) c(w) / N if the word was
learned, else the whole of what that leaves, for the one class of unknown words. Of order 2 the recursion begins with
P(w | v). d are Good-Turing discounts of counts up to CUT, with Katz's correction, of each order's own; larger counts
aren't discounted. From the first count whose discount is not between 0 and 1 (copies in the corpus bend the counts of
counts), the counts of counts are smoothed as in Simple Good-Turing: a line through the logarithms of Z_r, r up to FIT.
alpha is exact: what the learned followers of a history leave, over what the lower order leaves of them, so that the
probabilities of all words and the unknown class add up to 1. Not Katz's: a history none of whose counts is discounted
(all above CUT) counts once more in its denominator, so that something is left. Where the line does not fall faster than
1 / r either (a handful of texts), Good-Turing has no discounts; (c - 1/2) / c stands in, and a warning is logged.

*Distribution.* The corpus is cut into batches of texts; a batch row holds its words' 64-bit hashes, and its tokens as
indices into them, packed. P parts, a number that follows the tokens (TOKENS a part), hold the model. (1) Each batch asks
the parts of its words; a part adds up, numbers the words and answers. (2) Each batch sends its distinct pairs to the part
of their first word; a part merges them into its table of pairs and, the discounts being known, answers with counts and
alpha. (3) Each batch sends its distinct triples, with what it knows of their pairs and the texts they occur in, to the
part of the middle word. A part merges them into its table, walks the recursion for every token, and keeps sums per text:
how often triples of each small count occur in it, the sum of the logarithms that need no discount, and which histories
it leaves by backing off. With the counts of counts of all parts the discounts are known, parts turn these into sums
per text, and batches add them up. A frequent word's histories are dealt to several parts, and so are the followers of a
frequent history; statistics of these are sums, and there are at most 4 P such histories. Everything a task holds is a
batch or a part. A batch sends at most a row a part, none that is empty, so rows never exceed tokens. Triples are most of
what is exchanged: (3) goes over the batches PASSES times, each time for a share of the parts, so only that is on disk at once.

*Stored model.* `learned` writes a folder of tables: words, pairs and triples, each a Parquet table partitioned by part,
with counts and alpha, and the discounts. `scored` applies it to any corpus: its tables join the batches as one more
sender, so texts are scored by the same code. `probabilities` reads the tables as rows of history, word, count,
probability and backoff weight.

Defined cases: null and empty texts are an end alone; a null id is scored, never learned from by `training_view`, and not
held out; repeated rows each count and are scored; very long texts make a batch of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import logging
import math
import struct
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_mod, filesystem, parts_for, scratch_path, ship, staged, table, trim

CUT = 5
#: Counts of counts that the line is laid through.
FIT = 20
BATCH_BYTES = 9 << 20
#: Tokens a part.
TOKENS = 1_500_000
ORDER = 3
#: Times that the batches are gone through for the highest order, each time for as large a share of the parts.
PASSES = 2
#: The hash that stands for the end of a text.
END = 0x5A17E0FD2B3C4D91
#: The sender of what a stored model holds, and rows that are of a part, not of a batch.
STORED, OF_PART = -2, -1
_COLUMNS = "batch long, n long, doc_ids binary, doc_null binary, train binary, held binary, n_tokens binary, vocab binary, learned binary, tokens binary"


def pack(*arrays) -> bytes:
    """Arrays of numbers as one compressed byte string; the bytes of each place go together."""
    import numpy as np
    import zstandard

    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes) -> list:
    import numpy as np
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sQ", data, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def slim(a):
    """Unsigned integers in as few bytes as the largest needs."""
    import numpy as np

    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def slope(n: list[int]) -> float | None:
    """Of the least-squares line through log Z_r over log r; Z_r spreads n[r - 1] over the gaps about it."""
    at = [r for r, x in enumerate(n, 1) if x > 0]
    if len(at) < 2:
        return None
    ends = zip([0, *at], at, [*at[1:], 2 * at[-1] - at[-2]])
    z = [(math.log(r), math.log(2 * n[r - 1] / (after - before))) for before, r, after in ends]
    mx, my = sum(x for x, _ in z) / len(z), sum(y for _, y in z) / len(z)
    return sum((x - mx) * (y - my) for x, y in z) / sum((x - mx) ** 2 for x, _ in z)


def discounts(n: list[int], cut: int = CUT, of: str = "counts") -> list[float]:
    """d for counts 1 .. cut, of counts of counts n[r - 1] = how many types occur r times, r up to cut + 1 at least."""
    common = (cut + 1) * n[cut] / n[0] if n[0] else 1.0
    got = []
    for r in range(1, cut + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if common < 1 and min(n[r - 1], n[r], n[cut]) > 0 else -1.0
        if not 0 < d < 1:
            break
        got.append(d)
    if len(got) == cut:
        return got
    b = slope(n)
    if b is None or b >= -1:
        if any(n):
            logging.getLogger(__name__).warning("%s: no Good-Turing discounts, (c - 1/2) / c is used", of)
        return [(r - 0.5) / r for r in range(1, cut + 1)]
    logging.getLogger(__name__).info("%s: Good-Turing discounts, smoothed from count %d on", of, len(got) + 1)
    common = (cut + 1) ** (b + 1)
    return got + [((1 + 1 / r) ** (b + 1) - common) / (1 - common) for r in range(len(got) + 1, cut + 1)]


def batches(docs: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """docs (doc_id, train, held_out, text), to packed batches of about size bytes of text."""
    ship(docs.sparkSession)

    def run(parts):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        from lexiloom.llm import textvec as tv

        alphabet, task, seq = tv.spaced(), TaskContext.get().partitionId(), 0
        ids, train, held, hashes, counts, have = [], [], [], [], [], 0

        def row():
            nonlocal ids, train, held, hashes, counts, have, seq
            n = np.concatenate(counts)
            flat = np.concatenate(hashes)
            hashes = []
            code, uniq = pd.factorize(np.insert(flat, np.cumsum(n), np.uint64(END)))
            uniq = np.asarray(uniq, np.uint64)
            # Words in the order in which they first occur: frequent ones have small numbers, which pack well.
            tokens, on = code, np.repeat(np.concatenate(train), n + 1)
            learned = np.bincount(tokens[on], minlength=len(uniq))
            out = [(task << 32) + seq, len(tokens), pack(np.concatenate([i.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in ids])), pack(np.concatenate([i.is_null().to_numpy(zero_copy_only=False) for i in ids]).astype(np.uint8)), pack(np.concatenate(train).astype(np.uint8)), pack(np.concatenate(held).astype(np.uint8)), pack(slim(n + 1)), pack(uniq), pack(slim(learned)), pack(slim(tokens))]
            seq += 1
            ids, train, held, counts, have = [], [], [], [], 0
            del code, tokens, flat, on
            trim()
            kinds = [pa.int64()] * 2 + [pa.binary()] * 8
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in _COLUMNS.split(", ")])

        for b in parts:
            for i, j, h, first in tv.hashed(b.column(3), alphabet):
                ids.append(b.column(0).slice(i, j - i))
                train.append(b.column(1).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool))
                held.append(b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool))
                hashes.append(h)
                counts.append(np.diff(first))
                have += 6 * len(h) + 8 * (j - i)
                if have >= size:
                    yield row()
        if ids:
            yield row()

    return staged(docs.select("doc_id", "train", "held_out", "text").mapInArrow(run, _COLUMNS), "katz-batches")


def gaps(a):
    """Ascending integers as slim differences."""
    import numpy as np

    return slim(np.diff(a, prepend=a.dtype.type(0)))


def narrow(a):
    """Counts in four bytes, where they fit."""
    import numpy as np

    return a.astype(np.int32) if not len(a) or a.max() < 1 << 31 else a


def rising(a):
    import numpy as np

    return np.cumsum(a.astype(np.int64))


def listed(a):
    """(values, index) of integers, the values ascending and packed as gaps."""
    import numpy as np

    u, i = np.unique(a, return_inverse=True)
    return u, i


def scaled(h, parts: int):
    """Which of so many equal ranges a 64-bit hash lies in."""
    import numpy as np

    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def part_of(first, parts: int, *salts):
    """The part of a word's number, and of numbers that deal a frequent word to several."""
    import numpy as np

    from lexiloom.llm import textvec as tv

    x = first.astype(np.uint64)
    for s in salts:
        x = x + tv.mix(s.astype(np.uint64) + np.uint64(1)) * (s > 0)
    return scaled(tv.mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)), parts)


def dealt(number, of, split: int):
    """Which of the shares of something that occurs `of` times a number is dealt to."""
    import numpy as np

    from lexiloom.llm import textvec as tv

    shares = np.maximum(of - 1, 0) // split + 1
    return (tv.mix(number.astype(np.uint64) ^ np.uint64(0x1F83D9ABFB41BD6B)) % shares.astype(np.uint64)).astype(np.int64)


def level_sums(count, starts, lower, cut: int, reach: int):
    """Of histories that begin at starts: how many counts are r, r up to cut; the sum of larger ones; the lower order's
    probability of what was learned. And the counts of counts."""
    import numpy as np

    level = np.minimum(count, cut + 1)
    small = [np.add.reduceat((level == r).astype(np.int64), starts) for r in range(1, cut + 1)] if len(starts) else [np.zeros(0, np.int64)] * cut
    total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
    of = np.bincount(np.minimum(count, reach + 1), minlength=reach + 2)[1 : reach + 1].astype(np.int64)
    return small, total(np.where(count > cut, count, 0)), total(np.where(count > 0, lower, 0.0)), of


def backoff(hcount, small, big, share, d: list[float]):
    """(alpha, below): the weight of the lower order, and the denominator of a history."""
    import numpy as np

    mass = sum(x * r * s for (r, x), s in zip(enumerate(d, 1), small)) + big
    below = np.where(sum(small) > 0, hcount, hcount + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(hcount > 0, (1 - mass / below) / (1 - share), 1.0), below


def katz_probability(c, below, alpha, lower, d: list[float]):
    """P of words with counts c after histories."""
    import numpy as np

    return np.where(c > 0, c * np.concatenate([[0.0], d, [1.0]])[np.minimum(c, len(d) + 1)] / np.maximum(below, 1), alpha * lower)


def _unigram(c, n: int, d: list[float], unknown: float):
    """P(w) of words with totals c."""
    import numpy as np

    return np.where(c > 0, c * np.concatenate([[0.0], d, [1.0]])[np.minimum(c, len(d) + 1)] / max(n, 1), unknown)


def _row(names: str, *values):
    """A record batch of a row."""
    import pyarrow as pa

    kinds = {"batch": pa.int64(), "part": pa.int32()}
    cols = names.split()
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c, pa.binary())) for c, v in zip(cols, values)], names=cols)


def _table_of(part: int, rows: list[tuple[int, bytes]]):
    import pyarrow as pa

    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


_KINDS = "batch long, part int, data binary"


def word_totals(base: DataFrame, parts: int, stored: DataFrame | None = None, cut: int = CUT, keep: bool = False) -> DataFrame:
    """Rows (batch, part, data): totals and numbers of a batch's words of the part, in the order of their hashes; for each
    part, to keep, its table of words (STORED), and N, V and the counts of counts 1 .. reach (OF_PART)."""
    reach = max(FIT, cut + 1)

    def send(rows):
        import numpy as np

        for b in rows:
            for r in range(b.num_rows):
                (vocab,), (learned,) = unpack(b.column(1)[r].as_py()), unpack(b.column(2)[r].as_py())
                order = np.argsort(vocab)
                vocab, learned = vocab[order], learned[order]
                cut_at = np.searchsorted(scaled(vocab, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cut_at)).tolist():
                    x, y = cut_at[p], cut_at[p + 1]
                    yield _row("batch part data", b.column(0)[r].as_py(), p, pack(vocab[x:y], slim(learned[x:y])))

    def add(t):
        import numpy as np

        part, batch = t.column("part")[0].as_py(), t.column("batch").to_pylist()
        got = {b: unpack(x) for b, x in zip(batch, t.column("data").to_pylist())}
        old = got.get(STORED, [np.zeros(0, np.uint64)])[0]
        every = np.unique(np.concatenate([g[0] for g in got.values()]))
        sums = np.zeros(len(every), np.int64)
        for g in got.values():
            sums[np.searchsorted(every, g[0])] += g[1].astype(np.int64)
        # Words of a stored model keep their numbers, their places in it; others follow, frequent ones first: what is exchanged
        # are lists of numbers, and small ones pack well.
        fresh = np.flatnonzero(~np.isin(every, old))
        order = np.concatenate([np.searchsorted(every, old), fresh[np.argsort(-sums[fresh], kind="stable")]]).astype(np.int64)
        words, total, place = every[order], sums[order], np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        at = {b: place[np.searchsorted(every, g[0])] for b, g in got.items()}
        stat = np.concatenate([[total.sum(), (total > 0).sum()], np.bincount(np.minimum(total, reach + 1), minlength=reach + 2)[1 : reach + 1]])
        rows = [(b, pack(slim(total[at[b]]), slim(at[b]))) for b in got if b != STORED]
        rows += [(STORED, pack(words, slim(total)))] if keep else []
        return _table_of(part, [*rows, (OF_PART, pack(stat.astype(np.int64)))])

    sent = base.select("batch", "vocab", "learned").mapInArrow(send, _KINDS)
    sent = sent if stored is None else sent.unionByName(stored.select("batch", "part", "data"))
    return staged(sent.groupBy("part").applyInArrow(add, _KINDS), "katz-words")


class _Slots:
    """Answers to batches, in folders that a batch finds by its number; so batches, which are large, aren't shuffled."""

    def __init__(self, spark: SparkSession, name: str):
        self.n, self.path = max(4, parts_for(spark)), scratch_path(spark, name)

    def of(self, batch):
        return F.pmod(F.xxhash64(batch), F.lit(self.n)).cast("int")

    def write(self, answers: DataFrame) -> None:
        answers.filter("batch >= 0").withColumn("slot", self.of(F.col("batch"))).repartition(self.n, "slot").write.partitionBy("slot").parquet(self.path)

    def read(self, batch: int, slot: int) -> list[tuple[int, list]]:
        """(part, what it answered), by part."""
        import pyarrow.dataset as ds

        fs, folder = filesystem(self.path)
        got = ds.dataset(f"{folder}/slot={slot}", filesystem=fs, format="parquet").to_table(columns=["part", "data"], filter=ds.field("batch") == batch)
        return sorted(((r["part"], unpack(r["data"])) for r in got.to_pylist()), key=lambda r: r[0])


class _Batch:
    """A batch with what the parts of its words answered; words are renumbered so that their order is that of the numbers."""

    def __init__(self, b, r: int, slots: _Slots, parts: int):
        import numpy as np

        get = lambda name: b.column(b.schema.get_field_index(name))[r].as_py()
        (held,), (train,), (sizes,), (vocab,), (tokens,) = (unpack(get(n)) for n in ("held", "train", "n_tokens", "vocab", "tokens"))
        got = slots.read(get("batch"), get("slot"))
        total, number = np.empty(len(vocab), np.int64), np.empty(len(vocab), np.int64)
        order = np.argsort(vocab)
        total[order] = np.concatenate([x[0] for _, x in got])
        number[order] = np.concatenate([x[1].astype(np.int64) * parts + p for p, x in got])
        by = np.argsort(number)
        self.number, self.total = number[by], total[by]
        rank = np.empty(len(by), np.int32)  # arrays of a batch's tokens are kept narrow
        rank[by] = np.arange(len(by), dtype=np.int32)
        self.end = int(rank[np.flatnonzero(vocab == np.uint64(END))[0]])
        self.batch, self.held, self.train, self.sizes = get("batch"), held, train.astype(bool), sizes.astype(np.int64)
        self.w = rank[tokens]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        self.v[self.first] = self.end

    def pairs(self, parts: int, split: int):
        """(v, w, of, part, order): distinct pairs by part, v and w; for each token its pair's place in that order."""
        import numpy as np

        u, of = np.unique(self.v.astype(np.int64) * len(self.number) + self.w, return_inverse=True)
        of = of.astype(np.int32)
        v, w = np.divmod(u, len(self.number))
        part = part_of(self.number[v], parts, dealt(self.number[w], self.total[v], split))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return v[order], w[order], place[of], part[order]


def pair_parts(base: DataFrame, slots: _Slots, parts: int, split: int, unigram, stored: DataFrame | None, cut: int, keep: bool) -> DataFrame:
    """Rows (batch, part, data): of a batch, its first words of the part, which of them have pairs that were never learned,
    and the counts of its pairs; of each part its statistics (OF_PART) and, to keep, its table (STORED)."""
    reach = max(FIT, cut + 1)

    def send(rows):
        import numpy as np

        for b in rows:
            for r in range(b.num_rows):
                x = _Batch(b, r, slots, parts)
                v, w, of, part = x.pairs(parts, split)
                learned = np.bincount(of[x.train[x.doc]], minlength=len(v))
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    on = slice(cuts[p], cuts[p + 1])
                    yield _row("batch part data", x.batch, p, pair_slice(x.number[v[on]], x.total[v[on]], x.number[w[on]], x.total[w[on]], learned[on]))
                del x, v, w, of, part, learned
                trim()

    def merge(t):
        import numpy as np

        part, batch = t.column("part")[0].as_py(), t.column("batch").to_pylist()
        got = [read_pairs(x) for x in t.column("data").to_pylist()]
        v, cv, w, cw, learned = (np.concatenate(x) for x in zip(*got))
        at = np.cumsum([0] + [len(g[0]) for g in got])
        order = np.lexsort((w, v))
        sv, sw = v[order], w[order]
        new = np.concatenate([[True], (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1])])
        first = np.flatnonzero(new)
        count = np.add.reduceat(learned[order], first)
        per = np.empty(len(v), np.int64)
        per[order] = count[np.cumsum(new) - 1]
        hv, one = sv[first], order[first]
        starts = np.flatnonzero(np.concatenate([[True], hv[1:] != hv[:-1]]))
        small, big, share, of = level_sums(count, starts, unigram(cw[one]), cut, reach)
        rows, asked = [], np.zeros(len(starts), bool)
        for b, g, x, y in zip(batch, got, at, at[1:]):
            if b != STORED:
                own = np.flatnonzero(np.concatenate([[True], g[0][1:] != g[0][:-1]]))
                miss = np.minimum.reduceat(per[x:y], own) == 0
                asked[np.searchsorted(hv[starts], g[0][own[miss]])] = True
                rows.append((b, pack(gaps(g[0][own]), miss.astype(np.uint8), slim(per[x:y]))))
        # Weights are wanted where something was never learned; of histories in several parts others may want them.
        share[~asked & (cv[one][starts] <= split)] = 0
        rows.append((OF_PART, pack(hv[starts], slim(cv[one][starts]), *[slim(x) for x in small], slim(big), share, of)))
        if keep:
            on = count > 0
            rows.append((STORED, pair_slice(hv[on], cv[one][on], sw[first][on], cw[one][on], count[on])))
        del v, cv, w, cw, learned, order, sv, sw, per, got
        trim()
        return _table_of(part, rows)

    cols = ["batch", "held", "train", "n_tokens", "vocab", "tokens"]
    sent = base.select(*cols, slots.of(F.col("batch")).alias("slot")).mapInArrow(send, _KINDS)
    sent = sent if stored is None else sent.unionByName(stored.select("batch", "part", "data"))
    return staged(sent.groupBy("part").applyInArrow(merge, _KINDS), "katz-pairs")


def pair_slice(v, cv, w, cw, learned) -> bytes:
    """Pairs in the order of v and w, with the totals of both words."""
    import numpy as np

    new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    wu, wi = listed(w)
    of = np.zeros(len(wu), np.int64)
    of[wi] = cw
    return pack(gaps(v[new]), slim(cv[new]), slim(np.diff(np.append(new, len(v)))), gaps(wu), slim(of), slim(wi), slim(learned))


def read_pairs(raw: bytes):
    import numpy as np

    v, cv, n, wu, cw, wi, learned = unpack(raw)
    n = n.astype(np.int64)
    return np.repeat(rising(v), n), np.repeat(cv.astype(np.int64), n), rising(wu)[wi], cw.astype(np.int64)[wi], learned.astype(np.int64)


def wide_stats(rows: DataFrame, cut: int, split: int):
    """(counts of counts, {history: summed statistics}) of parts' OF_PART rows; of histories of more than split tokens
    only, 4 P at most."""
    total, wide = [0] * max(FIT, cut + 1), {}
    for r in rows.filter(F.col("batch") == OF_PART).mapInArrow(_counts_and_wide(cut, split), "n binary, wide binary").toLocalIterator():  # a row a part
        total = [a + int(b) for a, b in zip(total, unpack(r.n)[0])]
        for x in zip(*unpack(r.wide)):
            old = wide.get(int(x[0]), [0.0] * (len(x) - 1))
            wide[int(x[0])] = [a + float(b) for a, b in zip(old, x[1:])]
    return total, wide


def _counts_and_wide(cut: int, split: int):
    def run(rows):
        import numpy as np
        import pyarrow as pa

        for b in rows:
            out, wide = [], []
            for raw in b.column(b.schema.get_field_index("data")).to_pylist():
                hist, hcount, *rest = unpack(raw)
                big = np.flatnonzero(hcount > split)
                out.append(pack(rest[cut + 2]))
                wide.append(pack(hist[big], *[x[big].astype(np.float64) for x in rest[: cut + 2]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(wide, pa.binary())], names=["n", "wide"])

    return run


def weights_of(raw: bytes, cut: int, split: int, wide: dict, d: list[float]):
    """(histories, their tokens, alpha, below) from a part's statistics and those of histories that lie in several."""
    import numpy as np

    hist, hcount, *rest = unpack(raw)
    hcount = hcount.astype(np.int64)
    small, big, share = [x.astype(np.float64) for x in rest[:cut]], rest[cut].astype(np.float64), rest[cut + 1].copy()
    for i in np.flatnonzero(hcount > split).tolist():  # of these the part has a share only
        x = wide[int(hist[i])]
        for r in range(cut):
            small[r][i] = x[r]
        big[i], share[i] = x[cut], x[cut + 1]
    return hist, hcount, *backoff(hcount, small, big, share, d)


def pair_answers(found: DataFrame, cut: int, split: int, wide: dict, d: list[float]) -> DataFrame:
    """To batches: counts of their pairs; of their first words alpha, where a pair was never learned, and denominators."""

    def answer(t):
        import numpy as np

        part, batch, data = t.column("part")[0].as_py(), t.column("batch").to_pylist(), t.column("data").to_pylist()
        hist, hcount, alpha, below = weights_of(data[batch.index(OF_PART)], cut, split, wide, d)
        rows = []
        for b, raw in zip(batch, data):
            if b >= 0:
                v, miss, counts = unpack(raw)
                at = np.searchsorted(hist, rising(v))
                rows.append((b, pack(counts, np.where(miss == 1, alpha[at], 1.0), (below > hcount)[at].astype(np.uint8))))
        return _table_of(part, rows)

    return found.filter(F.col("batch") != STORED).groupBy("part").applyInArrow(answer, _KINDS)


def top_slice(v, u, w, of_v, of_h, of_w, cvw, learned, times, docs) -> bytes:
    """Triples in the order of v, u and w. of_v: columns of v; of_h: tokens of the history; of_w: totals of w."""
    import numpy as np

    start = lambda *cols: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])) if len(v) else np.zeros(0, np.int64)
    nv, nh = start(v), start(v, u)
    uu, ui = listed(u[nh])
    wu, wi = listed(w)
    cw, asked = np.zeros(len(wu), np.int64), cvw == 0
    cw[wi[asked]] = of_w[asked]  # wanted only where the recursion goes down to single words
    n = len(v)
    return pack(
        gaps(v[nv]), *[x[nv] if x.dtype == np.float64 else slim(x[nv]) for x in of_v], slim(np.diff(np.append(np.searchsorted(nh, nv), len(nh)))),
        gaps(uu), slim(ui), slim(of_h[nh]), slim(np.diff(np.append(nh, n))), gaps(wu), slim(cw), slim(wi), slim(cvw), slim(learned), slim(times), slim(docs),
    )


def read_top(raw: bytes):
    """(v, u, w, total of v, alpha of v, once more in v's denominator, tokens of the history, total of w, c(v w), learned, times, docs)."""
    import numpy as np

    v, cv, alpha, more, nh, uu, ui, ch, nw, wu, cw, wi, cvw, learned, times, docs = unpack(raw)
    nh, nw = nh.astype(np.int64), nw.astype(np.int64)
    of_v = np.repeat(np.repeat(np.arange(len(v)), nh), nw)
    per = lambda x: np.repeat(x, nw)
    return rising(v)[of_v], per(rising(uu)[ui]), rising(wu)[wi], cv.astype(np.int64)[of_v], alpha[of_v], more[of_v], per(ch.astype(np.int64)), cw.astype(np.int64)[wi], cvw.astype(np.int64), learned.astype(np.int64), times.astype(np.int64), docs


def top_parts(base: DataFrame, slots: _Slots, pair_slots: _Slots | None, parts: int, split: int, n: int, v_count: int, unigram, d2: list[float], stored: DataFrame | None, cut: int, keep: bool, share: tuple[int, int] | None = None) -> DataFrame:
    """The highest order. Rows (batch, part, data): what texts of a batch need of the part; of each part its statistics
    (OF_PART) and, to keep, its table (STORED); and of part -1 what needs no history, per batch. share: the parts from the
    first to before the second, all by default; part -1 goes with part 0."""
    low, high = share or (0, parts)
    reach = max(FIT, cut + 1)

    def send(rows):
        import numpy as np

        for b in rows:
            for r in range(b.num_rows):
                x = _Batch(b, r, slots, parts)
                if low == 0:
                    ids, null = (b.column(b.schema.get_field_index(c))[r].as_py() for c in ("doc_ids", "doc_null"))
                    log = np.log10((x.total + 1.0) / (n + v_count + 1.0))
                    known = np.add.reduceat((x.total > 0)[x.w].astype(np.int64), x.first)
                    yield _row("batch part data", x.batch, -1, pack(np.add.reduceat(log[x.w], x.first), known, x.sizes, x.held, unpack(ids)[0], unpack(null)[0]))
                size = len(x.number)
                if pair_slots is None:
                    u, ch, cvw = np.zeros(len(x.w), np.int32), narrow(x.total)[x.v], np.zeros(len(x.w), np.int32)
                    alpha, more, u_number = np.ones(size), np.zeros(size, np.uint8), np.zeros(1, np.int64)
                else:
                    got = pair_slots.read(x.batch, b.column(b.schema.get_field_index("pair_slot"))[r].as_py())
                    pv, _, of, part = x.pairs(parts, split)
                    count = np.concatenate([g[0].astype(np.int64) for _, g in got])
                    alpha, more = np.ones(size), np.zeros(size, np.uint8)
                    for p, g in got:  # a part answers for its first words in their order
                        on = np.unique(pv[np.searchsorted(part, p) : np.searchsorted(part, p, "right")])
                        alpha[on], more[on] = np.where(g[1] == 1.0, alpha[on], g[1]), g[2]  # of several parts some may not have been asked
                    cvw = narrow(count)[of]
                    u, ch = np.empty_like(x.v), np.empty(len(x.v), np.result_type(cvw.dtype, narrow(x.total).dtype))
                    u[1:], ch[1:] = x.v[:-1], cvw[:-1]
                    u[x.first], ch[x.first] = x.end, x.total[x.end]  # before a text stand two ends
                    u_number = x.number
                    del pv, of, part, count
                by_u = dealt(u_number[u], x.total[x.v], split) if pair_slots is not None else np.zeros(len(u), np.int64)
                to = part_of(x.number[x.v], parts, by_u, dealt(x.number[x.w], ch.astype(np.int64), split)).astype(np.int32)
                own = np.flatnonzero((to >= low) & (to < high))
                del by_u
                if not len(own):
                    continue
                if size < 1 << 21:
                    key = (x.v[own].astype(np.int64) * len(u_number) + u[own]) * size + x.w[own]
                    order = np.argsort(key)
                    key = key[order]
                    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    order = own[order]
                    del key
                else:  # a batch of a very long text
                    order = own[np.lexsort((x.w[own], u[own], x.v[own]))]
                    at = np.flatnonzero(np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in (x.v, u, x.w)], axis=0)]))
                one = order[at]
                times = np.diff(np.append(at, len(order)))
                docs = x.doc[order]
                learned = np.add.reduceat(x.train[docs].astype(np.int32), at)
                to = to[one]
                v, w, u, ch, cvw = (c[one].astype(np.int64) for c in (x.v, x.w, u, ch, cvw))
                x.v = x.w = x.doc = one = own = None
                by = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[by], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    on = by[cuts[p] : cuts[p + 1]]
                    t = times[on]
                    spots = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(at[on], t)
                    vv = v[on]
                    yield _row("batch part data", x.batch, p, top_slice(x.number[vv], u_number[u[on]], x.number[w[on]], (x.total[vv], alpha[vv], more[vv]), ch[on], x.total[w[on]], cvw[on], learned[on], t, docs[spots]))
                del x, order, docs
                trim()

    def merge(t):
        """A part: its table and statistics, and per batch what its texts need."""
        import numpy as np

        from lexiloom.llm import textvec as tv

        part, names, data = t.column("part")[0].as_py(), t.column("batch").to_pylist(), t.column("data").to_pylist()
        if part < 0:
            return _table_of(-1, list(zip(names, data)))
        got = [read_top(x) for x in data]
        v, u, w, cv, alpha, more, ch, cw, cvw, learned = (np.concatenate([g[i] for g in got]) for i in range(10))
        tails = [(g[10], g[11]) for g in got]
        at = np.cumsum([0] + [len(g[0]) for g in got])
        del got
        # The next lower order of each follower, by the same recursion.
        lower = unigram(cw)
        if pair_slots is not None:
            lower = katz_probability(cvw, cv + more, alpha, lower, d2)
        order = np.lexsort((w, u, v))
        apart = lambda *cols: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        sv, su = v[order], u[order]
        new = apart(sv, su, w[order])
        first = np.flatnonzero(new)
        count = np.add.reduceat(learned[order], first)
        per = np.empty(len(v), np.int64)
        per[order] = count[np.cumsum(new) - 1]
        one = order[first]
        starts = np.flatnonzero(apart(sv[first], su[first]))
        of = np.empty(len(v), np.int64)  # history of each
        of[order] = (np.cumsum(apart(sv, su)) - 1)
        hcount = ch[one][starts]
        small, big, share, counts = level_sums(count, starts, lower[one], cut, reach)
        none_small = sum(small) == 0
        hist = tv.mix(u[one][starts].astype(np.uint64) + np.uint64(1)) ^ v[one][starts].astype(np.uint64)
        out = []
        if keep:
            on = one[count > 0]
            out.append((STORED, top_slice(v[on], u[on], w[on], (cv[on], alpha[on], more[on]), ch[on], cw[on], cvw[on], count[count > 0], np.zeros(len(on), np.int64), np.zeros(0, np.int64))))
        del order, sv, su, new, u, w, cv, alpha, more, cw, cvw, learned
        trim()
        needs, used = [], [np.flatnonzero(hcount > split)]
        for i, name in enumerate(names):
            if name == STORED:
                continue
            x, (reps, doc) = slice(at[i], at[i + 1]), tails[i]
            doc = doc.astype(np.int64)
            docs_n = int(doc.max()) + 1
            c, hi = np.repeat(per[x], reps), np.repeat(of[x], reps)
            seen = c > 0
            plain = np.bincount(doc[seen], weights=np.log10(c[seen] / hcount[hi[seen]]), minlength=docs_n).astype(np.float64)  # integers where nothing is seen
            by_count = [np.bincount(doc[seen & (c == r)], minlength=docs_n) for r in range(1, cut + 1)]
            left = ~seen
            plain += np.bincount(doc[left], weights=np.log10(np.repeat(lower[x], reps)[left]), minlength=docs_n)
            off = left & (hcount[hi] > 0)  # a history never learned backs off wholly: alpha is 1
            # Seen after a history that has no discounted count here: the denominator may be one more.
            odd = seen & none_small[hi]
            back_key, back_n = np.unique(hi[off] * docs_n + doc[off], return_counts=True)
            odd_key, odd_n = np.unique(hi[odd] * docs_n + doc[odd], return_counts=True)
            by_history = [(key // docs_n, slim(key % docs_n), slim(times)) for key, times in ((back_key, back_n), (odd_key, odd_n))]
            used += [h for h, _, _ in by_history]
            needs.append((name, (plain, *[slim(y) for y in by_count]), by_history))
        # Of histories only those go on that a text needs or that lie in several parts.
        used = np.unique(np.concatenate(used))
        for name, sums, by_history in needs:
            out.append((name, pack(*sums, *(y for h, doc, times in by_history for y in (gaps(np.searchsorted(used, h)), doc, times)))))
        hist[hcount <= split] = 0
        out.append((OF_PART, pack(hist[used], slim(hcount[used]), *[slim(x[used]) for x in small], slim(big[used]), share[used], counts)))
        del per, of, tails, lower
        trim()
        return _table_of(part, out)

    cols = ["batch", "held", "train", "n_tokens", "vocab", "tokens", "doc_ids", "doc_null"]
    asked = base.select(*cols, slots.of(F.col("batch")).alias("slot"), *([pair_slots.of(F.col("batch")).alias("pair_slot")] if pair_slots else []))
    sent = asked.mapInArrow(send, _KINDS)
    sent = sent if stored is None else sent.unionByName(stored.filter((F.col("part") >= low) & (F.col("part") < high)).select("batch", "part", "data"))
    # Rows of part -1 are per batch: they go by batch, so that no task gets all of them.
    turn = F.when(F.col("part") < 0, F.col("batch")).otherwise(F.lit(0))
    return staged(sent.withColumn("turn", turn).groupBy("part", "turn").applyInArrow(merge, _KINDS), "katz-parts")


@contextmanager
def _releasing(spark: SparkSession):
    """While it lasts, Spark removes a step's shuffle files as soon as the step is done, not when its plan is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _discard(df: DataFrame) -> None:
    """Removes a scratch table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _fit(base: DataFrame, *how, keep: bool = False) -> dict:
    with _releasing(base.sparkSession):
        return _fitted(base, *how, keep)


def _fitted(base: DataFrame, order: int, cut: int, parts: int | None, model: str | None, keep: bool) -> dict:
    """Everything but the scores: the tables of a model of base's learned texts and of the stored model, and the discounts."""
    spark = base.sparkSession
    meta = json.loads(spark.read.text(f"{model}/meta").first()[0]) if model else {}
    order = meta.get("order", order)
    tokens = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = meta.get("parts") or parts or max(4, math.ceil(tokens / TOKENS))
    stored = lambda name: spark.read.schema(_KINDS).parquet(f"{model}/{name}") if model else None
    totals = word_totals(base, parts, stored("words"), cut, keep)
    sums = [0] * (max(FIT, cut + 1) + 2)
    for r in totals.filter(F.col("batch") == OF_PART).select("data").toLocalIterator():  # a row a part
        sums = [a + int(b) for a, b in zip(sums, unpack(r.data)[0])]
    n, v, counts = sums[0], sums[1], sums[2:]
    d1 = discounts(counts, cut, "words")
    # What learned words leave: the discounted share of words of each small count.
    unknown = sum((1 - d) * r * counts[r - 1] for r, d in enumerate(d1, 1)) / n if n else 1.0
    unknown = unknown if unknown > 0 else 1.0 / (n + 1)
    split = meta.get("split") or max(1, n // (4 * parts))  # what has more tokens is dealt to several parts
    unigram = lambda c: _unigram(c, n, d1, unknown)
    slots, pair_slots, d2, pairs = _Slots(spark, "katz-word-answers"), None, [], None
    slots.write(totals)
    if order == 3:
        pairs = pair_parts(base, slots, parts, split, unigram, stored("pairs"), cut, keep)
        pair_counts, wide = wide_stats(pairs, cut, split)
        d2 = discounts(pair_counts, cut, "pairs")
        pair_slots = _Slots(spark, "katz-pair-answers")
        pair_slots.write(pair_answers(pairs, cut, split, wide, d2))
    if not keep:
        for done in (totals, pairs):
            if done is not None:
                _discard(done)
    tops, times = None, min(PASSES, parts)
    for k in range(times):
        share = (k * parts // times, (k + 1) * parts // times)
        got = top_parts(base, slots, pair_slots, parts, split, n, v, unigram, d2, stored("tops"), cut, keep, share)
        tops = got if tops is None else tops.unionByName(got)
    _discard(base)
    for done in (slots, pair_slots):
        if done is not None:
            _delete(spark, done.path)
    top_counts, wide = wide_stats(tops, cut, split)
    d = discounts(top_counts, cut, "triples" if order == 3 else "pairs")
    return {"order": order, "cut": cut, "parts": parts, "split": split, "n": n, "v": v, "d1": d1, "d2": d2, "d": d, "unknown": unknown, "wide": wide, "words": totals, "pairs": pairs, "tops": tops}


def scored(docs: DataFrame, cut: int = CUT, order: int = 2, parts: int | None = None, model: str | None = None) -> DataFrame:
    """docs (doc_id, train, held_out, text). Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    The model is learned from the rows that train marks or, if model names one, is the one stored there."""
    fit = _fit(batches(docs.withColumn("train", F.lit(False)) if model else docs), order, cut, parts, model)
    n, d, split, wide, tops = fit["n"], fit["d"], fit["split"], fit["wide"], fit["tops"]

    def sums_of(t):
        """Of a part, with the discounts known: per batch the sum for each text."""
        import numpy as np

        names, data = t.column("batch").to_pylist(), t.column("data").to_pylist()
        _, hcount, alpha, below = weights_of(data[names.index(OF_PART)], cut, split, wide, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            back, more = np.log10(alpha), np.log10(np.where(hcount > 0, hcount / below, 1.0))
        rows = []
        for name, raw in zip(names, data):
            if name < 0:
                continue
            plain, *rest = unpack(raw)
            by_count, (bh, bd, bn, oh, od, on) = rest[:cut], rest[cut:]
            total = plain + sum(math.log10(x) * k for x, k in zip(d, by_count))
            total += np.bincount(bd.astype(np.int64), weights=back[rising(bh)] * bn, minlength=len(total))
            total += np.bincount(od.astype(np.int64), weights=more[rising(oh)] * on, minlength=len(total))
            rows.append((name, pack(total)))
        return _table_of(0, rows)

    def finish(t):
        import numpy as np
        import pyarrow as pa

        parts_of, data = t.column("part").to_pylist(), t.column("data").to_pylist()
        base_score, known, sizes, held, ids, null = unpack(data[parts_of.index(-1)])
        score = np.zeros(len(sizes))
        for p, raw in zip(parts_of, data):
            if p >= 0:
                (x,) = unpack(raw)
                score[: len(x)] += x
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(held == 1), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(sizes), n, np.int64)), "base_score": base_score, "score": score})

    texts = tops.filter((F.col("part") >= 0) & (F.col("batch") != STORED)).groupBy("part").applyInArrow(sums_of, _KINDS)
    every = texts.unionByName(tops.filter("part < 0"))
    return every.groupBy("batch").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learned(docs: DataFrame, to: str, order: int = ORDER, cut: int = CUT, parts: int | None = None) -> str:
    """Learns from the rows of docs (doc_id, train, held_out, text) that train marks and writes the model's tables to a folder."""
    spark = docs.sparkSession
    fit = _fit(batches(docs.filter("train")), order, cut, parts, None, keep=True)
    for name in ("words", "pairs", "tops"):
        if fit[name] is not None:
            kept = fit[name].filter((F.col("batch") == STORED) & (F.col("part") >= 0)).select("batch", "part", "data")
            kept.withColumn("p", F.col("part")).repartition(F.col("part")).write.partitionBy("p").parquet(f"{to}/{name}")
    meta = {k: fit[k] for k in ("order", "cut", "parts", "split", "n", "v", "d1", "d2", "d", "unknown")}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{to}/meta")
    return to


def probabilities(spark: SparkSession, model: str) -> DataFrame:
    """A stored model's highest order as rows: part, u, v, w (numbers of words), count, probability, and backoff, the
    weight of the lower order after u v. Only histories that lie in one part."""
    meta = json.loads(spark.read.text(f"{model}/meta").first()[0])
    cut, d, split, order = meta["cut"], meta["d"], meta["split"], meta["order"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, u, w, cv, alpha, more, ch, cw, cvw, count, _, _ = read_top(raw)
                if not len(v):
                    continue
                lower = _unigram(cw, meta["n"], meta["d1"], meta["unknown"])
                if order == 3:
                    lower = katz_probability(cvw, cv + more, alpha, lower, meta["d2"])
                starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]))
                small, big, share, _ = level_sums(count, starts, lower, cut, max(FIT, cut + 1))
                weight, below = backoff(ch[starts], small, big, share, d)
                n = np.diff(np.append(starts, len(v)))
                p = katz_probability(count, np.repeat(below, n), 0.0, 0.0, d)
                on = ch <= split
                yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (np.full(len(v), part, np.int32), u, v, w, count, p, np.repeat(weight, n))], names=["part", "u", "v", "w", "count", "probability", "backoff"])

    return spark.read.schema(_KINDS).parquet(f"{model}/tops").select("part", "data").mapInArrow(run, "part int, u long, v long, w long, count long, probability double, backoff double")


def training_view(docs: DataFrame) -> DataFrame:
    """(doc_id, train, held_out, text): held out are those whose crc32 of the id is 2 modulo 7."""
    m = crc_mod(F.col("doc_id"), 7)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(m != 2, F.lit(False)).alias("train"), F.coalesce(m == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(training_view(table(spark, sf_dir, "documents")), order=ORDER)
