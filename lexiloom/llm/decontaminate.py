"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased). A document leaks an item if some passage of it is within floor(EDIT_SHARE * n) word edits (insert,
delete, substitute) of the item's n words.

*CGK embedding.* A walk reads a sequence with a pointer that a random bit of (step, word) moves on or holds at each
step; what the walk reads is the embedding. Two sequences at edit distance k walk apart and fall in step again, so
their embeddings differ in O(k * k) places. *LSH.* Each of REPETITIONS walks samples BITS places of the embedding as
its key; a window whose key equals an item's is a candidate. *Windows.* A window starts at every word (long
items: at every few words, see THIN) and is as long as the item. Windows that hold too few words of every item are not embedded; the test is lossless: of an item with q
rare words (rare in the benchmark), a passage within k edits keeps at least q - k. *Verification.* The least edit
distance between the item and any passage about its candidate windows, by dynamic programming. *Rest.* Keys can miss a
leak, more so the longer the item and the more words were dropped. So the same test is made once more, for the edits
that a passage may have to be as near as what a document's candidates gave (or within the limit, where they gave
nothing), and what passes it is verified too. Leaks, edits and ends are therefore exact; good candidates save work.

Items are held by every task; they are taken in blocks of at most ITEM_WORDS words, one pass over the documents a
block. Texts are read in whole, whatever their length.

Defined cases: null and empty texts leak nothing; items without a word are no evidence; so are, by default, items of
fewer than MIN_WORDS words (min_words=1 takes them all, which the query and the pipeline do: for fewer than five words
the limit is no edit, so such items are matched exactly); repeated items each count; a null id is reported as null (and such a row is dropped by
`clean` like any other); repeated rows each count; other columns are ignored by `leaks` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import fresh, ship, table, trim

EDIT_SHARE = 0.2
MIN_WORDS = 5
REPETITIONS = 32
BITS = 3
#: Words of items that a task holds at once.
ITEM_WORDS = 2_000_000
#: Windows of THIN words or more start at every (words / THIN)-th word only.
THIN = 150
#: Cells of the tables of edit distances that are worked on at once.
CELLS = 2_000_000
#: A word is rare in the benchmark if at most this share of items (but two at least) hold it.
RARE_SHARE = 0.02
SEED = 0x5DEECE66D


def _merged(doc, item, lo, hi):
    """Overlapping ranges of the same document and item as one."""
    import numpy as np

    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    return doc[at], item[at], lo[at], np.maximum.reduceat(hi, at)


class Finder:
    """Finds leaks of a block of items; built once in each worker."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE, repetitions: int = REPETITIONS, bits: int = BITS, min_words: int = MIN_WORDS):
        import numpy as np
        import pyarrow as pa

        from lexiloom.llm import textvec as tv

        self.alphabet = tv.lettered()
        ids, seqs = [], []
        for i, j, h, first in tv.hashed(pa.array([t for _, t in items], pa.string()), self.alphabet):
            for x in range(j - i):
                if first[x + 1] - first[x] >= max(1, min_words):
                    ids.append(items[i + x][0])
                    seqs.append(h[first[x] : first[x + 1]])
        self.ids, self.seqs, self.rep, self.bits = ids, seqs, repetitions, bits
        self.len = np.array([len(s) for s in seqs], np.int64)
        self.k = np.floor(self.len * share).astype(np.int64)
        if not seqs:
            return
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.at = rng.random((repetitions, bits))  # sampled places, as shares of twice the length
        self._count_filter()
        n = self.len
        flat, start = np.concatenate(seqs), np.concatenate([[0], np.cumsum(n)[:-1]])
        keys = np.empty((repetitions, len(n)), np.uint64)
        by = np.argsort(n, kind="stable")
        for part in self._slices(n[by]):
            at = by[part]
            keys[:, at] = self.keys(flat, start[at], start[at] + n[at], n[at])
        self.tables = []
        for r in range(repetitions):
            order = np.argsort(keys[r], kind="stable")
            self.tables.append((keys[r][order], order))

    def _count_filter(self):
        """Events: rare words of each item, with the number of them that a passage within k edits must keep."""
        import numpy as np

        item = np.repeat(np.arange(len(self.seqs)), self.len)
        word = np.concatenate(self.seqs)
        pairs = np.unique(np.stack([word, item.astype(np.uint64)]), axis=1)
        values, held_by = np.unique(pairs[0], return_counts=True)
        often = held_by > max(2, int(RARE_SHARE * len(self.seqs)))
        common = values[often]
        rare = ~np.isin(word, common)
        q = np.bincount(item, weights=rare, minlength=len(self.seqs)).astype(np.int64)
        use_all = q - self.k < 1  # an item of common words goes by all of its words
        self.need = np.where(use_all, self.len - self.k, q - self.k)
        keep = np.isin(pairs[0], common, invert=True) | use_all[pairs[1].astype(np.int64)]
        w, i = pairs[0][keep], pairs[1][keep].astype(np.int64)
        order = np.argsort(w, kind="stable")
        self.ev_word, self.ev_item = w[order], i[order]
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.ev_word & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _slices(self, n, most: int = 512):
        """Slices of windows, ordered by length, that walk together."""
        for lo in range(0, len(n), most):
            yield slice(lo, lo + most)

    def moves(self, step: int, count: int):
        """The multipliers of the walks at steps step .. step + count - 1, steps x repetitions x 1."""
        import numpy as np

        from lexiloom.llm import textvec as tv

        at = np.arange(step * self.rep, (step + count) * self.rep, dtype=np.uint64)
        return (tv.mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) | np.uint64(1)).reshape(count, self.rep, 1)

    def keys(self, words, start, end, n):
        """LSH keys, repetitions x windows, of the windows [start, end) of words; n: the length that places refer to.
        Only the sampled places of an embedding are kept, so memory doesn't grow with the length."""
        import numpy as np

        from lexiloom.llm import textvec as tv

        padded = np.append(words, np.uint64(0))
        m, last = len(start), len(words)
        steps = 2 * int(n.max())
        place = (self.at[:, :, None] * (2 * n)[None, None, :]).astype(np.int64)  # repetitions x bits x windows
        order = np.argsort(place, axis=None, kind="stable")
        cuts = np.searchsorted(place.ravel()[order], np.arange(steps + 1))
        of = order // (self.bits * m) * m + order % m  # repetition and window of each
        seen = np.empty(place.size, np.uint64)
        i = np.broadcast_to(start, (self.rep, m)).copy()
        for step in range(steps):
            if step % 256 == 0:
                move = self.moves(step, min(256, steps - step))
            x = padded[np.where(i < end, i, last)]
            lo, hi = cuts[step], cuts[step + 1]
            if hi > lo:
                seen[order[lo:hi]] = x.ravel()[of[lo:hi]]
            i += ((x * move[step % 256] >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        seen = seen.reshape(place.shape)
        key = np.zeros((self.rep, m), np.uint64)
        for b in range(self.bits):
            key = tv.mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, b] + np.uint64(b + 1))
        return tv.mix(key + n.astype(np.uint64)[None, :])

    def _events(self, h, first):
        """(position, item, document) of words that count for an item, by item and position."""
        import numpy as np

        at = np.flatnonzero(self.bloom[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.ev_word, h[at], "left"), np.searchsorted(self.ev_word, h[at], "right")
        many = hi - lo
        pos = np.repeat(at, many)
        item = self.ev_item[np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)] if len(pos) else np.zeros(0, np.int64)
        order = np.lexsort((pos, item))
        pos, item = pos[order], item[order]
        return pos, item, np.searchsorted(first, pos, "right") - 1

    def _passing(self, events, bound):
        """(position, last position, span, item, document) of events that begin as many as a passage within bound edits
        keeps, in no more words than it has; bound: for each event."""
        import numpy as np

        pos, item, doc = events
        need, span = self.need[item] + self.k[item] - bound, self.len[item] + bound
        to = np.arange(len(pos)) + need - 1
        ok = to < len(pos)
        to = np.where(ok, to, 0)
        ok &= (item[to] == item) & (pos[to] - pos < span) & (doc == doc[to])
        return pos[ok], pos[to[ok]], span[ok], item[ok], doc[ok]

    def windows(self, events, first):
        """(start, end, n): the windows to embed. Every start is taken from which some item could be within its edits."""
        import numpy as np

        pos, to, span, item, doc = self._passing(events, self.k[events[1]])
        a = np.maximum(first[doc], to - span + 1)
        per = pos - a + 1
        start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(a, per)
        n = np.repeat(self.len[item], per)
        # A shift of few words keeps most of a long window's embedding: starts are thinned by length; `rest` misses none.
        on = start % np.maximum(1, n // THIN) == 0
        start, n = start[on], n[on]
        both = np.unique(np.stack([start, n]), axis=1)
        start, n = both[0], both[1]
        doc = np.searchsorted(first, start, "right") - 1
        return start, np.minimum(start + n, first[doc + 1]), n, doc

    def rest(self, events, first, found):
        """(document, item, lo, hi): where passages as near as found, {(document, item): (edits, end)}, or within the
        limit may be; in pieces, so that a long stretch doesn't hold up the others."""
        import numpy as np

        pos, item, doc = events
        bound = self.k[item]
        if found:
            known = np.array(sorted(d * len(self.ids) + i for d, i in found), np.int64)
            least = np.array([found[divmod(x, len(self.ids))][0] for x in known.tolist()], np.int64)
            key = doc * len(self.ids) + item
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            bound = np.where(known[at] == key, least[at], bound)
        pos, to, span, item, doc = self._passing(events, bound)
        if not len(pos):
            return (np.zeros(0, np.int64),) * 4
        doc, item, lo, hi = _merged(doc, item, np.maximum(first[doc], to - span + 1), np.minimum(first[doc + 1], pos + span))
        most = (self.len + self.k)[item]  # no passage is longer
        pieces = np.maximum(1, -((most - (hi - lo)) // (3 * most)))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        doc, item, lo, hi, most = (np.repeat(x, pieces) for x in (doc, item, lo, hi, most))
        lo = lo + nth * 3 * most
        return doc, item, lo, np.minimum(hi, lo + 4 * most)

    def candidates(self, h, first, events):
        """(document, item, first start, last start) of windows that share a key with an item."""
        import numpy as np

        start, end, n, doc = self.windows(events, first)
        order = np.argsort(n, kind="stable")  # windows of like length walk together
        start, end, n, doc = start[order], end[order], n[order], doc[order]
        got = []
        for part in self._slices(n):
            lo, s, e, m = part.start, start[part], end[part], n[part]
            keys = self.keys(h, s, e, m)
            for r, (known, rank) in enumerate(self.tables):
                a, b = np.searchsorted(known, keys[r], "left"), np.searchsorted(known, keys[r], "right")
                hit = np.flatnonzero(b > a)
                c = (b - a)[hit]
                items = rank[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(a[hit], c)]
                got.append(np.stack([np.repeat(doc[lo + hit], c), items, np.repeat(s[hit], c)]))
        if not got:
            return np.zeros((3, 0), np.int64)
        return np.unique(np.concatenate(got, axis=1), axis=1)

    def distances(self, h, lo, hi, item):
        """Least edit distance, and where it ends, between an item and any passage of h[lo:hi], for many at once."""
        import numpy as np

        best = np.empty(len(lo), np.int64)
        stop = np.empty(len(lo), np.int64)
        padded = np.append(h, np.uint64(0))
        for n in np.unique(self.len[item]):
            rows = np.flatnonzero(self.len[item] == n)
            rows = rows[np.argsort((hi - lo)[rows], kind="stable")]  # passages of like length together
            for part in np.array_split(rows, max(1, len(rows) // max(1, min(512, CELLS // int(n + 1))))):
                pat = np.stack([self.seqs[x] for x in item[part]])
                steps = np.arange(n + 1)
                d = np.broadcast_to(steps, (len(part), n + 1)).copy()
                least, where = d[:, n].copy(), lo[part].copy()
                for t in range(int((hi[part] - lo[part]).max())):
                    on = lo[part] + t < hi[part]
                    w = padded[np.where(on, lo[part] + t, len(h))]
                    new = d + 1
                    new[:, 0] = 0
                    new[:, 1:] = np.minimum(new[:, 1:], d[:, :-1] + (pat != w[:, None]))
                    new = np.minimum.accumulate(new - steps, axis=1) + steps
                    better = on & (new[:, n] < least)
                    least[better] = new[better, n]
                    where[better] = (lo[part] + t + 1)[better]
                    d = np.where(on[:, None], new, d)
                best[part], stop[part] = least, where
        return best, stop

    def leaks(self, h, first):
        """(document, item index, distance, end word) of all verified leaks, each document and item once."""
        import numpy as np

        if not self.ids or not len(h):
            return []
        events = self._events(h, first)
        found: dict[tuple[int, int], tuple[int, int]] = {}

        def verify(doc, item, lo, hi):
            best, stop = self.distances(h, lo, hi, item)
            for x in np.flatnonzero(best <= self.k[item]).tolist():
                key, value = (int(doc[x]), int(item[x])), (int(best[x]), int(stop[x] - first[doc[x]]))
                found[key] = min(found.get(key, value), value)

        doc, item, start = self.candidates(h, first, events)
        if len(doc):
            k, n = self.k[item], self.len[item]
            verify(*_merged(doc, item, np.maximum(start - k, first[doc]), np.minimum(start + n + 2 * k, first[doc + 1])))
        verify(*self.rest(events, first, found))
        return [(d, i, dist, end) for (d, i), (dist, end) in sorted(found.items())]


def item_blocks(items: DataFrame, most_words: int = ITEM_WORDS):
    """Blocks of (item_id, text) of bounded size, as lists; the blocks are made by running sums over the items."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    block, words = [], 0
    for r in rows.toLocalIterator():  # the driver holds a block at a time
        n = len(r.text.split()) + 1
        if block and words + n > most_words:
            yield block
            block, words = [], 0
        block.append((r.item_id, r.text))
        words += n
    if block:
        yield block


_FINDERS: dict[str, Finder] = {}


def _finder(name: str, block, share: float, min_words: int) -> Finder:
    """The index of a block, made once in a worker process; the last one is kept."""
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = Finder(block(), share, min_words=min_words)
    return _FINDERS[name]


def _scan(docs: DataFrame, block, schema: T.StructType, emit, share: float, min_words: int):
    """mapInArrow over docs, whose last column is the text; emit(batch, i, j, leaks) makes the record batches."""
    import uuid

    spark = docs.sparkSession
    ship(spark)
    held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex  # at most ITEM_WORDS words

    def run(batches):
        from lexiloom.llm import textvec as tv

        finder = _finder(name, lambda: held.value, share, min_words)
        for b in batches:
            for i, j, h, first in tv.hashed(b.column(b.num_columns - 1), finder.alphabet):
                yield from emit(finder, b, i, j, finder.leaks(h, first))
            trim()

    return docs.mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text). One row per document and item that it leaks: doc_id, item_id, edits
    (the least word edits) and end_word (where the passage ends)."""
    schema = "doc_id long, item_id long, edits long, end_word long"

    def emit(finder, b, i, j, found):
        import pyarrow as pa

        if found:
            ids = b.column(0).slice(i, j - i)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([f[0] for f in found])), pa.array([finder.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], names=["doc_id", "item_id", "edits", "end_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(item_blocks(items)):
        got = _scan(rows, block, schema, emit, share, min_words)
        out = out.unionByName(got) if n else got
    return out


def clean(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that leak no item, in one pass a block of items."""
    names, schema = docs.columns, docs.schema
    out = docs

    def emit(finder, b, i, j, found):
        import pyarrow as pa

        drop = {f[0] for f in found}
        rows = [i + x for x in range(j - i) if x not in drop]
        if rows:
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(rows)) for c in range(len(names))], names=names)

    for block in item_blocks(items):
        out = _scan(out.select("*", F.col("text").cast("string").alias(fresh(out, "_scanned"))), block, schema, emit, share, min_words)
    return out


def op8_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)
