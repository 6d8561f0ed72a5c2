"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the multiset of its five-word shingles (words are runs of ASCII letters and digits and of non-ASCII
characters, A-Z lower-cased; fewer than five words make one shingle); a shingle's weight is how often it occurs. Similarity is the probability Jaccard index
of those weights, which is the Jaccard index where all weights agree. Each shingle is a Poisson process whose rate is
its weight; an arrival falls on one of REGISTERS registers at random, and a register keeps the shingle that arrives
first. Arrivals come in increasing order, so a shingle stops once it is later than every register of its document.
Two documents agree in a register with probability equal to their similarity; BANDS bands of ROWS registers propose
candidates, and candidates are verified exactly.

*Groups.* Texts of equal shingle multisets are one node from the start. Nodes that buckets connect are a family. Small
families go many to a task, each node once, and all pairs of a bucket are verified there but for those already connected.
In families of more than TILE nodes, each node goes once to its largest bucket: whole buckets meet in one task, those of
more than TILE nodes in shares, each with the bucket's centre. That joins groups of near copies at the cost of a move a
node. What is left are buckets whose nodes aren't all connected. Their commonest component is a hub: its nodes are dealt out in
tiles, once for all of their buckets, and the others meet every tile, so no link between components is lost. Only links that join something come out of
a task, so a group of n copies makes about n rows.

Miss rate at similarity s: (1 - s**ROWS)**BANDS, 5e-5 at 0.8. Five-word shingles at 0.8 mean few edits: a word changed in
every w words breaks 5 / w of the shingles or so, and 0.8 is reached at about one changed word in 45.

Defined cases: null and empty texts, and those without a word, have no shingles and are classes by themselves; null ids
get a null class (`op1_probminhash_dedup`) and stay (`deduplicated`); in `classes` rows that repeat an id are one document
with the texts of all, while `deduplicated` judges each text of an id by itself, so that a different text under the same
id isn't lost; very long texts are shingled in whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, ship, spread_join, staged, table, trim
from lexiloom.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Buckets of up to SMALL nodes are compared pair by pair, others with an inverted index, in tiles of TILE nodes.
SMALL, TILE = 8, 1024


def weighted_shingles(h, first, k: int = WORDS):
    """(document, hash, weight), sorted by document and hash."""
    import numpy as np

    from lexiloom.llm import textvec as tv

    doc, s = tv.shingles(h, first, k)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    if not len(s):
        return doc, s, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], s[new], np.diff(np.append(new, len(s)))


def probminhash(doc, s, w, n_docs: int, registers: int):
    """Signatures, n_docs x registers, of weighted shingles: for each register the hash of the shingle that is first."""
    import numpy as np

    from lexiloom.llm import textvec as tv

    least = np.full(n_docs * registers, np.inf)
    sig = np.zeros(n_docs * registers, dtype=np.uint64)
    at, ident, rate = doc, s, w.astype(np.float64)
    time, k = np.zeros(len(s)), 0
    while len(at):
        k += 1
        r = tv.mix(ident + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log1p(-((r >> np.uint64(12)).astype(np.float64) * 2.0**-52))
        slot = at * registers + ((tv.mix(r) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        x = time / rate
        np.minimum.at(least, slot, x)
        won = least[slot] == x
        sig[slot[won]] = ident[won]
        last = least.reshape(n_docs, registers).max(1)
        on = x < last[at]
        at, ident, rate, time = at[on], ident[on], rate[on], time[on]
    return sig.reshape(n_docs, registers)


def band_keys(sig, bands: int, rows: int):
    import numpy as np

    from lexiloom.llm import textvec as tv

    parts = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), parts.shape[:2]).copy()
    for x in range(rows):
        out = tv.mix(out * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, x])
    return out.view(np.int64)


def shingle_digest(s, w) -> bytes:
    import hashlib

    import numpy as np

    return hashlib.blake2b(np.stack([s, w.astype(np.uint64)], axis=1).tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text). Per row with an id and a word: doc_id, h (hash of the text), digest of its shingle multiset, keys
    (a long per band)."""
    ship(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from lexiloom.llm import textvec as tv

        alphabet = tv.lettered()
        for b in batches:
            for i, j, h, first in tv.hashed(b.column(2), alphabet):
                doc, s, w = weighted_shingles(h, first, k)
                keys = band_keys(probminhash(doc, s, w, j - i, bands * rows), bands, rows)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                some = np.flatnonzero(np.diff(cut))
                digest = [shingle_digest(s[cut[x] : cut[x + 1]], w[cut[x] : cut[x + 1]]) for x in some]
                flat = keys[some].ravel()
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * bands, pa.array(flat, pa.int64()))
                own = [b.column(c).slice(i, j - i).take(pa.array(some)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digest, pa.binary()), lists], names=["doc_id", "h", "digest", "keys"])
            trim()

    rows_in = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, h long, digest binary, keys array<long>")


def shingle_sets(dealt: DataFrame, k: int = WORDS) -> DataFrame:
    """dealt (grp, lo, hi, own, node, label, keys, digest) with text. In place of digest and text: hashes and weights of the
    shingles as bytes, sorted by hash. Rows whose text isn't the node's (an id may have several) are left out."""
    ship(dealt.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from lexiloom.llm import textvec as tv

        alphabet = tv.lettered()
        for b in batches:
            for i, j, h, first in tv.hashed(b.column(8), alphabet):
                doc, s, w = weighted_shingles(h, first, k)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                want = b.column(7).slice(i, j - i).to_pylist()
                parts = [(s[cut[x] : cut[x + 1]], w[cut[x] : cut[x + 1]]) for x in range(j - i)]
                on = [x for x in range(j - i) if shingle_digest(*parts[x]) == want[x]]
                hs = [parts[x][0].astype("<u8").tobytes() for x in on]
                ws = [b"" if parts[x][1].max(initial=1) == 1 else parts[x][1].astype("<u4").tobytes() for x in on]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i).take(pa.array(on, pa.int64())) for c in range(7)), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], names=["grp", "lo", "hi", "own", "node", "label", "keys", "hs", "ws"])
            trim()

    kinds = "grp string, lo int, hi int, own int, node long, label long, keys array<long>, hs binary, ws binary"
    return dealt.select("grp", "lo", "hi", "own", "node", "label", "keys", "digest", "text").mapInArrow(run, kinds)


def probability_jaccard(ha, wa, hb, wb) -> float:
    """Exact, of two weighted sets given by sorted hashes and weights: the sum over common d of
    1 / sum over all e of max(wa[e] / wa[d], wb[e] / wb[d]). The inner sums depend on wb[d] / wa[d] alone, so sorting
    all e by that ratio turns them into differences of running sums."""
    import numpy as np

    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(ia) / (len(ha) + len(hb) - len(ia))
    x, y = wa.astype(np.float64), wb.astype(np.float64)
    only_b = np.ones(len(y), bool)
    only_b[ib] = False
    pair = np.zeros(len(x))
    pair[ia] = y[ib]
    ratio = pair / x  # wb / wa, 0 where only in a
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], pair[order]
    below = np.concatenate([[0.0], np.cumsum(xs)])
    above = np.concatenate([np.cumsum(ys[::-1])[::-1], [0.0]]) + y[only_b].sum()
    rho = y[ib] / x[ia]
    at = np.searchsorted(r, rho, "right")
    # sum over e of max(wa[e], wb[e] / rho), divided by wa[d]
    return float((x[ia] / (below[at] + above[at] / rho)).sum())


def _share(column: str, of, salt: int = 0):
    """Which of `of` shares a node is in."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), of).cast("int")


def _placed(rows: DataFrame, grp, lo, hi) -> DataFrame:
    return rows.select(grp.alias("grp"), lo.alias("lo"), hi.alias("hi"), "own", "node", "label", "keys", "doc_id", "digest")


def dealt_small(docs: DataFrame, chunks: int) -> DataFrame:
    """docs (node, keys, family, doc_id, digest) of small families, to tasks of whole families."""
    grp = F.concat(F.lit("c"), F.pmod(F.xxhash64("family"), F.lit(chunks)).cast("string"))
    own = F.lit(0).cast("int")
    return _placed(docs.withColumn("own", own).withColumn("label", F.col("node")), grp, own, own)


def dealt_by_bucket(docs: DataFrame, members: DataFrame, chunks: int, tile: int) -> DataFrame:
    """docs (node, keys, doc_id, digest) of large families; members (node, key, centre, n) of them. Each node once to its largest bucket,
    and a bucket's centre to all of its shares."""
    top = members.groupBy("node").agg(F.max(F.struct("n", "key", "centre")).alias("m")).select("node", "m.*")
    shares = F.ceil(F.col("n") / F.lit(float(tile))).cast("int")
    at = docs.join(top, "node").withColumn("own", F.when(F.col("n") > tile, _share("node", shares)).otherwise(F.lit(0)).cast("int"))
    grp = F.when(F.col("n") > tile, F.concat(F.lit("b"), F.col("key").cast("string"))).otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("string")))
    large = at.filter(F.col("n") > tile).groupBy("key", "centre").agg(F.max("own").alias("last"), F.max("n").alias("n"))
    centres = large.join(docs.withColumnRenamed("node", "centre"), "centre").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("node", F.col("centre"))
    out = lambda df: _placed(df.withColumn("label", F.col("node")), grp, F.col("own"), F.col("own"))
    return out(at).unionByName(out(centres))


def dealt_rest(members: DataFrame, labels: DataFrame, chunks: int, tile: int) -> DataFrame:
    """members (node, key) of large families, labels (node, label, doc_id, digest): what is left in buckets of several labels.
    The commonest label of a bucket is its hub. Nodes meet by hub, once for all of their buckets: the hub's own nodes are
    tiles that needn't meet each other, and the others meet every tile."""
    # Joined a row a node, and only then a row a key.
    rows = members.groupBy("node").agg(F.collect_list("key").alias("own_keys")).join(labels, "node").withColumn("key", F.explode("own_keys")).drop("own_keys")
    per = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("kinds")).filter("kinds > 1").select("key", F.col("m.label").alias("hub"))
    at = rows.join(mixed, "key").groupBy("node", "hub").agg(*[F.first(c).alias(c) for c in ("label", "doc_id", "digest")], F.collect_list("key").alias("keys"))
    at = staged(at, "minhash-mixed")  # a key a band at most
    major = F.col("label") == F.col("hub")
    tiles = lambda x: F.ceil(x / F.lit(float(tile))).cast("int")
    sizes = at.groupBy("hub").agg(F.count("*").alias("n"), tiles(F.count_if(major)).alias("k"), tiles(F.count_if(~major)).alias("r"))
    at = spread_join(at, sizes, "hub", "node")
    whole = F.col("n") <= tile
    at = at.withColumn("own", F.when(whole, F.lit(0)).when(major, _share("node", F.col("k"), 1)).otherwise(F.col("k") + _share("node", F.col("r"), 2)).cast("int"))
    others = F.when(whole, F.array(F.lit(0))).when(major, F.sequence(F.col("k"), F.col("k") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") + F.col("r") - 1))
    grp = F.when(whole, F.concat(F.lit("m"), F.pmod(F.xxhash64("hub"), F.lit(chunks)).cast("string"))).otherwise(F.concat(F.lit("t"), F.col("hub").cast("string")))
    return _placed(at.withColumn("other", F.explode(others)), grp, F.least("own", "other"), F.greatest("own", "other"))


def bucket_links(sets: DataFrame, threshold: float) -> DataFrame:
    """sets of shingle_sets. Compares all nodes of a bucket that aren't connected yet (labels are) and returns the links
    (a, b) found: a spanning forest of them in each task."""
    ship(sets.sparkSession)

    def compare(t):
        import numpy as np
        import pyarrow as pa

        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        own, ids = t.column("own").to_numpy(), t.column("node").to_numpy()
        keys = t.column("keys").combine_chunks()
        key, holder = keys.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy()))
        hs = [np.frombuffer(x, "<u8") for x in t.column("hs").to_pylist()]
        ws = [np.frombuffer(x, "<u4") if x else np.ones(len(h), np.uint32) for x, h in zip(t.column("ws").to_pylist(), hs)]
        size = np.array([len(h) for h in hs])
        label = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
        known: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []

        def test(x: int, y: int):
            pair = (x, y) if x < y else (y, x)
            if label[x] == label[y] or pair in known:
                return
            known.add(pair)
            # the similarity is at most the smaller set's share of the larger where no weight is above one
            if ws[x].max() == 1 == ws[y].max() and min(size[x], size[y]) < threshold * max(size[x], size[y]):
                return
            if probability_jaccard(hs[x], ws[x], hs[y], ws[y]) >= threshold:
                label[label == label[y]] = label[x]
                out.append((int(ids[x]), int(ids[y])))

        def large(left, right):
            """An inverted index gives the overlaps of a node with all of right at once."""
            if not len(left) or not len(right) or (label[right] == label[left[0]]).all() and (label[left] == label[left[0]]).all():
                return
            flat, doc = np.concatenate([hs[z] for z in right]), np.repeat(np.arange(len(right)), size[right])
            part = np.concatenate([ws[z] / ws[z].sum() for z in right])
            order = np.argsort(flat, kind="stable")
            flat, doc, part = flat[order], doc[order], part[order]
            for x in left.tolist():
                if (label[right] == label[x]).all():
                    continue
                a, b = np.searchsorted(flat, hs[x], "left"), np.searchsorted(flat, hs[x], "right")
                c = b - a
                at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(a, c)
                # probability Jaccard is at most the share of either that is common
                of_them = np.bincount(doc[at], weights=part[at], minlength=len(right))
                of_x = np.bincount(doc[at], weights=np.repeat(ws[x] / ws[x].sum(), c), minlength=len(right))
                for y in right[(of_them >= threshold - 1e-9) & (of_x >= threshold - 1e-9) & (label[right] != label[x])].tolist():
                    test(x, y)

        order = np.argsort(key, kind="stable")
        key, holder = key[order], holder[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for i, j in zip(cuts, cuts[1:]):
            rows = holder[i:j]
            if (label[rows] == label[rows[0]]).all():
                continue
            if len(rows) <= SMALL:
                for m, x in enumerate(rows.tolist()):
                    for y in rows[m + 1 :].tolist():
                        if {int(own[x]), int(own[y])} == {lo, hi}:
                            test(x, y)
            else:
                large(rows[own[rows] == lo], rows[own[rows] == hi])
        hs = ws = key = holder = None
        if len(ids) > SMALL:
            trim()
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return sets.groupBy("grp", "lo", "hi").applyInArrow(compare, "a long, b long")


def node_links(nodes: DataFrame, texts: DataFrame, threshold: float, k: int, tile: int = TILE) -> DataFrame:
    """nodes (node, first, digest, keys), texts (doc_id, text). Links (a, b) between nodes."""
    exploded = nodes.select("node", F.explode("keys").alias("key")).distinct()
    buckets = exploded.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = staged(exploded.join(buckets, "key"), "minhash-members")  # (key, node, centre, n)
    family = components(members.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    docs = members.groupBy("node").agg(F.collect_list("key").alias("keys"))  # a key a band at most
    docs = docs.join(family, docs.node == family.node).select(docs.node, "keys", F.col("component").alias("family"))
    sizes = docs.groupBy("family").agg(F.count("*").alias("size"))
    own = nodes.select("node", F.col("first").alias("doc_id"), "digest")
    docs = staged(spread_join(docs, sizes, "family", "node").join(own, "node"), "minhash-families")
    n, wide = docs.agg(F.count("*"), F.count_if(F.col("size") > tile)).first()
    chunks = n // 2000 + 1
    # Texts are read again, for candidates only, and go to their tasks as shingles: those are moved once.
    met = lambda dealt: bucket_links(shingle_sets(texts.join(dealt, "doc_id"), k), threshold)
    first = dealt_small(docs.filter(F.col("size") <= tile), chunks)
    if not wide:
        return met(first)
    large = docs.filter(F.col("size") > tile).select("node", "keys", "doc_id", "digest")
    of_large = members.join(large.select("node"), "node")
    links = staged(met(first.unionByName(dealt_by_bucket(large, of_large, chunks, tile))), "minhash-links")
    joined = components(links).withColumnRenamed("node", "v")
    labels = large.join(joined, F.col("node") == F.col("v"), "left").select("node", F.coalesce("component", "node").alias("label"), "doc_id", "digest")
    return links.unionByName(met(dealt_rest(of_large, staged(labels, "minhash-labels"), chunks, tile)))


def _judged(docs: DataFrame, threshold: float, k: int, bands: int, rows: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (doc_id, h, digest) with a word and an id; groups (digest, c, class_id), c being the component and
    class_id its smallest id. by_id: whether texts of one id are connected."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sig = staged(signatures(texts, k, bands, rows), "minhash-signatures")
    nodes = sig.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id())
    nodes = staged(nodes, "minhash-nodes")  # written, so that the numbers stay
    links = node_links(nodes, texts, threshold, k)
    number = nodes.select("digest", "node", "first")
    if by_id:
        several = sig.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("doc_id")
        held = sig.select("doc_id", "digest").join(several, "doc_id").distinct().join(number, "digest")
        least = held.groupBy("doc_id").agg(F.min("node").alias("b"))
        links = links.unionByName(held.join(least, "doc_id").select(F.col("node").alias("a"), "b"))
    found = components(links).withColumnRenamed("node", "v")
    grouped = staged(number.join(found, F.col("node") == F.col("v"), "left").select("digest", "first", F.coalesce("component", "node").alias("c")), "minhash-groups")
    least = grouped.groupBy("c").agg(F.min("first").alias("class_id"))
    return sig.select("doc_id", "h", "digest"), spread_join(grouped, least, "c", "digest").select("digest", "c", "class_id")


def classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with doc_id and text. Returns one row per distinct id that is not null: doc_id, class_id, the smallest id
    of the documents connected with it by similarity of at least threshold."""
    held, groups = _judged(docs, threshold, k, bands, rows, True)
    of = held.join(groups, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return ids.join(of, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row of docs for each class: one with the smallest id, and of its texts the one with the smallest hash. Each text of
    an id that repeats is judged by itself. Of rows that repeat both id and text one stays. Texts without a word and
    rows with a null id stay."""
    held, groups = _judged(docs, threshold, WORDS, BANDS, ROWS, False)
    every = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    many = every.groupBy("i", "t").agg(F.count("*").alias("n"))
    stays = held.join(groups, "digest").groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("s")).select(F.col("s.doc_id").alias("i"), F.col("s.h").alias("t"))
    wordless = many.select("i", "t").join(held.select(F.col("doc_id").alias("i"), F.col("h").alias("t")), ["i", "t"], "left_anti")
    mark, text, count = fresh(docs, "_id"), fresh(docs, "_h"), fresh(docs, "_n")
    marks = stays.unionByName(wordless).join(many, ["i", "t"]).toDF(mark, text, count)
    kept = docs.join(marks, (docs.doc_id.cast("long") == marks[mark]) & (F.xxhash64(docs.text.cast("string")) == marks[text]))
    once = kept.filter(marks[count] == 1).select(*[docs[c] for c in docs.columns])
    again = kept.filter(marks[count] > 1).groupBy(marks[mark], marks[text]).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("r"))
    return once.unionByName(again.select(*[F.col("r")[c].alias(c) for c in docs.columns])).unionByName(docs.filter("doc_id is null"))


def op1_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, kept (doc_id = class_id); a row with null ids and kept for each row without an id."""
    docs = table(spark, sf_dir, "documents")
    got = classes(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    bare = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return got.unionByName(bare)
