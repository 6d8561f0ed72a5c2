"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors are ordered lexicographically by LEVELS concatenated hash bits. Bit j is the side of a random
direction of the pass's own on which a vector lies, seen from the middle of those that share its first bits: medians of
a sample make the first levels (a random projection tree), means of the sample's leaves the rest. So bits tell vectors
apart in dense regions too, where signs about the origin would all agree. Each vector is compared with its next WINDOW
neighbours in that order and with all of its run (those that share the leading bits down to about WINDOW vectors), and
verified pairs of all passes are united. A pass emits only a spanning forest of the links of each group, so a group of n
near copies costs n rows a pass, not n * n.

*What moves.* A pass doesn't move vectors but one byte a component, with the exact length of the rounding error. That
bounds the cosine from both sides: pairs that are surely links are united at once, pairs that surely aren't are left
out, and the few between, if nothing else joins them in their group, are verified by their vectors in double precision.

*How many passes.* The first number assumes links at the threshold in random directions. Then recall is measured: the
links of QUERIES sampled vectors to all others, by brute force in blocks, against the components found. Passes are
doubled until RECALL of these links lie within components (short of it after MOST_PASSES, an error is raised, as counts would be wrong).

Runs are hash groups of about GROUP vectors. Where a group is longer than LONG groups (vectors that hardly any hash parts),
it is dealt at random, in each pass anew, to groups of that size; a dense crowd is connected by the passes together.

Equal vectors are one class from the start and are joined to it by a digest. Then links are counted exactly inside
each component, small components many a task, large ones by pairs of tiles of TILE vectors; only counts leave them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even
with their like; vectors of different length don't link; rows that repeat a vec_id are vectors of their own, linked
as any others, and one node of the graph; a null vec_id makes a row with no links and null component, not kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import ship, spread_join, staged, table
from lexiloom.llm.graph import components

THRESHOLD = 0.9
WINDOW = 2048
#: The query's, so that a few hundred vectors already go through several passes.
QUERY_WINDOW = 256
LEVELS = 40
#: Vectors of a hash group, and how many times that it may be.
GROUP, LONG = 2048, 4
#: The share of a sample's links that must be found, the sample's size, and a bound on passes.
RECALL, QUERIES, MOST_PASSES = 0.999, 512, 256
#: The sample that the trees are made from: so many vectors, and bytes of them, at most.
SAMPLE, SAMPLE_BYTES, LEAF = 16_384, 32 << 20, 16
MISS = 0.01
TILE = 4096
#: Rows of lists (of long groups, of large components) up to which they are broadcast.
FEW = 100_000
SALTS = 16
SEED = 20_240_501


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes that miss a pair at the threshold with probability under miss, for n vectors in random directions."""
    bits = run_bits(n, window)
    if not bits:
        return 1
    p = 1 - math.acos(threshold) / math.pi
    return max(2, math.ceil(math.log(miss) / math.log(1 - min(p**bits, 0.9))))


def run_bits(n: int, window: int = WINDOW) -> int:
    """Leading bits that vectors of a run share."""
    return min(LEVELS, max(0, math.ceil(math.log2(max(n, 1) / window))))


def unit(raw: bytes | list[bytes], kind: str):
    """Unit vectors in double precision, rows of a matrix, of equally long vectors as stored."""
    import numpy as np

    raw = raw if isinstance(raw, list) else [raw]
    a = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def kind_of(vectors: DataFrame, value: str) -> str:
    """How components are stored: as four-byte floats if they are such, else as doubles."""
    return "<f4" if vectors.schema[value].dataType.simpleString() == "array<float>" else "<f8"


def marked(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, vec, digest): vec is the vector as bytes and digest tells it from others, both null where the vector
    links with nothing."""
    ship(vectors.sparkSession)
    kind = kind_of(vectors, value)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            vec, digest = [], []
            for x in b.column(1):
                a = None if x.as_py() is None or x.values.null_count else np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=kind)
                ok = a is not None and len(a) > 0 and bool(np.isfinite(a).all()) and bool(np.any(a))
                vec.append((a + 0).astype(kind).tobytes() if ok else None)  # adding 0 makes -0 the same
                digest.append(hashlib.blake2b(vec[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "vec", "digest"])

    value_of = F.col(value) if kind == "<f4" else F.col(value).cast("array<double>")
    return vectors.select(F.col(key).cast("long").alias("vec_id"), value_of.alias("v")).mapInArrow(run, "vec_id long, vec binary, digest binary")


def directions(dim: int, which: int):
    import numpy as np

    return np.random.Generator(np.random.PCG64([SEED, dim, which])).standard_normal((LEVELS, dim))


class Order:
    """The hash bits of one pass, for vectors of one length."""

    def __init__(self, sample, which: int):
        """sample: unit vectors, a row each; may be none."""
        import numpy as np

        m, dim = sample.shape
        self.dim, self.which = dim, which
        self.depth = min(LEVELS - 1, max(0, int(math.log2(m / LEAF)))) if m >= LEAF else 0
        at, node, self.split = sample @ directions(dim, which).T, np.zeros(m, np.int64), []
        for j in range(self.depth):
            order = np.lexsort((at[:, j], node))
            count = np.bincount(node, minlength=1 << j)
            start = np.cumsum(count) - count
            mid = lambda k: at[order[np.minimum(start + k, m - 1)], j]
            cut = np.where(count > 0, (mid(np.maximum(count - 1, 0) // 2) + mid(count // 2)) / 2, 0.0)
            self.split.append(cut)
            node = 2 * node + (at[:, j] >= cut[node])
        count = np.maximum(np.bincount(node, minlength=1 << self.depth), 1)
        self.rest = np.stack([np.bincount(node, weights=at[:, j], minlength=1 << self.depth) / count for j in range(self.depth, LEVELS)], axis=1) if m else np.zeros((1, LEVELS))

    def keys(self, vectors):
        import numpy as np

        at, node = vectors @ directions(self.dim, self.which).T, np.zeros(len(vectors), np.int64)
        for j, cut in enumerate(self.split):
            node = 2 * node + (at[:, j] >= cut[node])
        bits = at[:, self.depth :] >= self.rest[node]
        power = np.int64(1) << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64)
        return (node << np.int64(bits.shape[1])) + bits.astype(np.int64) @ power


def rounded(vectors):
    """(bytes a row, scale, length of the error) of unit vectors, a byte a component."""
    import numpy as np

    scale = np.abs(vectors).max(axis=1) / 127
    q = np.rint(vectors / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((vectors - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12


def keyed(reps: DataFrame, kind: str, orders: dict, first: int, last: int) -> DataFrame:
    """reps (vec_id, vec). (vec_id, dim, q, scale, err, keys): keys of the passes first .. last - 1. orders: by dim."""
    ship(reps.sparkSession)
    held = reps.sparkSession.sparkContext.broadcast(orders)  # bounded by SAMPLE, LEVELS and the passes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        made = dict(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                ids, raw = b.column(0).slice(lo, 1024).to_numpy(), b.column(1).slice(lo, 1024).to_pylist()
                sizes = np.array([len(x) for x in raw])
                for size in np.unique(sizes):
                    on = np.flatnonzero(sizes == size)
                    v = unit([raw[x] for x in on], kind)
                    dim = v.shape[1]
                    if dim not in made:
                        made[dim] = [Order(np.zeros((0, dim)), p) for p in range(first, last)]
                    q, scale, err = rounded(v)
                    keys = np.stack([o.keys(v) for o in made[dim]], axis=1)
                    lists = pa.ListArray.from_arrays(np.arange(len(on) + 1, dtype=np.int32) * (last - first), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(np.full(len(on), dim, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale), pa.array(err), lists], names=["vec_id", "dim", "q", "scale", "err", "keys"])

    return reps.select("vec_id", "vec").mapInArrow(run, "vec_id long, dim int, q binary, scale double, err double, keys array<long>")


def _joined(label, i: int, near):
    """Those of near that join another group with i's; labels are brought up to date."""
    import numpy as np

    groups, at = np.unique(label[near], return_index=True)
    new = groups != label[i]
    if not new.any():
        return ()
    label[np.isin(label, groups[new])] = label[i]
    return near[at[new]].tolist()


def group_links(q, scale, err, runs, window: int, threshold: float):
    """(sure, open) of rounded vectors in their order: pairs (i, j) that are links, a spanning forest of them; and pairs
    that may be links and that the forest doesn't join. Compared are the next window rows and all of a run."""
    import numpy as np

    n, label, sure, maybe = len(q), np.arange(len(q)), [], []
    if n < 2:
        return sure, np.zeros((0, 2), np.int64)
    m = q.astype(np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64)  # sums of products are exact
    width = max(window, int(np.bincount(np.cumsum(np.diff(runs, prepend=runs[0]) != 0)).max()))
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        to = min(n, hi + width)
        dots = (m[lo:hi] @ m[lo:to].T).astype(np.float64) * (scale[lo:hi, None] * scale[None, lo:to])
        slack = err[lo:hi, None] + err[None, lo:to] * (1 + err[lo:hi, None])
        can = dots + slack >= threshold
        a, b = np.nonzero(can)
        on = (b > a) & ((b <= a + window) | (runs[a + lo] == runs[b + lo]))
        a, b = a[on], b[on]
        known = dots[a, b] - slack[a, b] >= threshold
        cuts = np.searchsorted(a, np.arange(hi - lo + 1))
        for i in np.unique(a[known]).tolist():
            part = slice(cuts[i], cuts[i + 1])
            sure += [(lo + i, j) for j in _joined(label, lo + i, b[part][known[part]] + lo)]
        a, b = a[~known] + lo, b[~known] + lo
        apart = label[a] != label[b]
        maybe.append(np.stack([a[apart], b[apart]], axis=1))
    maybe = np.concatenate(maybe)
    return sure, maybe[label[maybe[:, 0]] != label[maybe[:, 1]]]


def pass_links(reps: DataFrame, kind: str, orders: dict, first: int, last: int, n: int, window: int, threshold: float) -> DataFrame:
    """Links (a, b) of the passes first .. last - 1: spanning forests of groups, and open pairs that proved to be links."""
    spark = reps.sparkSession
    ship(spark)
    bits, depth = run_bits(n, window), run_bits(n, max(GROUP, window))
    rows = staged(keyed(reps, kind, orders, first, last), "vector-keys")
    at = F.posexplode("keys").alias("pass", "key")
    grp = F.shiftright("key", LEVELS - depth)
    size = GROUP * LONG
    long = rows.select("dim", at).groupBy("pass", "dim", grp.alias("grp")).agg(F.count("*").alias("size")).filter(F.col("size") > size)
    long = staged(long, "vector-long-groups")
    every = rows.select("vec_id", "dim", "q", "scale", "err", at).withColumn("grp", grp)
    if few := long.count():
        part = F.pmod(F.xxhash64("vec_id", F.col("pass") + F.lit(first)), F.ceil(F.col("size") / F.lit(float(size))))
        every = every.join(F.broadcast(long) if few <= FEW else long, ["pass", "dim", "grp"], "left").withColumn("part", F.coalesce(part, F.lit(0)))
    else:
        every = every.withColumn("part", F.lit(0))

    def linked(t):
        import numpy as np
        import pyarrow as pa

        key, ids = t.column("key").to_numpy(), t.column("vec_id").to_numpy()
        order = np.lexsort((ids, key))
        ids, key = ids[order], key[order]
        q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(len(ids), -1)[order]
        runs = key >> np.int64(LEVELS - bits)
        sure, maybe = group_links(q, t.column("scale").to_numpy()[order], t.column("err").to_numpy()[order], runs, window, threshold)
        a = np.concatenate([[i for i, _ in sure], maybe[:, 0]]).astype(np.int64)
        b = np.concatenate([[j for _, j in sure], maybe[:, 1]]).astype(np.int64)
        return pa.table({"a": ids[a], "b": ids[b], "sure": pa.array(np.arange(len(a)) < len(sure))})

    found = staged(every.groupBy("pass", "dim", "grp", "part").applyInArrow(linked, "a long, b long, sure boolean"), "vector-pairs")
    asked = found.filter(~F.col("sure")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = asked.join(reps.select(F.col("vec_id").alias("a"), F.col("vec").alias("va")), "a")
    both = left.join(reps.select(F.col("vec_id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")

    def verified(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            va, vb = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = np.array([len(x) == len(y) and float((unit(x, kind) @ unit(y, kind).T)[0, 0]) >= threshold for x, y in zip(va, vb)], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return found.filter("sure").select("a", "b").unionByName(both.mapInArrow(verified, "a long, b long"))


def links_of(reps: DataFrame, kind: str, queries: list[tuple[int, bytes]], threshold: float, one_in: int) -> DataFrame:
    """(q, vec_id): vectors with cosine at least threshold to a query, itself left out; of very many one in so many."""
    ship(reps.sparkSession)
    held = reps.sparkSession.sparkContext.broadcast(queries)  # QUERIES at most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = {}
        for size in {len(x) for _, x in held.value}:
            some = [(i, x) for i, x in held.value if len(x) == size]
            asked[size] = np.array([i for i, _ in some], np.int64), unit([x for _, x in some], kind)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                ids, raw = b.column(0).slice(lo, 1024).to_numpy(), b.column(1).slice(lo, 1024).to_pylist()
                sizes = np.array([len(x) for x in raw])
                for size in set(sizes.tolist()) & set(asked):
                    on = np.flatnonzero(sizes == size)
                    q, v = asked[size]
                    i, j = np.nonzero(unit([raw[x] for x in on], kind) @ v.T >= threshold)
                    a, c = q[j], ids[on][i]
                    keep = (a != c) & ((a * 31 + c) % one_in == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], names=["q", "vec_id"])

    return reps.select("vec_id", "vec").mapInArrow(run, "q long, vec_id long")


def link_components(reps: DataFrame, kind: str, threshold: float, window: int, miss: float) -> DataFrame:
    """(node, component) of reps (vec_id, vec) that link with others."""
    import numpy as np

    n = reps.count()
    some, have, by_dim = [], 0, {}
    for r in reps.select("vec_id", "vec").orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(SAMPLE).toLocalIterator():  # a bounded sample
        if (have := have + len(r.vec)) > SAMPLE_BYTES:
            break
        some.append((r.vec_id, bytes(r.vec)))
        by_dim.setdefault(len(r.vec), []).append(bytes(r.vec))
    sample = {(v := unit(x, kind)).shape[1]: v for x in by_dim.values()}
    truth = None
    if run_bits(n, window):
        queries = some[:QUERIES]
        near = sum(float((unit([x for _, x in queries if len(x) == size], kind) @ unit(x, kind).T >= threshold).mean()) for size, x in by_dim.items() if any(len(y) == size for _, y in queries))
        truth = staged(links_of(reps, kind, queries, threshold, max(1, int(near * n * len(queries) / 4_000_000))), "vector-truth")
    edges, first, last = None, 0, passes_for(n, threshold, window, miss)
    while True:
        orders = {dim: [Order(v, p) for p in range(first, last)] for dim, v in sample.items()}
        new = pass_links(reps, kind, orders, first, last, n, window, threshold)
        found = staged(components(new if edges is None else edges.unionByName(new)), "vector-components")
        if truth is None:
            return found
        mine, other = found.select(F.col("node").alias("q"), F.col("component").alias("c")), found.select(F.col("node").alias("vec_id"), F.col("component").alias("d"))
        total, hit = truth.join(mine, "q", "left").join(other, "vec_id", "left").agg(F.count("*"), F.coalesce(F.count_if(F.col("c") == F.col("d")), F.lit(0))).first()
        if hit >= RECALL * total:
            return found
        if last >= MOST_PASSES:
            raise RuntimeError(f"after {last} passes {hit} of {total} sampled links are found, which is too few to return; give a larger window")
        edges, first, last = found.select(F.col("node").alias("a"), F.col("component").alias("b")), last, min(2 * last, MOST_PASSES)


def tile_counts(members: DataFrame, kind: str, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """members (component, digest, copies, vec). Returns (digest, n): for each vector the copies of others in its
    component with cosine at least threshold."""
    ship(members.sparkSession)
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    large = staged(sizes.filter(F.col("size") > tile), "vector-large")
    few, chunks = large.count(), members.count() // tile + 1
    rows = members.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    if not few:
        rows = rows.withColumn("size", F.lit(1))
    elif few <= FEW:
        rows = rows.join(F.broadcast(large), "component", "left")
    else:  # rows of a large component are spread over tasks
        rows = rows.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["component", "salt"], "left")
    tiles = F.coalesce(F.ceil(F.col("size") / F.lit(float(tile))), F.lit(1)).cast("int")
    placed = rows.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.when(F.col("tiles") == 1, F.concat(F.lit("c"), F.pmod(F.xxhash64("component"), F.lit(chunks)).cast("string"))).otherwise(F.col("component").cast("string")).alias("grp"),
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "component", "digest", "copies", "vec",
    )

    def count(t):
        import numpy as np
        import pyarrow as pa

        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        order = np.argsort(t.column("component").to_numpy(), kind="stable")
        own, copies, comp = (t.column(c).to_numpy()[order] for c in ("own", "copies", "component"))
        raw = t.column("vec").to_pylist()
        v = unit([raw[x] for x in order], kind) if len({len(x) for x in raw}) == 1 else None
        n = np.zeros(len(raw), dtype=np.int64)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])), len(comp))
        for x, y in zip(cuts, cuts[1:]):
            part = v[x:y] if v is not None else unit([raw[z] for z in order[x:y]], kind)
            a, b = np.flatnonzero(own[x:y] == lo), np.flatnonzero(own[x:y] == hi)
            for s in range(0, len(a), 512):
                i = a[s : s + 512]
                hit = part[i] @ part[b].T >= threshold
                if lo == hi:
                    hit &= i[:, None] != b[None, :]
                n[x + i] += hit @ copies[x + b]
                if lo != hi:
                    n[x + b] += copies[x + i] @ hit
        return pa.table({"digest": t.column("digest").take(pa.array(order)), "n": n})

    got = dealt.groupBy("grp", "lo", "hi").applyInArrow(count, "digest binary, n long")
    return got.groupBy("digest").agg(F.sum("n").alias("n")) if few else got


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept."""
    kind = kind_of(vectors, value)
    rows = staged(marked(vectors, key, value), "vectors")
    good = rows.filter("digest is not null and vec_id is not null")
    reps = staged(good.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    # vec_id repeats among reps only where one id has several vectors; those are one node of the graph.
    found = link_components(reps, kind, threshold, window, miss)
    member = reps.join(found, reps.vec_id == found.node).select("component", "digest", "copies", "vec")
    counts = tile_counts(staged(member, "vector-members"), kind, threshold)
    per_rep = reps.select("digest", "vec_id", "copies").join(found, reps.vec_id == found.node, "left").select("digest", "copies", F.coalesce("component", "vec_id").alias("component"))
    per_rep = per_rep.join(counts, "digest", "left").select("digest", F.col("component").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # One vector may be a large share of all rows.
    done = spread_join(good.select("vec_id", "digest"), per_rep, "digest", "vec_id").select("vec_id", "n_links", "component_id")
    rest = rows.filter("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), window=QUERY_WINDOW)


OP5_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(n, r) as (select vec_id, vec_id from v union select reach.n, l.b from reach join l on reach.r = l.a),
c as (select n, min(r) as component_id from reach group by 1), k as (select a, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
       coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join k on vec_id = k.a left join c on vec_id = c.n"""
