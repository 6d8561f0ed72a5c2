"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document has the same expected copies, target / source size. Documents are laid on a line in
the order (size, digest byte of the id, id), each as long as its expected copies; the line is shifted by one random
offset per source, and a document is emitted once for each integer boundary it crosses. Ordering by size makes the
sample stratified: a source's words miss its target by no more than about one long document.

The prefix sum is distributed. Ranks come from three levels: counts of (source, size), prefix-summed per source;
counts of (source, size, one of 256 id bytes), prefix-summed per (source, size); and a row number inside one such
cell. No task sees a source's rows: the first window holds a source's distinct sizes, the second at most 256 rows a
key, the third a 256th of one source's documents of one size.

Defined cases: null text has size 0 and is sampled like any other row but adds no words; a null source is a source,
the last in order; a null id sorts first (digest of the empty text); rows that repeat an id, null ones too, are separate documents
(which of several with one text gets the odd copy is open, their rows being alike in what counts); an empty table gives an empty
result; sources of size 0 have target 0 and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, staged, table, word_count

#: Source weights, by the code-point order of the names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken at most so many times over.
MOST_COPIES = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds target: the total shared by weight, no source above
    most times its size, the excess reshared by weight. That is min(cap, level * weight) for the one level at which
    the targets add up to the total; sources are capped in the order of cap / weight, so running sums find it."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("i", F.row_number().over(order)).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "i")
    every = Window.partitionBy()
    run = (
        ranked.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("w_from"))
    )
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("i"), F.col("level").alias("level")))).over(every)
    return run.withColumn("at", level).select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("at.level") * F.col("w"), F.col("cap")))).alias("target"),
    )


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the source's name."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def id_byte(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 2)


def sampled(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """docs: (doc_id, source, text). Returns doc_id, source, size, source_size, target, copies; a row per row of docs."""
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_byte(F.col("doc_id")).alias("cell"))
    return _dealt(staged(base, "mix-sizes"), weights, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def _dealt(base: DataFrame, weights, most: int, seed: str) -> DataFrame:
    """base (doc_id, source, size, cell, others), with source_size, target and copies."""
    cells = base.groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    levels = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = levels.groupBy("source").agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("source_size"))
    goal = targets(sources, weights, most)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = levels.select("source", "size", before(Window.partitionBy("source").orderBy("size")).alias("b1"))
    by_cell = cells.select("source", "size", "cell", before(Window.partitionBy("source", "size").orderBy("cell")).alias("b2"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("doc_id"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    row = base.withColumn("b3", rank)
    row = row.join(by_cell.alias("c"), same(row, by_cell, "source", "size", "cell")).select(row["*"], by_cell.b2)
    row = row.join(by_size, same(row, by_size, "source", "size")).select(row["*"], by_size.b1)
    row = row.join(goal, same(row, goal, "source")).select(row["*"], goal.source_size, goal.target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, u = F.col("b1") + F.col("b2") + F.col("b3"), offset(F.col("source"), seed)
    copies = F.floor(at.cast("double") * rate + u) - F.floor((at - 1).cast("double") * rate + u)
    return row.select(*base.columns, "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Rows of one id, source and text (told by two hashes) are interchangeable: their copies are added up and handed out
    again by number among them. All other rows, those with null or repeated ids too, get what was sampled for them."""
    # One string is the key of the join and of the numbering, so that texts move once; null ids are spread by their texts.
    text = F.col("text").cast("string")
    said = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))
    key = F.md5(F.concat_ws("|", said("doc_id"), F.xxhash64(text).cast("string"), F.crc32(text.cast("binary")).cast("string"), said("source")).cast("binary"))
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_byte(F.col("doc_id")).alias("cell"), key.alias("key"))
    dealt = _dealt(staged(base, "mix-sizes"), weights, most, seed)
    taken = dealt.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    mark, turn = fresh(docs, "_mark"), fresh(docs, "_turn")
    joined = docs.withColumn(mark, key).join(taken, F.col(mark) == taken.key)
    nth = F.when(taken.rows == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(mark).orderBy(mark)))
    own = (F.floor(taken.copies / taken.rows) + (nth <= taken.copies % taken.rows).cast("long")).cast("int")
    per = joined.select(*[docs[c] for c in docs.columns], own.alias(turn))
    return per.filter(F.col(turn) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turn)))).drop(turn)


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = """
with b as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
                  substr(md5(coalesce(doc_id::varchar, '')), 1, 2) as cell from documents),
s as (select source, sum(size)::bigint as source_size from b group by 1),
r as (select *, row_number() over (order by source nulls last) as i from s),
w as (select *, [5.0::double, 2.0::double, 1.0::double][(i - 1) % 3 + 1] as w, source_size * 3.0::double as cap from r),
run as (select *, coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as before,
               sum(w) over (order by cap / w, i rows between current row and unbounded following) as w_from,
               sum(source_size) over ()::double as total from w),
lev as (select *, (total - before) / w_from as level from run),
best as (select arg_min(level, (cap / w, i)) filter (level * w <= cap) as level from lev),
goal as (select lev.source, source_size, case when source_size = 0 then 0 else least(cap, coalesce(best.level * w, cap)) end as target from lev, best),
pos as (select b.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
               row_number() over (partition by b.source order by size, cell, doc_id)::double as pos_at,
               ('0x' || substr(md5('mix-1|' || coalesce('s' || b.source, 'null')), 1, 8))::bigint::double / 4294967296.0 as u
        from b join goal on b.source is not distinct from goal.source)
select doc_id, size, source_size, target,
       (least(floor(pos_at * rate + u) - floor((pos_at - 1) * rate + u), 3)::bigint * size)::bigint as taken from pos"""
