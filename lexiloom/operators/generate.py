"""Sentence generation for many seeds at once: each walk is a row that a query extends by a word a step.

The four strategies differ in their state (one word or two) and in how the next word is chosen. Weighted choices use
a roll made from (seed, run, step, attempt), so a walk can be repeated, and checked. What is looked up lies in buckets of the
context, so a step moves the walks to it and never the other way; steps run in a session of their own, whose tables are theirs,
and each is staged, so that none carries the plans of those before. Up to FEW walks need few contexts: instead of bucketing
those of the whole model, each step reads the n-grams of the contexts where its walks stand, and nothing else is moved or written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import model
from lexiloom.sources.scratch import CLEANED, bucketed, delete, exists, passing, scratch_path, written

MAX_TOKENS = 20
ATTEMPTS = 10
#: Walks up to which each step fetches the contexts it needs; these are counted first, then broadcast.
FEW = 1000
#: Settings that the steps' session takes over from its caller's.
KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")


def _roll(total: str, *parts: str) -> str:
    return f"pmod(cast(conv(substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8), 16, 10) as bigint), {total})"


def _roll_of(*parts: Column | str) -> Column:
    """The same roll as a column, below the column total; text among the parts stands for itself."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.col("total"))


def _session(spark: SparkSession, levels: int) -> SparkSession:
    """A session for the steps of one call."""
    own = spark.newSession()
    for k in KEPT:
        own.conf.set(k, spark.conf.get(k))
    own.conf.set(CLEANED, "true")
    return own


def _used(order: int) -> str:
    """The n-grams that a walk w has passed over, as text; they are runs of its words."""
    gram = ", ".join(f"w.words[i + {k}]" for k in range(order))
    return f"if(size(w.words) >= {order}, transform(sequence(0, size(w.words) - {order}), i -> concat_ws(' ', {gram})), cast(array() as array<string>))"


def _walked(seeds: DataFrame, grams: DataFrame, order: int, most: int, stop: str | None, levels: int, index, step: str, args: dict) -> DataFrame:
    """seeds (seed_id, w1[, w2]) and what `step` makes of walk: the walks' next rows. index(n-grams): the tables that step looks
    things up in, as (table, columns of its buckets) by name. Stop word and run are values of the query, never a part of its
    text. (seed_id, words)"""
    spark, schema = seeds.sparkSession, seeds.schema
    own = _session(spark, levels)
    # Staged, as each step would count the corpus anew.
    begun = own.read.schema(schema).parquet(written(seeds, "seeds"))
    begun.createOrReplaceTempView("seeds")
    first = "w1 as a, cast(null as string) as b, array(w1) as words" if order == 2 else "w2 as a, w1 as b, array(w1, w2) as words"
    first = f"select seed_id, 0 as step, 0 as attempt, a, b, words, false as done from (select seed_id, {first} from seeds)"
    going = f"size(w.words) < {most}" + ("" if stop is None else " and (w.step = 0 or w.a <> :stop)")
    args = args | ({} if stop is None else {"stop": stop.lower()})
    walks = _Walks(own, own.sql(first))
    if begun.count() <= FEW:
        return _stepped(spark, own, walks, grams, order, levels, index, step, going, args)
    buckets = int(own.conf.get("spark.sql.shuffle.partitions"))
    with passing(spark):
        named = {name: bucketed(df, name, by, own, buckets) for name, (df, by) in index(grams, False).items()}
    try:
        for _ in range(levels):
            if walks.now().isEmpty():
                break
            walks.go(step.format(going=going, **named), args)
        return walks.last(spark)
    finally:
        for table in named.values():
            own.sql(f"drop table if exists {table}")


class _Walks:
    """The walks' rows (seed_id, step, attempt, a, b, words) as the view walk. Each step writes those that go on apart from those that are
    done, and what went on before goes, so a walk's words are kept once."""

    def __init__(self, own: SparkSession, start: DataFrame):
        self.own, self.names, self.schema, self.paths = own, start.columns, start.drop("done").schema, []
        self._write(start)

    def _write(self, rows: DataFrame) -> None:
        path = scratch_path(self.own, "walks")
        rows.write.partitionBy("done").parquet(path)
        if self.paths:
            delete(self.own, f"{self.paths[-1]}/done=false")
        self.paths.append(path)
        self.now().createOrReplaceTempView("walk")

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        there = [p for p in paths if exists(spark, p)]
        return spark.read.schema(self.schema).parquet(*there) if there else spark.createDataFrame([], self.schema)

    def now(self) -> DataFrame:
        return self._read(self.own, [f"{self.paths[-1]}/done=false"])

    def go(self, step: str, args: dict) -> None:
        self._write(self.own.sql(step, args=args).toDF(*self.names))

    def last(self, spark: SparkSession) -> DataFrame:
        """seed_id, words: each walk as its last step left it."""
        rows = self._read(spark, [f"{p}/done=true" for p in self.paths] + [f"{self.paths[-1]}/done=false"])
        return rows.groupBy("seed_id").agg(F.max_by("words", "step").alias("words"))


def _stepped(spark: SparkSession, own: SparkSession, walks: _Walks, grams: DataFrame, order: int, levels: int, index, step: str, going: str, args: dict) -> DataFrame:
    """The same steps for few walks, one query each, over an index of the contexts where walks stand or stood: a step reads the n-grams
    of those that no walk met before."""
    context, at = (["w1"], "a as w1") if order == 2 else (["w1", "w2"], "b as w1, a as w2")
    known, named = set(), {}
    for _ in range(levels):
        asked = {k: v for k, v in args.items() if f":{k}" in going}
        keys = own.sql(f"select distinct {at} from walk w where {going}", args=asked)
        here = {tuple(r) for r in keys.collect()}  # a row a walk at most, of which there are few
        if not here:
            break
        if new := here - known:
            wanted = F.broadcast(spark.createDataFrame(sorted(new, key=str), ", ".join(f"{c} string" for c in context)))
            near = grams
            for k, c in enumerate(context):  # asked of single columns first: where n-grams are sorted most are not read
                near = near.filter(F.col(c).isin(sorted({h[k] for h in new if h[k] is not None})))
            some = own.read.schema(grams.schema).parquet(written(near.join(wanted, context, "left_semi"), "contexts"))
            for name, (df, _by) in index(some, True).items():
                named.setdefault(name, []).append(written(df, name))
                own.read.schema(df.schema).parquet(*named[name]).createOrReplaceTempView(name)
            known |= new
        walks.go(step.format(going=going, **{name: name for name in named}), args)
    return walks.last(spark)


def _greedy(seeds: DataFrame, grams: DataFrame, order: int, most: int, stop: str | None) -> DataFrame:
    """Looked up are followers in the order of their ranks. A walk passes over most + order - 1 of them at most, so longer lists
    are cut there."""
    bi, most, top = order == 2, max(order - 1, most), most + order - 1
    context, word = (["w1"], "w2") if bi else (["w1", "w2"], "w3")
    index = lambda g, _few: {"lists": (model.follower_lists(model.ranked_followers(g, context, word, top), context, word), context)}
    gram = "concat_ws(' ', w.a, x)" if bi else "concat_ws(' ', w.b, w.a, x)"
    avoid = "w.b is not null and x = w.b" if bi else "x = w.a or x = w.b"
    fit = f"filter(l.cands, x -> not coalesce({avoid}, false) and not array_contains(u, {gram}))"
    moved = f"(go and nxt is not null{' and nxt <> a' if bi else ''})"
    step = f"""
        select seed_id, if(moved, step + 1, step), 0, if(moved, nxt, a), if(moved, a, b), if(moved, array_append(words, nxt), words), not moved
        from (select *, coalesce({moved}, false) as moved
              from (select /*+ shuffle_hash(w) */ w.*, transform(array({_used(order)}), u -> get({fit}, 0))[0] as nxt
                    from (select *, coalesce({{going}}, false) as go from walk w) w left join {{lists}} l on {'w.a = l.w1' if bi else 'w.b = l.w1 and w.a = l.w2'}))"""
    return _walked(seeds, grams, order, most, stop, most, index, step, {})


def _weighted(seeds: DataFrame, grams: DataFrame, order: int, most: int, stop: str | None, run: str, block: int, stored: bool) -> DataFrame:
    """Where a context has one block, all attempts of a step are made at once. Where it has more, a roll picks the block and
    a row of a step is one attempt: a failed one comes again with the next."""
    bi, most = order == 2, max(order - 1, most)
    context, word = (["w1"], "w2") if bi else (["w1", "w2"], "w3")
    tries = 1 if bi else ATTEMPTS
    on = lambda t: f"w.a = {t}.w1" if bi else f"w.b = {t}.w1 and w.a = {t}.w2"
    roll = lambda total, t: _roll(total, "cast(w.seed_id as string)", ":run", "cast(w.step as string)", f"cast({t} as string)")
    # A roll is bound before the search, else it would be made for each candidate.
    search = lambda cells, r, c, v: f"transform(array({r}), r -> get(filter({cells}, c -> r < c.{c}), 0).{v})[0]"
    ok = "not array_contains(w.words, x)" if bi else "x <> w.a and x <> w.b and not array_contains(u, concat_ws(' ', w.b, w.a, x))"
    # A list's followers are sorted once for all attempts, and each goes down them until its roll is used up.
    down = "(z, c) -> if(z.r < 0, z, struct(z.r + c.n as r, c.w as w))"
    drawn = lambda r, t: f"transform({t}, t -> aggregate(s, struct({r} as r, cast(null as string) as w), {down}).w)"
    listed = f"transform(array(array_sort(w.list)), s -> {drawn(roll('w.total', 't'), f'sequence(0, {tries - 1})')})[0]"
    draws = f"if(w.list is not null, {listed}, array({search('l.cands', roll('l.total', 'w.attempt'), 'cum', 'w')}))"
    known = f"""select /*+ shuffle_hash(w) */ w.*, l.total, l.cands as list
        from (select *, coalesce({{going}}, false) as go from walk w) w left join {{lists}} l on {on('l')}"""
    placed = f"""select /*+ shuffle_hash(t) */ w.*, go and t.hi is not null as many, {search('t.parts', roll('t.total', 'w.attempt'), 'hi', 'block')} as block
        from ({known}) w left join {{tops}} t on {on('t')} and {roll('t.total', 'w.attempt')} >= t.lo and {roll('t.total', 'w.attempt')} < t.hi"""
    fit = f"transform(array({'w.words' if bi else _used(order)}), u -> get(filter({draws}, x -> {ok}), 0))[0]"
    step = f"""
        select seed_id, if(nxt is null, step, step + 1), if(nxt is null, attempt + 1, 0), coalesce(nxt, a), if(nxt is null, b, a),
               if(nxt is null, words, array_append(words, nxt)), nxt is null and not (many and attempt < {tries - 1})
        from (select /*+ shuffle_hash(w) */ w.*, if(go, {fit}, null) as nxt from ({placed}) w left join {{blocks}} l on {on('l')} and w.block = l.block)"""

    def index(some: DataFrame, few: bool) -> dict:
        lists, tops, blocks = model.draw_index(some, context, word, block, stored or few)
        return {"lists": (lists, context), "tops": (tops, context), "blocks": (blocks, [*context, "block"])}

    return _walked(seeds, grams, order, most, stop, most * tries, index, step, {"run": run})


def bi_greedy(seeds: DataFrame, bigrams: DataFrame, most: int = MAX_TOKENS, stop: str | None = None, run: str = "0") -> DataFrame:
    """The most frequent follower that is neither the word before nor a pair already used; a word that follows itself
    first of all ends the sentence."""
    return _greedy(seeds, bigrams, 2, most, stop)


def bi_weighted(seeds: DataFrame, bigrams: DataFrame, most: int = MAX_TOKENS, stop: str | None = None, run: str = "0", block: int = model.BLOCK, stored: bool = False) -> DataFrame:
    """A follower drawn in proportion to its count; a word already in the sentence ends it."""
    return _weighted(seeds, bigrams, 2, most, stop, run, block, stored)


def tri_greedy(seeds: DataFrame, trigrams: DataFrame, most: int = MAX_TOKENS, stop: str | None = None, run: str = "0") -> DataFrame:
    return _greedy(seeds, trigrams, 3, most, stop)


def tri_weighted(seeds: DataFrame, trigrams: DataFrame, most: int = MAX_TOKENS, stop: str | None = None, run: str = "0", block: int = model.BLOCK, stored: bool = False) -> DataFrame:
    """Up to ATTEMPTS draws a step, until one is neither of the last two words nor makes a used triplet."""
    return _weighted(seeds, trigrams, 3, most, stop, run, block, stored)


ALGORITHMS = {"bi_weighted": bi_weighted, "bi_greedy": bi_greedy, "tri_weighted": tri_weighted, "tri_greedy": tri_greedy}


def algorithm(name: str):
    """By name, with - or _; any other name is tri_greedy."""
    return ALGORITHMS.get((name or "").strip().lower().replace("-", "_"), tri_greedy)


def start_rows(words: DataFrame, trigrams: DataFrame | None = None, weighted: bool = False, run: str = "0") -> DataFrame:
    """(seed_id, w1[, w2]): a walk from each word that begins a sentence; for trigrams with its best second word, or one
    drawn in proportion to its total."""
    seeds = words.filter("starts > 0").select(F.col("word").alias("seed_id"), F.col("word").alias("w1"))
    if trigrams is None:
        return seeds
    second = weighted_second_words(trigrams, run) if weighted else model.best_second_words(trigrams).select("w1", "w2")
    return seeds.join(second, "w1").select("seed_id", "w1", "w2")


def weighted_start(words: DataFrame, run: str = "0") -> DataFrame:
    """One row: a start word drawn in proportion to its starts; the roll comes from run. Running sums are made in blocks, so
    no task meets all start words."""
    some = words.filter("starts > 0").select("word", "starts")
    total = some.agg(F.sum("starts").alias("total"))
    c = model.ordered_blocks(some, "starts", "starts").crossJoin(F.broadcast(total))  # one row
    return c.filter(_roll_of(run) < F.col("cum")).agg(F.min_by("word", "cum").alias("word"))


def weighted_second_words(trigrams: DataFrame, run: str = "0") -> DataFrame:
    """(w1, w2): for each first word a second, drawn in proportion to how often triplets begin with both."""
    totals = model.second_word_totals(trigrams).withColumnRenamed("total", "cnt")
    c = model.cumulative(totals, ["w1"], "w2")
    return c.filter(_roll_of(F.col("w1"), run) < F.col("cum")).groupBy("w1").agg(F.min_by("w2", "cum").alias("w2"))
