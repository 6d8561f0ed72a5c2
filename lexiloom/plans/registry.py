"""Queries over the driver's tables, and the SQL that gives the same rows.

All value-checked queries split sentences by the rule that SQL can express (after . ! or ? before white space);
those named _jdk use the JDK's sentence rules, as the public API does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.operators import counts, generate, lookups, model

PROBE, STOP = "the", "of"
QUOTED = "o'clock"  # a stop word with an apostrophe


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark, sf):
    from lexiloom.sources.text_files import spread

    return spread(_table(spark, sf, "documents").select("doc_id", "text"))


def _sents(spark, sf, part: int | None = None):
    docs = _documents(spark, sf)
    return X.regex_sentence_tokens(docs if part is None else docs.filter(F.pmod("doc_id", F.lit(2)) == part))


def _words(spark, sf, part=None):
    return counts.word_counts(_sents(spark, sf, part))


def _grams(spark, sf, n, part=None):
    return counts.ngram_counts(_sents(spark, sf, part), n)


def _dict(spark, sf):
    return model.dictionary(_words(spark, sf))


def _suffixes(spark, sf):
    """Counts of which those of words, pairs and triplets are sums: one scan for queries that need several."""
    from lexiloom.sources.scratch import staged

    return staged(counts.suffix_counts(_sents(spark, sf)), "suffixes")


def _coded(make):
    """make(sentences, dictionary), of sentences that are cut once."""

    def query(spark, sf):
        from lexiloom.sources.scratch import staged

        sents = staged(_sents(spark, sf).select("toks"), "sentences")
        return make(sents, staged(model.dictionary(counts.word_counts(sents)), "dictionary"))

    return query


def _seeds(spark, sf):
    """The words of each benchmark text, as seeds."""
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("seed_id"), F.posexplode(X.seed_words(F.col("text"))).alias("pos", "word"))


def _pairs_of_seeds(spark, sf):
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("word")))
    return _seeds(spark, sf).groupBy("seed_id").agg(at(0).alias("w1"), at(1).alias("w2"))


def _sentences(walks: DataFrame) -> DataFrame:
    return walks.select(F.col("seed_id").alias("seed"), X.rendered(F.col("words")).alias("sentence"), F.size("words").cast("long").alias("n_words"))


def _file_stats(spark, sf):
    return counts.document_stats(_sents(spark, sf))


def _import_history(spark, sf):
    """The rows of the manifest that importing every document would leave, at made-up times."""
    files = counts.document_stats(_sents(spark, sf)).select("doc_id", F.col("n_tokens").alias("word_count"))
    return files.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "word_count", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("doc_id")).cast("string").alias("imported"))


def _new_files(spark, sf):
    from lexiloom.sources.text_files import documents_as_files

    files = documents_as_files(_table(spark, sf, "documents"))
    known = documents_as_files(_table(spark, sf, "documents").filter(F.pmod("doc_id", F.lit(2)) == 0))
    return lookups.new_files(files, known).select("file_name", F.length("text").cast("long").alias("n_chars"))


def _lookup(spark, sf):
    d = _dict(spark, sf)
    wanted = _seeds(spark, sf).select(F.col("word").alias("word_value"))
    return lookups.word_ids(d, wanted).select("word_id", "word_value", "total_occurrences", "start_sentence_count", "end_sequence_count")


def _lookup_one(spark, sf):
    d = lookups.for_lookups(_dict(spark, sf))
    hit = lookups.by_value(d, PROBE).select(F.lit("value").alias("by"), "word_id", "word_value")
    ident = lookups.by_id(d, 1).select(F.lit("id").alias("by"), "word_id", "word_value")
    none = lookups.word_id(d, "no such word").select(F.lit("missing").alias("by"), "word_id", F.lit("").alias("word_value"))
    return hit.unionByName(ident).unionByName(none)


def _cumulative(spark, sf):
    return model.cumulative(_grams(spark, sf, 2), ["w1"], "w2").drop("nth")


def _lookup_tri_start(spark, sf):
    return lookups.trigram_start(_pairs_of_seeds(spark, sf), _grams(spark, sf, 3))


def _merge(spark, sf, n):
    make = (lambda p: _words(spark, sf, p)) if n == 1 else (lambda p: _grams(spark, sf, n, p))
    return counts.merged(make(0), make(1), ["word"] if n == 1 else [f"w{i + 1}" for i in range(n)])


def _upsert_one(spark, sf):
    row = {"w1": PROBE, "w2": "lexiloom", "cnt": 0, "ends": 2}
    return counts.upserted_one(_grams(spark, sf, 2), row, ["w1", "w2"]).filter(F.col("w1") == PROBE)


def _report(spark, sf):
    s = _suffixes(spark, sf)
    w, b, t = counts.words_of(s), counts.bigrams_of(s), counts.trigrams_of(s)
    one = lambda name, df, c: df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.sum(c).alias("total"))
    return one("words", w, "total").unionByName(one("pairs", b, "cnt")).unionByName(one("triplets", t, "cnt"))


def _quoted(spark, sf):
    """Walks over pairs in which every `of` is written with an apostrophe, and which stop there."""
    s = _suffixes(spark, sf)
    named = lambda c: F.when(F.col(c) == STOP, F.lit(QUOTED)).otherwise(F.col(c)).alias(c)
    words, pairs = counts.words_of(s), counts.bigrams_of(s)
    pairs = pairs.select(named("w1"), named("w2"), "cnt", "ends")
    return _sentences(generate.bi_greedy(generate.start_rows(words.select(named("word"), "total", "starts", "ends")), pairs, stop=QUOTED))


def _every_order(spark, sf):
    """Words, pairs and triplets from one exchange of the tokens."""
    s = _suffixes(spark, sf)
    none = F.lit(None).cast("string")
    w = counts.words_of(s).select(F.lit(1).alias("n"), F.col("word").alias("w1"), none.alias("w2"), none.alias("w3"), F.col("total").alias("cnt"), "ends")
    b = counts.bigrams_of(s).select(F.lit(2).alias("n"), "w1", "w2", none.alias("w3"), "cnt", "ends")
    return w.unionByName(b).unionByName(counts.trigrams_of(s).select(F.lit(3).alias("n"), "w1", "w2", "w3", "cnt", "ends"))


def _bi(step, **kw):
    def query(spark, sf):
        s = _suffixes(spark, sf)
        words, grams = counts.words_of(s), counts.bigrams_of(s)
        return _sentences(step(generate.start_rows(words), grams, **kw))

    return query


def _tri(step, **kw):
    def query(spark, sf):
        s = _suffixes(spark, sf)
        words, grams = counts.words_of(s), counts.trigrams_of(s)
        return _sentences(step(generate.start_rows(words, grams), grams, **kw))

    return query


def _jdk(spark, sf):
    return X.jdk_sentence_tokens(_documents(spark, sf))


def _packed(sents, words):
    p = model.coded_pairs(sents, words)
    return p.select("preceding_word_id", "following_word_id", X.packed_key(F.col("preceding_word_id"), F.col("following_word_id")).alias("packed"))


_STORES: dict[tuple, object] = {}


def _store(spark, sf):
    """A store that got the even documents, then the odd ones, then the even ones once more; made anew when the application or
    the table's files change."""
    from lexiloom.sources.scratch import scratch_path
    from lexiloom.sources.store import Store
    from lexiloom.sources.text_files import documents_as_files

    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    state = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    key = (spark.sparkContext.applicationId, sf, state.getModificationTime(), state.getLen())
    if key not in _STORES:
        store = Store(spark, scratch_path(spark, "store"))
        store.build()
        files = lambda part: documents_as_files(_table(spark, sf, "documents").filter(F.pmod("doc_id", F.lit(2)) == part))
        for part in (0, 1, 0):
            store.import_files(files(part), split=X.regex_sentence_tokens)
        _STORES[key] = store
    return _STORES[key]


def _store_cleared(spark, sf):
    """Of a store that got all benchmark texts, was cleared, and got those of even numbers: its report."""
    from lexiloom.plans.generator import report
    from lexiloom.sources.scratch import scratch_path
    from lexiloom.sources.store import Store
    from lexiloom.sources.text_files import documents_as_files

    items = _table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    store = Store(spark, scratch_path(spark, "cleared"))
    store.build()
    store.import_files(documents_as_files(items), split=X.regex_sentence_tokens)
    store.clear()
    store.import_files(documents_as_files(items.filter("doc_id % 2 = 0")), split=X.regex_sentence_tokens)
    return report(store)


def _store_history(spark, sf):
    from pyspark.sql import Window

    rows = _store(spark, sf).history().select("file_name", "word_count", "import_timestamp", "file_id")
    # A rank over the manifest, which has a row a file.
    rank = F.row_number().over(Window.orderBy(F.col("import_timestamp").desc(), "file_id"))
    return rows.select("file_name", "word_count", "file_id", rank.cast("long").alias("nth"))


def _landing(spark, sf):
    """Benchmark texts as files: uploaded reversed, then as they are, and listed with what is in them."""
    from lexiloom.sources.scratch import scratch_path
    from lexiloom.sources.text_files import text_files, upload

    files = _table(spark, sf, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".TXT")).alias("file_name"), "text")
    folder = scratch_path(spark, "landing")
    for text in (F.reverse("text"), F.col("text")):
        upload(files.select("file_name", text.alias("text")), folder).write.format("noop").mode("overwrite").save()
    return text_files(spark, folder).select("file_name", "text")


def _rendered(spark, sf):
    """How long each sentence is when rendered; those without a word too."""
    rows = _table(spark, sf, "documents").select("doc_id", F.posexplode(X.regex_sentences(F.col("text"))).alias("sent", "s"))
    text = X.rendered(X.tokens(F.col("s")))
    return rows.select("doc_id", F.col("sent").cast("long").alias("sent"), X.rendered_length(text).alias("n_words"))


def _upsert_word(spark, sf):
    row = {"word": PROBE, "total": 0, "starts": 3, "ends": 2}
    return counts.upserted_one(_words(spark, sf), row, ["word"]).filter(F.col("word") == PROBE)


def _plain_texts(spark, sf):
    """Each document's ASCII words, a sentence for each of its sentences: `X` and the words, lower-cased, then a full stop.
    On such texts the JDK's rules break where the pattern does."""
    words = F.transform(X.regex_sentences(F.col("text")), lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0)))
    return _table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(words, lambda w: F.concat(F.lit("X "), F.array_join(w, " "), F.lit("."))), " ").alias("text"))


def _jdk_plain(spark, sf):
    from pyspark.sql import Window

    rows = X.jdk_sentence_tokens(_plain_texts(spark, sf))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent"))
    return rows.select("doc_id", nth.cast("long").alias("nth"), X.rendered(F.col("toks")).alias("sentence"))


def _seeded(algo):
    def query(spark, sf):
        from lexiloom.plans.generator import generate_sentences

        seeds = _table(spark, sf, "benchmark").select(F.col("item_id").alias("seed_id"), F.col("text").alias("seed"))
        return generate_sentences(_store(spark, sf), algo, seeds)

    return query


def _unseeded(spark, sf):
    from lexiloom.plans.generator import generate_sentences

    every = [generate_sentences(_store(spark, sf), a).select(F.lit(a).alias("algo"), "sentence", "n_words") for a in generate.ALGORITHMS]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


def _by_ids(spark, sf):
    """From ids that there are and that there aren't, greedy, by pairs and triplets."""
    from lexiloom.plans.generator import generate_from_ids

    got = [generate_from_ids(_store(spark, sf), a, ids).select(F.lit(f"{a} {ids}").alias("asked"), "sentence") for a, ids in ID_SEEDS]
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out


#: What `generate_by_ids` asks for.
ID_SEEDS = (("bi_greedy", [1]), ("bi_greedy", [2, 1]), ("bi_greedy", [2_000_000_000]), ("tri_greedy", [1]), ("tri_greedy", [3, 1]), ("tri_greedy", [2_000_000_000]))


QUERIES = {
    "word_counts_regex": _words,
    "bigram_counts": lambda s, d: _grams(s, d, 2),
    "trigram_counts": lambda s, d: _grams(s, d, 3),
    "sentence_length_hist": lambda s, d: counts.sentence_lengths(_sents(s, d)),
    "file_token_stats": _file_stats,
    "token_stream": lambda s, d: counts.token_stream(_sents(s, d)).withColumns({"n": F.col("n").cast("long"), "pos": F.col("pos").cast("long"), "sent": F.col("sent").cast("long")}),
    "unigram_map": lambda s, d: _words(s, d).select("word", "total"),
    "top_words": lambda s, d: model.top_k(_words(s, d).select("word", "total"), "word", "total", 10),
    "top_followers_of_probe": lambda s, d: model.top_k(_grams(s, d, 2).filter(F.col("w1") == PROBE).select("w2", "cnt"), "w2", "cnt", 10),
    "word_dictionary": _dict,
    "word_pairs": _coded(model.coded_pairs),
    "trigram_sequence": _coded(model.coded_triplets),
    "packed_pair_key": _coded(_packed),
    "bigram_followers_ranked": lambda s, d: model.ranked_followers(_grams(s, d, 2), ["w1"], "w2"),
    "trigram_followers_ranked": lambda s, d: model.ranked_followers(_grams(s, d, 3), ["w1", "w2"], "w3"),
    "start_candidates": lambda s, d: model.start_candidates(_words(s, d)),
    "best_start": lambda s, d: model.top_k(_words(s, d).select("word", "starts"), "word", "starts", 1),
    "second_word_totals": lambda s, d: model.second_word_totals(_grams(s, d, 3)),
    "best_second_word": lambda s, d: model.best_second_words(_grams(s, d, 3)),
    "follower_cumulative": _cumulative,
    "word_lookup": _lookup,
    "word_lookup_one": _lookup_one,
    "seed_first_known": lambda s, d: lookups.first_known(_seeds(s, d), _dict(s, d)),
    "seed_top_up": lambda s, d: lookups.topped_up(_seeds(s, d), _dict(s, d), 5),
    "trigram_seed_resolution": _lookup_tri_start,
    "weighted_start": lambda s, d: generate.weighted_start(_words(s, d), "7"),
    "new_files_anti": _new_files,
    "merge_words": lambda s, d: _merge(s, d, 1),
    "merge_pairs": lambda s, d: _merge(s, d, 2),
    "merge_triplets": lambda s, d: _merge(s, d, 3),
    "upsert_one_pair": _upsert_one,
    "import_history": _import_history,
    "import_report": _report,
    "generate_bi_greedy": _bi(generate.bi_greedy),
    "words_pairs_triplets": _every_order,
    "generate_bi_greedy_stop": _bi(generate.bi_greedy, stop=STOP),
    "generate_bi_greedy_quoted": _quoted,
    "generate_tri_greedy": _tri(generate.tri_greedy),
    "generate_bi_weighted": _bi(generate.bi_weighted),
    "generate_tri_weighted": _tri(generate.tri_weighted, stored=True),
    "sentences_jdk": lambda s, d: _jdk(s, d).select("doc_id", F.col("sent").cast("long").alias("sent"), X.rendered(F.col("toks")).alias("sentence")),
    "word_counts_jdk": lambda s, d: counts.word_counts(_jdk(s, d)),
    "sentences_jdk_plain": _jdk_plain,
    "word_counts_jdk_plain": lambda s, d: counts.word_counts(X.jdk_sentence_tokens(_plain_texts(s, d))),
    "rendered_lengths": _rendered,
    "upsert_one_word": _upsert_word,
    "landing_files": _landing,
    "store_words": lambda s, d: _store(s, d).table("words"),
    "store_history": _store_history,
    "store_report": lambda s, d: __import__("lexiloom.plans.generator", fromlist=["report"]).report(_store(s, d)),
    "store_cleared": _store_cleared,
    "weighted_second_word": lambda s, d: generate.weighted_second_words(_grams(s, d, 3), "7"),
    "generate_seeded_bi_greedy": _seeded("bi-greedy"),
    "generate_seeded_bi_weighted": _seeded("bi_weighted"),
    "generate_seeded_tri_greedy": _seeded("no such name"),
    "generate_seeded_tri_weighted": _seeded("TRI_WEIGHTED"),
    "generate_unseeded": _unseeded,
    "generate_by_ids": _by_ids,
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return model.top_k(counts.word_counts(_jdk(spark, sf)), "word", "total", 100)


# The same in SQL. The token rules, as above.
_WS = r"[ \t\n\x0B\f\r]"
_SENT = rf"""
s as materialized (select doc_id, i - 1 as sent, list_filter(list_transform(regexp_split_to_array(p[i], '{_WS}+'),
        lambda t: lower(regexp_replace(t, '^[^\p{{L}}\p{{Nd}}'']+|[^\p{{L}}\p{{Nd}}'']+$', '', 'g'))), lambda t: t <> '') as toks
      from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from
            (select doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null))),
t as (select doc_id, sent, len(toks) as n, unnest(range(len(toks))) as pos, unnest(toks) as word from s where len(toks) > 0)"""
_W = _SENT + """,
w as materialized (select word, count(*)::bigint as total, count(*) filter (pos = 0)::bigint as starts, count(*) filter (pos = n - 1)::bigint as ends from t group by 1)"""
_B = _W + """,
g2 as materialized (select toks[i] as w1, toks[i + 1] as w2, count(*)::bigint as cnt, count(*) filter (i + 1 = len(toks))::bigint as ends
       from (select toks, unnest(range(1, len(toks))) as i from s) group by 1, 2)"""
_T = _B + """,
g3 as materialized (select toks[i] as w1, toks[i + 1] as w2, toks[i + 2] as w3, count(*)::bigint as cnt, count(*) filter (i + 2 = len(toks))::bigint as ends
       from (select toks, unnest(range(1, len(toks) - 1)) as i from s where len(toks) > 2) group by 1, 2, 3)"""
_D = ",\nd as materialized (select (row_number() over (order by word))::int as word_id, word as word_value, total as total_occurrences, starts as start_sentence_count, ends as end_sequence_count from w)"
_SEEDS = rf""",
seeds as (select item_id as seed_id, unnest(range(len(q))) as pos, unnest(q) as word from
  (select item_id, list_filter(list_transform(regexp_split_to_array(trim(text), '{_WS}+'), lambda t: lower(t)), lambda t: t <> '') as q from benchmark))"""
_SECOND = ",\nsec as (select w1, w2, sum(cnt)::bigint as total from g3 group by 1, 2), best as (select w1, arg_min(w2, (-total, w2)) as w2, max(total) as total from sec group by 1)"


def _part(sql: str, part: int, tag: str) -> str:
    """The counts of half of the documents, under other names."""
    body = sql.replace("from documents where", f"from documents where doc_id % 2 = {part} and")
    for name in ("s", "t", "w", "g2", "g3"):
        body = body.replace(f"\n{name} as ", f"\n{name}{tag} as ").replace(f"from {name} ", f"from {name}{tag} ").replace(f"from {name})", f"from {name}{tag})")
    return body


def _merge_sql(n: int) -> str:
    base, name = ((_W, "w"), (_B, "g2"), (_T, "g3"))[n - 1]
    keys = "word" if n == 1 else ", ".join(f"w{i + 1}" for i in range(n))
    sums = ", ".join(f"sum({c})::bigint as {c}" for c in (("total", "starts", "ends") if n == 1 else ("cnt", "ends")))
    return f"with {_part(base, 0, 'x')}, {_part(base, 1, 'y')} select {keys}, {sums} from (from {name}x union all from {name}y) group by {keys}"


_NAMED = "case when {0} = '" + STOP + "' then '" + QUOTED.replace("'", "''") + "' else {0} end"


def _walk_sql(order: int, weighted: bool, stop: str | None = None, seeds: str | None = None, more: str = "", table: str | None = None) -> str:
    """seeds: SQL of (seed_id, a, b, words), by default a walk from each start; more: what it needs first."""
    bi = order == 2
    grams, ctx, nxt = ("g2", "w1", "w2") if bi else ("g3", "w1, w2", "w3")
    grams = table or grams
    if weighted:
        lists = f"""r as (select *, sum(cnt) over (partition by {ctx} order by cnt desc, {nxt} rows unbounded preceding)::bigint as cum, sum(cnt) over (partition by {ctx})::bigint as total from {grams}),
l as (select {ctx}, any_value(total) as total, list({{'cum': cum, 'w': {nxt}}} order by cum) as cands from r group by {ctx})"""
        tries = 0 if bi else 9
        roll = "(('0x' || substr(md5(concat_ws('|', w.seed_id, '0', w.step::varchar, k::varchar)), 1, 8))::bigint % l.total)"
        draws = f"list_transform(list_transform(range(0, {tries + 1}), lambda k: {roll}), lambda r: list_filter(l.cands, lambda c: r < c.cum)[1].w)"
        ok = "not list_contains(w.words, x)" if bi else "x <> w.a and x <> w.b and not list_contains(w.used, concat_ws(' ', w.b, w.a, x))"
        pick = f"list_filter({draws}, lambda x: {ok})[1]"
    else:
        top = 21 if bi else 22
        lists = f"""r as (select {ctx}, {nxt}, row_number() over (partition by {ctx} order by cnt desc, {nxt}) as rank from {grams}),
l as (select {ctx}, list({nxt} order by rank) as cands from r where rank <= {top} group by {ctx})"""
        avoid = "w.b is not null and x = w.b" if bi else "x = w.a or x = w.b"
        gram = "concat_ws(' ', w.a, x)" if bi else "concat_ws(' ', w.b, w.a, x)"
        pick = f"list_filter(l.cands, lambda x: not coalesce({avoid}, false) and not list_contains(w.used, {gram}))[1]"
    seeds = seeds or ("select word as seed_id, word as a, null::varchar as b, [word] as words from w where starts > 0" if bi else "select w.word as seed_id, best.w2 as a, w.word as b, [w.word, best.w2] as words from w join best on w.word = best.w1 where starts > 0")
    join = "w.a = l.w1" if bi else "w.b = l.w1 and w.a = l.w2"
    on = "" if stop is None else f" and (w.step = 0 or w.a <> '{stop.replace("'", "''")}')"
    here = " and nxt <> w1" if bi and not weighted else ""
    base = _B if bi else _T + _SECOND
    gram = "concat_ws(' ', w1, nxt)" if bi else "concat_ws(' ', w0, w1, nxt)"
    return f"""with recursive {base}{more}, {lists},
walk(seed_id, step, a, b, words, used) as (
  select seed_id, 0, a, b, words, []::varchar[] from ({seeds})
  union all
  select seed_id, step + 1, nxt, w1, list_append(words, nxt), list_append(used, {gram})
  from (select w.seed_id, w.step, w.b as w0, w.a as w1, w.words, w.used, {pick} as nxt from walk w join l on {join} where len(w.words) < 20{on}) where nxt is not null{here})
select seed_id as seed, array_to_string(arg_max(words, step), ' ') as sentence, len(arg_max(words, step))::bigint as n_words from walk group by 1"""


_PACK = "case when len(toks) = 0 then 1 else len(toks) end"
_HEX = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::bigint"
_WSEC = (
    ",\nc2 as (select w1, w2, sum(total) over (partition by w1 order by total desc, w2 rows unbounded preceding) as cum, sum(total) over (partition by w1) as every from sec)"
    ",\nwsec as (select w1, arg_min(w2, cum) as w2 from c2 where (" + _HEX.format("w1, '{run}'") + " % every)::bigint < cum group by w1)"
)
_START = {
    False: ",\nst as (select word from w order by starts desc, word limit 1)",
    True: ",\nsc as (select word, sum(starts) over (order by starts desc, word rows unbounded preceding) as cum, sum(starts) over ()::bigint as total from w where starts > 0)"
    ",\nst as (select arg_min(word, cum) as word from sc where (" + _HEX.format("'0'") + " % total) < cum)",
}
_FIRST = {False: ",\nf as (select min((w1, w2)) as f from sec)", True: ",\nf as (select arg_min((w1, w2), md5(concat_ws('|', '0', w1, w2))) as f from sec)"}


def _seeded_sql(order: int, weighted: bool, texts: bool = True) -> str:
    """Walks from the benchmark's texts, or one from nothing (seed 0)."""
    ids = "select item_id as seed_id from benchmark" if texts else "select 0 as seed_id"
    known = _SEEDS if texts else ",\nseeds as (select 0 as seed_id, 0 as pos, ''::varchar as word where false)"
    if order == 2:
        more = known + _START[weighted] + ",\nk as (select seed_id, arg_min(seeds.word, pos) as w1 from seeds join w on seeds.word = w.word group by 1)"
        start = f"select i.seed_id, coalesce(k.w1, st.word) as a, null::varchar as b, [coalesce(k.w1, st.word)] as words from ({ids}) i left join k on i.seed_id = k.seed_id, st"
    else:
        second = "wsec" if weighted else "best"
        more = known + _SECOND * 0 + (_WSEC.replace("{run}", "0") if weighted else "") + _FIRST[weighted]
        more += ",\np as (select seed_id, max(word) filter (pos = 0) as w1, max(word) filter (pos = 1) as w2 from seeds group by 1)"
        more += f""",\nq as (select i.seed_id, case when sec.w1 is not null or {second}.w1 is not null then p.w1 else f.f[1] end as x,
          case when sec.w1 is not null then p.w2 when {second}.w1 is not null then {second}.w2 else f.f[2] end as y
          from ({ids}) i left join p on i.seed_id = p.seed_id left join sec on p.w1 = sec.w1 and p.w2 = sec.w2 left join {second} on p.w1 = {second}.w1, f)"""
        start = "select seed_id, y as a, x as b, [x, y] as words from q"
    walk = _walk_sql(order, weighted, None, start, more)
    return f"select seed as seed_id, sentence, n_words from ({walk})"


def _by_ids_sql() -> str:
    """Ids as the store gives them: words of even documents first."""
    out = []
    for algo, ids in ID_SEEDS:
        bi = algo == "bi_greedy"
        named = lambda i: f"coalesce((select word_value from sd where word_id = {i}), '?')"
        more = "," + _part(_W, 0, "e") + ",\nsd as (" + _STORE_WORDS + ")"
        if bi:
            start = f"select 0 as seed_id, {named(ids[0])} as a, null::varchar as b, [{named(ids[0])}] as words"
        else:
            more += _FIRST[False] + f",\np as (select {named(ids[0])} as w1, {named(ids[1]) if len(ids) > 1 else 'null::varchar'} as w2)"
            more += """,\nq as (select case when sec.w1 is not null or best.w1 is not null then p.w1 else f.f[1] end as x,
              case when sec.w1 is not null then p.w2 when best.w1 is not null then best.w2 else f.f[2] end as y
              from p left join sec on p.w1 = sec.w1 and p.w2 = sec.w2 left join best on p.w1 = best.w1, f)"""
            start = "select 0 as seed_id, y as a, x as b, [x, y] as words from q"
        out.append(f"select '{algo} {ids}' as asked, sentence from ({_walk_sql(2 if bi else 3, False, None, start, more)})")
    return " union all ".join(out)


def _report_sql(counted: str, files: str) -> str:
    return f"""with {counted} select 'words' as "table", count(*)::bigint as "rows", coalesce(sum(total), 0)::bigint as total from w union all select 'bigrams', count(*), coalesce(sum(cnt), 0)::bigint from g2
  union all select 'trigrams', count(*), coalesce(sum(cnt), 0)::bigint from g3 union all select 'source_file', (select count(*) from {files}), coalesce(sum(total), 0)::bigint from w"""


_STORE_WORDS = """select (case when we.word is not null then row_number() over (partition by we.word is null order by w.word)
  else (select count(*) from we) + row_number() over (partition by we.word is null order by w.word) end)::int as word_id,
  w.word as word_value, w.total as total_occurrences, w.starts as start_sentence_count, w.ends as end_sequence_count from w left join we on w.word = we.word"""
#: Sentences by the JDK's rules, as its pattern gives them to both engines.
_JDK = rf"""
j as materialized (select doc_id, list_filter(list_transform(string_split(regexp_replace(translate(text, chr(1), chr(2)), '{X.jdk_breaks().replace("'", "''")}', '\1\2\4\6\8' || chr(1) || '\3\5\7\9', 'g'), chr(1)),
      lambda p: list_filter(list_transform(regexp_split_to_array(p, '{_WS}+'), lambda t: lower(regexp_replace(t, '^[^\p{{L}}\p{{Nd}}'']+|[^\p{{L}}\p{{Nd}}'']+$', '', 'g'))), lambda t: t <> '')), lambda s: len(s) > 0) as sents
      from documents where text is not null),
js as (select doc_id, unnest(range(len(sents))) as sent, unnest(sents) as toks from j)"""
_ROLL7 = "(('0x' || substr(md5('7'), 1, 8))::bigint % total)"
ORACLE_SQL = {
    "word_counts_regex": f"with {_W} select * from w",
    "bigram_counts": f"with {_B} select * from g2",
    "trigram_counts": f"with {_T} select * from g3",
    "sentence_length_hist": f"with {_SENT} select len(toks)::bigint as n_tokens, count(*)::bigint as n_sentences from s where len(toks) > 0 group by 1",
    "file_token_stats": f"with {_SENT} select doc_id, count(*)::bigint as n_tokens, count(distinct word)::bigint as n_words, count(distinct sent)::bigint as n_sentences from t group by 1",
    "token_stream": f"with {_SENT} select doc_id, sent::bigint as sent, n::bigint as n, pos::bigint as pos, word from t",
    "unigram_map": f"with {_W} select word, total from w",
    "top_words": f"with {_W} select word, total from w order by total desc, word limit 10",
    "top_followers_of_probe": f"with {_B} select w2, cnt from g2 where w1 = '{PROBE}' order by cnt desc, w2 limit 10",
    "word_dictionary": f"with {_W}{_D} select * from d",
    "word_pairs": f"with {_B}{_D} select a.word_id as preceding_word_id, b.word_id as following_word_id, cnt as occurrence_count, g2.ends as bi_end_frequency from g2 join d a on w1 = a.word_value join d b on w2 = b.word_value",
    "trigram_sequence": f"with {_T}{_D} select a.word_id as first_word_id, b.word_id as second_word_id, c.word_id as third_word_id, cnt as follows_count, g3.ends as tri_end_frequency from g3 join d a on w1 = a.word_value join d b on w2 = b.word_value join d c on w3 = c.word_value",
    "packed_pair_key": f"with {_B}{_D}, i as materialized (select word_value, word_id from d), p as materialized (select a.word_id as preceding_word_id, b.word_id as following_word_id from g2 join i a on w1 = a.word_value join i b on w2 = b.word_value) select preceding_word_id, following_word_id, preceding_word_id::bigint * 4294967296 + following_word_id as packed from p",
    "bigram_followers_ranked": f"with {_B} select w1, w2, cnt, row_number() over (partition by w1 order by cnt desc, w2)::bigint as rank from g2",
    "trigram_followers_ranked": f"with {_T} select w1, w2, w3, cnt, row_number() over (partition by w1, w2 order by cnt desc, w3)::bigint as rank from g3",
    "start_candidates": f"with {_W} select word, starts, row_number() over (order by starts desc, word)::bigint as rank from w where starts > 0",
    "best_start": f"with {_W} select word, starts from w order by starts desc, word limit 1",
    "second_word_totals": f"with {_T}{_SECOND} select * from sec",
    "best_second_word": f"with {_T}{_SECOND} select * from best",
    "follower_cumulative": f"with {_B} select w1, w2, cnt, sum(cnt) over (partition by w1 order by cnt desc, w2 rows unbounded preceding)::bigint as cum, sum(cnt) over (partition by w1)::bigint as total from g2",
    "word_lookup": f"with {_W}{_D}{_SEEDS} select * from d where word_value in (select word from seeds)",
    "word_lookup_one": f"with {_W}{_D} select 'value' as by, word_id, word_value from d where word_value = '{PROBE}' union all select 'id', word_id, word_value from d where word_id = 1 union all select 'missing', -1::int, ''",
    "seed_first_known": f"with {_W}{_D}{_SEEDS} select seed_id, arg_min(word, pos) as word, arg_min(word_id, pos) as word_id from seeds join d on word = word_value group by 1",
    "seed_top_up": f"""with {_W}{_D}{_SEEDS},
e as (select seed_id, 0 as kind, min(pos)::bigint as k1, '' as k2, word_id from seeds join d on word = word_value group by seed_id, word_id
  union all select seed_id, 1, -start_sentence_count, word_value, word_id from (select distinct seed_id from seeds), (select * from d where start_sentence_count > 0 order by start_sentence_count desc, word_value limit 5)
  union all select seed_id, 2, 0, word_value, word_id from (select distinct seed_id from seeds), (select * from d order by word_value limit 10)),
f as (select seed_id, word_id, min((kind, k1, k2)) as k from e group by 1, 2)
select seed_id, array_to_string(list(word_id order by k)[1:5], ' ') as ids from f group by 1""",
    "trigram_seed_resolution": f"""with {_T}{_SECOND}{_SEEDS},
p as (select seed_id, max(word) filter (pos = 0) as w1, max(word) filter (pos = 1) as w2 from seeds group by 1), f as (select min((w1, w2)) as f from sec)
select seed_id, case when sec.w1 is not null or best.w1 is not null then p.w1 else f.f[1] end as start1,
       case when sec.w1 is not null then p.w2 when best.w1 is not null then best.w2 else f.f[2] end as start2
from p left join sec on p.w1 = sec.w1 and p.w2 = sec.w2 left join best on p.w1 = best.w1, f""",
    "weighted_start": f"with {_W}, c as (select word, starts, sum(starts) over (order by starts desc, word rows unbounded preceding) as cum, sum(starts) over ()::bigint as total from w where starts > 0) select arg_min(word, cum) as word from c where {_ROLL7} < cum",
    "new_files_anti": "select 'doc_' || doc_id || '.txt' as file_name, length(coalesce(text, ''))::bigint as n_chars from documents where doc_id % 2 = 1",
    "merge_words": _merge_sql(1),
    "merge_pairs": _merge_sql(2),
    "merge_triplets": _merge_sql(3),
    "upsert_one_pair": f"with {_B} select * from g2 where w1 = '{PROBE}' union all select '{PROBE}', 'lexiloom', 1, 2",
    "import_history": f"with {_SENT} select 'doc_' || doc_id || '.txt' as file_name, count(*)::bigint as word_count, (timestamp '2020-01-01 00:00:00' + to_seconds(doc_id))::varchar as imported from t group by doc_id",
    "import_report": f"with {_T} select 'words' as name, count(*)::bigint as n_rows, sum(total)::bigint as total from w union all select 'pairs', count(*), sum(cnt)::bigint from g2 union all select 'triplets', count(*), sum(cnt)::bigint from g3",
    "generate_bi_greedy": _walk_sql(2, False),
    "generate_bi_greedy_stop": _walk_sql(2, False, STOP),
    "generate_bi_greedy_quoted": _walk_sql(2, False, QUOTED, table="q2", more=f", q2 as (select {_NAMED.format('w1')} as w1, {_NAMED.format('w2')} as w2, cnt, ends from g2)", seeds=f"select {_NAMED.format('word')} as seed_id, {_NAMED.format('word')} as a, null::varchar as b, [{_NAMED.format('word')}] as words from w where starts > 0"),
    "generate_tri_greedy": _walk_sql(3, False),
    "words_pairs_triplets": f"with {_T} select 1 as n, word as w1, null::varchar as w2, null::varchar as w3, total as cnt, ends from w union all select 2, w1, w2, null, cnt, ends from g2 union all select 3, w1, w2, w3, cnt, ends from g3",
    "generate_bi_weighted": _walk_sql(2, True),
    "generate_tri_weighted": _walk_sql(3, True),
    "sentences_jdk": f"with {_JDK} select doc_id, sent::bigint as sent, array_to_string(toks, ' ') as sentence from js",
    "word_counts_jdk": f"with {_JDK}, t as (select len(toks) as n, unnest(range(len(toks))) as pos, unnest(toks) as word from js) select word, count(*)::bigint as total, count(*) filter (pos = 0)::bigint as starts, count(*) filter (pos = n - 1)::bigint as ends from t group by 1",
    "sentences_jdk_plain": f"with {_SENT}, x as (select doc_id, i, list_prepend('x', regexp_extract_all(lower(p[i]), '[a-z]+')) as toks from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null))) select doc_id, row_number() over (partition by doc_id order by i)::bigint as nth, array_to_string(toks, ' ') as sentence from x",
    "word_counts_jdk_plain": f"with x as (select doc_id, list_prepend('x', regexp_extract_all(lower(p[i]), '[a-z]+')) as toks from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null))), t as (select len(toks) as n, unnest(range(len(toks))) as pos, unnest(toks) as word from x) select word, count(*)::bigint as total, count(*) filter (pos = 0)::bigint as starts, count(*) filter (pos = n - 1)::bigint as ends from t group by 1",
    "rendered_lengths": f"with {_SENT} select doc_id, sent::bigint as sent, ({_PACK})::bigint as n_words from s",
    "upsert_one_word": f"with {_W} select word, total + 1 as total, starts + 3 as starts, ends + 2 as ends from w where word = '{PROBE}'",
    "landing_files": "select 'item_' || item_id || '.TXT' as file_name, coalesce(text, '') as text from benchmark",
    "store_words": f"with {_W},{_part(_W, 0, 'e')} {_STORE_WORDS}",
    "store_history": f"with {_SENT}, m as (select 'doc_' || d.doc_id || '.txt' as file_name, d.doc_id % 2 as half, coalesce(c.n, 0)::bigint as word_count from documents d left join (select doc_id, count(*) as n from t group by 1) c on d.doc_id = c.doc_id) select file_name, word_count, row_number() over (order by half, file_name)::int as file_id, row_number() over (order by half desc, file_name)::bigint as nth from m",
    "store_report": _report_sql(_T, "documents"),
    "store_cleared": _report_sql(_T.replace("doc_id", "item_id").replace("from documents where", "from benchmark where item_id % 2 = 0 and"), "benchmark where item_id % 2 = 0"),
    "weighted_second_word": f"with {_T}{_SECOND}{_WSEC.replace('{run}', '7')} select w1, w2 from wsec",
    "generate_seeded_bi_greedy": _seeded_sql(2, False),
    "generate_seeded_bi_weighted": _seeded_sql(2, True),
    "generate_seeded_tri_greedy": _seeded_sql(3, False),
    "generate_seeded_tri_weighted": _seeded_sql(3, True),
    "generate_unseeded": " union all ".join(f"select '{n}_{k}' as algo, sentence, n_words from ({_seeded_sql(o, k == 'weighted', False)})" for o, n in ((2, "bi"), (3, "tri")) for k in ("greedy", "weighted")),
    "generate_by_ids": _by_ids_sql(),
}
