"""python -m lexiloom.cli import|generate|tokens|history ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexiloom.functions.text import jdk_sentence_tokens
from lexiloom.operators import counts, generate, model
from lexiloom.plans.generator import generate_sentences, report
from lexiloom.sources.store import Store
from lexiloom.sources.text_files import text_files


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexiloom")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("import", help="add text files to a store")
    i.add_argument("path", nargs="?", default="data/clean")
    i.add_argument("--words-only", action="store_true")
    g = sub.add_parser("generate", help="make sentences")
    g.add_argument("--algo", default="tri_greedy", help="|".join(generate.ALGORITHMS) + "; any other name is tri_greedy")
    g.add_argument("--max", type=int, default=generate.MAX_TOKENS)
    g.add_argument("--stop")
    g.add_argument("--seed", action="append")
    g.add_argument("--run", default="0", help="makes the rolls of weighted strategies")
    t = sub.add_parser("tokens", help="count the words of text files")
    t.add_argument("path", nargs="?", default="data/sample.txt")
    t.add_argument("-k", type=int, default=10)
    h = sub.add_parser("history", help="what was imported, latest first")
    for x in (i, g, h):
        x.add_argument("--store", default="data/store")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    if a.what == "tokens":
        words = counts.word_counts(jdk_sentence_tokens(text_files(spark, a.path), "file_name", "text"))
        words.agg({"total": "sum", "word": "count"}).show()
        model.top_k(words, "word", "total", a.k).show(truncate=False)
        return
    store = Store(spark, a.store)
    store.build()
    if a.what == "import":
        print(store.import_files(text_files(spark, a.path), a.words_only), "new files")
        report(store).show()
    elif a.what == "history":
        store.history().show(truncate=False)
    else:
        for r in generate_sentences(store, a.algo, a.seed, a.max, a.stop, a.run).orderBy("seed_id").toLocalIterator():
            print(f"{r.sentence} ({r.n_words})")


if __name__ == "__main__":
    main()
