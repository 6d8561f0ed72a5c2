"""From documents to token shards: language ID, near-duplicates, decontamination, mixing, tokens.

Every stage is (spark, docs, sf_dir) -> DataFrame. All but the last return rows with the columns of documents; each
stage's result is written as Parquet and reread as the next one's docs. Every stage calls an operator of lexiloom.llm;
nothing is sampled or capped but by the mixing, whose purpose that is.

Null or empty texts have no language and go in the first stage. The second judges each text of a repeated id by itself and
keeps rows without an id; of rows that repeat both id and text one is left. A mix may repeat rows again; every row has the
copies that were sampled for it. The tables between stages lie in the application's scratch folder and go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import decontaminate, language_id, minhash, mixing, token_files
from lexiloom.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what language identification rejects."""
    model = language_id.learned_dictionaries(language_id.training_rows(docs))
    return language_id.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents with a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), min_words=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by systematic sampling towards the target weights of their sources."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes range-coded token shards and returns, read from them, doc_id, start, n_tokens, ids_crc32."""
    return token_files.encoded(docs, token_files.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]

#: No SQL can express language ID, MinHash, edit distance over windows, or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
