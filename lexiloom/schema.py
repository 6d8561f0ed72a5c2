"""Schemas of the stored tables; every column is required."""

from pyspark.sql import types as T


def _table(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k, False) for n, k in kinds.items()])


I, L, S = T.IntegerType(), T.LongType(), T.StringType()
SOURCE_FILE = _table(file_id=I, file_name=S, word_count=L, import_timestamp=T.TimestampType())
WORDS = _table(word_id=I, word_value=S, total_occurrences=L, start_sentence_count=L, end_sequence_count=L)
WORD_PAIRS = _table(preceding_word_id=I, following_word_id=I, occurrence_count=L, bi_end_frequency=L)
TRIGRAMS = _table(first_word_id=I, second_word_id=I, third_word_id=I, follows_count=L, tri_end_frequency=L)
TABLES = {"source_file": SOURCE_FILE, "words": WORDS, "word_pairs": WORD_PAIRS, "trigram_sequence": TRIGRAMS}
