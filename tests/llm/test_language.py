"""op4: the sample reaches all of a text, and predictions equal encodings made one by one."""

import zstandard
from pyspark.sql import functions as F

from lexiloom.llm import language_id as L


def test_sample_is_spread_over_the_text(spark):
    text = "".join(chr(97 + i // 500 % 26) for i in range(13_000))
    rows = [(1, text, "a"), (2, "short", "a"), (3, "é" * 3000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.s for r in df.select("doc_id", L.spread(F.col("text")).alias("s")).collect()}
    assert got[2] == "short" and got[1][0] == "a" and got[1][-1] == "z" and "m" in got[1] and len(got[1]) == L.SAMPLE_CHARS + L.SAMPLE_PIECES - 1
    model = L.learned_dictionaries(df, most=1200)
    assert all(len(d) <= 1200 for d in model.values()) and model["a"].decode() and model["b"].decode() == ""


def test_predictions_equal_single_encodings(spark, sf):
    """The smallest of plain compressions with each dictionary, but for close calls, which are measured twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.learned_dictionaries(L.training_rows(docs))
    got = {r.doc_id: r for r in L.op4_language_id(spark, sf).collect()}
    far = 0
    for r in docs.filter("text is not null").collect():
        data = L.folded(r.text)
        if not data.strip():
            assert got[r.doc_id].lang_pred == L.UNKNOWN
            continue
        size = {}
        for lang, d in model.items():
            p = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, source_size=L.BLOCK_BYTES, dict_size=L.DICT_BYTES, write_checksum=0, write_content_size=0, write_dict_id=0)
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = sum(len(zstandard.ZstdCompressor(dict_data=z, compression_params=p).compress(data[i : i + L.BLOCK_BYTES])) for i in range(0, len(data), L.BLOCK_BYTES))
        first, second = sorted(size, key=lambda x: (size[x], x))[:2]
        if size[second] - size[first] >= 0.05 * size[second]:
            far += 1
            assert got[r.doc_id].lang_pred == first
    assert far > 100
    held = [r for r in docs.collect() if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
