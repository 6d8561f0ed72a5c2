"""op2 with very long payloads and one payload of very many pages."""

import hashlib

from lexiloom.llm import warc


def test_long_and_common_payloads(spark, tmp_path):
    long = "é<p>WARC/1.1\r\n\r\n" * 400_000
    common = "<html>" + "same " * 40
    rows = [(i, f"http://h/{i}", common) for i in range(2000, 2300)] + [(1, "http://l", long), (2, None, long), (3, "http://s", long[:-1])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op2_warc_captures(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html, i)
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = got[i]
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == i else ("revisit", first[html]))
