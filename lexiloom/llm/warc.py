"""WARC: archives of web captures, written, read back, and assembled into one nested row per capture.

`write_captures` writes three records per page: a request, a response (or a revisit of an identical earlier payload,
without the payload), and a metadata record. Request and metadata name the response in WARC-Concurrent-To.
`read_records` reads archives into one row per record. `assemble` joins the records of a capture through their
concurrent-to identifiers and emits one nested row per capture; `resolve_revisits` then follows WARC-Refers-To.

Archives are gzip files with a member per record, of about ARCHIVE_BYTES each, in the shared folder. Each task names
its files by a fresh token and returns a manifest row per file; only files in the manifest, which Spark commits task
by task, are read, so what a lost or repeated task leaves behind does no harm.

Defined cases: null html is an empty payload; a null URL leaves WARC-Target-URI out; control characters, spaces and
non-ASCII in URLs are percent-encoded; payloads under REVISIT_BYTES are always stored; of equal payloads the smallest
page_id is stored (null ids last); rows that repeat a page_id are captures of their own, told apart by a row number
in the record ids (the first of them holds the payload); an empty table gives no archive and no rows; a record that
names no other is a capture by itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import filesystem, scratch_path, ship, staged, table

ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 100
#: Shares that pages of one payload are dealt to.
SALTS = 16
PRIMARY = ("response", "revisit", "resource", "conversion")
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string,"
    " content_type string, payload_bytes long, payload_digest string, declared_digest string, fields map<string,string>, payload binary"
)
_DATE = "2020-01-01T00:00:00Z"


def record_uuid(kind: str, key: str) -> str:
    import hashlib

    h = hashlib.md5(f"{kind}|{key}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes, level: int = 3) -> bytes:
    import zlib

    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_records(key: str, page_id, url: str | None, html: str | None, digest: str, refers_to: str | None) -> list[bytes]:
    """The records of one page. key: what makes its record ids; refers_to: the key of the stored equal payload."""
    from urllib.parse import quote

    uri = None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")
    target = {"WARC-Target-URI": uri} if uri else {}
    rid = record_uuid("response", key)
    payload = (html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    common = target | {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        main = record("response", rid, common, http + payload)
    else:
        extra = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_uuid("response", refers_to)}
        main = record("revisit", rid, common | extra, http)
    path = quote(url.split("://", 1)[-1].partition("/")[2], safe="%/:?[]@!$&'()*+,;=-._~") if url else ""
    request = record("request", record_uuid("request", key), target | {"WARC-Concurrent-To": rid, "Content-Type": "application/http; msgtype=request"}, f"GET /{path} HTTP/1.1\r\n\r\n".encode())
    about = "" if page_id is None else f"page_id: {page_id}\r\n"
    meta = record("metadata", record_uuid("metadata", key), target | {"WARC-Concurrent-To": rid, "Content-Type": "application/warc-fields"}, about.encode())
    return [main, request, meta]


def parse_stream(read, want_payload: bool):
    """Yields the records of an archive; read(n) gives up to n bytes of the uncompressed stream. A record at a time is held."""
    import hashlib

    buf = b""
    while True:
        while (cut := buf.find(b"\r\n\r\n")) < 0 or not buf.startswith(b"WARC/"):
            if cut >= 0 and not buf.startswith(b"WARC/"):
                at = buf.find(b"WARC/")
                if at > 0:
                    buf = buf[at:]
                    continue
            more = read(1 << 16)
            if not more:
                return
            buf += more
        head, buf = buf[:cut].decode("utf-8", "replace"), buf[cut + 4 :]
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
        need = int(h.get("content-length", 0))
        parts = [buf]
        have = len(buf)
        while have < need:
            more = read(max(1 << 16, need - have))
            if not more:
                return  # a truncated record is left out
            parts.append(more)
            have += len(more)
        buf = b"".join(parts)
        block, buf = buf[:need], buf[need:].lstrip(b"\r\n")
        kind = h.get("warc-type", "")
        payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x) if h.get("content-type") == "application/warc-fields" else None
        stored = kind in ("response", "resource", "conversion")
        yield {
            "record_id": h.get("warc-record-id"), "record_type": kind, "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "content_type": h.get("content-type"), "payload_bytes": len(payload) if stored else None, "payload_digest": hashlib.sha256(payload).hexdigest() if stored else None,
            "declared_digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None, "fields": fields, "payload": payload if want_payload and stored else None,
        }


def planned(pages: DataFrame) -> DataFrame:
    """Adds to (page_id, url, html): key, digest, refers_key. html is moved once, by the even key of the page."""
    text = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    base = base.withColumn("digest", F.sha2(text.cast("binary"), 256)).withColumn("bytes", F.octet_length(text))
    # One key for the join and the numbering of repeated rows, so that html moves once.
    pair = lambda page, digest: F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), digest)
    base = base.withColumn("pair", pair(F.col("page_id"), F.col("digest")))
    small = base.filter(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest", "pair")
    firsts = small.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("id"))).alias("first"), F.count("*").alias("rows"))
    # A payload may be that of very many pages: those are spread over SALTS tasks.
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    shared = firsts.filter("rows > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    per_page = small.distinct().withColumn("salt", share("pair")).join(shared, ["digest", "salt"]).select("pair", pair(F.col("first.id"), F.col("digest")).alias("first_pair"))
    full = base.join(per_page, "pair", "left")
    number = F.row_number().over(Window.partitionBy("pair").orderBy(F.xxhash64("url")))
    out = full.withColumn("n", number).withColumn("key", F.concat_ws("|", "pair", F.col("n").cast("string")))
    is_first = F.col("first_pair").isNull() | ((F.col("first_pair") == F.col("pair")) & (F.col("n") == 1))
    return out.withColumn("refers_key", F.when(~is_first, F.concat_ws("|", "first_pair", F.lit("1")))).select(
        "page_id", "url", F.when(is_first, F.col("html")).alias("html"), "digest", "key", "refers_key"
    )


def write_captures(pages: DataFrame, to: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes the archives of (page_id, url, html) and returns (folder, manifest: path, records, bytes)."""
    spark = pages.sparkSession
    ship(spark)
    to = to or scratch_path(spark, "warc")

    def run(batches):
        import uuid

        import pyarrow as pa

        fs, base = filesystem(to)
        fs.create_dir(base, recursive=True)
        token, done, out, size, records = uuid.uuid4().hex, [], None, 0, 0
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(j)[i].as_py() for j in range(b.num_columns)]
                if out is None:
                    name = f"{base}/capture-{token}-{len(done):05d}.warc.gz"
                    out, size, records = fs.open_output_stream(name, compression=None), 0, 0
                for r in page_records(row[4], row[0], row[1], row[2], row[3], row[5]):
                    size += out.write(z := gzipped(r)) or len(z)
                    records += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0].rpartition("/")[2] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    rows = planned(pages).select("page_id", "url", "html", "digest", "key", "refers_key")
    return to, staged(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives named by manifest (path). Archives are read by the tasks, a stream each."""
    ship(spark)

    def run(batches):
        import gzip

        import pyarrow as pa

        fs, base = filesystem(folder)
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch(rows):
            cols = [pa.array([list(r[n].items()) if n == "fields" and r[n] is not None else r[n] for r in rows], k) for n, k in zip(names, kinds)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as text:
                    for r in parse_stream(text.read, payload):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 300
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2000))
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (its record), request (or null), metadata (list, by id).

    A record belongs to the primary record (response, revisit, resource, conversion) that it names in concurrent-to,
    or whose record names it, or that is named by the record that it names. Others are captures by themselves."""
    cols = records.columns
    primary = F.col("record_type").isin(*PRIMARY)
    others = records.filter(~primary)
    # other -> named by a primary record, or other -> other -> primary
    named = records.filter(primary & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("o_id"), F.col("record_id").alias("p_id"))
    hop = others.filter("concurrent_to is not null").select(F.col("record_id").alias("o_id"), F.col("concurrent_to").alias("to"))
    up = others.select(F.col("record_id").alias("to"), F.col("concurrent_to").alias("p_id")).filter("p_id is not null")
    second = hop.join(up, "to").select("o_id", "p_id")
    link = named.unionByName(second).groupBy("o_id").agg(F.min("p_id").alias("p_id"))
    keyed = records.filter(primary).withColumn("capture_id", F.col("record_id")).unionByName(
        others.join(link, others.record_id == link.o_id, "left").withColumn("capture_id", F.coalesce("p_id", "concurrent_to", "record_id")).select(*cols, "capture_id")
    )
    nested = F.struct(*cols)
    kind = F.col("record_type")
    return keyed.groupBy("capture_id").agg(
        F.max_by(F.when(primary, nested), F.when(primary, F.col("record_id"))).alias("response"),
        F.max_by(F.when(kind == "request", nested), F.when(kind == "request", F.col("record_id"))).alias("request"),
        F.collect_list(F.when(kind == "metadata", nested)).alias("metadata"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures of assemble. Returns page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), capture_id."""
    page = F.element_at(F.col("metadata")[0]["fields"], "page_id").cast("long")
    flat = staged(captures.select("capture_id", page.alias("page_id"), "response.record_type", F.col("response.refers_to").alias("to"), "response.payload_bytes", "response.payload_digest", "response.declared_digest"), "warc-captures")
    stored = flat.filter("record_type = 'response'").select(F.col("capture_id").alias("s_id"), F.col("page_id").alias("s_page"), F.col("payload_bytes").alias("s_bytes"), F.col("payload_digest").alias("s_digest"))
    # What revisits refer to is looked up in SALTS shares, as very many may refer to one record.
    asked = flat.filter("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int"))
    wanted = stored.join(asked.select(F.col("to").alias("s_id")).distinct(), "s_id", "left_semi").withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = asked.join(wanted, (F.col("to") == F.col("s_id")) & (F.col("salt") == F.col("s_salt")), "left")
    plain = flat.filter("record_type <> 'revisit'")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_id"]
    return plain.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(
        revisits.select("page_id", F.col("s_bytes").alias("payload_bytes"), F.coalesce("s_digest", "declared_digest").alias("payload_digest"), "record_type", F.col("s_page").alias("refers_to"), "capture_id")
    )


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_captures(table(spark, sf_dir, "pages"))
    # Staged, so that the archives are read once, and the joins see the true size of the records.
    records = staged(read_records(spark, folder, manifest, payload=False).drop("payload", "target_uri", "date"), "warc-records")
    return resolve_revisits(assemble(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
       case when first_id <> page_id then first_id end as refers_to
from d left join f using (payload_digest)"""
