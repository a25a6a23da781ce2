"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly and chunked-transfer decoding.

Writing: a page is an HTTP response in chunked framing.  Blocks over ``segment_bytes`` are written as a first record and
``continuation`` records (origin identifier, segment number, and on the last one the total length).  Files hold at most
``records_per_file`` records, so their size has the bound records_per_file * (segment_bytes + headers).

Reading: files are parsed by their content lengths; continuation records are grouped by origin identifier, ordered by segment number,
checked for gaps and against the total length, joined to their first record, and the chunked framing is decoded.  Only segmented
records are shuffled with their bytes.  A revisit takes length and digest from the record that it refers to.

Defined cases: null html is an empty payload; rows without page_id are written as responses and never referred to; rows that repeat both
page and payload are responses each (if of the smallest page_id); an incomplete record has ``complete`` false and no payload; other
columns are not written.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import shared_folder, staged, table

MIN_PAYLOAD = 100
SEGMENT_BYTES = 1 << 15
RECORDS_PER_FILE = 2_000
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("origin", pa.string()),
    ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
])
RECORD_DDL = "record_id string, warc_type string, page_id long, refers_to string, origin string, segment int, total long, block binary"


def _cut(raw: bytes, size: int):
    """Parts of at most ``size`` bytes (4 at least) that end between characters of UTF-8."""
    at = 0
    while at < len(raw):
        to = min(at + size, len(raw))
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to -= 1
        yield raw[at:to]
        at = to


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _cut(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of chunked framing (chunk extensions and trailers are skipped); None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> str:
    """A WARC record less its last line end, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n" + block.decode() + "\r\n"


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def records(page: dict, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """The records of one page: one revisit, or one response with its continuations."""
    http = "application/http; msgtype=response"
    own = [("WARC-Record-ID", f"<{page['record_id']}>"), ("WARC-Page-ID", page["page_id"]), ("WARC-Target-URI", _clean(page["url"])),
           ("WARC-Payload-Digest", f"sha256:{page['digest']}")]
    if page["refers_to"]:
        more = [("WARC-Refers-To", f"<{page['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record([("WARC-Type", "revisit"), *own, *more, ("Content-Type", http)], HTTP_HEAD.encode())]
    block = HTTP_HEAD.encode() + chunked((page["html"] or "").encode("utf-8", "replace"))
    parts = list(_cut(block, segment_bytes))
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), *own, ("Content-Type", http)], block)]
    out = [record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1), ("Content-Type", http)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = len(block) if n == len(parts) else None
        out.append(record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{page['record_id']}:{n}>"), ("WARC-Segment-Origin-ID", f"<{page['record_id']}>"),
            ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last),
        ], part))
    return out


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD,
               segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Archive files of all pages.  Of equal payloads of at least ``min_payload`` bytes the smallest page is stored, the others refer to it."""
    p = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256)).withColumn("long_", (F.octet_length("html") >= min_payload) & F.col("page_id").isNotNull())
    # map-side partial minima: a payload of a third of all pages is one row per task
    first = p.where("long_").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("digest_"), "first")
    p = p.join(first, (F.col("digest") == F.col("digest_")) & F.col("long_"), "left")
    name = lambda i: F.concat(F.lit("urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.substring("digest", 1, 16))
    p = p.select("page_id", "url", F.when(F.col("first") < F.col("page_id"), None).otherwise(F.col("html")).alias("html"), "digest",
                 name(F.col("page_id")).alias("record_id"), F.when(F.col("first") < F.col("page_id"), name(F.col("first"))).alias("refers_to"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r for page in b.to_pylist() for r in records(page, segment_bytes)], pa.string())], ["value"])

    p.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def parse(raw: bytes):
    """Records (dicts of RECORD) of one archive's bytes, plain or gzip of any number of members."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(raw))
            raw = z.unused_data
        raw = b"".join(parts)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        f = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            f[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = int(f.get("content-length", 0))
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        num = lambda k: int(f[k]) if f.get(k, "").isdigit() else None
        ref = lambda k: f[k].strip("<>") if k in f else None
        page = f.get("warc-page-id", "")
        yield {"record_id": ref("warc-record-id"), "warc_type": f.get("warc-type"), "page_id": int(page) if page.lstrip("-").isdigit() else None,
               "refers_to": ref("warc-refers-to"), "origin": ref("warc-segment-origin-id"), "segment": num("warc-segment-number"),
               "total": num("warc-segment-total-length"), "block": block}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, as written."""
    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows, size = [], 0
                for r in parse(raw.as_py()):
                    rows.append(r)
                    size += len(r["block"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_DDL)


def http_payload(block: Column) -> Column:
    """The decoded body of an HTTP message; null if its framing is broken or there is no block."""

    def arrow(blocks: pa.Array) -> pa.Array:
        out = []
        for b in blocks:
            b = b.as_py()
            head, found, body = (b or b"").partition(b"\r\n\r\n")
            out.append(None if not found else unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
        return pa.array(out, pa.binary())

    return F.arrow_udf(arrow, "binary")(block)


def reassemble(recs: DataFrame) -> DataFrame:
    """First and single records with their whole blocks: page_id, record_id, warc_type, refers_to, block, complete."""
    keep = ["record_id", "warc_type", "page_id", "refers_to"]
    heads = recs.where("warc_type <> 'continuation'")
    single = heads.where("segment IS NULL").select(*keep, "block", F.lit(True).alias("complete"))
    tails = recs.where("warc_type = 'continuation' AND origin IS NOT NULL").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "total", "block"))).alias("parts")
    )
    j = heads.where("segment = 1").withColumnRenamed("block", "head").drop("origin", "segment", "total").join(tails, F.col("record_id") == F.col("origin"), "left")
    sizes = F.transform("parts", lambda x: F.octet_length(x["block"]))
    length = F.octet_length("head") + F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    in_order = F.forall(F.transform("parts", lambda x, i: x["segment"] == i + 2), lambda ok: ok)
    complete = F.coalesce(in_order & (F.element_at("parts", -1)["total"] == length), F.lit(False))
    whole = F.aggregate("parts", F.col("head"), lambda a, x: F.concat(a, x["block"]))
    return single.unionByName(j.select(*keep, F.when(complete, whole).alias("block"), complete.alias("complete")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, warc_type, refers_to, complete, payload (null for revisits)."""
    r = reassemble(read_records(spark, path))
    return r.select("page_id", "record_id", "warc_type", "refers_to", "complete", F.when(F.col("warc_type") == "response", http_payload(F.col("block"))).alias("payload"))


def op10_warc(spark, d) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(table(spark, d, "pages"), path)
    r = staged(read_pages(spark, path).select(
        "page_id", "record_id", "warc_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest")
    ), "warc-read")
    own = r.where("warc_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                                   F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = r.where("warc_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("to"), F.max("n").alias("n"), F.max("digest").alias("digest"))
    again = r.where("warc_type = 'revisit'").select("page_id", F.col("refers_to").alias("ref")).join(target, F.col("ref") == F.col("target"), "left")
    return own.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"),
                                        F.col("to").alias("refers_to")))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, q.digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON f.digest = q.digest AND q.n >= 100
"""
