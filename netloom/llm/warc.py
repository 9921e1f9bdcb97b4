"""WARC archives through a chunked record table.

Payloads are streamed as (record, chunk number) rows of at most ``CHUNK`` bytes; each row carries the
SHA-1 digest and length of the payload up to its end, so the last row holds those of the whole and no
record is copied in one piece. The table is written once and decides on the last rows alone which
records revisit which: of equal payloads (digest and length) of at least ``LEAST`` bytes, the one
with the largest page id is the response.

An archive record is a chunk: the first is ``response`` (or ``revisit``, without payload), the others
are ``continuation`` segments; each states the digest and length of the payload up to its own end. Spark's text writer stores them as gzip files in the shared folder;
records are told apart by a line with the archive's own random name, which no payload can hold by
accident. Reading back splits at that line, checks lengths, and feeds the segments of a record, in
order, to one running digest, which must be the stated one after every segment. Payloads are
shuffled only if there are more than ``MAX_BROADCAST`` revisits, or to put segments in order.

Edge cases: null html is empty (a response of 0 bytes); null page ids and urls stay null; repeated
pages are records of their own, and of equal page ids the last record answers; an empty table makes
an empty archive.
"""

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions.skew import spread_join
from netloom.llm.common import raw
from netloom.session import cut, scratch

CHUNK, LEAST, BATCH, MAX_BROADCAST = 1 << 20, 1000, 8 << 20, 1_000_000
TABLE = "rid string, page_id long, url string, chunk int, chunks int, data binary, digest string, bytes long"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of their own


def chunked(pages: DataFrame, chunk=CHUNK) -> DataFrame:
    """The chunked record table of (page_id, url, html), written once: record ids must not change."""

    def work(batches):
        at, rows, size = 0, [], 0
        names = [x.split()[0] for x in TABLE.split(", ")]

        def flush():
            schema = pa.schema([("rid", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()),
                                ("data", pa.binary()), ("digest", pa.string()), ("bytes", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)

        part = TaskContext.get().partitionId()
        for b in batches:
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), raw(b, "html")):
                view, h, n = memoryview(html), hashlib.sha1(), max(1, -(-len(html) // chunk))
                for k in range(n):
                    piece = bytes(view[k * chunk:(k + 1) * chunk])
                    h.update(piece)
                    rows.append((f"{part}-{at}", page, url, k, n, piece, h.hexdigest(), min(len(html), (k + 1) * chunk)))
                    size += len(piece) + 100
                    if size > BATCH:
                        yield flush()
                        rows, size = [], 0
                at += 1
        if rows:
            yield flush()

    return cut(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(work, TABLE), "records")


def revisits(records: DataFrame, least=LEAST) -> DataFrame:
    """(rid, refers, refers_to): records that revisit another. Decided on narrow rows; hot digests are sliced."""
    whole = records.where("chunk = chunks - 1").select("rid", "page_id", "digest", "bytes").where(F.col("bytes") >= least)
    top = (whole.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "rid")).alias("_t"), F.count("*").alias("_c")).where("_c > 1")
           .select("digest", "bytes", F.col("_t.rid").alias("refers"), F.col("_t.page_id").alias("refers_to")))
    return spread_join(whole, top, ["digest", "bytes"], ["rid"]).where("rid <> refers").select("rid", "refers", "refers_to")


def write(pages: DataFrame, path: str, chunk=CHUNK, least=LEAST) -> str:
    """Writes the archive to ``path``; returns the name that separates its records."""
    records = chunked(pages, chunk)
    name = uuid.uuid4().hex
    again = cut(revisits(records, least), "revisits")
    # a revisit is written where its last chunk is, which knows the whole payload's digest
    r = records.join(F.broadcast(again) if again.count() <= MAX_BROADCAST else again, "rid", "left").where("refers is null or chunk = chunks - 1")
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n"))).otherwise("")
    again = F.col("refers").isNotNull()
    block = F.when(again, F.lit("").cast("binary")).otherwise(F.col("data"))
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Archive: {name}\r\nWARC-Type: "), F.when(again, "revisit").when(F.col("chunk") > 0, "continuation").otherwise("response"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"), line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), "rid", F.lit(">"))), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Page-ID", F.col("page_id")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("WARC-Payload-Length", F.col("bytes")),
        line("WARC-Segment-Number", F.when(~again & (F.col("chunks") > 1), F.col("chunk") + 1)), line("WARC-Segments", F.when(again, 1).otherwise(F.col("chunks"))),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:record:"), "refers", F.lit(">")))), line("WARC-Refers-To-Page", F.col("refers_to")),
        line("Content-Length", F.length(block)), F.lit("\r\n"))
    r.select(F.concat(head, block.cast("string"), F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)
    return name


PARSED = "rid string, page_id long, kind string, segment int, segments int, data binary, payload_digest string, payload_bytes long, refers_to long"


def _parse(batches):
    names = [x.split()[0] for x in PARSED.split(", ")]
    for b in batches:
        rows = []
        for rec in b.column("value").to_pylist():
            end = rec.index(b"\r\n\r\n")
            h = dict(x.split(": ", 1) for x in rec[:end].decode().split("\r\n") if ": " in x)
            n = int(h["Content-Length"])
            data = rec[end + 4:end + 4 + n]
            if len(data) != n or rec[end + 4 + n:].strip(b"\r\n"):
                raise ValueError(f"record {h['WARC-Record-ID']}: wrong length")
            num = lambda k: int(h[k]) if k in h else None
            rows.append((h["WARC-Record-ID"][12:-1], num("WARC-Page-ID"), h["WARC-Type"], num("WARC-Segment-Number") or 1, num("WARC-Segments"), data,
                         h["WARC-Payload-Digest"][5:], num("WARC-Payload-Length"), num("WARC-Refers-To-Page")))
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _checked(batches):
    """Segments in order -> one row per record; the running digest outlives batches."""
    h, open_rid, done = None, None, 0

    def out(rows):
        keep = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in keep], [k for k, _ in keep])

    for b in batches:
        rows = []
        cols = {k: b.column(k) for k in b.schema.names}
        for i in range(b.num_rows):
            r = {k: c[i].as_py() for k, c in cols.items()}
            if r["kind"] == "revisit":
                rows.append(r)
                continue
            if r["segment"] == 1 and open_rid is None:
                h, open_rid, done, follows = hashlib.sha1(), r["rid"], 0, 1
            if open_rid != r["rid"] or r["segment"] != follows:
                raise ValueError(f"record {r['rid']}: a segment is missing")
            h.update(r["data"])
            done, follows = done + len(r["data"]), follows + 1
            if h.hexdigest() != r["payload_digest"] or done != r["payload_bytes"]:
                raise ValueError(f"record {r['rid']}: digest or length differs")
            if r["segment"] == r["segments"]:
                rows.append({**r, "kind": "response"})
                open_rid = None
        if rows:
            yield out(rows)
    if open_rid is not None:
        raise ValueError(f"record {open_rid}: a segment is missing")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive, checked against its contents."""
    sep = f"\r\n\r\nWARC/1.0\r\nWARC-Archive: {name}\r\n"
    parsed = spark.read.schema("value string").option("lineSep", sep).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, PARSED)
    done = "page_id long, payload_bytes long, payload_digest string, kind string, refers_to long"
    single = parsed.where("segments = 1").mapInArrow(_checked, done)
    many = parsed.where("segments > 1").repartition("rid").sortWithinPartitions("rid", "segment").mapInArrow(_checked, done)
    return single.unionByName(many).withColumnRenamed("kind", "record_type")


def round_trip(pages: DataFrame, chunk=CHUNK, least=LEAST) -> DataFrame:
    """Writes an archive of ``pages`` to the shared folder and reads it back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    return read(spark, path, write(pages, path, chunk, least))
