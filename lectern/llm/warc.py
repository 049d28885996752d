"""WARC archives: writing with segments and revisits, reading back with segment reassembly.

A page becomes one HTTP response with chunked transfer framing. Of pages with equal payloads of MIN_REVISIT
bytes or more, the one with the smallest page_id is a response, the others are revisit records that name it. A
block longer than SEGMENT_BYTES is cut: the first record keeps its type and segment number 1, continuation
records follow under ids of their own with the first one's id as origin, and the last has the total length.

Archives are gzipped files of complete records, written by Spark's own writer (a record ends with two line
ends, the writer's separator), so they lie wherever Spark can write, and file sizes are bounded by
RECORDS_PER_FILE records of at most a segment each. Reading parses whole files; only segments are then grouped
by origin, ordered, checked against the total length and joined, and the chunks are undone.

A very long payload is cut into segments. Nulls: a null html is an empty payload, a null url an empty target, a null page_id is written as empty and read
back as null. It counts as larger than any id; pages equal in id and payload are all responses, under ids of their own, and
then revisits name their page alone. Empty tables
give an archive without records. Further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, join_hot, new_path, slices, tidy, written

MIN_REVISIT = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 2_000
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: Of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
HTTP = "application/http;msgtype=response"


def record_id(*of: object) -> str:
    """A record id that follows from what it is given; with the id of a run among it no two archives share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, '|'.join(map(str, of)))}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over. ValueError if it is cut short."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, uid: str, block: bytes, **more: str | int | None) -> bytes:
    """A record without its two closing line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": uid, "WARC-Date": NO_DATE, **{f"WARC-{k.replace('_', '-')}": v for k, v in more.items()}, **({} if kind == "continuation" else {"Content-Type": HTTP}), "Content-Length": len(block)}
    return VERSION + b"".join(f"\r\n{k}: {v}".encode() for k, v in head.items() if v is not None) + END + block


def segments(kind: str, uid: str, block: bytes, size: int = SEGMENT_BYTES, **more: str | int | None) -> list[bytes]:
    """The record, in as many as its block needs."""
    if len(block) <= size:
        return [record(kind, uid, block, **more)]
    cut = [block[i : i + size] for i in range(0, len(block), size)]
    out = [record(kind, uid, cut[0], Segment_Number=1, **more)]
    for i, part in enumerate(cut[1:], 2):
        last = {"Segment_Total_Length": len(block)} if i == len(cut) else {}
        out.append(record("continuation", record_id(uid, i), part, Segment_Origin_ID=uid, Segment_Number=i, **last))
    return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(END, at)
        head = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode()
        begin = stop + len(END)
        end = begin + int(head["content-length"])
        if data[end : end + len(END)] != END:
            raise ValueError(f"record at byte {at} has a wrong length")
        yield head, data[begin:end]
        at = end + len(END)


def _as_uri(url: str | None, page_id: int | None) -> str:
    """One line, so that no url can break the head."""
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "") or f"urn:page:{page_id}"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest; first: the page_id of the response that a revisit refers to, else null; named: whether the
    record is such a response, and the only row of its page; single: whether the response is, so that its record can be named."""
    rows = columns_of(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256)
    by_page = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy(digest.alias("digest"), "page_id").agg(F.count("*").alias("n"))
    keys = by_page.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("n", F.coalesce("page_id", F.lit((1 << 63) - 1))).alias("same"), F.sum("n").alias("n")).where("n > 1")
    groups = written(keys, "equal-pages")
    out = join_hot(rows.withColumn("digest", digest), groups.select("digest", "first", "same"), "digest", groups)
    is_first = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    single = F.coalesce(F.col("same") == 1, F.lit(False))
    return out.withColumn("named", is_first & single).withColumn("first", F.when(~is_first, F.col("first"))).withColumn("single", single).drop("same")


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages under the path. Record ids hold the id of this run, so archives of several runs can be read
    together."""
    identity = uuid.uuid4().hex

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, run = TaskContext.get().partitionId(), 0, identity
        for batch in slices(batches, "payload"):
            out: list[bytes] = []
            for row in batch.to_pylist():
                payload, first = row["payload"], row["first"]
                uid = record_id(run, row["digest"]) if row["named"] else record_id(run, part, n, row["digest"])
                n += 1
                more = {"Target_URI": _as_uri(row["url"], row["page_id"]), "Payload_Digest": f"sha256:{row['digest']}", "Page_ID": "" if row["page_id"] is None else row["page_id"]}
                if first is None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                    out += segments("response", uid, block, **more)
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    named = {"Refers_To": record_id(run, row["digest"])} if row["single"] else {}  # where the page has several rows none has that id
                    out.append(record("revisit", uid, block, Profile=PROFILE, **named, Refers_To_Page_ID=first, **more))
            for i in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 500], pa.binary())], ["value"])

    plan(pages).mapInArrow(tidy(lines), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


PARSED = "origin string, segment int, total bigint, kind string, page_id bigint, digest string, refers_to bigint, block binary"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, segments int, error string, payload binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARSED: origin names all records of a block within all archives."""
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            rows: list[tuple] = []
            for head, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                segmented = "warc-segment-number" in head
                rows.append((head.get("warc-segment-origin-id", head["warc-record-id"]), int(head["warc-segment-number"]) if segmented else None, number(head.get("warc-segment-total-length")), head["warc-type"], number(head.get("warc-page-id")), digest, number(head.get("warc-refers-to-page-id")), block))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _decoded(keep_payload: bool):
    """Rows of READ from whole blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segments", pa.int32()), ("error", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                parts = sorted(x["parts"], key=lambda p: p["segment"] or 1)
                numbers = [p["segment"] or 1 for p in parts]
                block = b"".join(p["block"] for p in parts)
                total, error, payload = x["total"], None, b""
                if numbers != [*range(1, len(parts) + 1)] or (len(parts) > 1 and total is None):
                    error = "segments missing"
                elif total is not None and total != len(block):
                    error = "wrong total length"
                head, _, body = block.partition(END)
                size = re.search(rb"\r\nContent-Length: (\d+)", head)
                if error is None and x["kind"] == "response":
                    try:
                        payload = unchunked(body) if re.search(rb"\r\nTransfer-Encoding: chunked", head) else body
                    except ValueError as e:
                        error = str(e)
                    if error is None and hashlib.sha256(payload).hexdigest() != x["digest"]:
                        error = "wrong digest"
                n = len(payload) if x["kind"] == "response" else int(size[1]) if size else None
                rows.append((x["page_id"], n, x["digest"], x["kind"], x["refers_to"], len(parts), error, payload if keep_payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read(spark, path: str, keep_payload: bool = False) -> DataFrame:
    """A row of READ for each response or revisit in the archives under the path; error says what is wrong with it."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(tidy(_parse), PARSED)
    part = F.struct("segment", "block")
    whole = parsed.where("segment is null").select("kind", "page_id", "digest", "refers_to", "total", F.array(part).alias("parts"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parsed.where("segment is not null").groupBy("origin").agg(first("kind"), first("page_id"), first("digest"), first("refers_to"), F.max("total").alias("total"), F.collect_list(part).alias("parts")).drop("origin")
    return whole.unionByName(joined).mapInArrow(_decoded(keep_payload), READ)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes archives of all pages, reads them back and returns their digest rows."""
    path = path or new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).drop("payload")


SQL = f"""
with pages_ as (select page_id, coalesce(html, '') as h from pages),
groups as (select h, min(page_id) as least, count(*) as n from pages_ where strlen(h) >= {MIN_REVISIT} group by h)
select p.page_id, strlen(p.h) as payload_bytes, sha256(p.h) as payload_digest, case when g.least < p.page_id then 'revisit' else 'response' end as record_type, case when g.least < p.page_id then g.least end as refers_to
from pages_ p left join groups g on g.h = p.h
"""
