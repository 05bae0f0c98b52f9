r"""WARC: pages written as request, response or revisit, and metadata records; read back and assembled per capture.

A capture's records name each other by WARC-Concurrent-To. Archives are gzip files in WARC/1.1 that Spark's text writer
makes on any store: a row is a record without its last two line ends, which are the writer's line separator. Reading
goes by Content-Length alone, so payloads may contain anything.

Each row of pages is a capture of its own, with a row number in its record ids. The table is read twice, for the payloads'
hashes and for the records, and must give its rows in the same order both times, as files do.

Defined results: a null html is an empty payload, a null url gives no WARC-Target-URI; pages with equal payloads (SHA-1,
SHA-256 and length) of at least `min_bytes` bytes are revisits of that with the smallest page_id (null last); rows that
repeat the smallest page_id are all responses; archives hold at most about FILE_BYTES of payloads, a longer page has one of
its own; extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm.common import durable, hinted, salted_join, shared_dir, with_python

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that an archive holds at most, unless a single page has more; pages up to SMALL bytes share archives of
#: PER_FILE pages, longer ones, class by class of doubled size, archives of fewer.
FILE_BYTES, SMALL = 128 << 20, 64 << 10
PER_FILE = FILE_BYTES // SMALL
#: Bytes of an archive read at once, and of its compressed members.
PIECE, PACKED_PIECE = 1 << 20, 1 << 16
RECORD = "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, block binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digest_rows(batches):
    for batch in batches:
        bodies = [(v.as_py() or "").encode("utf-8", "surrogatepass") for v in batch.column(2)]
        columns = (pa.array(map(payload_digest, bodies), pa.string()), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()), pa.array(map(len, bodies), pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["row", "page_id", "digest", "sha256", "n_bytes"])


def _urn(page_id, digest: str, row: int, kind: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}:{row}:{kind}>"


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: str) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block.encode("utf-8", "surrogatepass"))))]
    return "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head if v is not None) + CRLF + block


def _uri(url: str | None) -> str | None:
    """A url fit for a header line: control characters and spaces percent-coded."""
    return None if url is None else "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def capture_records(row: int, page_id, url: str | None, html: str | None, first: tuple | None) -> list[str]:
    """The three records of one page; first: page_id and row of the response that a revisit refers to."""
    html = html or ""
    payload = html.encode("utf-8", "surrogatepass")
    digest, uri = payload_digest(payload), _uri(url)
    main = "response" if first is None else "revisit"
    main_id = _urn(page_id, digest, row, main)
    http = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + f"Content-Length: {len(payload)}" + CRLF * 2
    target = ("WARC-Target-URI", uri)
    more = [] if first is None else [("WARC-Refers-To", _urn(first[0], digest, first[1], "response")), ("WARC-Profile", REVISIT_PROFILE)]
    ask = f"GET {uri or '*'} HTTP/1.1" + CRLF * 2
    return [
        _record("request", _urn(page_id, digest, row, "request"), [target, ("WARC-Concurrent-To", main_id), ("Content-Type", "application/http; msgtype=request")], ask),
        _record(main, main_id, [target, *more, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http + (html if first is None else "")),
        _record("metadata", _urn(page_id, digest, row, "metadata"), [target, ("WARC-Concurrent-To", main_id), ("Content-Type", "application/warc-fields")], f"fetched-bytes: {len(payload)}{CRLF}"),
    ]


def _record_rows(batches):
    """row, page_id, url, html and the response that the page repeats, if any (page_id, row), to records."""
    for batch in batches:
        out, held = [], 0
        for row, page_id, url, html, first in zip(*[c for c in batch.columns]):
            first = first.as_py()
            out += capture_records(row.as_py(), page_id.as_py(), url.as_py(), html.as_py(), first and (first["page_id"], first["row"]))
            held += len(out[-2])
            if len(out) >= 300 or held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _size_class(n_bytes: Column) -> Column:
    """0 for pages of up to SMALL bytes, 1 up to twice as many, and so on."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n_bytes, F.lit(1)) / F.lit(float(SMALL))))).cast("int")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives of pages (page_id, url, html) under path."""
    d = with_python(pages).select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digests = durable(d.select("row", "page_id", "html").mapInArrow(_digest_rows, "row long, page_id long, digest string, sha256 binary, n_bytes long"), "payloads")
    keys = ["digest", "sha256", "n_bytes"]
    first = F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("row")))
    groups = digests.filter(F.col("n_bytes") >= min_bytes).groupBy(*keys).agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = durable(groups.select(*keys, F.struct("first.page_id", "first.row").alias("first")), "payload_groups")
    again = salted_join(digests, groups, keys, "row").filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    again = hinted(durable(again.select(F.col("row").alias("again_row"), "first"), "revisits"), 48)
    classes = [r["k"] for r in digests.select(_size_class(F.col("n_bytes")).alias("k")).distinct().collect()]
    # One pass for each class of sizes, of which there are no more than doublings up to the longest page; mostly one.
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    for k in sorted(classes):
        some = d.filter(_size_class(size) == k) if len(classes) > 1 else d
        marked = some.join(again, F.col("row") == F.col("again_row"), "left").select("row", "page_id", "url", "html", "first")
        records = marked.mapInArrow(_record_rows, "value string")
        records.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, PER_FILE >> k)).text(path)


def _plain(blob: bytes):
    """The bytes of an archive in pieces: of gzip members one after another, or as they are."""
    if blob[:2] != b"\x1f\x8b":
        for at in range(0, len(blob), PIECE):
            yield blob[at : at + PIECE]
        return
    at, rest, member = 0, b"", zlib.decompressobj(31)
    while rest or at < len(blob):
        if not rest:
            rest, at = blob[at : at + PACKED_PIECE], at + PACKED_PIECE
        if member.eof:
            rest = rest.lstrip(b"\0")
            if not rest:
                continue
            member = zlib.decompressobj(31)
        yield member.decompress(rest, PIECE)
        rest = member.unused_data if member.eof else member.unconsumed_tail
    if not member.eof:
        yield member.flush()


def parse_records(pieces):
    """(headers in lower case, block) of each record; pieces: the archive's bytes.

    What was read stays in front of an offset until a piece's worth of it is dropped at once, so the time is linear.
    """
    held, at = bytearray(), 0
    pieces = iter(pieces)

    def more() -> bool:
        nonlocal at
        new = next(pieces, None)
        if new is None:
            return False
        if at >= PIECE:
            del held[:at]
            at = 0
        held.extend(new)
        return True

    while True:
        while at < len(held) or more():
            if at < len(held) and held[at] in b"\r\n":
                at += 1
            elif at < len(held):
                break
        if at >= len(held):
            return
        searched = 0
        while (end := held.find(b"\r\n\r\n", at + searched)) < 0:
            # The offset may move as bytes are dropped; three bytes of an end may be there already.
            searched = max(0, len(held) - at - 3)
            if not more():
                raise ValueError("a record's header has no end")
        lines = bytes(held[at:end]).decode("utf-8", "surrogatepass").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record must begin with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        n = int(headers["content-length"])
        while len(held) - at < n:
            if not more():
                raise ValueError("a record's block is shorter than its length")
        block = bytes(held[at : at + n])
        at += n
        yield headers, block


def _parsed_row(h: dict, block: bytes) -> dict:
    kind, digest, n, ok = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            n, ok = len(payload), digest is None or payload_digest(payload) == digest
        else:
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
            n = int(fields[b"content-length"]) if b"content-length" in fields else None
    return {"record_id": h["warc-record-id"], "warc_type": kind, "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": n, "digest_ok": ok, "block": block}


_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])


def _parse_files(batches):
    for batch in batches:
        for blob in batch.column(0):
            rows, held = [], 0
            for headers, block in parse_records(_plain(blob.as_py())):
                rows.append(_parsed_row(headers, block))
                held += len(block)
                if len(rows) >= 1000 or held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under path."""
    return with_python(spark.read.format("binaryFile").load(path)).select("content").mapInArrow(_parse_files, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the requests and metadata records concurrent to it.

    One grouping by the capture's record id, which the records beside it name, so the archives are read once. Archives in
    which a record id repeats give each of its captures all of what is concurrent to it.
    """
    kind = F.col("warc_type")
    main = kind.isin("response", "revisit")
    d = records.filter(main | (kind.isin("request", "metadata") & F.col("concurrent_to").isNotNull()))
    one = F.struct("record_id", "target_uri", "block")
    capture = F.struct("record_id", "warc_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "digest_ok", "block")
    d = d.groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("_capture")).agg(
        F.collect_list(F.when(main, capture)).alias("captures"),
        F.collect_list(F.when(kind == "request", one)).alias("requests"),
        F.collect_list(F.when(kind == "metadata", one)).alias("metadata"),
    )
    return d.select(F.col("_capture").alias("record_id"), F.explode("captures").alias("capture"), "requests", "metadata")


def page_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:([^:]*):", 1), F.lit("null")).cast("long")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lexivec/archive-{uuid.uuid4().hex}"
    # Read as it is: rows that are dealt out anew may come in another order when read again.
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    c = assemble(read_records(spark, path))
    return c.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        page_of(F.col("capture.refers_to")).alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
        F.size("metadata").cast("long").alias("n_metadata"),
    )


OP6_SQL = """
with d as (select page_id, coalesce(html, '') body from pages),
h as (select page_id, strlen(body) n, body, sha1(body) x from d),
b as (select *, list_transform(range(8), lambda i: ('0x' || substr(x, i * 5 + 1, 5))::int) v from h),
e as (select page_id, n, min(page_id) over (partition by body) first_id,
        array_to_string(list_transform(v, lambda a: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((a >> k) & 31) + 1, 1)), '')), '') digest
      from b)
select page_id, n payload_bytes, digest payload_digest, case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id = first_id then null else first_id end refers_to, 1::bigint n_requests, 1::bigint n_metadata
from e
"""
