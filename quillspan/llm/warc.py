"""WARC archives with revisit resolution.

``write_archives`` turns page rows into WARC/1.1 files, ``read_archives`` parses
such files, and ``resolve_revisits`` shuffles only the headers by payload
digest, joins revisit records to their original responses, sends each archive
the list of its verdicts, and writes every archive anew next to its list, with
fresh headers.  Payloads are read where their archive lies and never shuffled.

Files go through Spark's text sink: a record's header and block are one row and
the line separator is the blank-line pair that ends a WARC record, so any file
system that Spark can write to will do.  Files hold about ``ARCHIVE_BYTES``
of records each, which bounds what one reader task holds; a record larger than
that has a file to itself or shares one with few others.

Null html is an empty payload.  A null page id has a record id without a page in
it and comes back as null; as an original it ranks below every other id.  Rows
with equal ids are records of their own: of equal payloads under the largest id
the one in the last place of the last archive stays the response.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.workspace import fresh_path, materialize, table

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 1000
#: Verdicts that may be broadcast, some 100 bytes each; a list belongs to an archive of ``ARCHIVE_BYTES``.
BROADCAST_VERDICTS = 200_000
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_COLUMNS = "page_id long, uri string, warc_date string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _urn(generation: Column | str, page_id: Column) -> Column:
    """A record id; the page id stands in the last 16 hex digits, so that readers get it back, after a digit that says whether there is one."""
    head = F.substring(F.md5(F.concat_ws("/", F.lit(generation), page_id.cast("string"))), 1, 15)
    tail = F.lpad(F.lower(F.hex(F.coalesce(page_id, F.lit(0)))), 16, "0")
    full = F.concat(head, F.when(page_id.isNull(), "0").otherwise("1"), tail)
    parts = [F.substring(full, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, generation: str, page_id: Column, uri: Column, date: Column, payload: Column, size: Column, digest: Column, refers_to: Column, refers_uri: Column) -> Column:
    """Header and block of one record; a revisit's block has the HTTP header alone."""
    revisit = kind == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn(generation, page_id),
        F.lit(f"{CRLF}WARC-Date: "), date,
        F.lit(f"{CRLF}WARC-Target-URI: "), clean(uri),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(
            F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), _urn(generation, refers_to),
            F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), clean(refers_uri))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"),
        F.lit(CRLF * 2), http, F.when(revisit, F.lit("")).otherwise(payload),
    )


def _files_for(total_bytes: int) -> int:
    return max(1, -(-total_bytes // ARCHIVE_BYTES))


def _write(records: DataFrame, path: str) -> str:
    records.select("record").write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)
    return path


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> str:
    """One response record per row; returns the folder that holds the archives."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload") + 600).cast("long")).first()[0] or 0
    size = F.octet_length("payload").cast("long")
    none = F.lit(None)
    record = _record(F.lit("response"), "capture", F.col("id"), F.col("uri"), F.lit(date), F.col("payload"), size, F.sha1("payload"), none.cast("long"), none.cast("string"))
    # dealt by id and URI: no key is hot, and files come out of about equal size
    dealt = rows.repartition(_files_for(total), F.xxhash64("id", "uri"))
    return _write(dealt.select(record.alias("record")), fresh_path(pages.sparkSession, "warc-capture"))


def parse_records(content: bytes):
    """(headers, block) of each record of a possibly gzipped archive; follows Content-Length alone."""
    if content[:2] == b"\x1f\x8b":
        plain, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        content = b"".join(plain)
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        lines = content[at:head_end].decode("utf-8").split(CRLF)
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        start = head_end + 4
        end = start + int(headers["content-length"])
        yield headers, content[start:end]
        at = end + 4


def _page_of(urn: str) -> int | None:
    digits = urn.strip("<>").replace("-", "")[-17:]
    if digits[0] == "0":
        return None
    tail = int(digits[1:], 16)
    return tail - (1 << 64) if tail >> 63 else tail


def _row(headers: dict, block: bytes) -> tuple[list, bytes]:
    """(page id, URI, date, type, payload size and digest, what a revisit refers to) and the payload of a record."""
    split = block.index(b"\r\n\r\n") + 4
    payload, revisit = block[split:], headers["warc-type"] == "revisit"
    http = block[:split].lower()
    mark = http.index(b"content-length:") + 15
    size = int(http[mark : http.index(b"\r\n", mark)])
    # a response's digest is taken from what was read, a revisit has it in its header
    digest = headers["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha1(payload).hexdigest()
    refers = _page_of(headers["warc-refers-to"]) if revisit else None
    return [_page_of(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-date"], headers["warc-type"], size if revisit else len(payload), digest, refers], payload


def _reader(with_payload: bool, batch_bytes: int = 8 << 20):
    names = [("page_id", pa.int64()), ("uri", pa.string()), ("warc_date", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(names + ([("payload", pa.string())] if with_payload else []))

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse_records(content.as_buffer().to_pybytes()):
                    row, payload = _row(headers, block)
                    if with_payload:
                        row.append(payload.decode("utf-8"))
                        held += len(payload)
                    rows.append(row)
                    held += 200
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of all archives in a folder: ids, URI, date, type, payload size and digest, what a revisit refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), RECORD_COLUMNS + (", payload string" if with_payload else ""))


def _places(batches):
    """Header of each record with the place of the record in its archive."""
    schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("page_id", pa.int64()), ("uri", pa.string()), ("size", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for place, (headers, block) in enumerate(parse_records(content.as_buffer().to_pybytes())):
                row, _ = _row(headers, block)
                rows.append((path, place, row[0], row[1], row[4], row[5]))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))) if rows else {n: [] for n in schema.names}, schema=schema)


def _resolver(batches):
    """Records of each archive with their verdicts: (page_id, uri, payload or null for a revisit, size, digest, original id and URI)."""
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("revisit", pa.bool_()), ("payload", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("original_id", pa.int64()), ("original_uri", pa.string())])
    for batch in batches:
        for content, verdicts in zip(batch.column(0), batch.column(1).to_pylist()):
            verdict = {v["place"]: v for v in verdicts or ()}
            rows, held = [], 0
            for place, (headers, block) in enumerate(parse_records(content.as_buffer().to_pybytes())):
                row, payload = _row(headers, block)
                v = verdict.get(place)
                text = None if v else payload.decode("utf-8")
                rows.append((row[0], row[1], v is not None, text, row[4], row[5], v and v["original_id"], v and v["original_uri"]))
                held += 200 + len(payload)
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)


def resolve_revisits(spark: SparkSession, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-02T00:00:00Z") -> str:
    """Write deduplicated archives from those in ``path`` and return their folder.

    Among records with equal payloads of at least ``min_bytes`` the one with the
    largest page id stays a response and the others become revisits of it.
    Headers are combined per digest before they are shuffled, so a digest that a
    third of all records share is one row per task, and only repeated digests
    are joined back to the headers.  The verdicts of an archive, one short row
    for each of its revisits, then meet the archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    headers = materialize(files.select("path", "content").mapInArrow(_places, "path string, place int, page_id long, uri string, size long, digest string"), "warc-headers")
    large = headers.filter(F.col("size") >= min_bytes)
    best = F.max(F.struct("page_id", "path", "place", "uri")).alias("o")
    originals = large.groupBy("digest", "size").agg(F.count("*").alias("n"), best).filter("n > 1")
    originals = materialize(originals.select("digest", "size", F.col("o.page_id").alias("original_id"), F.col("o.uri").alias("original_uri"), F.col("o.path").alias("o_path"), F.col("o.place").alias("o_place")), "warc-originals")
    revisits = large.join(originals, ["digest", "size"]).filter((F.col("path") != F.col("o_path")) | (F.col("place") != F.col("o_place")))
    verdicts = materialize(revisits.groupBy("path").agg(F.collect_list(F.struct("place", "original_id", "original_uri")).alias("verdicts")), "warc-verdicts")
    # archives are few and stay where they are while their lists fit a broadcast; else both sides meet by path
    total = verdicts.agg(F.sum(F.size("verdicts"))).first()[0] or 0
    listed = F.broadcast(verdicts) if total <= BROADCAST_VERDICTS else verdicts
    resolved = files.select("path", "content").join(listed, "path", "left").select("content", "verdicts")
    rows = resolved.mapInArrow(_resolver, "page_id long, uri string, revisit boolean, payload string, size long, digest string, original_id long, original_uri string")
    record = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), "dedup", F.col("page_id"), F.col("uri"), F.lit(date), F.coalesce("payload", F.lit("")), F.col("size"), F.col("digest"), F.col("original_id"), F.col("original_uri"))
    return _write(rows.select(record.alias("record")), fresh_path(spark, "warc-dedup"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through capture archives, revisit resolution and the deduplicated archives."""
    deduplicated = resolve_revisits(spark, write_archives(table(spark, sf_dir, "pages")))
    return read_archives(spark, deduplicated).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""
