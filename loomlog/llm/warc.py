"""Convert ARC archives (versions 1 and 2) to WARC, and read both.

`write_arc` packs pages into ARC files, `read_arc` parses the version block and, by it, each record's
header line and declared length, `to_warc` makes the equivalent WARC records (response, or revisit where an earlier
record has the same payload) with identifiers, timestamps, types and digests, and `read_warc` reads
those back. An archive is one row of text and one file of about `archive_bytes` (or of one longer
record), so a task holds one archive at a time; files are written and read by Spark, in the shared
folder. Which record of equal payloads is the response is settled by an aggregate over digests that collapses
copies by task.

Identifiers are derived from the page and its digest, so a task that runs again writes the same record.

Defined cases: a null url is written as `-` and a null html as an empty payload; urls are
percent-encoded in header lines; rows that repeat an id and a payload share an identifier, and all of them are responses
if their id is the smallest; a null id is written as `-`, and null ids come last among equal payloads; an empty table gives
no archive; other columns are not written.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import new_path, stage

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
#: The field lists of the two versions of the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
DATE, ARCHIVE_BYTES = "20240101000000", 8 << 20
PARSED = "url string, ip string, date string, mime string, page_id long, payload string, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}/{payload_digest}')}>"


def http_block(page_id, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if page_id is None else page_id}\r\n\r\n"
    return head.encode() + payload


def http_split(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def arc_start(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 loomlog\n{' '.join(FIELDS[version])}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ")
    return f"{line}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, page_id, payload: bytes, date: str = DATE) -> bytes:
    block = http_block(page_id, payload)
    line = f"{quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else '-'} 0.0.0.0 {date} text/html "
    if version == 2:
        line += f"200 {digest(payload)} - {offset} {name} "
    return f"{line}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive; the version block says which fields there are."""
    at, fields = 0, None
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace")
        if not line.strip():
            at = stop + 1 if stop >= 0 else len(data)
            continue
        parts = line.split(" ")
        if not parts[-1].isdigit() or stop < 0 or stop + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"bad ARC header line at byte {at}: {line[:80]!r}")
        block = data[stop + 1 : stop + 1 + int(parts[-1])]
        at = stop + 1 + len(block)
        if fields is None:
            version = int(block.split(b" ", 1)[0]) if line.startswith("filedesc://") else 0
            if version not in FIELDS:
                raise ValueError(f"no version block of a known version: {line[:80]!r}")
            fields = FIELDS[version]
            continue
        if len(parts) != len(fields):
            raise ValueError(f"a record of {len(parts)} fields where the version has {len(fields)}: {line[:80]!r}")
        yield dict(zip(fields, parts)), block


def warc_record(kind: str, url: str, page_id, payload: bytes, payload_digest: str, date: str, first_id=None) -> bytes:
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    block = http_block(page_id, payload) if kind == "response" else http_block(page_id, b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, payload_digest)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first_id, payload_digest)}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:stop].decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        if stop + 4 + size > len(data):
            raise ValueError(f"a record is cut short at byte {at}")
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def _archives(rows: DataFrame, path: str, make, archive_bytes: int) -> str:
    """Write one file an archive; make(row, place in the archive) gives a record, and the start of an archive for no row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for row in b.itertuples(index=False):
                if not held:
                    held = [make(None, 0)]
                    size = len(held[0])
                held.append(make(row, size))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"value": [b"".join(held).decode()]})
                    held = []
        if held:
            yield pd.DataFrame({"value": [b"".join(held).decode()]})

    rows.mapInPandas(work, "value string").write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)
    return path


def write_arc(pages: DataFrame, path: str, version: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write pages as ARC files of the version; returns the path."""
    name = f"loomlog-v{version}.arc"

    def make(row, offset):
        if row is None:
            return arc_start(version, name)
        return arc_record(version, name, offset, row.url, None if pd.isna(row.i) else int(row.i), (row.html or "").encode())

    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return _archives(rows, path, make, archive_bytes)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of the ARC files under path, see PARSED; digests are of the payload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in parse_arc(_inflate(content.as_py())):
                    head, payload = http_split(block)
                    page_id = head.get("x-page-id", "-")
                    url = fields["URL"]
                    rows.append((None if url == "-" else unquote(url), fields["IP-address"], fields["Archive-date"], fields["Content-type"], None if page_id == "-" else int(page_id), payload.decode("utf-8", "replace"), len(payload), digest(payload)))
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 8, kinds)], ["url", "ip", "date", "mime", "page_id", "payload", "payload_bytes", "payload_digest"])

    return _files(spark, path).mapInArrow(work, PARSED)


def to_warc(records: DataFrame, path: str, smallest_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write WARC archives of the rows of `read_arc`; returns the path.

    Of records with equal payloads of at least `smallest_payload` bytes, that with the smallest
    page_id is the response; the others revisit it.
    """
    repeated = records.where(F.col("payload_bytes") >= smallest_payload).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = stage(repeated, "first-records")  # written, so that the join below can be split where one payload is hot
    rows = records.join(firsts, ["payload_digest", "payload_bytes"], "left").select("url", "date", "page_id", "payload", "payload_bytes", "payload_digest", (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= smallest_payload)).alias("again"), "first_id")

    def make(row, offset):
        if row is None:
            info = b"software: loomlog\r\nformat: WARC File Format 1.1\r\n"
            return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, 'info')}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
        number = lambda x: None if pd.isna(x) else int(x)
        return warc_record("revisit" if row.again else "response", quote(row.url, safe=":/?#[]@!$&()*+,;=%~") if row.url else "-", number(row.page_id), row.payload.encode(), row.payload_digest, row.date, number(row.first_id))

    return _archives(rows, path, make, archive_bytes)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of the WARC files under path.

    page_id, url, warc_date, record_type, record_id, refers_to_id, payload_bytes and payload_digest
    (of the full payload; that of a response is checked against its bytes), payload (null for a revisit).
    """
    schema = "page_id long, url string, warc_date string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in parse_warc(_inflate(content.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = http_split(block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != said:
                        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
                    page_id = head.get("x-page-id", "-")
                    url = fields["warc-target-uri"]
                    rows.append((None if page_id == "-" else int(page_id), None if url == "-" else unquote(url), fields["warc-date"], kind, fields["warc-record-id"], fields.get("warc-refers-to"), int(fields["x-payload-length"]), said, payload.decode("utf-8", "replace") if kind == "response" else None))
                kinds = [pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 9, kinds)], [x.split()[0] for x in schema.split(", ")])

    return _files(spark, path).mapInArrow(work, schema)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC (even ids as version 1, the others as version 2), ARC to WARC, and the WARC read back.

    The rows of `read_warc` without payloads, with refers_to (the page_id of the response referred to).
    """
    spark = pages.sparkSession
    even = F.coalesce(F.col(id_col).cast("long") % 2 == 0, F.lit(False))
    arc = new_path(spark, "arc")
    write_arc(pages.where(even), f"{arc}/v1", 1, id_col, url_col, html_col, archive_bytes)
    write_arc(pages.where(~even), f"{arc}/v2", 2, id_col, url_col, html_col, archive_bytes)
    records = read_arc(spark, f"{arc}/v1").unionAll(read_arc(spark, f"{arc}/v2"))
    warc = to_warc(records, new_path(spark, "warc"), smallest_payload, archive_bytes)
    back = stage(read_warc(spark, warc).drop("payload"), "warc-index")
    responses = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    return back.join(responses, "refers_to_id", "left")
