"""WARC archives: writing with payload deduplication, and a salvage reader.

Archives are rows (archive, content binary) of a table in the shared folder, so Spark writes and reads them on any
store; ``spark.read.format("binaryFile")`` gives the same shape for archive files. Each record is a gzip member of its
own. The reader checks every member, header and digest. After a failed check it searches for the next member, or in
plain archives the next version line, goes on from there, and logs the bytes between as a quarantined gap. It passes
over an archive once, whatever the number of records and damages.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import join_marked, materialize, prepare

# Fixed values of the format.
VERSION = b"WARC/1.1"
_MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_DATE = "2020-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records (compressed) after which a task starts the next archive.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes that are inflated at once.
INFLATE_BYTES = 1 << 16
#: What a reader of foreign archives takes in by default: inflated bytes of a record, and bytes of its header. What is larger is
#: quarantined with that as the reason. Without limits a small member may inflate to any size.
RECORD_BYTES: int | None = 1 << 30
HEADER_BYTES: int | None = 1 << 20


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def format_record(fields: dict[str, str], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    return VERSION + b"\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def compress_record(record: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int = 0, header_bytes: int | None = None) -> tuple[dict[str, str], bytes, int]:
    """The header fields (names in lower case), the block, and where the record ends; a header may have ``header_bytes``."""
    line = _LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at, len(data) if header_bytes is None else at + header_bytes)
    if end < 0:
        raise Damaged("no end of header" + ("" if header_bytes is None else f" in {header_bytes} bytes"))
    fields = {}
    for one in data[line.end() : end].split(b"\r\n"):
        name, colon, value = one.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":  # before the block is copied
        raise Damaged("length does not fit")
    block = data[start:stop]
    for name in _digests_of(fields):
        want = fields.get(name, "")
        if want.startswith("sha1:") and want != "sha1:" + digest_of(block):
            raise Damaged(f"{name} differs")
    return fields, block, stop + 4


def _digests_of(fields: dict[str, str]) -> list[str]:
    """The digests that are of the block: a revisit's payload is elsewhere, and within HTTP it is only a part of it."""
    inner = fields.get("warc-type") == "revisit" or fields.get("content-type", "").startswith("application/http")
    return ["warc-block-digest"] + ["warc-payload-digest"] * (not inner)


def _inflate(content: memoryview, at: int, record_bytes: int | None) -> tuple[bytes, int]:
    """The gzip member that begins at ``at``, and where it ends; it may inflate to ``record_bytes``."""
    inflate, parts, size = zlib.decompressobj(31), [], 0
    while not inflate.eof:
        if at >= len(content):
            raise Damaged("member is cut off")
        part = content[at : at + INFLATE_BYTES]
        try:
            parts.append(inflate.decompress(part))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        at, size = at + len(part), size + len(parts[-1])
        if record_bytes is not None and size > record_bytes:
            raise Damaged(f"a member of more than {record_bytes} bytes")
    return b"".join(parts), at - len(inflate.unused_data)


def salvage(content: bytes, record_bytes: int | None = None, header_bytes: int | None = None) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """(offset, length, fields, block, None) of each record; (offset, length, None, b"", reason) of each quarantined gap.

    The reason is that of the gap's first failed check. Records and headers have any size unless a limit is given.
    """
    at = gap = 0
    why = None
    view, starts = memoryview(content), _Starts(content)
    while at < len(content):
        try:
            if content.startswith(_MAGIC, at):
                record, end = _inflate(view, at, record_bytes)
                fields, block, used = parse_record(record, 0, header_bytes)
                if used != len(record):
                    raise Damaged("more than a record in the member")
            else:
                fields, block, end = parse_record(content, at, header_bytes)
                if record_bytes is not None and end - at > record_bytes:
                    raise Damaged(f"a record of more than {record_bytes} bytes")
        except Damaged as e:
            why = why or str(e)
            at = starts.after(at + 1)
            continue
        if gap < at:
            yield gap, at - gap, None, b"", why
        yield at, end - at, fields, block, None
        at = gap = end
        why = None
    if gap < len(content):
        yield gap, len(content) - gap, None, b"", why


def read_archive(content: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """``salvage`` without limits and reasons."""
    return (found[:4] for found in salvage(content))


class _Starts:
    """Where members and version lines begin. Each is searched for once: what was found ahead is kept."""

    def __init__(self, content: bytes) -> None:
        self.content, self.member, self.line = content, -1, -1

    def after(self, at: int) -> int:
        """The first beginning at ``at`` or later; the content's end without one."""
        if self.member < at:
            found = self.content.find(_MAGIC, at)
            self.member = found if found >= 0 else len(self.content)
        if self.line < at:
            line = _LINE.search(self.content, at)
            self.line = line.start() if line else len(self.content)
        return min(self.member, self.line)


def write_warc(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Archives of one record a row: archive string, content binary; written to the shared folder.

    Of rows with equal payloads the one with the smallest id is a response with the payload; the others are revisits
    that refer to it. Null payloads are empty ones. Null ids come after all others; rows that share the smallest id
    are all responses. Digests are counted first, so no group of equal payloads is gathered anywhere, and payloads whose
    digest is none of the repeated ones are not shuffled. An empty table gives no archive.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("sorted"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    first = rows.groupBy("digest").agg(F.min("sorted").cast("string").alias("first"), F.count("*").alias("n"))
    repeated = materialize(first.where("n > 1").select("digest", "first"), "repeated", pages.count())
    placed = join_marked(rows, repeated, "digest", "left").select("id", "first", "payload", "digest")
    names = [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "first", "payload", "digest")]
            for page, refers, text, hexed in zip(*columns, strict=True):
                payload = text.encode()
                fields = {
                    "WARC-Type": "response" if refers is None or refers == page else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{hexed}')}>",
                    "WARC-Date": _DATE,
                    "WARC-Target-URI": f"urn:{names[0]}:{page if page is not None else ''}",
                    "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode(),
                    "X-Payload-Length": str(len(payload)),
                }
                if fields["WARC-Type"] == "revisit":
                    fields |= {"WARC-Profile": _REVISIT_PROFILE, "WARC-Refers-To-Target-URI": f"urn:{names[0]}:{refers}"}
                    payload = b""
                fields["WARC-Block-Digest"] = "sha1:" + digest_of(payload)
                members.append(compress_record(format_record(fields, payload)))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(members)
                    members, size = [], 0
        if members:
            yield _archive(members)

    return materialize(placed.mapInArrow(run, "archive string, content binary"), "warc")


def _archive(members: list[bytes]) -> pa.RecordBatch:
    content = b"".join(members)
    name = hashlib.sha256(content).hexdigest()[:24] + ".warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])


def read_warc(
    archives: DataFrame, content_col: str = "content", archive_col: str = "archive",
    record_bytes: int | None = RECORD_BYTES, header_bytes: int | None = HEADER_BYTES,
) -> DataFrame:
    """Records and gaps of archives: archive, offset, length, quarantined boolean, reason, fields map, block binary.

    A row whose content is null or empty gives nothing; nor does an empty table. Records come in the order of their
    offsets within an archive; repeated archives give theirs each time. A record of more than ``record_bytes`` inflated bytes,
    or whose header has more than ``header_bytes``, is quarantined and says so in ``reason``; None is no limit, and a task then
    holds the largest record there is. Other columns are not looked at.
    """
    prepare(archives.sparkSession)
    kind = archives.schema[archive_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(content_col)[i].as_py() or b""
                rows: list[tuple] = []
                size = 0
                for record in salvage(content, record_bytes, header_bytes):
                    rows.append(record)
                    size += len(record[3])
                    if size > (8 << 20):
                        yield _records(batch.column(archive_col)[i], rows)
                        rows, size = [], 0
                if rows:
                    yield _records(batch.column(archive_col)[i], rows)

    schema = f"archive {kind}, offset long, length long, quarantined boolean, reason string, fields map<string,string>, block binary"
    return archives.select(archive_col, content_col).mapInArrow(run, schema)


def _records(archive: pa.Scalar, rows: list[tuple]) -> pa.RecordBatch:
    offset, length, fields, block, reason = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([archive.as_py()] * len(rows), archive.type), pa.array(offset, pa.int64()), pa.array(length, pa.int64()),
            pa.array([f is None for f in fields]), pa.array(reason, pa.string()),
            pa.array([list((f or {}).items()) for f in fields], pa.map_(pa.string(), pa.string())),
            pa.array(block, pa.binary()),
        ],
        names=["archive", "offset", "length", "quarantined", "reason", "fields", "block"],
    )


def op6(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty payloads are records of no bytes; payloads of any size are read back. Ids may be null or repeat (as in
    ``write_warc``); an empty table gives no rows. A gap in the query's own archives, which would lose a page, raises.
    """
    kind = pages.schema["page_id"].dataType
    records = read_warc(write_warc(pages), record_bytes=None, header_bytes=None)
    lost = F.raise_error(F.concat(F.lit("a gap in archive "), "archive", F.lit(": "), "reason"))
    records = records.where(F.when(F.col("quarantined"), lost.cast("boolean")).otherwise(True))
    prefix = F.lit(len("urn:page_id:") + 1)
    uri = F.col("fields")["warc-target-uri"]
    refers = F.col("fields")["warc-refers-to-target-uri"]
    response = F.col("fields")["warc-type"] == "response"
    return records.select(
        F.when(uri != "urn:page_id:", F.substr(uri, prefix)).cast(kind).alias("page_id"),
        F.when(response, F.length("block")).otherwise(F.col("fields")["x-payload-length"]).cast("long").alias("payload_bytes"),
        F.substr(F.col("fields")["warc-payload-digest"], F.lit(6)).alias("payload_digest"),
        F.col("fields")["warc-type"].alias("record_type"),
        F.substr(refers, prefix).cast(kind).alias("refers_to"),
    )


#: SQL of op6 for DuckDB: the base32 digits are read off the hexadecimal ones in groups of five bits.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
b AS (SELECT h, first, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS bits FROM f),
e AS (SELECT h, first, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
      + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest FROM b)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, e.payload_digest,
  CASE WHEN d.page_id IS NOT DISTINCT FROM e.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS NOT DISTINCT FROM e.first THEN NULL ELSE e.first END AS refers_to
FROM d JOIN e ON d.h = e.h
"""
