"""Media columns: content-addressed payloads in tar shards.

Payloads are stored as grey PNG images in tar shards, each under its digest, once in all. Rows carry digest, shard,
offset and length. A payload that one row has goes into a shard of the task that reads the row; one that several rows
have goes into a shard of the digest's own partition, so only such payloads are shuffled. Metadata columns come from
range reads of the image headers alone; features come from range reads of whole images, in the order in which members
lie in their shards. Shards are files in the shared folder, opened through ``pyarrow.fs``, named by their own content,
so that a task that runs again on the same rows writes the same files.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import mark_keys, materialize, prepare, shared_path

#: Samples of an image row; payloads are padded to a multiple.
WIDTH = 192
#: Bytes of members after which a task closes a shard.
SHARD_BYTES = 32 << 20
#: Effort of compression: less would make shards larger by a sixth.
LEVEL = 6
# Fixed values of the image format.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def pad(data: bytes, multiple: int = WIDTH) -> bytes:
    """``data`` with spaces up to a positive multiple."""
    return data + b" " * ((-len(data)) % multiple if data else multiple)


def encode_image(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG of 8-bit samples, ``width`` a row, without row filters."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    chunks = (
        (b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), LEVEL)), (b"IEND", b""),
    )
    return _SIGNATURE + b"".join(
        struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in chunks
    )


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES of an image."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_image(data: bytes) -> np.ndarray:
    """The samples of an image that ``encode_image`` wrote; every chunk's checksum is verified."""
    width, height, _ = read_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        body = data[at + 4 : at + 8 + size]
        if zlib.crc32(body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("chunk checksum differs")
        if body[:4] == b"IDAT":
            packed += body[4:]
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, width + 1)[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Mean, deviation and an 8-step brightness histogram of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    levels, total = np.arange(256), samples.size
    mean = float((counts * levels).sum()) / total
    spread = (float((counts * (levels - mean) ** 2).sum()) / total) ** 0.5
    steps = "-".join(str(int(c) * 1000 // total) for c in counts.reshape(8, 32).sum(axis=1))
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.3f} sd={spread:.3f} hist={steps}"


class _Shards:
    """One task's open shard: members by digest, flushed to a file named by its content."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.start()

    def start(self) -> None:
        self.buffer, self.members = io.BytesIO(), 0
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, digest: bytes, data: bytes) -> tuple[int, int]:
        """Add a member: its offset and length."""
        info = tarfile.TarInfo(f"{digest.hex()[:2]}/{digest.hex()}.png")
        info.size = len(data)
        place = (self.tar.offset + tarfile.BLOCKSIZE, len(data))
        self.tar.addfile(info, io.BytesIO(data))
        self.members += 1
        return place

    def close(self) -> str:
        """Write the shard if there is anything in it; its name."""
        self.tar.close()
        content = self.buffer.getvalue()
        name = f"{hashlib.sha256(content).hexdigest()[:32]}.tar"
        path = f"{self.folder}/{name}"
        if self.members and self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            part = f"{path}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(part) as f:
                f.write(content)
            self.fs.move(part, path)
        return name


def payload_digest(text: Column) -> Column:
    """SHA-256 of a text's padded bytes (those of ``pad``), as 32 bytes."""
    n = F.octet_length(text)
    spaces = F.when(n == 0, WIDTH).otherwise((WIDTH - n % WIDTH) % WIDTH)
    return F.unhex(F.sha2(F.concat(text, F.repeat(F.lit(" "), spaces)).cast("binary"), 256))


def _write(rows: DataFrame, folder: str) -> DataFrame:
    """Each row's text as a member: the row's columns but ``text``, and shard, offset, length. Digests are distinct."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        done: list[pa.RecordBatch] = []
        places: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            name, at = shards.close(), 0
            for batch in done:
                own = places[at : at + batch.num_rows]
                at += batch.num_rows
                columns = [*batch.columns, pa.array([name] * len(own)), *(pa.array(c, pa.int64()) for c in zip(*own, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["shard", "offset", "length"])

        for batch in batches:
            narrow = batch.select([f.name for f in kept])
            at = 0
            for n, (text, digest) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("digest"), strict=True)):
                places.append(shards.add(digest.as_py(), encode_image(pad(text.as_py()))))
                if shards.tar.offset >= SHARD_BYTES:
                    done.append(narrow.slice(at, n + 1 - at))
                    at = n + 1
                    yield from flush()
                    done, places = [], []
                    shards.start()
            if at < batch.num_rows:
                done.append(narrow.slice(at))
        if done:
            yield from flush()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{fields}, shard string, offset long, length long")


@dataclass(frozen=True)
class Media:
    """Stored payloads. ``alone``: id, n_bytes, digest, shard, offset, length of rows whose payload no other row has;
    ``copies``: id, n_bytes, digest of the others; ``members``: digest, shard, offset, length of the payloads of those."""

    folder: str
    alone: DataFrame
    copies: DataFrame
    members: DataFrame

    def rows(self) -> DataFrame:
        """Every row with its payload's place: id, n_bytes, digest, shard, offset, length."""
        return self.alone.unionByName(self.copies.join(self.members, "digest"))


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> Media:
    """Store each distinct text's padded bytes as an image, once.

    A null text is an empty one. Each row gives one row, repeated rows and null ids included; an empty table writes
    nothing. Other columns are not looked at. The rows are written to the shared folder once, so the shards are too.
    Texts whose digest is none of the repeated ones are not shuffled; of the others each task sends one a digest.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "digest": payload_digest(F.col("text"))})
    repeated = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    marks = mark_keys(repeated, "digest")
    alone = materialize(_write(marks.rows(rows, False, "digest"), folder), "media")
    several = marks.rows(rows, True, "digest")
    once = several.select("digest", "text").dropDuplicates(["digest"])
    members = materialize(_write(once, folder), "members")
    return Media(folder, alone, materialize(several.select("id", "n_bytes", "digest"), "copies"), members)


def _read(located: DataFrame, folder: str, kernel: Callable[[Callable[[int], bytes], int], tuple], columns: str) -> DataFrame:
    """``located`` with columns of its members, read in the order of its rows. The kernel may read a first part or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                out.append(kernel(lambda n, file=file, offset=offset: file.read_at(n, offset), length))
            if out:
                names = batch.schema.names + [c.split()[0] for c in columns.split(", ")]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, zip(*out, strict=True))], names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in located.schema.fields)
    return located.mapInArrow(run, f"{fields}, {columns}")


METADATA = "width long, height long, depth long"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_metadata(located: DataFrame, folder: str) -> DataFrame:
    """Rows with shard, offset and length, and width, height, depth: from the members' headers alone."""
    return _read(located, folder, lambda read, _: read_header(read(HEADER_BYTES)), METADATA)


def media_features(located: DataFrame, folder: str) -> DataFrame:
    """The same with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature too, of whole members."""

    def kernel(read: Callable[[int], bytes], length: int) -> tuple:
        header = read_header(read(HEADER_BYTES))
        data = read(length)
        samples = decode_image(data)
        payload = samples.tobytes()
        return (
            *header, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data),
            hashlib.sha256(data).hexdigest(), describe(samples),
        )

    return _read(located, folder, kernel, f"{METADATA}, {FEATURES}")


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns, and width, height and depth from header reads."""
    media = store_media(docs, shared_path(prepare(docs.sparkSession), "shards"))
    found = [c.split()[0] for c in f"{FEATURES}, {METADATA}".split(", ")]
    alone = media_features(media.alone.drop("digest"), media.folder)
    # A hot payload's rows are split by Spark: both sides are scans.
    members = materialize(media_features(media.members, media.folder), "features")
    rows = alone.select("id", "n_bytes", *found).unionByName(media.copies.join(members, "digest").select("id", "n_bytes", *found))
    return rows.withColumnRenamed("id", "doc_id")
