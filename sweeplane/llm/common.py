"""Helpers the training-data operators share: table access, lineage cuts, skew-safe joins, marked keys, Arrow maps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions.tables import shared_path, shared_root

#: Rows and bytes of one Arrow batch (one longer row is a batch by itself): they bound a Python worker's memory.
ARROW_ROWS = 1024
ARROW_BYTES = 4 << 20
#: UTF-8 bytes that vectorised kernels take at once (one longer text is a block by itself).
BLOCK_BYTES = 1 << 18
#: Keys that a skew-safe join serves by broadcast. Any other key holds at most 1/257 of the rows.
HEAVY_KEYS = 256
#: Rows of small records that make a file worth its own.
FILE_ROWS = 1 << 16
#: Rows that are counted before they are broadcast; more of them meet the other side in a shuffled join of marked rows.
BROADCAST_ROWS = 1 << 17
#: A bitmap of marked keys has 2^MARK_BITS bits (4 MB), however many keys there are.
MARK_BITS = 25


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and see that a checkpoint folder is set (the session's own wins)."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    shared_root(spark)
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    With ``rows``, the most rows it can have, partitions of few rows are written together, so that a small table is not
    hundreds of files; a large one keeps all its partitions.
    """
    path = shared_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_heavy(left: DataFrame, right: DataFrame, on: str, weight: str, how: str = "inner") -> DataFrame:
    """Join ``left`` (any skew) with ``right`` (one row per key, ``weight`` = its rows in left).

    The HEAVY_KEYS keys with most rows go by broadcast, so no row of theirs is shuffled; the rest is an
    ordinary shuffled join, where each key is at most 1/257 of the rows. ``left`` is read twice, so give a table.
    """
    heavy = materialize(right.orderBy(F.desc(weight), on).limit(HEAVY_KEYS), "heavy").drop(weight)
    right = right.drop(weight)
    few = left.join(F.broadcast(heavy), on, "inner")
    rest = left.join(F.broadcast(heavy.select(on)), on, "left_anti").join(right, on, how)
    return few.unionByName(rest)


@dataclass(frozen=True)
class KeyMarks:
    """A bitmap of keys' hashes, of fixed size: words of 64 bits as a table that is broadcast.

    Rows that have nothing to do with a join on these keys need not be shuffled for it: those whose bit is not set have
    surely none of the keys. The others, which hold a key or share a bit with one, go through the join, which decides.
    With many more keys than bits every row does.
    """

    words: DataFrame

    def rows(self, df: DataFrame, marked: bool, key: Column | str) -> DataFrame:
        """The rows of ``df`` whose key, of the type of the marked ones, may be one of them; or those whose key is none."""
        place = df.withColumn("__bit", F.shiftrightunsigned(F.xxhash64(key), 64 - MARK_BITS))
        met = place.join(F.broadcast(self.words), F.shiftright("__bit", 6) == F.col("__word"), "left")
        held = F.expr("coalesce(shiftright(__bits, CAST(__bit & 63 AS INT)) & 1, 0) = 1")
        return met.where(held if marked else ~held).select(df.columns)


def mark_keys(keys: DataFrame, key: str) -> KeyMarks:
    """Mark the values of a column; the driver holds its words, at most 2^(MARK_BITS - 6) rows of two numbers."""
    bits = keys.select(F.shiftrightunsigned(F.xxhash64(key), 64 - MARK_BITS).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("__word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("__bits")).toArrow()
    return KeyMarks(keys.sparkSession.createDataFrame(found, "__word long, __bits long"))


def join_marked(df: DataFrame, keys: DataFrame, key: str, how: str, weight: Column | None = None) -> DataFrame:
    """Inner, left or left anti join of ``df`` (any size, any skew) with written ``keys`` (one row a key), both with a column ``key``.

    Up to BROADCAST_ROWS keys are broadcast; where rows are not of fixed width, ``weight`` tells how many small rows each
    stands for. With more, only rows that may hold one are shuffled, and a hot key among them is split by Spark: both sides
    are scans. ``df`` must have no column named ``__bit``, ``__word`` or ``__bits``: a caller's rows go in a struct.
    """
    if (keys.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0) <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), key, how)
    marks = mark_keys(keys, key)
    met = marks.rows(df, True, key).join(keys, key, how)
    if how == "inner":
        return met
    clear = marks.rows(df, False, key)
    if how == "left":
        clear = clear.withColumns({f.name: F.lit(None).cast(f.dataType) for f in keys.schema.fields if f.name != key})
    return clear.unionByName(met)


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can have the name of one of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def from_row(df: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``df`` out of such a struct."""
    return [F.col(row).getField(c).alias(c) for c in df.columns]


def bucket_of(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(buckets)


def held_out(id_col: str, buckets: int, fold: int) -> Column:
    return F.coalesce(bucket_of(id_col, buckets) == fold, F.lit(False))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a kernel from batch to batch; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield kernel(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


# -- vectorised token hashing -------------------------------------------------------------------------------------

_BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))


def classes(words: str) -> np.ndarray:
    """Byte classes 0 (between tokens), 1 (letters, digits, non-ASCII), 2 (other visible ASCII; 0 for 'words')."""
    table = np.full(256, 0 if words == "words" else 2, dtype=np.uint8)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[lo:hi] = 1
    table[:33] = 0
    return table


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def hash_tokens(texts: list[bytes], table: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all tokens (runs of one byte class) of the texts, and each text's end among them.

    With ``prefix`` also, in second place, hashes of each token's first ``prefix`` bytes.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = table[data]
    change = np.empty(len(kind), dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    starts = np.flatnonzero(change)
    keep = kind[starts] != 0
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    values = _BYTE_VALUES[data] * _PLACES[place & 255]
    found = [np.add.reduceat(values, starts)]
    if prefix:
        values[place >= prefix] = 0
        found.append(np.add.reduceat(values, starts))
    starts = starts[keep]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return *(_mixed(h[keep]) for h in found), np.searchsorted(starts, ends)
