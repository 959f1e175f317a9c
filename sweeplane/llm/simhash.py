"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: two binary Golay codes (23 bits, 4096 words, covering radius 3) side by side
cover 46 bits of a fingerprint. Every fingerprint is at home at its one anchor (each block's nearest word) and is
replicated to every anchor within the covering radius plus the threshold; the threshold's bits may be spent on either
block. Two fingerprints that differ in at most the threshold meet at the home of either. Fingerprints are compared per
anchor, by a join on it. Where an anchor is home to more than DENSE fingerprints, its links come the exact way instead:
fingerprints within two bits share a neighbour one bit away from both, a key that at most 65 fingerprints have.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.llm.common import as_row, from_row, join_marked, map_arrow, materialize, prepare
from sweeplane.llm.graph import connected_components

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Homes an anchor may have before its fingerprints are linked by shared neighbours.
DENSE = 256
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
_BITS = 23
_CHUNK = 1 << 15
_FPS = 128  # fingerprints whose anchors are worked out at once


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles; zero for a text without words."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1] if n > _CHUNK else words
        grams = [b" ".join(part)] if len(part) < shingle else map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp long (the fingerprint's 64 bits as a signed integer). A null text has no words."""

    return docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col).alias("fp"))


def fingerprint_column(text_col: str) -> Column:
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or b"") for t in texts.cast(pa.binary())], dtype=np.uint64).view(np.int64))

    return prints(F.col(text_col))


# -- the covering code --------------------------------------------------------------------------------------------


def _syndromes() -> np.ndarray:
    """Remainder modulo the generator for each value of each of three bytes (the remainder is linear)."""
    table = np.zeros((3, 256), dtype=np.uint32)
    for place in range(3):
        for value in range(256):
            rest = value << (8 * place)
            for bit in range(23, 10, -1):
                if rest >> bit & 1:
                    rest ^= GOLAY << (bit - 11)
            table[place, value] = rest
    return table


def _patterns(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit patterns of weight up to ``most`` ordered by syndrome, their weights, and where each syndrome begins."""
    errors, weights = [], []
    for weight in range(most + 1):
        for bits in combinations(range(_BITS), weight):
            errors.append(sum(1 << b for b in bits))
            weights.append(weight)
    errors, weights = np.array(errors, dtype=np.uint64), np.array(weights)
    syndrome = _syndrome(errors)
    order = np.lexsort((weights, syndrome))
    return errors[order], weights[order], np.searchsorted(syndrome[order], np.arange(2049))


_TABLE = _syndromes()


def _syndrome(block: np.ndarray) -> np.ndarray:
    b = block.astype(np.int64)
    return _TABLE[0][b & 255] ^ _TABLE[1][b >> 8 & 255] ^ _TABLE[2][b >> 16 & 255]


_CODE: list = []


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every fingerprint (uint64) and every anchor within radius + threshold of it."""
    if not _CODE or _CODE[0] != threshold:
        _CODE[:] = [threshold, *_patterns(3 + threshold)]
    _, errors, weights, begin = _CODE
    mask = np.uint64((1 << _BITS) - 1)
    blocks = [fps & mask, fps >> np.uint64(_BITS) & mask]
    places = []
    for block in blocks:
        s = _syndrome(block).astype(np.int64)
        places.append((begin[s], begin[s + 1] - begin[s]))
    count = places[0][1] * places[1][1]
    row = np.repeat(np.arange(len(fps)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    i = places[0][0][row] + nth // places[1][1][row]
    j = places[1][0][row] + nth % places[1][1][row]
    spent = np.maximum(weights[i] - 3, 0) + np.maximum(weights[j] - 3, 0)
    near = spent <= threshold
    row, i, j, spent = row[near], i[near], j[near], spent[near]
    anchor = (blocks[0][row] ^ errors[i]) | (blocks[1][row] ^ errors[j]) << np.uint64(_BITS)
    return row, anchor.astype(np.int64), spent == 0


def _replicas(distinct: DataFrame, homes_only: bool) -> DataFrame:
    """(anchor, fp) of homes alone, or of all replicas."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        found = []
        for at in range(0, len(fps), _FPS):
            part = fps[at : at + _FPS]
            row, anchor, _ = anchors(part.view(np.uint64), 0 if homes_only else THRESHOLD)
            found.append((anchor, part[row]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["anchor", "fp"])

    return map_arrow(distinct.select("fp"), kernel, "anchor long, fp long")


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints linked at the threshold; ``distinct`` has each ``fp`` once.

    An edge joins fingerprints at two or fewer differing bits. Sparse anchors give every such pair; dense ones give
    each shared neighbour's fingerprints a star, which connects the same fingerprints.
    """
    homes = _replicas(distinct, True)
    dense = homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("anchor")
    some = not dense.isEmpty()
    dense = materialize(dense, "dense") if some else dense
    replicas = _replicas(distinct, False)
    if some:
        homes = homes.join(dense, "anchor", "left_anti")
    home = homes.select("anchor", F.col("fp").alias("a"))
    # The planner takes the replicas for as few as the fingerprints and would broadcast them; a merge join it is.
    met = home.join(replicas.withColumnRenamed("fp", "b").hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (_differing("a", "b") <= THRESHOLD))
    edges = met.select("a", "b").distinct()
    if some:
        crowd = replicas.join(dense, "anchor", "left_semi").select("fp").distinct()
        flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64 if b == 63 else 0)) for b in range(64)))
        keyed = crowd.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("key"))
        stars = keyed.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
        edges = edges.unionByName(stars)
    return edges


def _components(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``prints`` (id, fp): each fingerprint's component (fp, root), and each component's first document (root, id, fp)."""
    rows = prints.count()
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct", rows)
    roots = connected_components(links(distinct))
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    members = materialize(members.select("fp", "least", F.coalesce("root", "fp").alias("root")), "members", rows)
    first = members.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp")).alias("f"))
    return members.select("fp", "root"), materialize(first.select("root", "f.id", "f.fp"), "first", rows)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are documents of their
    own in one component. Null ids are passed over in the smallest id; a component of null ids alone has a null id.
    Ids may be of any type that orders. Other columns are not looked at; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    members, first = _components(prints)
    groups = members.join(first.select("root", F.col("id").alias("component_id")), "root").select("fp", "component_id")
    out = prints.join(materialize(groups, "groups", prints.count()), "fp")  # a hot fingerprint is split by Spark: both sides are scans
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, among those of its smallest fingerprint.

    Null ids come after all others, so a row without an id stays only if its whole component has none. Which of several
    rows of one id and one fingerprint stays is not defined. Null and empty texts are one component. An id may stand for
    several texts: each is judged by its own component. An empty table gives no rows; all columns, of any names, stay as they were.
    Where the ids that go are too many to broadcast, only rows that may have one of them are shuffled.
    """
    prepare(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    _, first = _components(prints)
    stay = first.select("id", "fp")
    named = prints.where("id IS NOT NULL")
    gone = named.join(stay, ["id", "fp"], "left_anti").select("id", F.lit(False).alias("odd"))
    odd = named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("odd"))
    # Ids that go, and those of several rows, which are judged by row.
    doubtful = gone.unionByName(odd).groupBy("id").agg(F.max("odd").alias("odd"))
    doubtful = materialize(doubtful, "doubtful", prints.count())
    key = F.col(id_col)
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), as_row(docs).alias("row"))
    kept = join_marked(rows.where("id IS NOT NULL"), doubtful.select("id"), "id", "left_anti").select(from_row(docs))
    several = doubtful.where("odd")
    if several.isEmpty() and prints.where("id IS NULL").isEmpty():
        return kept
    by_row = rows.join(several.select("id"), "id", "left_semi").unionByName(rows.where("id IS NULL").select("id", "text", "row"))
    # Rows of one id and fingerprint meet as partial aggregates, so a hot pair is one row a task.
    by_row = by_row.withColumn("fp", fingerprint_column("text")).dropDuplicates(["id", "fp"])
    stay = stay.select(F.col("id").alias("stay"), F.col("fp").alias("first"))
    same = F.col("id").eqNullSafe(F.col("stay")) & (F.col("fp") == F.col("first"))
    return kept.unionByName(by_row.join(stay, same, "left_semi").select(from_row(docs)))
