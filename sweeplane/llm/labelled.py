"""Bounded, stratified samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.llm.common import map_arrow

#: Bytes of text a sample has at most, and bytes of a text that is learned from: they bound what reaches the driver.
SAMPLE_BYTES = 64 << 20
TEXT_BYTES = 1 << 20


def known_labels(labels: DataFrame, label_col: str, learn: Callable[[str], Column], id_col: str = "doc_id") -> DataFrame:
    """id and y (0 or 1) where ``learn(id column)`` holds; ids with two labels or none are left out."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2")
    ).where("y = y2").select("id", "y")
    return known.where(learn("id"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, learn: Callable[[str], Column], rows: int,
    features: Callable[[list[bytes]], list[np.ndarray]], id_col: str = "doc_id", text_col: str = "text",
) -> tuple[np.ndarray, list[np.ndarray], list[str], float]:
    """(labels, feature arrays, ids as text, share of label 1 in the table) of ``rows`` labelled rows at most.

    Half the sample goes to each label, as far as there are so many; rows are picked by a hash of the id. Ids with
    two labels or none, and rows whose label is not 0 or 1, are left out. Only the sample reaches the driver, as the
    features of its whole texts; it ends before its texts exceed SAMPLE_BYTES, and has none of over TEXT_BYTES.
    """
    known = known_labels(labels, label_col, learn, id_col)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return np.zeros(0, int), [], [], 0.5
    spare = sum(max(0, rows // 2 - n) for n in sizes.values())
    chance = F.lit(0.0)
    for y, n in sizes.items():
        chance = F.when(F.col("y") == y, min(1.0, (rows // 2 + spare) / n)).otherwise(chance)
    order = F.xxhash64("id", F.lit(13))
    picked = known.where(F.pmod(order, F.lit(1_000_000)) / 1_000_000 < chance).orderBy(order, "id").limit(rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = own.select("id", size.alias("size")).join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.max("size").alias("size"))
    total = F.sum("size").over(Window.orderBy(order, "id"))  # over ``rows`` rows at most
    picked = sized.where(F.col("size") <= TEXT_BYTES).withColumn("total", total).where(F.col("total") <= SAMPLE_BYTES).select("id", "y")
    texts = own.join(F.broadcast(picked), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # an id that repeats counts once

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays(
            [batch.column("id").cast(pa.string()), batch.column("y"), pa.array([f.tobytes() for f in features(raw)], pa.binary())],
            names=["id", "y", "x"],
        )

    got = map_arrow(texts, kernel, "id string, y int, x binary").collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    share = sizes.get(1, 0) / sum(sizes.values())
    x = [np.frombuffer(r["x"], dtype=np.int32) for r in got]
    return np.array([r["y"] for r in got], dtype=int), x, [r["id"] for r in got], share


def score_rows(docs: DataFrame, score: Callable[[list[str]], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """id and score of every whole text; null as empty."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = score([t or "" for t in batch.column(text_col).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), kernel, f"{id_col} {kind}, score double")
