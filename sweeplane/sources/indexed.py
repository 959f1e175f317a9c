"""A table in buckets of its samples' ids, sorted within: ids are looked up, and tables joined by id, without a shuffle of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that go into the scan's filter, which leaves out the buckets and row groups that hold none; more of them are joined.
FILTER_IDS = 1000


def write_indexed(df: DataFrame, name: str, path: str, key: str = "sample_id", buckets: int = 64) -> None:
    """Store as table ``name`` with its files at ``path``: a file for each bucket. Tables of the same buckets join in place."""
    df.repartition(buckets, key).write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def take(spark: SparkSession, name: str, ids: Sequence[int] | DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows in the order of a list of ids: ``position`` (from 0) and the row. An id that is listed twice comes twice, one that
    is not stored, or null, not at all.

    ``ids`` is a list, or a table of ``position`` and the key. Up to FILTER_IDS listed ids reach the scan as a filter. Of a
    table, or a longer list, the ids are shuffled into the stored buckets, and the stored rows stay where they are.
    """
    stored = spark.table(name)
    if "position" in stored.columns:
        raise ValueError("a stored column is named position")
    if isinstance(ids, DataFrame):
        return ids.select("position", key).join(stored.hint("merge"), key)
    wanted = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"position long, `{key}` {stored.schema[key].dataType.simpleString()}")
    if len(ids) > FILTER_IDS:
        return wanted.join(stored.hint("merge"), key)
    few = stored.where(F.col(key).isin([i for i in set(ids) if i is not None]))
    return F.broadcast(wanted).join(few, key)
