"""Lineage cuts, ranks over whole tables without one task seeing them all, and keyed random draws."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so have the same files."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, a local master gets a temporary folder; on a cluster that would be one machine's own, so it raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sweeplane-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/sweeplane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def ordered_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the 0-based rank by ``order``: a range sort, and a running total of the partitions' sizes."""
    place = F.monotonically_increasing_id()
    parted = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__place", place))
    parted = parted.withColumn("__part", F.shiftright("__place", 33))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + within).drop("__part", "__place", "__start")


def hashed_rank(df: DataFrame, seed: int, id_col: str, name: str, ids: DataFrame | None = None) -> DataFrame:
    """``df`` with the 0-based rank of its ids in the order of md5("seed:id"): a seeded permutation.

    The digest's first three hex digits are 4096 even buckets; ranks are taken within a bucket and shifted by the
    sizes of those before it, a table of 4096 rows at most. They are counted in ``ids``, the same ids by a shorter plan:
    without it, ranks upon ranks double the plan each time.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    bucket = F.substring(key, 1, 3).alias("__bucket")
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    sizes = (df if ids is None else ids).groupBy(bucket).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", id_col)) - 1
    ranked = keyed.withColumn("__within", within).join(F.broadcast(starts), "__bucket")
    return ranked.withColumn(name, F.col("__start") + F.col("__within")).drop("__key", "__bucket", "__within", "__start")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A draw from (0, 1) that depends on the seed and the keys alone, not on partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal draw by the keys (Box-Muller)."""
    radius = F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, F.lit("a"), *keys))
