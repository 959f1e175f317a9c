"""Stored networks: Parquet tables, their dispatch by path, exports, a generator of synthetic samples, and packing."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.operators.network import NETWORK_SCHEMA, network_fields
from sweeplane.sources.touchstone import append_ids, read_touchstone


def write_store(networks: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    """Packed networks as Parquet, parted by port count."""
    networks.write.mode(mode).option("compression", compression).partitionBy("n_ports").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    return found.withColumn("n_ports", F.col("n_ports").cast("int"))


def append_store(networks: DataFrame, path: str) -> None:
    """Append, with sample ids behind those stored."""
    stored = read_store(networks.sparkSession, path)
    append_ids(stored, networks).write.mode("append").option("compression", "zstd").partitionBy("n_ports").parquet(path)


def open_networks(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet store by its suffix; else a folder of Touchstone files."""
    if path.rstrip("/").endswith(".parquet"):
        return read_store(spark, path)
    if path.lower().endswith((".h5", ".hdf5")):
        raise ValueError("HDF5 is not read here; pack the samples into a .parquet store")
    return read_touchstone(spark, path)


def synthetic(spark: SparkSession, n: int, factory: Callable[[int], dict], partitions: int | None = None) -> DataFrame:
    """n generated networks; ``factory(index)`` gives the fields of a packed row but its id. Recomputed unless persisted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"].tolist():
                blank = {"path": None, "unit": "GHz", "s_def": "power", "z0_re": [50.0], "z0_im": [0.0], "comments": [], "params": {}, "params_str": {}}
                rows.append({"sample_id": i, **blank, **factory(i)})
            yield pd.DataFrame(rows)[names]

    names = [name for name, _ in network_fields()]
    return spark.range(0, n, 1, partitions).mapInPandas(run, NETWORK_SCHEMA)


def export_params_csv(networks: DataFrame, path: str, keys: list[str]) -> bool:
    """Parameters as CSV part files with a header; nothing is written for no sample."""
    from sweeplane.operators.analyze import params_wide

    if networks.isEmpty():
        return False
    params_wide(networks, keys).write.mode("overwrite").option("header", "true").csv(path)
    return True


def export_summary(summary: DataFrame, path: str, unit: str = "GHz") -> None:
    """A summary table as Parquet with the frequency unit as a column."""
    summary.withColumn("frequency_unit", F.lit(unit)).write.mode("overwrite").parquet(path)


def main(args: list[str] | None = None) -> None:
    """Pack a folder of Touchstone files into a store: --src FOLDER --dst STORE.parquet [--pattern GLOB]."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--src", required=True)
    p.add_argument("--dst", required=True)
    p.add_argument("--pattern", default="*.[sS][0-9]*[pP]")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    write_store(read_touchstone(spark, a.src, a.pattern), a.dst, "overwrite")


if __name__ == "__main__":
    main()
