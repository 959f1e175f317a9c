"""Selection, splits and batches of samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.params import param
from sweeplane.functions.tables import cut, hashed_rank


def project_params(networks: DataFrame, keys: list[str]) -> DataFrame:
    """sample_id and x: the listed parameters in order, NaN where missing."""
    return networks.select("sample_id", F.array(*(param("params", k) for k in keys)).alias("x"))


def swap_xy(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The two columns' roles exchanged."""
    return df.select(*(F.col(y if c == x else x if c == y else c).alias(c) for c in df.columns))


def first_samples(df: DataFrame, n: int) -> DataFrame:
    """Samples of the lowest n indices."""
    return df.where(F.col("sample_id") < n)


def split(df: DataFrame, val: float, test: float, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """``df`` with a column ``split``: exact sizes floor(n val) and floor(n test), the rest is train; seeded."""
    if val < 0 or test < 0 or val + test > 1:
        raise ValueError("the shares must be at least 0 and sum to at most 1")
    n = df.count()
    n_val, n_test = int(n * val), int(n * test)
    ranked = hashed_rank(df, seed, id_col, "__rank")
    name = F.when(F.col("__rank") < n_val, "val").when(F.col("__rank") < n_val + n_test, "test").otherwise("train")
    return ranked.withColumn("split", name).drop("__rank")


def subset(splits: DataFrame, name: str) -> DataFrame:
    """One split; ``full`` is all of them."""
    if name not in ("train", "val", "test", "full"):
        raise ValueError(f"unknown split {name!r}")
    return splits if name == "full" else splits.where(F.col("split") == name)


def sample_rows(df: DataFrame, k: int, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """k rows without replacement, by a seeded hash of the id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(k)


def batches(df: DataFrame, size: int, seed: int | None = None, id_col: str = "sample_id") -> DataFrame:
    """``df`` with a batch number: ``size`` rows each, the last fewer; shuffled by a seeded permutation."""
    ranked = hashed_rank(df, 0 if seed is None else seed, id_col, "__rank")
    return ranked.withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")


def stage_loaders(splits: DataFrame, size: int, seed: int = 0) -> Iterator[tuple[str, DataFrame]]:
    """The batches of each stage: train shuffled, val and test plain, predict over all rows."""
    kept = cut(splits)
    for name in ("train", "val", "test"):
        yield name, batches(subset(kept, name), size, seed if name == "train" else None)
    yield "predict", batches(kept, size)
