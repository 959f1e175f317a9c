"""Summaries that follow appends: mergeable states stored beside the data, added up instead of scanning the data again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import no_nan

STATE = ("n", "nan_n", "mean", "m2", "lo", "hi", "sketch")


@dataclass(frozen=True)
class Rollup:
    """Count, missing values, mean, deviation, extremes and quantiles of ``value`` by ``keys`` and by any of their subsets.

    A state is one row for each occurring combination of keys and batch, with a KLL sketch of ``k`` (a rank is told to about
    1.3 % at 200, 0.3 % at 1000; its draws differ from run to run). NaN and null values count as missing; null keys are keys. Means and deviations of states are
    joined by the parallel formula in two aggregations of states, without the cancellation of sums of squares.
    """

    keys: tuple[str, ...]
    value: str
    k: int = 200

    def __post_init__(self) -> None:
        if len(set(self.keys)) < len(self.keys) or any(c in (*STATE, "batch", "level") or c.startswith("__") for c in self.keys):
            raise ValueError(f"keys must differ, begin with no two underscores, and be none of {(*STATE, 'batch', 'level')}")

    def states(self, df: DataFrame) -> DataFrame:
        """One state for each combination of keys in ``df``; none for an empty table."""
        v = no_nan(F.col(self.value).cast("double"))
        return df.select(*self.keys, v.alias("__v")).groupBy(*self.keys).agg(
            F.count("__v").alias("n"), (F.count("*") - F.count("__v")).alias("nan_n"), F.avg("__v").alias("mean"),
            (F.var_pop("__v") * F.count("__v")).alias("m2"), F.min("__v").alias("lo"), F.max("__v").alias("hi"),
            F.kll_sketch_agg_double("__v", F.lit(self.k)).alias("sketch"),
        )

    def merge(self, states: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
        """States by fewer keys, or by the same ones over several batches."""
        by = list(self.keys if by is None else by)
        if set(by) - set(self.keys):
            raise ValueError(f"no keys of this summary: {sorted(set(by) - set(self.keys))}")
        own = [F.col(c).alias(f"__{c}") for c in by]
        centre = states.groupBy(*own).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__mean"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        met = states.join(centre if by else F.broadcast(centre), same)
        apart = F.col("mean") - F.col("__mean")
        return met.groupBy(*by).agg(
            F.sum("n").alias("n"), F.sum("nan_n").alias("nan_n"), F.max("__mean").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.kll_merge_agg_double("sketch", self.k).alias("sketch"),
        )

    def finish(self, states: DataFrame, quantiles: Sequence[float] = ()) -> DataFrame:
        """Keys, n, nan_n, mean, std (n), lo, hi, and q_0, q_1, ... of ``quantiles``; null where no value was there."""
        rest = [c for c in states.columns if c not in STATE]
        at: list[Column] = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(f"q_{i}") for i, q in enumerate(quantiles)]
        std = F.when(F.col("n") > 0, F.sqrt(F.col("m2") / F.col("n")))
        return states.select(*rest, "n", "nan_n", "mean", std.alias("std"), "lo", "hi", *at)

    def append(self, df: DataFrame, path: str, batch: str) -> None:
        """Store a batch's states. A batch that is written again, say by a task that is tried anew, replaces itself."""
        self.states(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    def stored(self, spark: SparkSession, path: str) -> DataFrame:
        """States of all batches, with their batch."""
        return spark.read.option("basePath", path).parquet(path)

    def compact(self, spark: SparkSession, path: str, target: str, batch: str = "merged") -> None:
        """Write the states of all batches as those of one to another folder."""
        self.merge(self.stored(spark, path)).write.mode("errorifexists").parquet(f"{target.rstrip('/')}/batch={batch}")

    def sets(self, states: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
        """States by each of several sets of keys; ``level`` is the set's place, keys outside it are null.

        The data were grouped once, by all keys; each set adds up states, so no row of the data is repeated for a set.
        """
        types = dict(states.dtypes)
        out = None
        for level, by in enumerate(sets):
            one = self.merge(states, by)
            row = one.select(F.lit(level).alias("level"), *(F.col(c) if c in by else F.lit(None).cast(types[c]).alias(c) for c in self.keys), *STATE)
            out = row if out is None else out.unionByName(row)
        if out is None:
            raise ValueError("at least one set of keys is needed")
        return out
