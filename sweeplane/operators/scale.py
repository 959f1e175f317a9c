"""Scalers of long value tables: statistics by the dimensions that are kept, then an expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.tables import cut

EPS = 1e-12


def _reduced(df: DataFrame, value: str, keep: list[str], over: list[str], first, then) -> DataFrame:
    """Reduce one dimension after the other (a deviation of deviations), ending with ``keep``."""
    left = [*keep, *over]
    step = first
    for dim in over:
        left = [d for d in left if d != dim]
        df = df.groupBy(*left).agg(step(F.col(value)).alias(value))
        step = then
    return df


@dataclass(frozen=True)
class StdScaler:
    """(x - mean) / std. ``keep`` are the columns that each have statistics of their own."""

    keep: tuple[str, ...] = ()
    unbiased: bool = False
    eps: float = EPS

    def fit(self, df: DataFrame, value: str, sequential_over: list[str] | None = None) -> DataFrame:
        """keep.., mean, std (at least eps). With ``sequential_over`` dimensions are reduced one by one."""
        std = F.stddev_samp if self.unbiased else F.stddev_pop
        mean = df.groupBy(*self.keep).agg(F.avg(value).alias("mean"), std(value).alias("std"))
        if sequential_over:
            spread = _reduced(df.select(*self.keep, *sequential_over, value), value, list(self.keep), sequential_over, std, std)
            mean = _met(mean.drop("std"), spread.withColumnRenamed(value, "std"), self.keep)
        return cut(mean.withColumn("std", F.greatest(F.coalesce("std", F.lit(0.0)), F.lit(self.eps))))

    def forward(self, df: DataFrame, stats: DataFrame, value: str) -> DataFrame:
        return _met(df, stats, self.keep).withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")

    def inverse(self, df: DataFrame, stats: DataFrame, value: str) -> DataFrame:
        return _met(df, stats, self.keep).withColumn(value, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


@dataclass(frozen=True)
class MinMaxScaler:
    """To [a, b] by the least and greatest value."""

    keep: tuple[str, ...] = ()
    a: float = 0.0
    b: float = 1.0
    eps: float = EPS

    def __post_init__(self) -> None:
        if not all(isinstance(x, (int, float)) for x in (self.a, self.b)):
            raise TypeError("the range takes two numbers")
        if self.b <= self.a:
            raise ValueError("the range must not be empty")

    def fit(self, df: DataFrame, value: str) -> DataFrame:
        """keep.., lo, width (at least eps)."""
        spread = F.greatest(F.max(value) - F.min(value), F.lit(self.eps))
        return cut(df.groupBy(*self.keep).agg(F.min(value).alias("lo"), spread.alias("width")))

    def forward(self, df: DataFrame, stats: DataFrame, value: str) -> DataFrame:
        scaled: Column = (F.col(value) - F.col("lo")) / F.col("width") * (self.b - self.a) + self.a
        return _met(df, stats, self.keep).withColumn(value, scaled).drop("lo", "width")

    def inverse(self, df: DataFrame, stats: DataFrame, value: str) -> DataFrame:
        back = (F.col(value) - self.a) / max(self.b - self.a, self.eps) * F.col("width") + F.col("lo")
        return _met(df, stats, self.keep).withColumn(value, back).drop("lo", "width")


#: Most rows of statistics that are broadcast.
BROADCAST_ROWS = 100_000


def _met(df: DataFrame, stats: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows with their statistics. Kept dimensions have few values, each with many rows, so a table of checked size is
    broadcast and no row of the data moves; a larger one, with its many keys, meets them in an ordinary join."""
    if not keep:
        return df.join(F.broadcast(stats))
    small = stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(stats) if small else stats, list(keep))
