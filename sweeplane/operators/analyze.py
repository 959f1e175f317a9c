"""Statistics of parameters and responses over a set of samples. Missing values are NaN; aggregates pass them over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import NAN, db, mag, no_nan
from sweeplane.operators.network import to_points
from sweeplane.operators.transform import unwrapped_deg, unwrapped_packed


def params_long(networks: DataFrame) -> DataFrame:
    """sample_id, key, val."""
    return networks.select("sample_id", F.explode("params").alias("key", "val"))


def params_wide(networks: DataFrame, keys: list[str]) -> DataFrame:
    """A column for each key, NaN where a sample lacks it."""
    return networks.select("sample_id", *(F.coalesce(F.try_element_at("params", F.lit(k)), F.lit(NAN)).alias(k) for k in keys))


def summarize_params(networks: DataFrame) -> DataFrame:
    """Per key: mean, std (n-1; NaN for one value), min, max, nan_count, is_constant (at most one distinct value)."""
    samples = networks.agg(F.count("*").alias("samples"))
    v = no_nan(F.col("val"))
    stats = params_long(networks).groupBy("key").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"),
        (F.count_distinct(v) <= 1).alias("is_constant"),
    )
    out = stats.join(F.broadcast(samples)).withColumn("nan_count", F.col("samples") - F.col("n")).drop("samples", "n")
    return out.withColumns({c: F.coalesce(c, F.lit(NAN)) for c in ("mean", "std", "min", "max")})


def varying_keys(networks: DataFrame) -> DataFrame:
    """Keys with more than one distinct value."""
    counted = params_long(networks).groupBy("key").agg(F.count_distinct(no_nan(F.col("val"))).alias("n_distinct"))
    return counted.where("n_distinct > 1")


def histogram(networks: DataFrame, key: str, bins: int = 30) -> DataFrame:
    """Equal-width bins of one parameter: bin (from 0), lo, hi, n; bins without values are left out."""
    v = networks.select(no_nan(F.try_element_at("params", F.lit(key))).alias("v")).where("v IS NOT NULL")
    span = v.agg(F.min("v").alias("lo0"), F.max("v").alias("hi0"))
    width = F.when(F.col("hi0") > F.col("lo0"), (F.col("hi0") - F.col("lo0")) / bins).otherwise(F.lit(1.0) / bins)
    at = F.least(F.floor((F.col("v") - F.col("lo0")) / F.col("w")), F.lit(bins - 1)).cast("long")
    met = v.join(F.broadcast(span)).withColumn("w", width).withColumn("bin", at)
    lo = (F.col("lo0") + F.col("bin") * F.col("w")).alias("lo")
    return met.groupBy("bin", "lo0", "w").agg(F.count("*").alias("n")).select("bin", lo, (F.col("lo0") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "n")


def metric(points: DataFrame, kind: str, name: str = "v") -> DataFrame:
    """Points with a column of their ``db``, ``mag`` or (unwrapped) ``deg``."""
    if kind == "deg":
        return unwrapped_deg(points, name)
    if kind not in ("db", "mag"):
        raise ValueError(f"unknown metric {kind!r}")
    of = db if kind == "db" else mag
    return points.withColumn(name, of(F.col("re"), F.col("im")))


def _spread(v: Column) -> list[Column]:
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]


def summarize_s(points: DataFrame, kind: str = "db") -> DataFrame:
    """Per frequency index and port pair over the samples: mean, std (n), min, max. One exchange."""
    return metric(points, kind).groupBy("k", "i", "j").agg(*_spread(no_nan(F.col("v"))))


def summarize_phase(networks: DataFrame) -> DataFrame:
    """``summarize_s`` of the unwrapped phase of packed networks, whose sweeps stay within their rows."""
    return to_points(unwrapped_packed(networks), also=("s_deg",)).groupBy("k", "i", "j").agg(*_spread(no_nan(F.col("s_deg"))))


def norm_stats(points: DataFrame, kind: str = "db") -> DataFrame:
    """The same as arrays along the sweep, one row a port pair."""
    rows = F.array_sort(F.collect_list(F.struct("k", "mean", "std", "min", "max")))
    out = summarize_s(points, kind).groupBy("i", "j").agg(rows.alias("r"))
    along = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    return out.select("i", "j", *(along(c) for c in ("mean", "std", "min", "max")))


def summarize_components(points: DataFrame) -> DataFrame:
    """Per element's real and imaginary part over samples and frequencies: moments, nan_count, is_constant."""
    parts = F.array(F.struct(F.lit("real").alias("part"), F.col("re").alias("v")), F.struct(F.lit("imag").alias("part"), F.col("im").alias("v")))
    rows = points.select("i", "j", F.explode(parts).alias("e")).select("i", "j", "e.*")
    v = no_nan(F.col("v"))
    out = rows.groupBy("i", "j", "part").agg(*_spread(v), (F.count("*") - F.count(v)).alias("nan_count"))
    name = F.concat(F.lit("S"), (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.lit("."), "part")
    return out.withColumn("is_constant", F.coalesce(F.col("std") < 1e-12, F.lit(False))).withColumn("component", name).drop("i", "j", "part")
