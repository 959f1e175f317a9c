"""The two layouts of a network: packed (arrays in one row a sample) and points (a row for each matrix element)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import scale_of

#: Packed networks: frequencies in Hz; matrices row-major by frequency, out port, in port.
NETWORK_SCHEMA = (
    "sample_id long, path string, n_ports int, unit string, s_def string, z0_re array<double>, z0_im array<double>, "
    "comments array<string>, params map<string,double>, params_str map<string,string>, f_hz array<double>, "
    "s_re array<double>, s_im array<double>"
)
POINTS = ("sample_id", "k", "f_hz", "i", "j", "re", "im")


def network_fields() -> list[tuple[str, str]]:
    """Names and types of the schema's fields."""
    return [tuple(f.split(" ", 1)) for f in re.split(r",\s*(?=\w+ )", NETWORK_SCHEMA)]


def to_points(
    networks: DataFrame, band_hz: tuple[float, float] | None = None, keep: tuple[str, ...] = (), also: tuple[str, ...] = ()
) -> DataFrame:
    """One row for each sample, frequency and port pair (ports from 0). A band drops frequencies before exploding.

    ``keep`` are columns of the sample; ``also`` arrays in the order of s_re, of which each row gets its element.
    """
    f = F.arrays_zip(F.sequence(F.lit(0), F.size("f_hz") - 1).alias("k"), F.col("f_hz").alias("f"))
    if band_hz:
        f = F.filter(f, lambda x: (x["f"] >= band_hz[0]) & (x["f"] <= band_hz[1]))
    rows = networks.where(F.size("f_hz") > 0).select("sample_id", "n_ports", *keep, F.explode(f).alias("p"), "s_re", "s_im", *also)
    pairs = F.col("n_ports") * F.col("n_ports")
    at = F.col("p.k") * pairs + F.col("e")
    return rows.withColumn("e", F.explode(F.sequence(F.lit(0), pairs - 1))).select(
        "sample_id", *keep, F.col("p.k").cast("long").alias("k"), F.col("p.f").alias("f_hz"),
        F.expr("CAST(e div n_ports AS BIGINT)").alias("i"), (F.col("e") % F.col("n_ports")).cast("long").alias("j"),
        F.get("s_re", at).alias("re"), F.get("s_im", at).alias("im"), *(F.get(c, at).alias(c) for c in also),
    )


def to_packed(points: DataFrame) -> DataFrame:
    """Points back to arrays: sample_id, n_ports, f_hz, s_re, s_im. One sample's sweep is one group."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "i", "j", "f_hz", "re", "im")))
    rows = points.groupBy("sample_id").agg(ordered.alias("p"), (F.max("i") + 1).cast("int").alias("n_ports"))
    first = F.filter("p", lambda x: (x["i"] == 0) & (x["j"] == 0))
    return rows.select(
        "sample_id", "n_ports", F.transform(first, lambda x: x["f_hz"]).alias("f_hz"),
        F.transform("p", lambda x: x["re"]).alias("s_re"), F.transform("p", lambda x: x["im"]).alias("s_im"),
    )


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Left-to-right composition of transforms."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run


def port(points: DataFrame, m: int, n: int) -> DataFrame:
    """The element S_mn (ports from 1)."""
    return points.where((F.col("i") == m - 1) & (F.col("j") == n - 1))


def band_mask(points: DataFrame, band_ghz: tuple[float, float] | None) -> DataFrame:
    """Frequencies within the band, both ends included, in GHz; all of them without a band."""
    return points if band_ghz is None else points.where((F.col("f_hz") / 1e9).between(*band_ghz))


def crop(points: DataFrame, start: float, stop: float, unit: str = "Hz") -> DataFrame:
    """Frequencies between the grid points nearest to the two bounds, both included; of equally near ones the lower."""
    if start >= stop:
        raise ValueError("the crop must start below its stop")
    lo, hi = start * scale_of(unit), stop * scale_of(unit)
    near = lambda b: F.min_by("f_hz", F.struct(F.abs(F.col("f_hz") - b), F.col("f_hz")))
    ends = points.groupBy(F.col("sample_id").alias("__id")).agg(near(lo).alias("__lo"), near(hi).alias("__hi"))
    met = points.join(ends, points["sample_id"] == ends["__id"])
    return met.where(F.col("f_hz").between(F.col("__lo"), F.col("__hi"))).drop("__id", "__lo", "__hi")


def check_grid(points: DataFrame, tol_hz: float = 1e-3) -> DataFrame:
    """Samples whose grid differs from that of the smallest sample id: sample_id, n_bad. Empty means consistent."""
    grid = points.groupBy("sample_id", "k").agg(F.first("f_hz").alias("f"))
    first = points.agg(F.min("sample_id").alias("sid"))
    base = grid.join(F.broadcast(first), grid["sample_id"] == first["sid"]).select(F.col("k").alias("bk"), F.col("f").alias("bf"))
    sizes = base.agg(F.count("*").alias("want"))
    met = grid.join(F.broadcast(base), grid["k"] == base["bk"], "left")  # one sample's sweep: it does not grow with the table
    bad = F.when(F.col("bf").isNull() | (F.abs(F.col("f") - F.col("bf")) > tol_hz), 1).otherwise(0)
    out = met.groupBy("sample_id").agg(F.sum(bad).alias("bad"), F.count("*").alias("n"))
    out = out.join(F.broadcast(sizes)).withColumn("n_bad", F.col("bad") + F.greatest(F.col("want") - F.col("n"), F.lit(0)))
    return out.where("n_bad > 0").select("sample_id", "n_bad")


def check_units(networks: DataFrame) -> DataFrame:
    """Samples whose frequency unit is not that of the smallest sample id: sample_id, unit. Empty means consistent."""
    first = networks.agg(F.min_by("unit", "sample_id").alias("__unit"))
    return networks.join(F.broadcast(first)).where(~F.col("unit").eqNullSafe(F.col("__unit"))).select("sample_id", "unit")


def with_shared_grid(networks: DataFrame, grids: DataFrame) -> DataFrame:
    """A sample's own f_hz where it has one, else the shared one of its grid_id. Grids are a small dimension table."""
    shared = grids.select(F.col("grid_id"), F.col("f_hz").alias("__f"))
    return networks.join(shared, "grid_id", "left").withColumn("f_hz", F.coalesce("f_hz", "__f")).drop("__f")
