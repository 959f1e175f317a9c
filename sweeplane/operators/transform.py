"""Transforms along the frequency axis, as expressions over points. Random ones draw by sample id and seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweeplane.functions.complexcols import TWO_PI, deg, mul, scale_of, turn
from sweeplane.functions.tables import normal, uniform
from sweeplane.operators.network import to_packed, to_points

Amount = float | tuple[float, float] | Callable[[], Column]


def amount(value: Amount, seed: int, name: str) -> Column:
    """A constant; a normal draw for each sample from (mean, deviation); or what a callable returns."""
    if callable(value):
        return value()
    if isinstance(value, tuple) and len(value) == 2:
        return value[0] + value[1] * normal(seed, F.lit(name), "sample_id")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value))
    raise TypeError(f"{name} must be a number, a (mean, deviation) pair or a callable")


def _times(points: DataFrame, factor: tuple[Column, Column]) -> DataFrame:
    re, im = mul((F.col("re"), F.col("im")), factor)
    return points.withColumns({"re": re, "im": im})


def phase_delay(points: DataFrame, tau_ps: Amount, seed: int = 0) -> DataFrame:
    """s e^(-j 2 pi f tau)."""
    return _times(points, turn(-TWO_PI * F.col("f_hz") * (amount(tau_ps, seed, "tau_ps") * 1e-12)))


def phase_angle(points: DataFrame, phi_deg: Amount, seed: int = 0) -> DataFrame:
    """s e^(j phi)."""
    return _times(points, turn(F.radians(amount(phi_deg, seed, "phi_deg"))))


def mag_slope(points: DataFrame, slope_db_per_ghz: Amount, seed: int = 0) -> DataFrame:
    """s 10^(k (f - f0) / 20), f0 the sample's first frequency."""
    first = F.first("f_hz").over(Window.partitionBy("sample_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    gain = F.pow(F.lit(10.0), amount(slope_db_per_ghz, seed, "slope") * ((F.col("f_hz") - first) / 1e9) / 20)
    return points.withColumn("__g", gain).withColumns({"re": F.col("re") * F.col("__g"), "im": F.col("im") * F.col("__g")}).drop("__g")


def ripple(points: DataFrame, amp_db: Amount, period_hz: Amount, seed: int = 0, phase: float | None = None) -> DataFrame:
    """s (1 + a sin(2 pi f / T + phi)), a = 10^(dB/20) - 1; phi is drawn for each sample unless given."""
    a = F.pow(F.lit(10.0), amount(amp_db, seed, "amp_db") / 20) - 1
    phi = F.lit(float(phase)) if phase is not None else TWO_PI * uniform(seed, F.lit("phase"), "sample_id")
    gain = 1 + a * F.sin(TWO_PI * F.col("f_hz") / amount(period_hz, seed, "period") + phi)
    return points.withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain})


def add_noise(points: DataFrame, sigma_db: Amount = 0.0, sigma_deg: Amount = 0.0, cartesian: bool = False, seed: int = 0) -> DataFrame:
    """Noise for each element: a gain in dB and a phase, or with ``cartesian`` a complex number of deviation ``sigma_db``."""
    at = ("sample_id", "k", "i", "j")
    spread = amount(sigma_db, seed, "sigma_db")
    if cartesian:
        return points.withColumns({"re": F.col("re") + spread * normal(seed, F.lit("re"), *at), "im": F.col("im") + spread * normal(seed, F.lit("im"), *at)})
    gain = F.pow(F.lit(10.0), spread * normal(seed, F.lit("db"), *at) / 20)
    c, s = turn(F.radians(amount(sigma_deg, seed, "sigma_deg") * normal(seed, F.lit("deg"), *at)))
    return _times(points, (gain * c, gain * s))


def dereciprocal(points: DataFrame, sigma_db: float, seed: int = 0) -> DataFrame:
    """Adds n to S_ij above the diagonal and takes the same n from S_ji; the diagonal stays."""
    sigma = 10 ** (sigma_db / 20) - 1
    pair = ("sample_id", "k", F.least("i", "j"), F.greatest("i", "j"))
    sign = F.when(F.col("i") < F.col("j"), 1.0).when(F.col("i") > F.col("j"), -1.0).otherwise(0.0)
    return points.withColumns({
        "re": F.col("re") + sign * sigma * normal(seed, F.lit("re"), *pair), "im": F.col("im") + sign * sigma * normal(seed, F.lit("im"), *pair),
    })


def z0_shift(points: DataFrame, delta_ohm: Amount, z0: float = 50.0, seed: int = 0) -> DataFrame:
    """Renormalisation from z0 to z0 + delta at every port, for any port count; each sample's sweep is one row on the way."""
    sweeps = to_packed(points).withColumn("z0_re", F.array_repeat(F.lit(float(z0)), F.col("n_ports")))
    return to_points(renormalize(sweeps, delta_ohm, seed))


def renormalize(networks: DataFrame, delta_ohm: Amount, seed: int = 0) -> DataFrame:
    """Packed networks with z0 + delta for z0: (S - rI)(I - rS)^-1, r = delta / (2 z0 + delta).

    Any port count and any real z0 equal at all ports (50 where none is given). A batch's matrices of one port count are
    solved at once; nothing is shuffled.
    """

    def run(batches):
        for pdf in batches:
            ports, re, im = pdf["n_ports"].to_numpy(), pdf["s_re"].tolist(), pdf["s_im"].tolist()
            old = np.array([z[0] if z is not None and len(z) else 50.0 for z in pdf["z0_re"]])
            delta = pdf["__delta"].to_numpy(dtype=float)
            r = delta / (2 * old + delta)
            for p in np.unique(ports):
                at = np.flatnonzero(ports == p)
                sizes = [len(re[n]) // (p * p) for n in at]
                s = (np.concatenate([re[n] for n in at]) + 1j * np.concatenate([im[n] for n in at])).reshape(-1, p, p)
                k, eye = np.repeat(r[at], sizes)[:, None, None], np.eye(p)
                new = np.linalg.solve((eye - k * s).transpose(0, 2, 1), (s - k * eye).transpose(0, 2, 1)).transpose(0, 2, 1)
                for n, one in zip(at, np.split(new, np.cumsum(sizes)[:-1]), strict=True):
                    re[n], im[n] = one.real.ravel(), one.imag.ravel()
            shifted = [None if z is None else [x + d for x in z] for z, d in zip(pdf["z0_re"], delta, strict=True)]
            yield pdf.drop(columns="__delta").assign(s_re=re, s_im=im, z0_re=shifted)

    return networks.withColumn("__delta", amount(delta_ohm, seed, "delta")).mapInPandas(run, networks.schema)


#: How far a target frequency may lie outside a sweep, in Hz.
OUTSIDE_HZ = 1e-3


def resample_packed(networks: DataFrame, grid: int | list[float], unit: str = "Hz") -> DataFrame:
    """Packed networks on another grid: real and imaginary parts are interpolated linearly, within the row.

    A number stands for so many evenly spaced frequencies over a sample's own span. Source grids ascend, and need not be
    uniform; a target outside the span raises.
    """
    f, last = F.col("f_hz"), F.size("f_hz") - 1
    if isinstance(grid, int):
        if grid < 2:
            raise ValueError("at least two points")
        first, span = F.get(f, F.lit(0)), F.get(f, last) - F.get(f, F.lit(0))
        target = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: first + k * span / (grid - 1))
    else:
        target = F.array(*(F.lit(float(x) * scale_of(unit)) for x in grid))
    # Each target's lower neighbour, then its weight, once for all port pairs.
    lower = F.transform("__to", lambda t: F.struct(t.alias("t"), (F.greatest(F.least(F.size(F.filter(f, lambda x: x <= t)), last), F.lit(1)) - 1).alias("k")))
    share = lambda p: F.try_divide(p["t"] - F.get(f, p["k"]), F.get(f, p["k"] + 1) - F.get(f, p["k"]))
    weight = lambda p: F.coalesce(F.least(F.greatest(share(p), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    rows = networks.withColumn("__to", target).withColumn("__at", lower)
    rows = rows.withColumn("__at", F.transform("__at", lambda p: F.struct(p["k"].alias("k"), weight(p).alias("w"))))
    pairs = F.col("n_ports") * F.col("n_ports")

    def along(name: str) -> Column:
        def value(p: Column, e: Column) -> Column:
            a = F.get(name, p["k"] * pairs + e)
            return a + p["w"] * (F.coalesce(F.get(name, (p["k"] + 1) * pairs + e), a) - a)

        return F.flatten(F.transform("__at", lambda p: F.transform(F.sequence(F.lit(0), pairs - 1), lambda e: value(p, e))))

    outside = (F.array_min("__to") < F.get(f, F.lit(0)) - OUTSIDE_HZ) | (F.array_max("__to") > F.get(f, last) + OUTSIDE_HZ)
    grid_of = F.when(outside, F.raise_error(F.lit("a target frequency lies outside the sweep"))).otherwise(F.col("__to"))
    return rows.withColumns({"s_re": along("s_re"), "s_im": along("s_im"), "f_hz": grid_of}).select(networks.columns)


def resample_uniform(points: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced frequencies over each sample's span, on points; each sample's sweep is one row on the way."""
    return to_points(resample_packed(to_packed(points), n))


def resample_targets(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points on each sample's own target frequencies, ``targets`` (sample_id, k, f_hz): real and imaginary parts by linear interpolation.

    Grids of any spacing and number, from a table. A source point knows the next one; sources and targets are then merged in
    one pass in the order of frequency, where each target takes the last source before it. One exchange by sample, no cross of
    targets with sources. A target outside its sample's span by more than OUTSIDE_HZ raises; one of a sample without points
    gives no row, and a sample without targets none.
    """
    by_sample = points.repartition("sample_id")
    values = F.array_sort(F.collect_list(F.struct("i", "j", "re", "im")))
    source = by_sample.groupBy("sample_id", "f_hz").agg(values.alias("e"))
    along = Window.partitionBy("sample_id").orderBy("f_hz")
    source = source.withColumn("here", F.struct("f_hz", "e")).withColumn("next", F.lead("here").over(along))
    source = source.select("sample_id", "f_hz", F.struct("here", "next").alias("at"), F.lit(None).cast("long").alias("t"))
    merged = source.unionByName(targets.select("sample_id", F.col("f_hz").cast("double"), F.lit(None).cast(source.schema["at"].dataType).alias("at"), F.col("k").cast("long").alias("t")))
    order = Window.partitionBy("sample_id").orderBy("f_hz", F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("at", ignorenulls=True).over(Window.partitionBy("sample_id").orderBy(F.col("at").isNull(), "f_hz"))
    met = merged.withColumns({"before": F.last("at", ignorenulls=True).over(order), "first": first}).where("t IS NOT NULL AND first IS NOT NULL")
    # A target a hair below the span goes by its first point.
    p = met.withColumn("p", F.coalesce("before", "first"))
    low, high, f = F.col("p.here"), F.coalesce("p.next", "p.here"), F.col("f_hz")
    weight = F.coalesce(F.try_divide(f - low["f_hz"], high["f_hz"] - low["f_hz"]), F.lit(0.0))
    outside = (f < low["f_hz"] - OUTSIDE_HZ) | (f > high["f_hz"] + OUTSIDE_HZ)
    checked = F.when(outside, F.raise_error(F.lit("a target frequency lies outside the sweep"))).otherwise(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)))
    pair = F.zip_with(low["e"], high["e"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = p.select("sample_id", F.col("t").alias("k"), "f_hz", checked.alias("w"), F.explode(pair).alias("x"))
    between = lambda c: F.col(f"x.a.{c}") + F.col("w") * (F.col(f"x.b.{c}") - F.col(f"x.a.{c}"))
    return rows.select("sample_id", "k", "f_hz", F.col("x.a.i").alias("i"), F.col("x.a.j").alias("j"), between("re").alias("re"), between("im").alias("im"))


def unwrapped_deg(points: DataFrame, name: str = "deg") -> DataFrame:
    """Phase in degrees without jumps along the sweep: each step is brought into [-180, 180) and summed."""
    sweep = Window.partitionBy("sample_id", "i", "j").orderBy("k")
    raw = points.withColumn("__p", deg(F.col("re"), F.col("im")))
    step = raw.withColumn("__d", F.col("__p") - F.lag("__p").over(sweep))
    inside = F.pmod(F.col("__d") + 180, F.lit(360.0)) - 180
    inside = F.when((inside == -180) & (F.col("__d") > 0), F.lit(180.0)).otherwise(inside)
    fix = F.when(F.abs(F.col("__d")) < 180, 0.0).otherwise(inside - F.col("__d"))
    total = F.sum(F.coalesce("__c", F.lit(0.0))).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("__c", fix).withColumn(name, F.col("__p") + total).drop("__p", "__d", "__c")


def unwrapped_packed(networks: DataFrame, name: str = "s_deg") -> DataFrame:
    """Packed networks with an array of unwrapped phases in the order of s_re; each sweep is followed within its row.

    A batch's sweeps of one shape are unwrapped together by running sums, so the time is in proportion to the points. A null
    part has a null phase and is no step; from a NaN on a sweep is NaN.
    """

    @F.arrow_udf("array<double>")
    def unwrap(ports: pa.Array, re: pa.Array, im: pa.Array) -> pa.Array:
        pairs = [-1 if p is None or not r.is_valid or not i.is_valid else p * p for p, r, i in zip(ports.to_pylist(), re, im, strict=True)]
        return _unwrapped(np.array(pairs, dtype=np.int64), re, im)

    return networks.withColumn(name, unwrap("n_ports", "s_re", "s_im"))


def _unwrapped(pairs: np.ndarray, re: pa.Array, im: pa.Array) -> pa.Array:
    """Unwrapped phases of each row's sweeps of so many port pairs; -1 stands for a null row."""
    sizes = np.array([len(r) if r.is_valid else 0 for r in re], dtype=np.int64)
    ends = np.append(0, np.cumsum(np.where(pairs < 0, 0, sizes)))
    values, nulls = np.zeros(ends[-1]), np.zeros(ends[-1], dtype=bool)
    for shape in sorted(set(zip(pairs.tolist(), sizes.tolist(), strict=True))):
        if shape[0] < 1 or not shape[1]:
            continue
        at = np.flatnonzero((pairs == shape[0]) & (sizes == shape[1]))
        rows = [(re[int(n)].values, im[int(n)].values) for n in at]
        a, b = (np.stack([r[part].to_numpy(zero_copy_only=False).astype(float) for r in rows]).reshape(len(at), -1, shape[0]) for part in (0, 1))
        gone = np.stack([pc.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False) for x, y in rows]).reshape(a.shape)
        p = np.degrees(np.arctan2(b, a))
        d = np.diff(p, axis=1)
        inside = np.mod(d + 180, 360.0) - 180
        inside = np.where((inside == -180) & (d > 0), 180.0, inside)
        fix = np.where(np.abs(d) < 180, 0.0, inside - d)
        fix[gone[:, 1:] | gone[:, :-1]] = 0.0
        p[:, 1:] += np.cumsum(fix, axis=1)
        place = ends[at][:, None] + np.arange(shape[1])
        values[place], nulls[place] = p.reshape(place.shape), gone.reshape(place.shape)
    valid = pa.array(np.append(ends[:-1], ends[-1]), pa.int32(), mask=np.append(pairs < 0, False))
    return pa.ListArray.from_arrays(valid, pa.array(values, mask=nulls))


def group_delay(points: DataFrame) -> DataFrame:
    """Extension: -d(phase)/d(omega) in seconds between neighbours; null at the last point."""
    sweep = Window.partitionBy("sample_id", "i", "j").orderBy("k")
    p = unwrapped_deg(points, "__deg")
    slope = F.radians(F.lead("__deg").over(sweep) - F.col("__deg")) / (TWO_PI * (F.lead("f_hz").over(sweep) - F.col("f_hz")))
    return p.withColumn("delay_s", -slope).drop("__deg")
