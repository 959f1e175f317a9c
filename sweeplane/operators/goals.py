"""Specifications: selector -> aggregator -> comparator criteria, compiled to one aggregation over points."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.complexcols import NAN, axial_ratio, db, mag
from sweeplane.functions.registry import register

SELECTORS: dict[str, type] = {}
AGGREGATORS: dict[str, type] = {}
COMPARATORS: dict[str, type] = {}


@dataclass(frozen=True)
class Selector:
    """Values along the sweep within a band in GHz, both ends included."""

    band_ghz: tuple[float, float] | None = None

    def in_band(self) -> Column:
        return F.lit(True) if self.band_ghz is None else (F.col("f_hz") / 1e9).between(*self.band_ghz)


@register(SELECTORS, "s_mag", "sdb", "smag")
@dataclass(frozen=True)
class SMag(Selector):
    """|S_mn| (ports from 1), in dB unless told otherwise."""

    m: int = 1
    n: int = 1
    in_db: bool = True

    @property
    def name(self) -> str:
        return f"S{self.m}{self.n}_{'dB' if self.in_db else 'mag'}"

    def value(self) -> Column:
        v = db(F.col("re"), F.col("im")) if self.in_db else mag(F.col("re"), F.col("im"))
        return F.when(self.in_band() & (F.col("i") == self.m - 1) & (F.col("j") == self.n - 1), v)


@register(SELECTORS, "axial_ratio", "ar")
@dataclass(frozen=True)
class AxialRatio(Selector):
    """Axial ratio from S31 and S41; needs points with the columns of ``with_axial_ratio``."""

    in_db: bool = True

    @property
    def name(self) -> str:
        return "AR_dB" if self.in_db else "AR"

    def value(self) -> Column:
        return F.when(self.in_band() & (F.col("i") == 2) & (F.col("j") == 0), F.col("ar_db" if self.in_db else "ar"))


def with_axial_ratio(points: DataFrame) -> DataFrame:
    """Points with ar and ar_db on the rows of S31, for networks of four ports and more."""
    other = points.where("i = 3 AND j = 0").select("sample_id", "k", F.col("re").alias("re4"), F.col("im").alias("im4"), F.lit(2).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    met = points.join(other, ["sample_id", "k", "i", "j"], "left")
    c, d = (F.col("re"), F.col("im")), (F.col("re4"), F.col("im4"))
    return met.withColumns({"ar": axial_ratio(c, d, False), "ar_db": axial_ratio(c, d)}).drop("re4", "im4")


@register(AGGREGATORS, "max")
class MaxAgg:
    def over(self, v: Column) -> Column:
        return F.max(v)


@register(AGGREGATORS, "min")
class MinAgg:
    def over(self, v: Column) -> Column:
        return F.min(v)


@register(AGGREGATORS, "mean")
class MeanAgg:
    def over(self, v: Column) -> Column:
        return F.avg(v)


@register(AGGREGATORS, "ripple")
class RippleAgg:
    def over(self, v: Column) -> Column:
        return F.max(v) - F.min(v)


@register(AGGREGATORS, "std")
class StdAgg:
    """Extension: deviation over the band."""

    def over(self, v: Column) -> Column:
        return F.stddev_pop(v)


@register(COMPARATORS, "le")
@dataclass(frozen=True)
class LE:
    """At most the limit; NaN is not. The penalty is 0 or 1."""

    limit: float

    def ok(self, v: Column) -> Column:
        return F.coalesce((v <= self.limit) & ~F.isnan(v), F.lit(False))

    def penalty(self, v: Column) -> Column:
        return F.when(self.ok(v), 0.0).otherwise(1.0)


@register(COMPARATORS, "ge")
@dataclass(frozen=True)
class GE(LE):
    """At least the limit."""

    def ok(self, v: Column) -> Column:
        return F.coalesce((v >= self.limit) & ~F.isnan(v), F.lit(False))


@register(COMPARATORS, "soft_le")
@dataclass(frozen=True)
class SoftLE(LE):
    """At most the limit; above it the penalty is ((v - limit) / margin)^power."""

    margin: float = 1.0
    power: float = 2

    def __post_init__(self) -> None:
        if self.margin <= 0:
            raise ValueError("the margin must be positive")

    def penalty(self, v: Column) -> Column:
        return F.when(self.ok(v), 0.0).otherwise(F.pow((v - self.limit) / self.margin, F.lit(float(self.power))))


@register(COMPARATORS, "window")
@dataclass(frozen=True)
class Window(LE):
    """Extension: from the limit to ``upper``, both included."""

    upper: float = float("inf")

    def __post_init__(self) -> None:
        if self.upper < self.limit:
            raise ValueError("the window must not be empty")

    def ok(self, v: Column) -> Column:
        return F.coalesce(v.between(self.limit, self.upper) & ~F.isnan(v), F.lit(False))


@dataclass(frozen=True)
class Criterion:
    selector: SMag | AxialRatio
    aggregator: MaxAgg | MinAgg | MeanAgg | RippleAgg | StdAgg
    comparator: LE
    weight: float = 1.0
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or self.selector.name


@dataclass(frozen=True)
class Specification:
    """All criteria must hold. Names must differ."""

    criteria: tuple[Criterion, ...]
    reserved: frozenset = field(default=frozenset({"sample_id", "all_ok", "penalty"}), repr=False)

    def __post_init__(self) -> None:
        labels = [c.label for c in self.criteria]
        if len(set(labels)) < len(labels) or set(labels) & self.reserved:
            raise ValueError("criteria need names of their own")

    def values(self, points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """One column a criterion; NaN where the band has no point. One aggregation for all criteria."""
        aggregates = [F.coalesce(c.aggregator.over(c.selector.value()), F.lit(NAN)).alias(c.label) for c in self.criteria]
        return points.groupBy("sample_id", *keep).agg(*aggregates)

    def all_ok(self) -> Column:
        out = F.lit(True)
        for c in self.criteria:
            out = out & c.comparator.ok(F.col(c.label))
        return out

    def is_ok(self, points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return self.values(points, keep).select("sample_id", *keep, self.all_ok().alias("ok"))

    def penalty(self, points: DataFrame, reduce: str = "sum") -> DataFrame:
        """Sum, mean or max of the weighted penalties."""
        each = [c.comparator.penalty(F.col(c.label)) * c.weight for c in self.criteria]
        total = sum(each[1:], each[0])
        if reduce not in ("sum", "mean", "max"):
            raise ValueError(f"unknown reduction {reduce!r}")
        out = total if reduce == "sum" else total / len(each) if reduce == "mean" else F.greatest(*each) if len(each) > 1 else each[0]
        return self.values(points).select("sample_id", out.alias("penalty"))

    def report(self, points: DataFrame) -> DataFrame:
        """A row for each criterion: value, ok, penalty, weight; and over all: all_ok, total_penalty (unweighted)."""
        v = self.values(points)
        each = [c.comparator.penalty(F.col(c.label)) for c in self.criteria]
        items = [
            F.struct(F.lit(c.label).alias("criterion"), F.col(c.label).alias("value"), c.comparator.ok(F.col(c.label)).alias("ok"), p.alias("penalty"), F.lit(c.weight).alias("weight"))
            for c, p in zip(self.criteria, each, strict=True)
        ]
        rows = v.select("sample_id", self.all_ok().alias("all_ok"), sum(each[1:], each[0]).alias("total_penalty"), F.explode(F.array(*items)).alias("e"))
        return rows.select("sample_id", "e.*", "all_ok", "total_penalty")


def yield_by(flags: DataFrame, *keys: str) -> DataFrame:
    """Share of samples that pass, with their number, by key."""
    return flags.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("yield"))


def binary_metrics(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """accuracy, recall, precision, f1 of two flag columns; 0/0 counts as 0."""
    both = lambda p, t: F.count_if((F.col(pred) == p) & (F.col(truth) == t))
    c = rows.agg(both(True, True).alias("tp"), both(True, False).alias("fp"), both(False, True).alias("fn"), both(False, False).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def regression_metrics(rows: DataFrame, pred: str, truth: str, output: str) -> DataFrame:
    """mse and mae over all rows; r2 as the mean over outputs of 1 - SSE/SST."""
    e = F.col(pred) - F.col(truth)
    per = rows.groupBy(output).agg(
        F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.count("*").alias("n"), (F.var_pop(truth) * F.count("*")).alias("sst")
    )
    return per.agg(
        (F.sum("sse") / F.sum("n")).alias("mse"), (F.sum("sae") / F.sum("n")).alias("mae"),
        F.avg(1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
    )
