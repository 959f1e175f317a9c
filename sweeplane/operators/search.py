"""Manufacturing yield, and the largest box of tolerances around a centre."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions.tables import cut
from sweeplane.operators.design import DesignSpace
from sweeplane.operators.goals import Specification
from sweeplane.operators.surrogate import Surrogate


#: Rows of a block of edges of boxes, and of a block of points.
BLOCK = 4096
#: Pairs of a box and a point that are compared without an index.
DIRECT_PAIRS = 1 << 30
#: Cells of the index of a cloud, over all its axes: 256 columns of each of two, 40 of each of three.
CELLS = 1 << 16


def estimate_yield(spark: SparkSession, space: DesignSpace, surrogate: Surrogate, spec: Specification, n: int = 8192, sampler: str = "normal", **options) -> DataFrame:
    """One row: n, yield. Constraints of the space are not applied. Points without a verdict fail."""
    points = space.sample(spark, n, sampler, reject_invalid=False, **options)
    flags = spec.is_ok(surrogate.transform(points))
    judged = points.join(flags, points["point_id"] == flags["sample_id"], "left")
    return judged.agg(F.count("*").alias("n"), F.avg(F.coalesce("ok", F.lit(False)).cast("double")).alias("yield"))


def candidate_boxes(passing: DataFrame, center: dict[str, float], mode: str = "sym") -> DataFrame:
    """A box for each passing point: lo_<v>, hi_<v>, volume. Symmetric around the centre, or between it and the point."""
    if mode not in ("sym", "asym"):
        raise ValueError(f"unknown mode {mode!r}")
    columns, volume = [], F.lit(1.0)
    for v, c in center.items():
        d = F.abs(F.col(v) - c)
        lo, hi = (c - d, c + d) if mode == "sym" else (F.least(F.col(v), F.lit(c)), F.greatest(F.col(v), F.lit(c)))
        columns += [lo.alias(f"lo_{v}"), hi.alias(f"hi_{v}")]
        volume = volume * (hi - lo)
    return passing.select(F.col("point_id").alias("cid"), *columns, volume.alias("volume"))


@dataclass(frozen=True)
class CloudIndex:
    """Columns of a cloud along each axis, and running totals of its points and passing points over their cells.

    ``borders`` are an axis's, by quantiles, so that columns hold about as many points each; ``totals`` is (2, columns + 1, ...):
    at most CELLS cells in all, whatever the cloud.
    """

    variables: tuple[str, ...]
    borders: tuple[np.ndarray, ...]
    totals: np.ndarray

    @classmethod
    def build(cls, cloud: DataFrame, variables: list[str]) -> CloudIndex:
        per_axis = max(2, int(CELLS ** (1 / len(variables))))
        shares = [q / per_axis for q in range(1, per_axis)]
        row = cloud.agg(*(F.percentile_approx(F.col(v).cast("double"), shares, 10 * per_axis).alias(f"q{n}") for n, v in enumerate(variables))).first()
        borders = tuple(np.unique(np.array(row[f"q{n}"] or [], dtype=float)) for n in range(len(variables)))
        shape = tuple(len(b) + 1 for b in borders)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, int(np.prod(shape))), dtype=np.int64)
            for pdf in batches:
                x = pdf[variables].to_numpy(dtype=float)
                cell = np.ravel_multi_index([np.searchsorted(b, x[:, n], "right") for n, b in enumerate(borders)], shape)
                total[0] += np.bincount(cell, minlength=total.shape[1])
                total[1] += np.bincount(cell[pdf["ok"].to_numpy(dtype=bool)], minlength=total.shape[1])
            at = np.flatnonzero(total[0])
            yield pd.DataFrame({"cell": at, "n": total[0, at], "g": total[1, at]})

        counted = cloud.select(*variables, "ok").mapInPandas(count, "cell long, n long, g long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        cells = np.zeros((2, int(np.prod(shape))), dtype=np.int64)
        for r in counted.collect():  # CELLS rows at most
            cells[:, r["cell"]] = r["n"], r["g"]
        totals = np.pad(cells.reshape(2, *shape), [(0, 0)] + [(1, 0)] * len(shape))
        for axis in range(1, totals.ndim):
            totals = totals.cumsum(axis=axis)
        return cls(tuple(variables), borders, totals)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The column of each row's value along each axis."""
        return np.stack([np.searchsorted(b, x[:, n], "right") for n, b in enumerate(self.borders)], axis=1)

    def whole(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(points, passing points) of the cells strictly between the columns ``low`` and ``high`` of each row, by inclusion and exclusion."""
        out = np.zeros((2, len(low)), dtype=np.int64)
        a, b = low + 1, np.maximum(high, low + 1)
        for corner in range(1 << low.shape[1]):
            upper = [corner >> n & 1 for n in range(low.shape[1])]
            place = tuple(b[:, n] if up else a[:, n] for n, up in enumerate(upper))
            out += (-1) ** (low.shape[1] - sum(upper)) * self.totals[(slice(None), *place)]
        return out


def _edges(candidates: DataFrame, index: CloudIndex) -> DataFrame:
    """For each box: a row with what its whole cells hold (axis -1), and a row for each column in which it has an edge."""
    variables = index.variables
    lows, highs = [f"lo_{v}" for v in variables], [f"hi_{v}" for v in variables]
    shared = candidates.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = shared.value
            low, high = own.columns(pdf[lows].to_numpy(dtype=float)), own.columns(pdf[highs].to_numpy(dtype=float))
            n, g = own.whole(low, high)
            yield pdf.assign(axis=-1, part=0, n=n, g=g)
            for axis in range(len(variables)):
                yield pdf.assign(axis=axis, part=low[:, axis], n=0, g=0)
                two = low[:, axis] != high[:, axis]
                yield pdf[two].assign(axis=axis, part=high[two, axis], n=0, g=0)

    bounds = ", ".join(f"{c} double" for c in (*lows, *highs))
    doubles = [F.col(c).cast("double").alias(c) for c in (*lows, *highs)]
    return candidates.select(F.col("cid").cast("long").alias("cid"), *doubles).mapInPandas(run, f"cid long, {bounds}, axis long, part long, n long, g long")


def _in_columns(cloud: DataFrame, index: CloudIndex) -> DataFrame:
    """Each point (its coordinates as x_0, x_1, ...) once for each axis, in its column there."""
    names = _places(len(index.variables))
    shared = cloud.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = shared.value.columns(pdf[names].to_numpy(dtype=float))
            for axis in range(len(names)):
                yield pdf.assign(axis=axis, part=at[:, axis])

    rows = cloud.select("point_id", *(F.col(v).cast("double").alias(x) for v, x in zip(index.variables, names, strict=True)), "ok")
    return rows.mapInPandas(run, f"point_id {cloud.schema['point_id'].dataType.simpleString()}, {', '.join(f'{x} double' for x in names)}, ok boolean, axis long, part long")


def _places(n: int) -> list[str]:
    """Coordinates by position, so that no variable's name is that of a helper column."""
    return [f"x_{k}" for k in range(n)]


def compared_pairs(candidates: DataFrame, cloud: DataFrame, variables: list[str]) -> tuple[int, int]:
    """(pairs of a box and a point that are compared, all pairs): what the index saves."""
    index = CloudIndex.build(cloud, variables)
    at = ("axis", "part")
    boxes = _edges(candidates, index).groupBy(*at).agg(F.count("*").alias("b"))
    points = _in_columns(cloud, index).groupBy(*at).agg(F.count("*").alias("p"))
    met = boxes.join(points, list(at)).agg(F.sum(F.col("b") * F.col("p"))).first()[0]
    return int(met or 0), candidates.count() * cloud.count()


def _score_directly(candidates: DataFrame, cloud: DataFrame, variables: list[str], rows: list[int]) -> DataFrame:
    """``score_boxes`` without an index: every block of boxes with every block of points, each about BLOCK rows."""
    parts = [max(1, -(-n // BLOCK)) for n in rows]
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    names = _places(len(variables))
    left = candidates.withColumns({"a": block("cid", parts[0]), "b": every(parts[1])})
    right = cloud.select("point_id", *(F.col(v).alias(x) for v, x in zip(variables, names, strict=True)), "ok")
    right = right.withColumns({"b": block("point_id", parts[1]), "a": every(parts[0])})
    lows, highs = [f"lo_{v}" for v in variables], [f"hi_{v}" for v in variables]

    def score(boxes: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        x, ok = points[names].to_numpy(dtype=float), points["ok"].to_numpy(dtype=bool)
        lo, hi = boxes[lows].to_numpy(dtype=float), boxes[highs].to_numpy(dtype=float)
        within = np.ones((len(lo), len(x)), dtype=bool)
        for v in range(len(variables)):
            within &= (x[:, v] >= lo[:, v, None]) & (x[:, v] <= hi[:, v, None])
        return pd.DataFrame({"cid": boxes["cid"], "n": within.sum(axis=1), "g": (within & ok).sum(axis=1)})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(score, "cid long, n long, g long")
    return candidates.join(met.groupBy("cid").agg(F.sum("n").alias("inside"), F.sum("g").alias("good")), "cid")


def score_boxes(candidates: DataFrame, cloud: DataFrame, variables: list[str], direct: int = DIRECT_PAIRS) -> DataFrame:
    """Candidates with ``inside`` and ``good``: how many points of the cloud lie within, and how many of those pass.

    Cells that lie wholly within a box are added from running totals. Only points in a column where the box has an edge are
    compared with it: of any pair the first such axis is the one that counts it. A box is a row for each of its edges, a point
    one for each axis. Columns of many rows are dealt in blocks of about BLOCK by BLOCK, each one task's arrays; no pair of
    rows is made into a row, and the driver holds the cells, at most CELLS. ``cid`` must be unique. Up to ``direct`` pairs are
    compared without an index, whose jobs would take longer; the counts are the same.
    """
    names = list(variables)
    rows = [df.count() for df in (candidates, cloud)]
    if rows[0] * rows[1] <= direct:
        return _score_directly(candidates, cloud, names, rows)
    index = CloudIndex.build(cloud, names)
    edges, points = cut(_edges(candidates, index)), _in_columns(cloud, index)
    at = ("axis", "part")
    parts = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    sizes = parts(edges.where("axis >= 0"), "edge_blocks").join(parts(points, "point_blocks"), list(at))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = edges.join(sizes, list(at)).withColumns({"a": block("cid", "edge_blocks"), "b": every("point_blocks")})
    right = points.join(sizes, list(at)).withColumns({"b": block("point_id", "point_blocks"), "a": every("edge_blocks")})
    lows, highs = [f"lo_{v}" for v in names], [f"hi_{v}" for v in names]
    keys, places = (*at, "a", "b"), _places(len(names))
    left, right = left.select(*keys, "cid", *lows, *highs), right.select(*keys, "point_id", *places, "ok")
    shared = candidates.sparkSession.sparkContext.broadcast(index)

    def score(boxes: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        x, ok, own = points[places].to_numpy(dtype=float), points["ok"].to_numpy(dtype=bool), shared.value
        lo, hi = boxes[lows].to_numpy(dtype=float), boxes[highs].to_numpy(dtype=float)
        within = np.ones((len(lo), len(x)), dtype=bool)
        for v in range(len(names)):
            within &= (x[:, v] >= lo[:, v, None]) & (x[:, v] <= hi[:, v, None])
        if len(lo) and len(x):
            first, last, place = own.columns(lo), own.columns(hi), own.columns(x)
            for v in range(int(boxes["axis"].iloc[0])):
                within &= (place[:, v] > first[:, v, None]) & (place[:, v] < last[:, v, None])
        return pd.DataFrame({"cid": boxes["cid"], "n": within.sum(axis=1), "g": (within & ok).sum(axis=1)})

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "cid long, n long, g long")
    counts = met.unionByName(edges.where("axis < 0").select("cid", "n", "g")).groupBy("cid")
    return candidates.join(counts.agg(F.sum("n").alias("inside"), F.sum("g").alias("good")), "cid")


def best_box(scored: DataFrame, alpha: float) -> DataFrame:
    """The box of greatest volume among those whose share of passing points is at least alpha; of ties the lowest id."""
    fit = scored.where((F.col("inside") > 0) & (F.col("good") >= alpha * F.col("inside")))
    return fit.orderBy(F.desc("volume"), "cid").limit(1)


@dataclass(frozen=True)
class AxisZoom:
    """The box that a search along the axes found: half widths around the centre, and the cloud's points and passing points within."""

    center: dict[str, float]
    half: dict[str, float]
    inside: int
    good: int
    rounds: int
    converged: bool

    def within(self) -> Column:
        """Whether a point of the cloud lies within."""
        out = F.lit(True)
        for v, c in self.center.items():
            out = out & (F.abs(F.col(v) - c) <= self.half[v])
        return out


def _axis_counts(leveled: DataFrame, bins: int, at: list[int]) -> np.ndarray:
    """Points and passing points up to each level of each axis, of those that the other axes' levels ``at`` admit: (axes, 2, bins)."""
    names = _places(len(at))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(at), 2, bins + 1), dtype=np.int64)
        for pdf in batches:
            level, ok = pdf[names].to_numpy(), pdf["ok"].to_numpy(dtype=bool)
            for axis in range(len(at)):
                others = np.delete(np.arange(len(at)), axis)
                rows = (level[:, others] <= np.array(at, dtype=int)[others]).all(axis=1)
                total[axis, 0] += np.bincount(level[rows, axis], minlength=bins + 1)
                total[axis, 1] += np.bincount(level[rows & ok, axis], minlength=bins + 1)
        axis, kind, level = np.nonzero(total)
        yield pd.DataFrame({"axis": axis, "kind": kind, "level": level, "n": total[axis, kind, level]})

    out = np.zeros((len(at), 2, bins + 1), dtype=np.int64)
    counted = leveled.mapInPandas(count, "axis long, kind long, level long, n long").groupBy("axis", "kind", "level").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # two counts for each level of each axis at most
        out[r["axis"], r["kind"], r["level"]] = r["n"]
    return out[:, :, :bins].cumsum(axis=2)


def _quantiles(df: DataFrame, columns: list[str], bounds: list[tuple[float, float]], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` quantiles of each column's values between its bounds (both left out), ascending; its least and greatest are among them."""
    shares = [q / bins for q in range(bins + 1)]
    between = [F.when((F.col(x) > lo) & (F.col(x) < hi), F.col(x)) for x, (lo, hi) in zip(columns, bounds, strict=True)]
    row = df.agg(*(F.percentile_approx(b, shares, 10 * bins).alias(x) for x, b in zip(columns, between, strict=True))).first()
    return [np.unique(np.array(row[x] or [], dtype=float)) for x in columns]


def _leveled(df: DataFrame, columns: list[str], levels: list[np.ndarray]) -> DataFrame:
    """The first level of each axis (x_0, x_1, ...) that reaches a point's value, or their number if none does; ok."""
    names = _places(len(columns))
    shared = df.sparkSession.sparkContext.broadcast(levels)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{x: np.searchsorted(b, pdf[x].to_numpy(), "left") for x, b in zip(names, shared.value, strict=True)})

    rows = df.select(*(F.col(c).alias(x) for c, x in zip(columns, names, strict=True)), "ok")
    return cut(rows.mapInPandas(place, f"{', '.join(f'{x} int' for x in names)}, ok boolean"))


def _first_box(apart: DataFrame, names: list[str], alpha: float, bins: int) -> list[float]:
    """Half widths of the greatest box of one shape that holds alpha: distances are measured by each axis's median one.

    Quantiles of the points' sizes (of the least such box that holds each) are tried; where none holds alpha, those below the
    least of them, down to the nearest point.
    """
    medians = apart.agg(*(F.percentile_approx(x, 0.5).alias(x) for x in names)).first()
    size = F.greatest(F.lit(-1.0), *(F.col(x) / (medians[x] or 1.0) for x in names))
    sized = apart.withColumn("size", size)
    above, top = -1.0, np.inf
    while True:
        (sizes,) = _quantiles(sized, ["size"], [(above, top)], bins)
        if not len(sizes):
            raise RuntimeError("no box of this shape holds the share of passing points")
        n, g = _axis_counts(_leveled(sized, ["size"], [sizes]), len(sizes), [0])[0]
        fit = np.flatnonzero(g >= alpha * n)
        if len(fit):
            return list(sized.where(F.col("size") <= float(sizes[fit[-1]])).agg(*(F.max(x) for x in names)).first())
        top = float(sizes[0])


def axis_zoom(cloud: DataFrame, center: dict[str, float], alpha: float, bins: int = 1024, rounds: int = 64, zooms: int = 2) -> AxisZoom:
    """Widen a box around the centre axis by axis, while at least ``alpha`` of the cloud's points within it pass.

    The first box is the greatest of one shape that holds alpha. Levels of an axis are quantiles of the points' distances to the
    centre beyond the box. A round counts, in one aggregation, what every level of every axis would hold with the others as they
    are, and widens the axis whose widest feasible level adds most volume (of equal ones the first). When none is left, levels
    are taken anew between each axis's level and the next (a zoom), ``zooms`` times or until no point lies between. Counts are
    exact, so the box holds alpha; it is the widest along each axis among the levels, and among all distances where alpha is 1
    or levels are all of them (an axis of at most ``bins`` distances, without a zoom).

    ``cloud`` has the variables and ``ok`` (null fails); points with a null or NaN coordinate are left out. Raises where no box
    of the first shape holds alpha: for an empty cloud, or at an alpha of 1 where the nearest point fails. ``rounds`` bounds
    the aggregations; where they run out, ``converged`` is false.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    names = _places(len(center))
    far = [F.abs(F.col(v).cast("double") - float(c)).alias(x) for (v, c), x in zip(center.items(), names, strict=True)]
    apart = cloud.select(*far, F.coalesce("ok", F.lit(False)).alias("ok")).dropna(subset=names)
    half = _first_box(apart, names, alpha, bins)
    ends, used, moved = [np.inf] * len(names), 0, False
    for _ in range(1 + zooms):
        found = _quantiles(apart, names, list(zip(half, ends, strict=True)), bins)
        if not any(map(len, found)):
            break
        levels, at, moved = [np.concatenate([[h], b]) for h, b in zip(half, found, strict=True)], [0] * len(names), True
        leveled = _leveled(apart, names, levels)
        while moved and used < rounds:
            used += 1
            counts = _axis_counts(leveled, max(map(len, levels)), at)
            gains = []
            for (n, g), b, now in zip(counts, levels, at, strict=True):
                widest = int(np.flatnonzero(g[: len(b)] >= alpha * n[: len(b)])[-1])
                gains.append((b[widest] / b[now] if b[now] > 0 else np.inf if widest > now else 1.0, widest))
            axis = max(range(len(gains)), key=lambda a: gains[a][0])
            moved = gains[axis][1] > at[axis]
            if moved:
                at[axis] = gains[axis][1]
        half = [float(b[k]) for b, k in zip(levels, at, strict=True)]
        ends = [float(b[k + 1]) if k + 1 < len(b) else end for b, k, end in zip(levels, at, ends, strict=True)]
        if moved:
            break
    within = F.lit(True)
    for x, h in zip(names, half, strict=True):
        within = within & (F.col(x) <= h)
    inside, good = apart.where(within).agg(F.count("*"), F.count_if("ok")).first()
    return AxisZoom(dict(center), dict(zip(center, half, strict=True)), inside, good, used, not moved)


@dataclass
class BoxFinder:
    """Up to ``rounds`` clouds: score boxes around the centre, keep the largest, zoom in on it."""

    spec: Specification
    surrogate: Surrogate
    alpha: float = 0.95
    n: int = 4096
    rounds: int = 6
    eps: float = 1e-3
    mode: str = "sym"
    zoom: float = 1.2
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        if self.mode not in ("sym", "asym"):
            raise ValueError(f"unknown mode {self.mode!r}")

    def judge(self, points: DataFrame) -> DataFrame:
        """Points with ok."""
        flags = self.spec.is_ok(self.surrogate.transform(points)).withColumnRenamed("sample_id", "__id")
        return points.join(flags, points["point_id"] == flags["__id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False))).drop("__id")

    def find(self, spark: SparkSession, center: dict[str, float], delta: float | dict[str, float]) -> DataFrame:
        """One row a parameter: param, lo, hi relative to the centre, center. Each round brings one row to the driver."""
        half = {v: float(delta if isinstance(delta, (int, float)) else delta[v]) for v in center}
        start, at, best, last = dict(center), dict(center), None, None
        for turn in range(self.rounds):
            space = DesignSpace.around(at, half)
            cloud = cut(self.judge(space.sample(spark, self.n, "sobol", reject_invalid=False, start=turn * self.n, seed=self.seed)))
            passing = cloud.where("ok")
            if passing.isEmpty():
                half = {v: h / 2 for v, h in half.items()}
                continue
            scored = score_boxes(candidate_boxes(passing, at, self.mode), cloud, list(center))
            top = best_box(scored, self.alpha).first()
            if top and (best is None or top["volume"] > best["volume"]):
                best = top
            if best:
                if last and abs(best["volume"] - last) / last < self.eps:
                    break
                last = best["volume"]
                at = {v: (best[f"lo_{v}"] + best[f"hi_{v}"]) / 2 for v in center}
                half = {v: self.zoom * (best[f"hi_{v}"] - best[f"lo_{v}"]) / 2 for v in center}
                if min(half.values()) <= 0:
                    break
        if best is None:
            raise RuntimeError("no box meets the specification")
        rows = pd.DataFrame([{"param": v, "lo": best[f"lo_{v}"] - c, "hi": best[f"hi_{v}"] - c, "center": c} for v, c in start.items()])
        return spark.createDataFrame(rows)


@dataclass
class ToleranceLoop:
    """One search of the box around a centre."""

    finder: BoxFinder
    delta: float | dict[str, float]

    def run(self, spark: SparkSession, center: dict[str, float]) -> DataFrame:
        return self.finder.find(spark, center, self.delta)
