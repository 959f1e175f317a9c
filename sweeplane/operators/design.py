"""Design spaces and point generators. Every generator is addressed by point index, so any partitioning gives the same points."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions.registry import lookup, register
from sweeplane.functions.tables import cut, hashed_rank, normal, uniform


@dataclass(frozen=True)
class Continuous:
    lower: float
    upper: float

    def __post_init__(self) -> None:
        if self.upper <= self.lower:
            raise ValueError("upper must exceed lower")

    @classmethod
    def around(cls, center: float, delta: float) -> Continuous:
        return cls(center - delta, center + delta)

    @property
    def bounds(self) -> tuple[float, float]:
        return self.lower, self.upper

    def from_unit(self, z: Column) -> Column:
        return self.lower + z * (self.upper - self.lower)

    def to_unit(self, v: Column) -> Column:
        return (v - self.lower) / (self.upper - self.lower)


@dataclass(frozen=True)
class Integer(Continuous):
    """Whole numbers ``step`` apart from ``lower`` (with ``from_zero`` multiples of the step), half to even."""

    step: int = 1
    from_zero: bool = False

    def from_unit(self, z: Column) -> Column:
        base = 0 if self.from_zero else self.lower
        v = F.rint((self.lower + z * (self.upper - self.lower) - base) / self.step) * self.step + base
        return F.least(F.greatest(v, F.lit(float(self.lower))), F.lit(float(self.upper))).cast("long")


@dataclass(frozen=True)
class Levels:
    """Named levels; the end levels get half the share of the others, unless ``even``."""

    levels: tuple[str, ...]
    ordered: bool = False
    even: bool = False

    @property
    def bounds(self) -> tuple[float, float]:
        return 0.0, float(len(self.levels) - 1)

    def from_unit(self, z: Column) -> Column:
        n = len(self.levels)
        at = F.floor(z * n) if self.even else F.rint(z * (n - 1))
        return F.get(F.array(*(F.lit(x) for x in self.levels)), F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int"))

    def to_unit(self, v: Column) -> Column:
        at = F.array_position(F.array(*(F.lit(x) for x in self.levels)), v) - 1
        return F.try_divide(at.cast("double"), F.lit(float(len(self.levels) - 1)))


Variable = Continuous | Integer | Levels
_KINDS = {"continuous": Continuous, "integer": Integer, "ordinal": Levels, "categorical": Levels}


class DesignSpace:
    """Ordered variables by name, and constraints on points (column expressions)."""

    def __init__(self, variables: dict[str, Variable]) -> None:
        self.variables = dict(variables)
        self.constraints: list[Column] = []

    @classmethod
    def around(cls, centers: dict[str, float], delta: float | dict[str, float], relative: bool = False) -> DesignSpace:
        d = {k: delta if isinstance(delta, (int, float)) else delta[k] for k in centers}
        return cls({k: Continuous.around(c, d[k] * abs(c) if relative else d[k]) for k, c in centers.items()})

    @classmethod
    def of_table(cls, df: DataFrame, columns: list[str]) -> DesignSpace:
        """Continuous variables between the least and the greatest value of a table's columns, of one aggregation; null and NaN
        are passed over. A column without two different values raises."""
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = df.agg(*(f(value(c)).alias(f"{name}{n}") for n, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max)))).first()
        if any(row[f"lo{n}"] is None for n in range(len(columns))):
            raise ValueError("a column has no value")
        return cls({c: Continuous(row[f"lo{n}"], row[f"hi{n}"]) for n, c in enumerate(columns)})

    def add_constraint(self, condition: Column) -> None:
        self.constraints.append(condition)

    def valid(self, points: DataFrame) -> DataFrame:
        for c in self.constraints:
            points = points.where(c)
        return points

    def denormalize(self, units: DataFrame) -> DataFrame:
        """point_id and typed variables from point_id and u (an array in [0, 1])."""
        return units.select("point_id", *(v.from_unit(F.get("u", F.lit(n))).alias(name) for n, (name, v) in enumerate(self.variables.items())))

    def normalize(self, points: DataFrame) -> DataFrame:
        return points.select("point_id", F.array(*(v.to_unit(F.col(name)).cast("double") for name, v in self.variables.items())).alias("u"))

    def sample(self, spark: SparkSession, n: int, sampler: str = "sobol", reject_invalid: bool = True, max_attempts: int = 1000, start: int = 0, **options) -> DataFrame:
        """n points; those that break a constraint are replaced by later ones of the sequence."""
        draw = lambda count, at: self.denormalize(generator(sampler)(spark, count, len(self.variables), start=at, **options))
        if not (reject_invalid and self.constraints):
            return draw(n, start)
        count, tried = n, 0
        while tried < max_attempts:
            good = self.valid(draw(count, start))
            have = good.count()
            if have >= n:
                return good.orderBy("point_id").limit(n)
            tried += count // n
            count = min(max(2 * count, math.ceil(1.2 * count * n / max(have, 1))), n * max_attempts)
        raise RuntimeError("too few points meet the constraints")

    def to_json(self) -> str:
        kind = lambda v: "integer" if isinstance(v, Integer) else ("ordinal" if v.ordered else "categorical") if isinstance(v, Levels) else "continuous"
        return json.dumps({k: {"type": kind(v), **asdict(v)} for k, v in self.variables.items()})

    @classmethod
    def from_dict(cls, spec: dict[str, dict]) -> DesignSpace:
        """Types default to continuous; center and delta may stand for the bounds."""
        out: dict[str, Variable] = {}
        for name, fields in spec.items():
            fields = dict(fields)
            kind = fields.pop("type", "continuous")
            if kind not in _KINDS:
                raise ValueError(f"unknown variable type {kind!r}")
            if "center" in fields:
                c, d = fields.pop("center"), fields.pop("delta")
                fields |= {"lower": c - d, "upper": c + d}
            if "levels" in fields:
                fields |= {"levels": tuple(fields["levels"]), "ordered": kind == "ordinal"}
            out[name] = _KINDS[kind](**fields)
        return cls(out)

    @classmethod
    def from_json(cls, text: str) -> DesignSpace:
        return cls.from_dict(json.loads(text))

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(json.loads(self.to_json()), sort_keys=False, allow_unicode=True)

    @classmethod
    def from_file(cls, path: str) -> DesignSpace:
        """A JSON or YAML file, by its suffix."""
        with open(path, encoding="utf-8") as f:
            if path.lower().endswith((".yaml", ".yml")):
                import yaml

                return cls.from_dict(yaml.safe_load(f))
            return cls.from_dict(json.load(f))


# -- generators: (spark, n, d, start=0, ...) -> point_id, u array<double> -------------------------------------------

GENERATORS: dict[str, Callable[..., DataFrame]] = {}


def generator(alias: str) -> Callable[..., DataFrame]:
    return lookup(GENERATORS, alias)


def _range(spark: SparkSession, n: int, start: int) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "point_id")


def primes(n: int) -> list[int]:
    out: list[int] = []
    c = 2
    while len(out) < n:
        if all(c % p for p in out):
            out.append(c)
        c += 1
    return out


def radical_inverse(index: Column, base: int) -> Column:
    """The index's digits in a base, mirrored at the point."""
    digits = min(40, math.ceil(63 * math.log(2) / math.log(base)))
    state = F.struct(index.cast("long").alias("left"), F.lit(0.0).alias("sum"), F.lit(1.0 / base).alias("unit"))
    step = lambda s, _: F.struct(
        F.floor(s["left"] / base).cast("long").alias("left"), (s["sum"] + (s["left"] % base) * s["unit"]).alias("sum"), (s["unit"] / base).alias("unit")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), state, step, lambda s: s["sum"])


@register(GENERATORS, "halton", "qmc_halton")
def halton(spark: SparkSession, n: int, d: int, start: int = 0, scramble: bool = False, seed: int = 0) -> DataFrame:
    """Halton points; scrambling rotates each dimension by a seeded amount modulo 1."""
    shift = lambda c, x: F.pmod(x + uniform(seed, F.lit(c)), F.lit(1.0)) if scramble else x
    return _range(spark, n, start).select("point_id", F.array(*(shift(c, radical_inverse(F.col("point_id"), b)) for c, b in enumerate(primes(d)))).alias("u"))


def _primitive_polynomials(count: int) -> list[tuple[int, int]]:
    """(degree, inner coefficients) of primitive polynomials over GF(2), by degree, then coefficients."""
    out: list[tuple[int, int]] = []
    degree = 1
    while len(out) < count:
        order = (1 << degree) - 1
        for inner in range(1 << (degree - 1)):
            poly = 1 << degree | inner << 1 | 1
            x, period = 1, 0
            while True:
                x <<= 1
                if x >> degree & 1:
                    x ^= poly
                period += 1
                if x == 1 or period > order:
                    break
            if period == order:
                out.append((degree, inner))
        degree += 1
    return out[:count]


def sobol_directions(d: int, bits: int = 52, seed: int = 1) -> list[list[int]]:
    """Direction numbers by Sobol's recurrence; starting numbers are odd and drawn by a seed, all ones in dimension 1."""
    rng = np.random.default_rng(seed)
    rows = [[1 << (bits - 1 - k) for k in range(bits)]]
    for degree, inner in _primitive_polynomials(d - 1):
        m = [int(rng.integers(0, 1 << k)) << 1 | 1 for k in range(degree)]
        for k in range(degree, bits):
            new = m[k - degree] ^ (m[k - degree] << degree)
            for q in range(1, degree):
                if inner >> (degree - 1 - q) & 1:
                    new ^= m[k - q] << q
            m.append(new)
        rows.append([m[k] << (bits - 1 - k) for k in range(bits)])
    return rows


@register(GENERATORS, "sobol", "qmc_sobol")
def sobol(spark: SparkSession, n: int, d: int, start: int = 0, scramble: bool = True, seed: int = 0) -> DataFrame:
    """A digital net in base 2 in Gray-code order; scrambling is a seeded digital shift. There are 2^40 points."""
    if start + n > 1 << 40:
        raise ValueError("a net has 2^40 points")
    bits = 52
    gray = F.col("point_id").bitwiseXOR(F.shiftright("point_id", 1))
    columns = []
    for c, row in enumerate(sobol_directions(d, bits)):
        take = F.transform(F.array(*(F.lit(v).cast("long") for v in row[:40])), lambda v, k: F.when(F.getbit(gray, k) == 1, v).otherwise(F.lit(0).cast("long")))
        x = F.aggregate(take, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))
        if scramble:
            x = x.bitwiseXOR(F.pmod(F.xxhash64(F.lit(seed), F.lit(c)), F.lit(1 << bits)))
        columns.append(x.cast("double") / float(1 << bits))
    return _range(spark, n, start).select("point_id", F.array(*columns).alias("u"))


@register(GENERATORS, "lhs", "latin")
def lhs(spark: SparkSession, n: int, d: int, start: int = 0, seed: int = 0) -> DataFrame:
    """One point in each of n strata of every dimension; ``start`` picks another design."""
    points = ids = _range(spark, n, start)
    for c in range(d):
        points = hashed_rank(points, seed * 1_000_003 + start * 1009 + c, "point_id", f"__{c}", ids)
    return points.select("point_id", F.array(*((F.col(f"__{c}") + uniform(seed, F.lit(c), "point_id")) / n for c in range(d))).alias("u"))


#: Points of a maximin design: a stratum's edges leave 12 bits of a double for the place in it.
MAXIMIN_POINTS = 1 << 40


@register(GENERATORS, "lhs_maximin")
def lhs_maximin(spark: SparkSession, n: int, d: int, start: int = 0, seed: int = 0, iterations: int = 10) -> DataFrame:
    """Of several LHS designs the one whose closest two points are farthest apart; of equal ones the first.

    Beyond 10 dimensions or below 2d points it is plain LHS, with a warning; above MAXIMIN_POINTS points it raises.
    """
    if n > MAXIMIN_POINTS:
        raise ValueError(f"a maximin design has at most {MAXIMIN_POINTS} points; take plain LHS")
    if d > 10 or n < 2 * d:
        warnings.warn("maximin means little beyond 10 dimensions or below 2d points: plain LHS", RuntimeWarning, stacklevel=2)
        return lhs(spark, n, d, start, seed)
    trials = [lhs(spark, n, d, start, seed + t).withColumn("trial", F.lit(t)) for t in range(iterations)]
    near = least_distances(reduce(DataFrame.unionByName, trials), n, d)
    chosen = near.orderBy(F.desc("distance"), "trial").first()["trial"]
    return lhs(spark, n, d, start, seed + chosen)


def least_distances(designs: DataFrame, n: int, d: int) -> DataFrame:
    """trial, distance: that of the closest two of a trial's n points (point_id, u), exactly.

    The unit cube is cut into fewer cells than points, so some cell has two; the closest such pair bounds the distance.
    Only points nearer than that to another cell's side are sent there, to be compared with its points.
    """
    m = max(k for k in range(1, int(n ** (1 / d)) + 2) if k == 1 or k**d < n)
    at = lambda x: F.least(F.greatest(F.floor(x * m), F.lit(0)), F.lit(m - 1))
    axes = range(d)
    coordinates = designs.select("trial", "point_id", *(F.col("u")[c].alias(f"x{c}") for c in axes))
    home = cut(coordinates.withColumn("cell", sum((at(F.col(f"x{c}")) * m**c for c in axes), F.lit(0))))
    other = home.select("trial", "cell", F.col("point_id").alias("other"), *(F.col(f"x{c}").alias(f"y{c}") for c in axes))
    square = F.min(sum(((F.col(f"x{c}") - F.col(f"y{c}")) ** 2 for c in axes), F.lit(0.0))).alias("square")
    within = cut(home.join(other, ["trial", "cell"]).where(F.col("point_id") < F.col("other")).groupBy("trial").agg(square))
    # A little more than the bound, so that rounding leaves no cell out.
    guests = home.join(F.broadcast(within.select("trial", (F.sqrt("square") * (1 + 1e-9) + 1e-15).alias("reach"))), "trial").withColumn("visit", F.lit(0).cast("long"))
    for c in axes:
        reached = F.explode(F.sequence(at(F.col(f"x{c}") - F.col("reach")), at(F.col(f"x{c}") + F.col("reach"))))
        guests = guests.withColumn("__k", reached).withColumn("visit", F.col("visit") + F.col("__k") * m**c).drop("__k")
    guests = guests.where(F.col("visit") < F.col("cell")).drop("cell").withColumnRenamed("visit", "cell")
    across = guests.join(other, ["trial", "cell"]).groupBy("trial").agg(square)
    return within.unionByName(across).groupBy("trial").agg(F.sqrt(F.min("square")).alias("distance"))


def least_distance(u: np.ndarray) -> float:
    """The distance of the closest two rows: each with those next to it along the first dimension, as far as they can be it."""
    u = u[np.argsort(u[:, 0])]
    best = float("inf")
    for step in range(1, len(u)):
        ahead = u[step:] - u[:-step]
        best = min(best, float((ahead**2).sum(axis=1).min()))
        if float(ahead[:, 0].min()) ** 2 >= best:
            break
    return best**0.5


@register(GENERATORS, "normal", "gauss")
def gaussian(spark: SparkSession, n: int, d: int, start: int = 0, seed: int = 0, k: float = 3.0) -> DataFrame:
    """Normal around the centre with bounds k deviations away, clipped to them."""
    if k <= 0:
        raise ValueError("k must be positive")
    draw = lambda c: F.least(F.greatest(0.5 + normal(seed, F.lit(c), "point_id") / (2 * k), F.lit(0.0)), F.lit(1.0))
    return _range(spark, n, start).select("point_id", F.array(*(draw(c) for c in range(d))).alias("u"))


@register(GENERATORS, "factorial_full", "ff2k")
def factorial_full(spark: SparkSession, n: int, d: int, start: int = 0, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """All 2^d corners (n is not looked at); the first variable is the most significant bit. ``shuffle``: in a seeded order."""
    if d > 10:
        raise ValueError("more than 10 variables")
    corners = _range(spark, 1 << d, 0)
    if shuffle:
        ranked = hashed_rank(corners, seed, "point_id", "__rank")
        at = F.col("point_id")
        return ranked.select(F.col("__rank").cast("long").alias("point_id"), F.array(*(F.getbit(at, F.lit(d - 1 - c)).cast("double") for c in range(d))).alias("u"))
    return corners.select("point_id", F.array(*(F.getbit("point_id", F.lit(d - 1 - c)).cast("double") for c in range(d))).alias("u"))


def _small(spark: SparkSession, rows: list) -> DataFrame:
    """A design whose size depends on the number of variables alone; -1 and 1 are the bounds."""
    return spark.createDataFrame([(n, [(float(x) + 1) / 2 for x in r]) for n, r in enumerate(rows)], "point_id long, u array<double>")


@register(GENERATORS, "factorial_frac", "ff_fractional")
def factorial_fractional(spark: SparkSession, n: int, d: int, start: int = 0, gen: str = "") -> DataFrame:
    """By a generator such as ``a b ab``: letters are base factors, words their products, a minus turns the sign."""
    words = gen.split()
    if len(words) != d:
        raise ValueError("the generator needs a word for each variable")
    base = sorted({c for w in words for c in w if c.isalpha()})
    rows = []
    for levels in product((-1, 1), repeat=len(base)):
        at = dict(zip(base, levels[::-1], strict=True))
        rows.append([math.prod(at[c] for c in w if c.isalpha()) * (-1 if w.startswith("-") else 1) for w in words])
    return _small(spark, rows)


@register(GENERATORS, "pb", "plackett_burman")
def plackett_burman(spark: SparkSession, n: int, d: int, start: int = 0) -> DataFrame:
    """Runs are the smallest power of two above d, or a multiple of four one above a prime (a cyclic design)."""
    q = 3
    while q < d or q % 4 != 3 or any(q % p == 0 for p in range(2, int(q**0.5) + 1)):
        q += 1
    power = 1 << d.bit_length()
    if power <= q + 1:
        rows = [[1 - 2 * (bin(r & c).count("1") % 2) for c in range(1, d + 1)] for r in range(power)]
    else:
        squares = {x * x % q for x in range(1, q)}
        line = [1 if x == 0 or x in squares else -1 for x in range(q)]
        rows = [[line[(c - r) % q] for c in range(d)] for r in range(q)] + [[-1] * d]
    return _small(spark, rows)


@register(GENERATORS, "ccd", "central_comp")
def central_composite(spark: SparkSession, n: int, d: int, start: int = 0, center: tuple[int, int] = (4, 4)) -> DataFrame:
    """Corners, star points at the orthogonal distance (beyond the bounds), and centre points of either block."""
    corners = [list(r) for r in product((-1, 1), repeat=d)]
    alpha = math.sqrt(d * (1 + center[1] / (2 * d)) / (1 + center[0] / len(corners)))
    stars = [[s * alpha if c == v else 0 for c in range(d)] for v in range(d) for s in (-1, 1)]
    return _small(spark, corners + [[0] * d] * center[0] + stars + [[0] * d] * center[1])


@register(GENERATORS, "box_behnken")
def box_behnken(spark: SparkSession, n: int, d: int, start: int = 0, center: int = 3) -> DataFrame:
    """Corners of each pair of variables with the others at their centre."""
    if d < 3:
        raise ValueError("at least three variables")
    rows = [[a if c == i else b if c == j else 0 for c in range(d)] for i, j in combinations(range(d), 2) for a, b in product((-1, 1), repeat=2)]
    return _small(spark, rows + [[0] * d] * center)
