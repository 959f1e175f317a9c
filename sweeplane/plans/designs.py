"""Queries over design generators, random transforms and searches. Where values are drawn, the SQL states their properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.operators import design, goals, search, transform
from sweeplane.operators.surrogate import InverseLinear, KernelSurrogate, LinearSurrogate
from sweeplane.plans.catalog import query
from sweeplane.plans.views import SQL_DB, SQL_RANGES, points, r6, ranges, rounded, sql_at, sql_points, table

S2 = sql_points(2)


def _coordinates(designs: DataFrame) -> DataFrame:
    return designs.select("point_id", F.posexplode("u").alias("dim", "u"))


def _strata(designs: DataFrame, n: int) -> DataFrame:
    """Per dimension: how many of n equal intervals have a point, and the least and most points of one."""
    by = _coordinates(designs).withColumn("s", F.floor(F.col("u") * n)).groupBy("dim", "s").agg(F.count("*").alias("n"))
    return by.groupBy("dim").agg(F.count("*").alias("strata"), F.min("n").alias("least"), F.max("n").alias("most"))


def _strata_sql(d: int, n: str, rows: str) -> str:
    return f"SELECT CAST(c AS INT) AS dim, n AS strata, CAST(1 AS BIGINT) AS least, CAST(1 AS BIGINT) AS most FROM range({d}) t(c), (SELECT {n} AS n FROM {rows})"


@query(_strata_sql(4, "CAST(1 AS BIGINT) << CAST(floor(log2(count(*))) AS BIGINT)", "part"))
def sobol_strata(spark, d):
    """As many points as the greatest power of two of parts: each of as many intervals of every dimension has one."""
    n = 1 << (table(spark, d, "part").count().bit_length() - 1)
    return _strata(design.sobol(spark, n, 4, seed=3), n)


@query(_strata_sql(3, "count(*)", "part"))
def lhs_strata(spark, d):
    """A point for each part."""
    n = table(spark, d, "part").count()
    return _strata(design.lhs(spark, n, 3, seed=3), n)


@query(_strata_sql(3, "count(*)", "supplier"))
def maximin_strata(spark, d):
    """A point for each supplier."""
    n = table(spark, d, "supplier").count()
    return _strata(design.lhs_maximin(spark, n, 3, seed=3), n)


@query("SELECT CAST(c AS INT) AS dim, n, true AS inside, true AS centred, true AS spread FROM range(3) t(c), (SELECT CAST(20 * count(*) AS BIGINT) AS n FROM part)")
def normal_moments(spark, d):
    """Twenty points for each part: within the bounds, around their middle, a sixth of their distance wide."""
    c = _coordinates(design.gaussian(spark, 20 * table(spark, d, "part").count(), 3, seed=3)).groupBy("dim")
    return c.agg(
        F.count("*").alias("n"), F.bool_and(F.col("u").between(0, 1)).alias("inside"), (F.abs(F.avg("u") - 0.5) < 0.015).alias("centred"),
        (F.abs(F.stddev_pop("u") - 1 / 6) < 0.01).alias("spread"),
    )


def _placed(spark, d, designs: DataFrame) -> DataFrame:
    """A design in the space that parts and line items span."""
    space = ranges(spark, d)
    return rounded(space.denormalize(designs), *space.variables)


_BIT = lambda k: f"((n >> {k}) & 1)"


@query(f"""WITH {SQL_RANGES} SELECT CAST(n AS BIGINT) AS point_id, {sql_at(_BIT(0), "s")} AS size, {sql_at(_BIT(1), "p")} AS price,
{sql_at(f"1 - ({_BIT(0)} + {_BIT(1)}) % 2", "q")} AS qty, {sql_at(f"1 - {_BIT(0)}", "d")} AS disc FROM range(4) t(n), r""")
def factorial_fractional(spark, d):
    """Factors size and price, their product for the quantity, the first turned for the discount."""
    return _placed(spark, d, design.factorial_fractional(spark, 0, 4, gen="a b ab -a"))


@query(f"""WITH {SQL_RANGES} SELECT CAST(16 AS BIGINT) AS n, CAST(8 AS BIGINT) AS size, CAST(8 AS BIGINT) AS price, CAST(8 AS BIGINT) AS qty, CAST(8 AS BIGINT) AS disc, CAST(16 AS BIGINT) AS corners,
round(8 * (s0 + s1), 4) AS sum_size, round(8 * (q0 + q1), 4) AS sum_qty FROM r""")
def factorial_shuffled(spark, d):
    """All corners in another order: each once, each variable high in half of them."""
    space = ranges(spark, d)
    u = space.denormalize(design.factorial_full(spark, 0, 4, shuffle=True, seed=5))
    high = lambda c: F.count_if(F.col(c) > sum(space.variables[c].bounds) / 2).alias(c)
    total = lambda c: F.round(F.sum(c), 4).alias(f"sum_{c}")
    return u.agg(F.count_distinct("point_id").alias("n"), *map(high, space.variables), F.count_distinct(*space.variables).alias("corners"), total("size"), total("qty"))


@query("""WITH e AS (SELECT vec_id % 12 AS run, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings), f AS (SELECT CAST(c AS INT) AS a, run <> 11 AND (c - run + 11) % 11 IN (0, 1, 3, 4, 5, 9) AS high, y FROM e, range(11) t(c)),
m AS (SELECT a, round(avg(y) FILTER (high) - avg(y) FILTER (NOT high), 6) + 0.0 AS effect FROM f GROUP BY a)
SELECT a, CAST(b AS INT) AS b, CASE WHEN a = b THEN 12.0 ELSE 0.0 END AS dot, effect FROM m, range(11) u(b)""")
def plackett_burman(spark, d):
    """Twelve runs of eleven variables, every two of them orthogonal; main effects on all networks, each made in one of the runs."""
    c = _coordinates(design.plackett_burman(spark, 0, 11)).select("point_id", "dim", (2 * F.col("u") - 1).alias("x"))
    other = c.select("point_id", F.col("dim").alias("b"), F.col("x").alias("y"))
    dots = c.join(other, "point_id").groupBy(F.col("dim").alias("a"), "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    made = table(spark, d, "embeddings").select((F.col("vec_id") % 12).alias("point_id"), F.get("embedding", F.lit(0)).cast("double").alias("y"))
    runs = made.groupBy("point_id").agg(F.sum("y").alias("y"), F.count("y").alias("n"))
    level = lambda high: F.sum(F.when(F.col("x") == high, F.col("y"))) / F.sum(F.when(F.col("x") == high, F.col("n")))
    effects = c.join(runs, "point_id").groupBy(F.col("dim").alias("a")).agg(r6(level(1) - level(-1), "effect"))
    return dots.join(effects, "a")


@query(f"""WITH {SQL_RANGES} SELECT CAST(p AS BIGINT) AS point_id, {sql_at("(x + 1) / 2", "s")} AS size, {sql_at("(y + 1) / 2", "p")} AS price FROM r, (
 SELECT n AS p, (CASE WHEN n // 2 = 0 THEN -1.0 ELSE 1.0 END) AS x, (CASE WHEN n % 2 = 0 THEN -1.0 ELSE 1.0 END) AS y FROM range(4) t(n) UNION ALL
 SELECT 4 + n, 0.0, 0.0 FROM range(4) t(n) UNION ALL SELECT 8 + n, CASE n WHEN 0 THEN -sqrt(2) WHEN 1 THEN sqrt(2) ELSE 0 END, CASE n WHEN 2 THEN -sqrt(2) WHEN 3 THEN sqrt(2) ELSE 0 END FROM range(4) t(n) UNION ALL
 SELECT 12 + n, 0.0, 0.0 FROM range(4) t(n))""")
def central_composite(spark, d):
    """Corners, stars and centres of the parts' sizes and prices."""
    space = design.DesignSpace(dict(list(ranges(spark, d).variables.items())[:2]))
    return rounded(space.denormalize(design.central_composite(spark, 0, 2)), "size", "price")


@query(f"""WITH {SQL_RANGES} SELECT count(*) AS n, CAST(sum(CASE WHEN a = 0.5 AND b = 0.5 AND c = 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS centres, round(sum(s0 + a * (s1 - s0)), 4) AS size,
 round(sum(p0 + b * (p1 - p0)), 4) AS price, round(sum(q0 + c * (q1 - q0)), 4) AS qty, CAST(count(DISTINCT (a, b, c)) AS BIGINT) AS runs
FROM r, (SELECT a, b, c FROM (VALUES (0.0), (0.5), (1.0)) x(a), (VALUES (0.0), (0.5), (1.0)) y(b), (VALUES (0.0), (0.5), (1.0)) z(c)
 WHERE (a <> 0.5)::INT + (b <> 0.5)::INT + (c <> 0.5)::INT = 2 UNION ALL SELECT 0.5, 0.5, 0.5 FROM range(3))""")
def box_behnken(spark, d):
    """Two of size, price and quantity at their bounds, the third at its middle; three centre points."""
    space = design.DesignSpace(dict(list(ranges(spark, d).variables.items())[:3]))
    w = space.denormalize(design.box_behnken(spark, 0, 3))
    middle = F.lit(True)
    for c, v in space.variables.items():
        middle = middle & (F.abs(F.col(c) - (v.lower + v.upper) / 2) < 1e-9 * (v.upper - v.lower))
    return w.agg(
        F.count("*").alias("n"), F.count_if(middle).alias("centres"), *(F.round(F.sum(c), 4).alias(c) for c in space.variables), F.count_distinct(*space.variables).alias("runs")
    )


@query("SELECT count(*) AS n, count(*) AS valid, true AS steps FROM part")
def constrained_sample(spark, d):
    """A point for each part in the space that they and line items span; those that break a constraint are replaced by later ones, whole numbers keep to their step."""
    size, price = (ranges(spark, d).variables[c] for c in ("size", "price"))
    middle = lambda v: (v.lower + v.upper) / 2
    space = design.DesignSpace.from_dict({
        "x": {"center": middle(size), "delta": size.upper - middle(size)}, "y": {"lower": price.lower, "upper": price.upper}, "n": {"type": "integer", "lower": 2, "upper": 8, "step": 2},
    })
    below = (F.col("x") - size.lower) / (size.upper - size.lower) + (F.col("y") - price.lower) / (price.upper - price.lower) <= 1
    space.add_constraint(below)
    got = space.sample(spark, table(spark, d, "part").count(), "sobol", seed=4)
    return got.agg(F.count("*").alias("n"), F.count_if(below).alias("valid"), F.bool_and(F.col("n").isin(2, 4, 6, 8)).alias("steps"))


@query(f"WITH {S2} SELECT CAST(i AS BIGINT) AS i, j, count(*) AS n, true AS gain_centred, true AS gain_spread, true AS phase_centred, true AS phase_spread FROM s GROUP BY i, j")
def noise_moments(spark, d):
    """Noise of 0.1 dB and 2 degrees has these deviations, and no mean."""
    p = points(spark, d)
    noisy = transform.add_noise(p, 0.1, 2.0, seed=3).select("sample_id", "k", "i", "j", F.col("re").alias("nr"), F.col("im").alias("ni"))
    met = p.join(noisy, ["sample_id", "k", "i", "j"])
    size: Column = F.hypot("re", "im")
    gain = 20 * F.log10(F.hypot("nr", "ni") / size)
    turn = F.degrees(F.atan2(F.col("ni") * F.col("re") - F.col("nr") * F.col("im"), F.col("nr") * F.col("re") + F.col("ni") * F.col("im")))
    near = lambda v, want, tol, name: (F.abs(v - want) < tol).alias(name)
    return met.groupBy("i", "j").agg(
        F.count("*").alias("n"), near(F.avg(gain), 0, 0.01, "gain_centred"), near(F.stddev_pop(gain), 0.1, 0.01, "gain_spread"),
        near(F.avg(turn), 0, 0.2, "phase_centred"), near(F.stddev_pop(turn), 2.0, 0.2, "phase_spread"),
    )


@query(f"""WITH {S2} SELECT a.sample_id, a.k, round(a.re + b.re, 6) + 0.0 AS sum_re, round(a.im + b.im, 6) + 0.0 AS sum_im, round(c.re, 6) + 0.0 AS own, true AS moved
FROM s a JOIN s b USING (sample_id, k) JOIN s c USING (sample_id, k) WHERE a.i = 0 AND a.j = 1 AND b.i = 1 AND b.j = 0 AND c.i = 0 AND c.j = 0""")
def dereciprocal_sums(spark, d):
    """What one direction gains the other loses; the diagonal stays."""
    p = points(spark, d)
    one = lambda q, i, j, name: q.where((F.col("i") == i) & (F.col("j") == j)).select("sample_id", "k", F.struct("re", "im").alias(name))
    now = transform.dereciprocal(p, 0.5, seed=4)
    met = one(now, 0, 1, "a").join(one(now, 1, 0, "b"), ["sample_id", "k"]).join(one(now, 0, 0, "c"), ["sample_id", "k"]).join(one(p, 0, 1, "was"), ["sample_id", "k"])
    return met.select(
        "sample_id", "k", r6(F.col("a.re") + F.col("b.re"), "sum_re"), r6(F.col("a.im") + F.col("b.im"), "sum_im"), r6("c.re", "own"),
        (F.col("a.re") != F.col("was.re")).alias("moved"),
    )


_SQUARE = KernelSurrogate(("x", "y"), (1e9,), lambda p: np.maximum(np.abs(p[:, 0]), np.abs(p[:, 1])).reshape(-1, 1, 1, 1) + 0j)
def _box(spark, d, mode: str) -> DataFrame:
    """The finder in a square zone whose half width is a five-hundredth of the largest part's size."""
    largest = ranges(spark, d).variables["size"].upper
    spec = goals.Specification((goals.Criterion(goals.SMag(None, 1, 1, False), goals.MaxAgg(), goals.LE(largest / 500)),))
    finder = search.BoxFinder(spec, _SQUARE, 0.99, 2048, 4, mode=mode)
    return search.ToleranceLoop(finder, {"x": largest / 200, "y": largest / 200}).run(spark, {"x": 0.0, "y": 0.0}).withColumn("zone", F.lit(largest / 500))


@query("SELECT param, round(-max(p_size) / 500.0, 1) AS lo, round(max(p_size) / 500.0, 1) AS hi, CAST(0 AS DOUBLE) AS center FROM part, (VALUES ('x'), ('y')) t(param) GROUP BY param")
def box_finder_sym(spark, d):
    """The box found in the square zone is that square, to one decimal."""
    return _box(spark, d, "sym").select("param", F.round("lo", 1).alias("lo"), F.round("hi", 1).alias("hi"), "center")


@query("SELECT param, count(*) > 0 AS inside FROM part, (VALUES ('x'), ('y')) t(param) GROUP BY param")
def box_finder_asym(spark, d):
    """A box between the centre and a point lies within the zone."""
    edge = F.col("zone") + 1e-4
    return _box(spark, d, "asym").select("param", ((F.col("lo") >= -edge) & (F.col("hi") <= edge) & (F.col("hi") > F.col("lo"))).alias("inside"))


@query("""SELECT p_partkey AS sample_id, p_brand AS brand, round(20 * log10(sqrt(pow(0.1 + 0.01 * p_size, 2) + pow(0.2, 2))), 6) + 0.0 AS v FROM part""")
def prediction_meta(spark, d):
    """A surrogate's predictions meet the samples' meta data by id."""
    p = table(spark, d, "part")
    surrogate = LinearSurrogate(("size",), ((0, 1e9, 0, 0, {"size": (0.01, 0.0)}, (0.1, 0.2)),))
    surrogate = LinearSurrogate.loads(surrogate.dumps())
    spec = goals.Specification((goals.Criterion(goals.SMag(None, 1, 1), goals.MaxAgg(), goals.LE(0.0), name="v"),))
    values = spec.values(surrogate.transform(p.select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("size"))))
    meta = p.select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("brand"))
    return rounded(values.join(meta, "sample_id"), "v")


@query("SELECT p_partkey AS sample_id, round(0.5 + 2 * p_size - p_retailprice / 100, 5) + 0.0 AS a, round(-1 + 0.25 * p_size, 5) + 0.0 AS b FROM part")
def inverse_surrogate(spark, d):
    """Parameters found again from responses by a fitted inverse."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("y"))
    size, price = F.get("y", F.lit(0)), F.get("y", F.lit(1))
    p = p.withColumn("x", F.array(0.5 + 2 * size - price, -1 + 0.25 * size))
    found = p.withColumn("p", InverseLinear.fit(p).predict("y"))
    return found.select("sample_id", (F.round(F.get("p", F.lit(0)), 5) + 0.0).alias("a"), (F.round(F.get("p", F.lit(1)), 5) + 0.0).alias("b"))


@query(f"""WITH {SQL_RANGES}, z AS (SELECT p_partkey AS point_id, (p_size - s0) / (s1 - s0) AS z, r.* FROM part, r)
SELECT point_id, {sql_at("z", "p")} AS x, ['low', 'mid', 'high'][CAST(round_even(z * 2, 0) AS INT) + 1] AS level FROM z""")
def space_from_text(spark, d):
    """A space of the parts' prices, written as text and read again: every part's place by its size."""
    price, size = (ranges(spark, d).variables[c] for c in ("price", "size"))
    space = design.DesignSpace({"x": price, "level": design.Levels(("low", "mid", "high"), ordered=True)})
    again = design.DesignSpace.from_json(space.to_json())
    z = size.to_unit(F.col("p_size").cast("double"))
    return rounded(again.denormalize(table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.array(z, z).alias("u"))), "x")


@query(f"""WITH {S2}, v AS (SELECT sample_id, stddev_pop({SQL_DB}) AS sd, max({SQL_DB}) AS top FROM s WHERE i = 1 AND j = 0 GROUP BY sample_id)
SELECT sample_id, round(sd, 6) + 0.0 AS sd, top BETWEEN -30 AND -12 AS ok FROM v""")
def window_criterion(spark, d):
    """The extensions: deviation over the band, and a window of allowed values."""
    spec = goals.Specification((
        goals.Criterion(goals.SMag(None, 2, 1), goals.StdAgg(), goals.LE(100.0), name="sd"), goals.Criterion(goals.SMag(None, 2, 1), goals.MaxAgg(), goals.Window(-30.0, -12.0), name="top"),
    ))
    return rounded(spec.values(points(spark, d)).select("sample_id", "sd", spec.all_ok().alias("ok")), "sd")
