"""One query for each operator over the driver's tables, with the SQL that states its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.functions import complexcols, params
from sweeplane.operators import analyze, dataset, design, goals, network, scale, search, transform
from sweeplane.operators.codec import Backup, Codec
from sweeplane.plans import designs, growth, keeping, stores  # noqa: F401  (they register their queries)
from sweeplane.plans.catalog import QUERIES, SQL, query
from sweeplane.plans.views import SQL_DB, SQL_PARTS, SQL_RANGES, packed, parts, points, r6, ranges, rounded, sql_at, sql_points, table
from sweeplane.streaming.running_yield import packed_verdicts

S2, S4 = sql_points(2), sql_points(4)
KEY = ("sample_id", "k", "i", "j")
SPEC = goals.Specification((
    goals.Criterion(goals.SMag((1.5, 3.5), 1, 1), goals.MaxAgg(), goals.LE(-12.0), 2.0),
    goals.Criterion(goals.SMag((1.0, 3.0), 2, 1), goals.MinAgg(), goals.GE(-45.0)),
    goals.Criterion(goals.SMag(None, 2, 1), goals.MeanAgg(), goals.SoftLE(-20.0, 5.0, 2), 0.5, "S21_mean"),
    goals.Criterion(goals.SMag((2.0, 4.5), 1, 2), goals.RippleAgg(), goals.LE(30.0), 1.0, "S12_ripple"),
))
WORST = goals.Specification((goals.Criterion(goals.SMag((1.5, 3.5), 1, 1), goals.MaxAgg(), goals.LE(-12.0)),))


def _sql_in(m: int, n: int, lo: float | None = None, hi: float | None = None) -> str:
    band = f" AND f_hz / 1e9 BETWEEN {lo} AND {hi}" if lo is not None else ""
    return f"i = {m - 1} AND j = {n - 1}{band}"


# -- flagship -----------------------------------------------------------------------------------------------------


@query(f"""WITH {S2}, v AS (SELECT sample_id, label, max({SQL_DB}) AS v FROM s WHERE {_sql_in(1, 1, 1.5, 3.5)} GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN v <= -12 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS "yield", round(max(v), 6) + 0.0 AS v_max FROM v GROUP BY label""")
def flagship_yield_by_family(spark, d):
    """Share of devices of each family whose worst in-band |S11| meets the limit; the band is cut within the row."""
    p = points(spark, d).where("i = 0 AND j = 0")
    v = WORST.values(p, ("label",)).withColumn("ok", WORST.all_ok())
    out = v.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("yield"), F.max("S11_dB").alias("v_max"))
    return rounded(out, "yield", "v_max")


@query(f"""WITH {S2}, v AS (SELECT sample_id, label, max({SQL_DB}) AS v FROM s WHERE {_sql_in(1, 1, 1.5, 3.5)} GROUP BY ALL)
SELECT sample_id, v <= -12 AS ok FROM v""")
def packed_verdict(spark, d):
    """The same verdict within packed rows, as streams take it."""
    return packed_verdicts(packed(spark, d), WORST).select("sample_id", "ok")


# -- scalar measures ----------------------------------------------------------------------------------------------


def _scalar(name: str, column, sql: str) -> None:
    f = lambda spark, d: points(spark, d).select(*KEY, r6(column(F.col("re"), F.col("im")), "v"))
    query(f"WITH {S2} SELECT sample_id, k, i, j, round({sql}, 6) + 0.0 AS v FROM s", name)(f)


_scalar("s_mag", complexcols.mag, "sqrt(re*re + im*im)")
_scalar("s_db", complexcols.db, SQL_DB)
_scalar("s_db_eps", lambda a, b: complexcols.db(a, b, 1e-12), "20 * log10(sqrt(re*re + im*im) + 1e-12)")
_scalar("s_deg", complexcols.deg, "degrees(atan2(im, re))")


@query(f"WITH {S2} SELECT sample_id, k, i, j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM s")
def s_real_imag(spark, d):
    return rounded(network.to_points(packed(spark, d)).select(*KEY, "re", "im"), "re", "im")


@query(f"""WITH {S2}, p AS (SELECT *, degrees(atan2(im, re)) AS p FROM s),
q AS (SELECT *, p - lag(p) OVER (PARTITION BY sample_id, i, j ORDER BY k) AS dp FROM p),
c AS (SELECT *, CASE WHEN dp IS NULL OR abs(dp) < 180 THEN 0.0 ELSE dp - 360 * floor((dp + 180) / 360) - dp END AS c FROM q)
SELECT sample_id, k, i, j, round(p + sum(c) OVER (PARTITION BY sample_id, i, j ORDER BY k ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS deg FROM c""")
def s_deg_unwrapped(spark, d):
    return rounded(transform.unwrapped_deg(points(spark, d)).select(*KEY, "deg"), "deg")


@query(SQL["s_deg_unwrapped"])
def s_deg_packed(spark, d):
    """The same within packed rows, without a shuffle."""
    out = network.to_points(transform.unwrapped_packed(packed(spark, d)), also=("s_deg",))
    return out.select(*KEY, r6("s_deg", "deg"))


@query(f"""WITH {S4}, w AS (SELECT a.sample_id, a.k, a.re AS cr, a.im AS ci, b.re AS dr, b.im AS di FROM s a JOIN s b USING (sample_id, k) WHERE a.i = 2 AND a.j = 0 AND b.i = 3 AND b.j = 0)
SELECT sample_id, k, round(abs(tan(asin(greatest(least(2 * (dr*ci - di*cr) / (cr*cr + ci*ci + dr*dr + di*di), 1.0), -1.0)) / 2)), 6) + 0.0 AS ar FROM w""")
def axial_ratio(spark, d):
    return rounded(goals.with_axial_ratio(points(spark, d, 4)).where("i = 2 AND j = 0").select("sample_id", "k", "ar"), "ar")


# -- filters and joins --------------------------------------------------------------------------------------------

_POINT = "round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im"


def _points_query(name: str, f, sql: str, extra: tuple[str, ...] = ()) -> None:
    run = lambda spark, d: rounded(f(points(spark, d)).select(*KEY, *extra, "re", "im"), *extra, "re", "im")
    query(sql, name)(run)


_points_query("crop_nearest", lambda p: network.crop(p, 1.4, 3.2, "GHz"), f"""WITH {S2}, e AS (SELECT sample_id, arg_min(f_hz, abs(f_hz - 1.4e9)) AS lo, arg_min(f_hz, abs(f_hz - 3.2e9)) AS hi FROM s GROUP BY sample_id)
SELECT sample_id, k, i, j, {_POINT} FROM s JOIN e USING (sample_id) WHERE f_hz BETWEEN lo AND hi""")
_points_query("band_mask", lambda p: network.band_mask(p, (1.4, 3.2)), f"WITH {S2} SELECT sample_id, k, i, j, {_POINT} FROM s WHERE f_hz / 1e9 BETWEEN 1.4 AND 3.2")
_points_query("port_select", lambda p: network.port(p, 2, 1), f"WITH {S2} SELECT sample_id, k, i, j, {_POINT} FROM s WHERE i = 1 AND j = 0")
_points_query("row_limit", lambda p: dataset.first_samples(p, 100), f"WITH {S2} SELECT sample_id, k, i, j, {_POINT} FROM s WHERE sample_id < 100")


@query("""WITH g AS (SELECT label, sample_id, k, f FROM (SELECT label, vec_id AS sample_id, k, 1e9 + k * 5e8 + CASE WHEN vec_id % 50 = 7 AND k = 3 THEN 10 ELSE 0 END AS f FROM embeddings, range(8) t(k)))
SELECT sample_id, count(*) AS n_bad FROM g WHERE abs(f - (1e9 + k * 5e8)) > 1e-3 GROUP BY sample_id""")
def grid_consistency(spark, d):
    """Samples whose grid was moved are found against the first sample's."""
    p = points(spark, d).where("i = 0 AND j = 0")
    moved = F.when((F.col("sample_id") % 50 == 7) & (F.col("k") == 3), F.col("f_hz") + 10).otherwise(F.col("f_hz"))
    return network.check_grid(p.withColumn("f_hz", moved)).select("sample_id", F.col("n_bad").cast("long").alias("n_bad"))


@query("SELECT vec_id AS sample_id, CASE WHEN vec_id % 3 = 0 THEN 1e9 ELSE 2e9 + label * 1e6 END AS f0 FROM embeddings WHERE label IS NOT NULL")
def shared_grid_join(spark, d):
    """A sample's own grid where it has one, else its family's."""
    n = packed(spark, d).where("label IS NOT NULL").withColumn("grid_id", F.col("label"))
    n = n.withColumn("f_hz", F.when(F.col("sample_id") % 3 == 0, F.col("f_hz")))
    grids = n.select("grid_id").distinct().withColumn("f_hz", F.array(2e9 + F.col("grid_id") * 1e6))
    return network.with_shared_grid(n, grids).select("sample_id", F.get("f_hz", F.lit(0)).alias("f0"))


# -- transforms ---------------------------------------------------------------------------------------------------


def _rotated(angle: str, gain: str = "1") -> str:
    return f"round({gain} * (re * cos({angle}) - im * sin({angle})), 6) + 0.0 AS re, round({gain} * (re * sin({angle}) + im * cos({angle})), 6) + 0.0 AS im"


_ROW = "SELECT sample_id, k, i, j, "
_points_query("phase_delay", lambda p: transform.phase_delay(p, 35.0), f"WITH {S2} {_ROW}{_rotated('(-2 * pi() * f_hz * 35e-12)')} FROM s")
_points_query("phase_angle", lambda p: transform.phase_angle(p, 30.0), f"WITH {S2} {_ROW}{_rotated('radians(30)')} FROM s")
_gain = "pow(10, 0.8 * (f_hz - 1e9) / 1e9 / 20)"
_points_query("mag_slope", lambda p: transform.mag_slope(p, 0.8), f"WITH {S2} {_ROW}round(re * {_gain}, 6) + 0.0 AS re, round(im * {_gain}, 6) + 0.0 AS im FROM s")
_gain = "(1 + (pow(10, 0.5 / 20) - 1) * sin(2 * pi() * f_hz / 7e8 + 0.3))"
_points_query("ripple_fixed", lambda p: transform.ripple(p, 0.5, 7e8, phase=0.3), f"WITH {S2} {_ROW}round(re * {_gain}, 6) + 0.0 AS re, round(im * {_gain}, 6) + 0.0 AS im FROM s")
_points_query(
    "composed_transforms", network.compose(lambda p: network.band_mask(p, (1.5, 4.0)), lambda p: transform.phase_angle(p, 30.0), lambda p: network.port(p, 1, 2)),
    f"WITH {S2} {_ROW}{_rotated('radians(30)')} FROM s WHERE f_hz / 1e9 BETWEEN 1.5 AND 4.0 AND i = 0 AND j = 1",
)
@query(f"""WITH {S2}, t AS (SELECT sample_id, kk, kk * 7 / 12.0 AS x FROM (SELECT DISTINCT sample_id FROM s), range(13) t(kk)),
b AS (SELECT sample_id, kk, least(CAST(floor(x) AS BIGINT), 6) AS k0, x - least(floor(x), 6) AS w FROM t)
SELECT b.sample_id, kk AS k, a.i, a.j, round(1e9 + kk * 3.5e9 / 12, 3) + 0.0 AS f_hz, round(a.re + w * (c.re - a.re), 6) + 0.0 AS re, round(a.im + w * (c.im - a.im), 6) + 0.0 AS im
FROM b JOIN s a ON a.sample_id = b.sample_id AND a.k = k0 JOIN s c ON c.sample_id = b.sample_id AND c.k = k0 + 1 AND c.i = a.i AND c.j = a.j""")
def resample_uniform(spark, d):
    out = network.to_points(transform.resample_packed(packed(spark, d), 13)).withColumn("f_hz", F.round("f_hz", 3) + 0.0)
    return rounded(out.select(*KEY, "f_hz", "re", "im"), "re", "im")


@query(f"""WITH {S2}, g AS (SELECT * FROM (VALUES (0, 1.1e9), (1, 2.0e9), (2, 3.3e9)) t(kk, ft))
SELECT a.sample_id, CAST(kk AS BIGINT) AS k, a.i, a.j, round(a.re + (ft - a.f_hz) / 5e8 * (c.re - a.re), 6) + 0.0 AS re, round(a.im + (ft - a.f_hz) / 5e8 * (c.im - a.im), 6) + 0.0 AS im
FROM g JOIN s a ON ft >= a.f_hz AND ft < a.f_hz + 5e8 JOIN s c ON c.sample_id = a.sample_id AND c.k = a.k + 1 AND c.i = a.i AND c.j = a.j""")
def resample_grid(spark, d):
    """A grid of its own; the sweeps stay within their rows."""
    out = network.to_points(transform.resample_packed(packed(spark, d), [1.1, 2.0, 3.3], "GHz"))
    return rounded(out.select(*KEY, "re", "im"), "re", "im")


_Z = "(10.0 / 110)"
@query(f"""WITH {S2}, w AS (SELECT sample_id, k, max(re) FILTER (i=0 AND j=0) ar, max(im) FILTER (i=0 AND j=0) ai, max(re) FILTER (i=0 AND j=1) br, max(im) FILTER (i=0 AND j=1) bi,
 max(re) FILTER (i=1 AND j=0) cr, max(im) FILTER (i=1 AND j=0) ci, max(re) FILTER (i=1 AND j=1) dr, max(im) FILTER (i=1 AND j=1) di FROM s GROUP BY ALL),
x AS (SELECT *, (ar*dr - ai*di) - (br*cr - bi*ci) AS xr, (ar*di + ai*dr) - (br*ci + bi*cr) AS xi FROM w),
y AS (SELECT *, 1 - {_Z}*(ar+dr) + {_Z}*{_Z}*xr AS ur, -{_Z}*(ai+di) + {_Z}*{_Z}*xi AS ui FROM x),
e AS (SELECT sample_id, k, ur, ui, u.* FROM y, LATERAL (VALUES
 (0, 0, ar - {_Z}*(1+xr) + {_Z}*{_Z}*dr, ai - {_Z}*xi + {_Z}*{_Z}*di), (0, 1, br*(1-{_Z}*{_Z}), bi*(1-{_Z}*{_Z})),
 (1, 0, cr*(1-{_Z}*{_Z}), ci*(1-{_Z}*{_Z})), (1, 1, dr - {_Z}*(1+xr) + {_Z}*{_Z}*ar, di - {_Z}*xi + {_Z}*{_Z}*ai)) u(i, j, nr, ni))
SELECT sample_id, k, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round((nr*ur + ni*ui)/(ur*ur + ui*ui), 6) + 0.0 AS re, round((ni*ur - nr*ui)/(ur*ur + ui*ui), 6) + 0.0 AS im FROM e""")
def z0_shift_2port(spark, d):
    return rounded(transform.z0_shift(points(spark, d), 10.0).select(*KEY, "re", "im"), "re", "im")


@query(SQL["z0_shift_2port"])
def renormalize_packed(spark, d):
    return rounded(network.to_points(transform.renormalize(packed(spark, d).drop("label"), 10.0)).select(*KEY, "re", "im"), "re", "im")


@query()
def augment_noise(spark, d):
    """Random by key: no SQL; tested by its properties."""
    noisy = transform.add_noise(points(spark, d), 0.1, 2.0, seed=3)
    return transform.dereciprocal(noisy, 0.2, seed=4).select(*KEY, "re", "im")


# -- aggregators and specifications -------------------------------------------------------------------------------

for _name, _agg, _fn in (("max", goals.MaxAgg(), "max(v)"), ("min", goals.MinAgg(), "min(v)"), ("mean", goals.MeanAgg(), "avg(v)"), ("ripple", goals.RippleAgg(), "max(v) - min(v)"), ("std", goals.StdAgg(), "stddev_pop(v)")):
    _one = goals.Specification((goals.Criterion(goals.SMag((1.2, 4.2), 2, 1), _agg, goals.LE(0.0), name="v"),))
    query(f"WITH {S2}, v AS (SELECT sample_id, {SQL_DB} AS v FROM s WHERE {_sql_in(2, 1, 1.2, 4.2)}) SELECT sample_id, round({_fn}, 6) + 0.0 AS v FROM v GROUP BY sample_id", f"agg_{_name}")(
        lambda spark, d, one=_one: rounded(one.values(points(spark, d)), "v")
    )

_VALUES = f"""{S2}, d AS (SELECT sample_id, f_hz, i, j, {SQL_DB} AS v FROM s), w AS (SELECT sample_id, max(v) FILTER ({_sql_in(1, 1, 1.5, 3.5)}) AS a, min(v) FILTER ({_sql_in(2, 1, 1.0, 3.0)}) AS b,
 avg(v) FILTER ({_sql_in(2, 1)}) AS c, max(v) FILTER ({_sql_in(1, 2, 2.0, 4.5)}) - min(v) FILTER ({_sql_in(1, 2, 2.0, 4.5)}) AS e FROM d GROUP BY sample_id),
q AS (SELECT *, a <= -12 AS ka, b >= -45 AS kb, c <= -20 AS kc, e <= 30 AS ke, CASE WHEN a <= -12 THEN 0.0 ELSE 1.0 END AS pa, CASE WHEN b >= -45 THEN 0.0 ELSE 1.0 END AS pb,
 CASE WHEN c <= -20 THEN 0.0 ELSE pow((c + 20) / 5, 2) END AS pc, CASE WHEN e <= 30 THEN 0.0 ELSE 1.0 END AS pe FROM w)"""


@query(f'WITH {_VALUES} SELECT sample_id, round(a, 6) + 0.0 AS "S11_dB", round(b, 6) + 0.0 AS "S21_dB", round(c, 6) + 0.0 AS "S21_mean", round(e, 6) + 0.0 AS "S12_ripple" FROM q')
def spec_values(spark, d):
    return rounded(SPEC.values(points(spark, d)), *(c.label for c in SPEC.criteria))


@query(f"WITH {_VALUES} SELECT sample_id, ka AND kb AND kc AND ke AS ok FROM q")
def spec_is_ok(spark, d):
    return SPEC.is_ok(points(spark, d))


for _name, _fn in (("sum", "2*pa + pb + 0.5*pc + pe"), ("mean", "(2*pa + pb + 0.5*pc + pe) / 4"), ("max", "greatest(2*pa, pb, 0.5*pc, pe)")):
    query(f"WITH {_VALUES} SELECT sample_id, round({_fn}, 6) + 0.0 AS penalty FROM q", f"spec_penalty_{_name}")(
        lambda spark, d, how=_name: rounded(SPEC.penalty(points(spark, d), how), "penalty")
    )


@query(f"""WITH {_VALUES} SELECT sample_id, u.criterion, round(u.v, 6) + 0.0 AS value, u.ok, round(u.p, 6) + 0.0 AS penalty, u.w AS weight, ka AND kb AND kc AND ke AS all_ok, round(pa + pb + pc + pe, 6) + 0.0 AS total_penalty
FROM q, LATERAL (VALUES ('S11_dB', a, ka, pa, 2.0), ('S21_dB', b, kb, pb, 1.0), ('S21_mean', c, kc, pc, 0.5), ('S12_ripple', e, ke, pe, 1.0)) u(criterion, v, ok, p, w)""")
def spec_report(spark, d):
    return rounded(SPEC.report(points(spark, d)), "value", "penalty", "total_penalty")


# -- statistics ---------------------------------------------------------------------------------------------------

_STATS = "round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max"
_FOUR = ("mean", "std", "min", "max")
for _name, _v in (("db", SQL_DB), ("mag", "sqrt(re*re + im*im)")):
    query(f"WITH {S2}, v AS (SELECT k, i, j, {_v} AS v FROM s) SELECT k, i, j, {_STATS} FROM v GROUP BY ALL", f"summarize_s_{_name}")(
        lambda spark, d, kind=_name: rounded(analyze.summarize_s(points(spark, d), kind), *_FOUR)
    )


@query(SQL["s_deg_unwrapped"].replace("SELECT sample_id, k, i, j, round(p + sum(c)", "SELECT k, i, j, " + _STATS + " FROM (SELECT k, i, j, (p + sum(c)").replace(", 6) + 0.0 AS deg FROM c", ") AS v FROM c) GROUP BY ALL"))
def summarize_s_deg(spark, d):
    return rounded(analyze.summarize_phase(packed(spark, d)), *_FOUR)


@query(SQL["summarize_s_deg"])
def summarize_s_deg_points(spark, d):
    """The same of points, whose sweeps meet in a window."""
    return rounded(analyze.summarize_s(points(spark, d), "deg"), *_FOUR)


@query(f"""WITH {S2}, v AS (SELECT i, j, 'real' AS part, re AS v FROM s UNION ALL SELECT i, j, 'imag', im FROM s)
SELECT 'S' || (i + 1) || (j + 1) || '.' || part AS component, {_STATS}, CAST(0 AS BIGINT) AS nan_count, stddev_pop(v) < 1e-12 AS is_constant FROM v GROUP BY i, j, part""")
def s_components(spark, d):
    return rounded(analyze.summarize_components(points(spark, d)), *_FOUR)


@query(f"""WITH {S2}, v AS (SELECT k, i, j, avg({SQL_DB}) AS mean, stddev_pop({SQL_DB}) AS std FROM s GROUP BY ALL)
SELECT i, j, round(sum(mean * (k + 1)), 5) + 0.0 AS mean_dot, round(sum(std * (k + 1)), 5) + 0.0 AS std_dot FROM v GROUP BY i, j""")
def s_norm_stats(spark, d):
    """The arrays along the sweep, each taken with 1, 2, .. so that one number tells their order."""
    dot = lambda c: F.round(F.aggregate(F.transform(c, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 5) + 0.0
    return analyze.norm_stats(points(spark, d)).select("i", "j", dot("mean").alias("mean_dot"), dot("std").alias("std_dot"))


@query(f"WITH {SQL_PARTS} SELECT sample_id, key, val FROM p")
def params_long(spark, d):
    return analyze.params_long(parts(spark, d))


@query(f"""WITH {SQL_PARTS} SELECT key, round(avg(val), 6) + 0.0 AS mean, round(stddev_samp(val), 6) + 0.0 AS std, min(val) AS min, max(val) AS max,
 (SELECT count(*) FROM part) - count(val) AS nan_count, count(DISTINCT val) <= 1 AS is_constant FROM p GROUP BY key""")
def summarize_params(spark, d):
    return rounded(analyze.summarize_params(parts(spark, d)), "mean", "std")


@query(f"WITH {SQL_PARTS} SELECT key, count(DISTINCT val) AS n_distinct FROM p GROUP BY key HAVING count(DISTINCT val) > 1")
def varying_keys(spark, d):
    return analyze.varying_keys(parts(spark, d))


@query("""WITH s AS (SELECT min(p_retailprice) AS lo0, (max(p_retailprice) - min(p_retailprice)) / 30 AS w FROM part)
SELECT least(CAST(floor((p_retailprice - lo0) / w) AS BIGINT), 29) AS bin, count(*) AS n FROM part, s GROUP BY 1""")
def param_hist(spark, d):
    return analyze.histogram(parts(spark, d), "price").select("bin", "n")


@query("""SELECT p_partkey AS sample_id, CAST(p_size AS DOUBLE) + 0.5 AS w, CAST(p_partkey AS DOUBLE) AS gap, p_brand AS mat FROM part""")
def param_parse(spark, d):
    """Parameters out of comment lines: decimal commas, blanks, junk items, repeated keys, text values."""
    p = table(spark, d, "part")
    line = F.concat(F.lit(" parameters = { w = "), F.col("p_size").cast("string"), F.lit(",5 ; gap=1; junk; =3; mat="), "p_brand", F.lit("; gap = "), F.col("p_partkey").cast("string"), F.lit("}"))
    raw = params.raw_params(F.array(F.lit("made by hand"), line))
    both = p.select(F.col("p_partkey").alias("sample_id"), params.numeric_params(raw).alias("n"), params.text_params(raw).alias("t"))
    return both.select("sample_id", params.param("n", "w").alias("w"), params.param("n", "gap").alias("gap"), F.try_element_at("t", F.lit("mat")).alias("mat"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def props_param(spark, d):
    """Parameters from JSON text."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query(f"WITH {SQL_PARTS} SELECT sample_id, count(*) AS n FROM p WHERE key IN ('q', 'size') GROUP BY sample_id")
def select_keys(spark, d):
    return parts(spark, d).select("sample_id", F.size(params.select_keys("params", ["q", "size"])).cast("long").alias("n"))


@query("SELECT p_partkey AS sample_id, CAST(p_size AS DOUBLE) AS size, p_partkey % 7 = 0 AS q_missing FROM part")
def nan_fill_projection(spark, d):
    x = dataset.project_params(parts(spark, d), ["q", "size"])
    return x.select("sample_id", F.get("x", F.lit(1)).alias("size"), F.isnan(F.get("x", F.lit(0))).alias("q_missing"))


@query("SELECT p_partkey AS sample_id, CAST(p_size AS DOUBLE) AS y, p_retailprice AS x FROM part")
def swap_xy(spark, d):
    rows = parts(spark, d).select("sample_id", params.param("params", "size").alias("x"), params.param("params", "price").alias("y"))
    return dataset.swap_xy(rows)


# -- codec --------------------------------------------------------------------------------------------------------

CODEC = Codec(("price", "q", "size"), ("S1_1.real", "S1_1.imag", "S2_1.db", "S2_1.deg", "S1_2.mag"), tuple(1e9 + k * 5e8 for k in range(8)), backup=Backup.MISSING)


@query("SELECT p_partkey AS sample_id, round(p_retailprice, 6) + 0.0 AS x0, CASE WHEN p_partkey % 7 = 0 THEN -1.0 ELSE CAST(p_partkey % 5 AS DOUBLE) END AS x1, CAST(p_size AS DOUBLE) AS x2 FROM part")
def encode_x(spark, d):
    x = CODEC.encode_x(parts(spark, d))
    at = lambda n: F.get("x", F.lit(n))
    return x.select("sample_id", r6(at(0), "x0"), F.when(F.isnan(at(1)), -1.0).otherwise(at(1)).alias("x1"), at(2).alias("x2"))


@query(f"""WITH {S2} SELECT sample_id, 0 AS c, k, round(re, 6) + 0.0 AS y FROM s WHERE i = 0 AND j = 0 UNION ALL SELECT sample_id, 1, k, round(im, 6) + 0.0 FROM s WHERE i = 0 AND j = 0
UNION ALL SELECT sample_id, 2, k, round(20 * log10(sqrt(re*re + im*im) + 1e-12), 6) + 0.0 FROM s WHERE i = 1 AND j = 0
UNION ALL SELECT sample_id, 3, k, deg FROM ({SQL["s_deg_unwrapped"]}) WHERE i = 1 AND j = 0 UNION ALL SELECT sample_id, 4, k, round(sqrt(re*re + im*im), 6) + 0.0 FROM s WHERE i = 0 AND j = 1""")
def encode_s_long(spark, d):
    return rounded(CODEC.encode_long(points(spark, d)), "y")


@query(f"""WITH {S2} SELECT sample_id, k, i, j, {_POINT} FROM s WHERE (i = 0 AND j = 0) OR (i = 1 AND j = 0) UNION ALL
SELECT sample_id, k, i, j, round(sqrt(re*re + im*im), 6) + 0.0, 0.0 FROM s WHERE i = 0 AND j = 1""")
def decode_roundtrip(spark, d):
    """Encoded and decoded: re and im, amplitude with phase, and an amplitude alone (whose phase is lost)."""
    return rounded(CODEC.decode_s(CODEC.encode_s(points(spark, d))).select(*KEY, "re", "im"), "re", "im")


@query(f"WITH {S2} SELECT sample_id, k, i, j, {_POINT} FROM s WHERE i = 1 AND j = 1")
def backup_missing(spark, d):
    return rounded(CODEC.backup_points(points(spark, d)).select(*KEY, "re", "im"), "re", "im")


@query(f"""WITH {S2} SELECT c, i, j, part, count(*) AS n FROM (VALUES (0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'real'), (1, 0, 0, 'imag'), (2, 1, 0, 'db'), (3, 1, 0, 'deg'), (4, 0, 1, 'mag')) t(c, i, j, part)
JOIN s USING (i, j) GROUP BY ALL""")
def channels(spark, d):
    """The channels of a codec, with how many elements of all networks each takes."""
    table_of = CODEC.channel_table(spark)
    return table_of.join(points(spark, d).groupBy("i", "j").agg(F.count("*").alias("n")), ["i", "j"]).select(*table_of.columns, "n")


@query("SELECT DISTINCT unnest(['fc', 'price', 'q', 'size']) AS key")
def codec_schema(spark, d):
    """The sorted union of keys that schema inference finds."""
    wide = parts(spark, d).withColumns({"n_ports": F.lit(2), "f_hz": F.array(F.lit(1e9))})
    return spark.createDataFrame([(k,) for k in Codec.infer(wide).x_keys], "key string")


# -- scalers ------------------------------------------------------------------------------------------------------


@query(f"""WITH {S2}, m AS (SELECT k, i, j, avg(re) AS m, greatest(stddev_pop(re), 1e-12) AS sd FROM s GROUP BY ALL)
SELECT sample_id, k, i, j, round((re - m) / sd, 6) + 0.0 AS z FROM s JOIN m USING (k, i, j)""")
def std_scaler(spark, d):
    s = scale.StdScaler(("k", "i", "j"))
    p = points(spark, d).withColumn("z", F.col("re")).select(*KEY, "z")
    return rounded(s.forward(p, s.fit(p, "z"), "z"), "z")


@query(f"""WITH {S2}, m AS (SELECT i, j, min(re) AS lo, greatest(max(re) - min(re), 1e-12) AS w FROM s GROUP BY ALL)
SELECT sample_id, k, i, j, round((re - lo) / w * 2 - 1, 6) + 0.0 AS z FROM s JOIN m USING (i, j)""")
def minmax_scaler(spark, d):
    s = scale.MinMaxScaler(("i", "j"), -1.0, 1.0)
    p = points(spark, d).withColumn("z", F.col("re")).select(*KEY, "z")
    return rounded(s.forward(p, s.fit(p, "z"), "z"), "z")


@query("SELECT l_orderkey, l_partkey, round(l_quantity, 6) + 0.0 AS v FROM lineitem")
def scaler_inverse(spark, d):
    """Scaled and scaled back, over one set of statistics."""
    s, m = scale.StdScaler(), scale.MinMaxScaler()
    v = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("v"))
    a, b = s.fit(v, "v"), m.fit(v, "v")
    return rounded(m.inverse(m.forward(s.inverse(s.forward(v, a, "v"), a, "v"), b, "v"), b, "v"), "v")


@query("""WITH a AS (SELECT l_linenumber, l_returnflag, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(stddev_pop(s), 4) + 0.0 AS std FROM a GROUP BY l_returnflag""")
def sequential_std(spark, d):
    """The deviation of deviations that reducing one dimension after the other gives."""
    rows = scale._reduced(table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_suppkey", "l_extendedprice"), "l_extendedprice", ["l_returnflag", "l_linenumber"], ["l_suppkey"], F.stddev_pop, F.stddev_pop)
    return rows.groupBy("l_returnflag").agg((F.round(F.stddev_pop("l_extendedprice"), 4) + 0.0).alias("std"))


# -- splits -------------------------------------------------------------------------------------------------------

_SPLIT = """r AS (SELECT vec_id AS sample_id, row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings),
x AS (SELECT sample_id, r, CASE WHEN r < floor(n * 0.2) THEN 'val' WHEN r < floor(n * 0.2) + floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query(f"WITH {_SPLIT} SELECT sample_id, split FROM x")
def split_members(spark, d):
    return dataset.split(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), 0.2, 0.1, 7)


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n FROM x GROUP BY split")
def split_counts(spark, d):
    return split_members(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {_SPLIT} SELECT sample_id, CAST(r // 32 AS BIGINT) AS batch FROM x")
def batches(spark, d):
    return dataset.batches(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), 32, 7)


@query("SELECT vec_id AS sample_id FROM embeddings ORDER BY md5('5:' || vec_id), vec_id LIMIT 40")
def random_sample(spark, d):
    return dataset.sample_rows(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), 40, 5)


# -- design spaces ------------------------------------------------------------------------------------------------

SPACE = design.DesignSpace({
    "size": design.Continuous(0.0, 60.0), "qty": design.Integer(2, 50, 4), "mat": design.Levels(("Cu", "Ag", "Au")),
})


@query(f"""WITH {SQL_RANGES} SELECT CAST(n AS BIGINT) AS point_id, {sql_at("(n >> 3) & 1", "s")} AS size, {sql_at("(n >> 2) & 1", "p")} AS price, {sql_at("(n >> 1) & 1", "q")} AS qty,
{sql_at("n & 1", "d")} AS disc FROM range(16) t(n), r""")
def factorial_full(spark, d):
    """The corners of the space that parts and line items span."""
    space = ranges(spark, d)
    return rounded(space.denormalize(design.factorial_full(spark, 0, 4)), *space.variables)


def _inverse(base: int, digits: int) -> str:
    """The radical inverse of n in SQL, beside a range of digits b."""
    return f"sum(CASE WHEN b < {digits} THEN ((n // CAST(pow({base}, b) AS BIGINT)) % {base}) / pow({base}, b + 1) ELSE 0 END)"


_NUMBERED = "h AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)"


@query(f"WITH {_NUMBERED} SELECT CAST(n AS BIGINT) AS point_id, round({_inverse(2, 40)}, 6) + 0.0 AS h2, round({_inverse(3, 30)}, 6) + 0.0 AS h3 FROM h, range(40) t(b) GROUP BY n")
def halton(spark, d):
    """A point for each part."""
    u = design.halton(spark, table(spark, d, "part").count(), 2)
    return u.select("point_id", r6(F.get("u", F.lit(0)), "h2"), r6(F.get("u", F.lit(1)), "h3"))


def _stock(spark, d) -> tuple[design.DesignSpace, int]:
    """A space of the parts' sizes with steps and levels, and the number of parts."""
    return design.DesignSpace({**SPACE.variables, "size": ranges(spark, d).variables["size"]}), table(spark, d, "part").count()


@query()
def sobol(spark, d):
    """A point for each part; a digital net, tested by its stratification."""
    space, n = _stock(spark, d)
    return space.sample(spark, n, "sobol", seed=2)


@query()
def latin_hypercube(spark, d):
    """A point for each part."""
    space, n = _stock(spark, d)
    return space.sample(spark, n, "lhs", seed=2)


@query("SELECT p_partkey AS point_id, round(p_size / 60.0, 6) + 0.0 AS u_size, round((p_partkey % 49) / 48.0, 6) + 0.0 AS u_qty, (p_partkey % 3) / 2.0 AS u_mat FROM part")
def normalize(spark, d):
    mat = F.get(F.array(F.lit("Cu"), F.lit("Ag"), F.lit("Au")), (F.col("p_partkey") % 3).cast("int"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").alias("size"), (F.col("p_partkey") % 49 + 2).alias("qty"), mat.alias("mat"))
    return SPACE.normalize(p).select("point_id", *(r6(F.get("u", F.lit(n)), f"u_{v}") for n, v in enumerate(SPACE.variables)))


@query("""WITH u AS (SELECT p_partkey AS point_id, (p_partkey % 101) / 101.0 AS z FROM part)
SELECT point_id, round(z * 60, 6) + 0.0 AS size, CAST(least(greatest(round_even((2 + z * 48 - 2) / 4, 0) * 4 + 2, 2), 50) AS BIGINT) AS qty, (['Cu', 'Ag', 'Au'])[CAST(round_even(z * 2, 0) AS INT) + 1] AS mat FROM u""")
def denormalize(spark, d):
    z = (F.col("p_partkey") % 101) / 101.0
    return rounded(SPACE.denormalize(table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.array(z, z, z).alias("u"))), "size")


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) + 0.0 AS total FROM lineitem WHERE l_discount + l_tax <= 0.08 AND l_quantity >= 5")
def constraint_filter(spark, d):
    space = design.DesignSpace({"l_discount": design.Continuous(0, 1)})
    space.add_constraint(F.round(F.col("l_discount") + F.col("l_tax"), 9) <= 0.08)
    space.add_constraint(F.col("l_quantity") >= 5)
    return space.valid(table(spark, d, "lineitem")).agg(F.count("*").alias("n"), (F.round(F.sum("l_extendedprice"), 2) + 0.0).alias("total"))


SQL["constraint_filter"] = SQL["constraint_filter"].replace("l_discount + l_tax", "round(l_discount + l_tax, 9)")


# -- metrics ------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1 FROM c""")
def binary_metrics(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("p"), (F.col("toxic") == 1).alias("t"))
    return rounded(goals.binary_metrics(rows, "p", "t"), "accuracy", "recall", "precision", "f1")


@query(f"""WITH {S2}, e AS (SELECT i, j, sum((re - im) * (re - im)) AS sse, sum(abs(re - im)) AS sae, count(*) AS n, var_pop(im) * count(*) AS sst FROM s GROUP BY i, j)
SELECT round(sum(sse) / sum(n), 6) + 0.0 AS mse, round(sum(sae) / sum(n), 6) + 0.0 AS mae, round(avg(1 - sse / sst), 6) + 0.0 AS r2 FROM e""")
def regression_metrics(spark, d):
    p = points(spark, d).withColumn("output", F.col("i") * 2 + F.col("j"))
    return rounded(goals.regression_metrics(p, "re", "im", "output"), "mse", "mae", "r2")


@query(f"""WITH {S2}, a AS (SELECT sample_id, max({SQL_DB}) <= -12 AS t FROM s WHERE {_sql_in(1, 1, 1.5, 3.5)} GROUP BY sample_id),
b AS (SELECT sample_id, max({SQL_DB} + 0.5) <= -12 AS p FROM s WHERE {_sql_in(1, 1, 1.5, 3.5)} GROUP BY sample_id)
SELECT round(avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM a JOIN b USING (sample_id)""")
def spec_pass_accuracy(spark, d):
    """Verdicts on predictions (half a dB off) against those on the truth, met by sample id."""
    p = points(spark, d)
    off = p.withColumns({c: F.col(c) * 10 ** (0.5 / 20) for c in ("re", "im")})
    both = WORST.is_ok(p).withColumnRenamed("ok", "t").join(WORST.is_ok(off).withColumnRenamed("ok", "p"), "sample_id")
    return rounded(goals.binary_metrics(both, "p", "t").select("accuracy"), "accuracy")


# -- yield and boxes ----------------------------------------------------------------------------------------------


def _cloud(spark, d) -> DataFrame:
    """Parts as a two-variable cloud; a point passes near the centre, apart from every eleventh."""
    x = table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), ((F.col("p_partkey") * 37 % 1009) / 1009.0 - 0.5).alias("x"), ((F.col("p_partkey") * 101 % 997) / 997.0 - 0.5).alias("y"))
    return x.withColumn("ok", (F.abs("x") <= 0.2) & (F.abs("y") <= 0.3) & (F.col("point_id") % 11 != 0))


_CLOUD = """c AS (SELECT *, abs(x) <= 0.2 AND abs(y) <= 0.3 AND point_id % 11 <> 0 AS ok FROM (SELECT p_partkey AS point_id, (p_partkey * 37 % 1009) / 1009.0 - 0.5 AS x, (p_partkey * 101 % 997) / 997.0 - 0.5 AS y FROM part))"""
_BOXES = {
    "sym": f"{_CLOUD}, b AS (SELECT point_id AS cid, 0 - abs(x) AS lx, abs(x) AS hx, 0 - abs(y) AS ly, abs(y) AS hy FROM c WHERE ok)",
    "asym": f"{_CLOUD}, b AS (SELECT point_id AS cid, least(x, 0) AS lx, greatest(x, 0) AS hx, least(y, 0) AS ly, greatest(y, 0) AS hy FROM c WHERE ok)",
}
for _mode, _sql in _BOXES.items():
    query(f"WITH {_sql} SELECT cid, round(max((hx - lx) * (hy - ly)), 6) + 0.0 AS volume, count(*) AS inside, count(*) FILTER (c.ok) AS good FROM b JOIN c ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy GROUP BY cid", f"box_candidates_{_mode}")(
        lambda spark, d, mode=_mode: rounded(
            search.score_boxes(search.candidate_boxes((c := _cloud(spark, d)).where("ok"), {"x": 0.0, "y": 0.0}, mode), c, ["x", "y"]).select("cid", "volume", "inside", "good"), "volume"
        )
    )


@query(f"""WITH {_BOXES["sym"]}, s AS (SELECT cid, max((hx - lx) * (hy - ly)) AS volume, count(*) AS inside, count(*) FILTER (c.ok) AS good FROM b JOIN c ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy GROUP BY cid)
SELECT cid, round(volume, 6) + 0.0 AS volume FROM s WHERE good >= 0.9 * inside ORDER BY volume DESC, cid LIMIT 1""")
def box_best(spark, d):
    c = _cloud(spark, d)
    scored = search.score_boxes(search.candidate_boxes(c.where("ok"), {"x": 0.0, "y": 0.0}), c, ["x", "y"])
    return rounded(search.best_box(scored, 0.9).select("cid", "volume"), "volume")


@query(f"""WITH {SQL_RANGES}, {_NUMBERED}, u AS (SELECT n, {_inverse(2, 40)} AS u FROM h, range(40) t(b) GROUP BY n),
v AS (SELECT 20 * log10(sqrt(2 * pow(0.1 + 0.4 * (s0 + u * (s1 - s0)) / 50, 2))) AS v FROM u, r) SELECT count(*) AS n, avg(CASE WHEN v <= -9 THEN 1.0 ELSE 0.0 END) AS "yield" FROM v""")
def mc_yield_linear_surrogate(spark, d):
    """A draw for each part, between the least and the greatest of their sizes."""
    from sweeplane.operators.surrogate import LinearSurrogate

    surrogate = LinearSurrogate(("size",), ((0, 1e9, 0, 0, {"size": (0.4 / 50, 0.4 / 50)}, (0.1, 0.1)),))
    spec = goals.Specification((goals.Criterion(goals.SMag(None, 1, 1), goals.MaxAgg(), goals.LE(-9.0)),))
    space = design.DesignSpace({"size": ranges(spark, d).variables["size"]})
    return search.estimate_yield(spark, space, surrogate, spec, table(spark, d, "part").count(), "halton")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_yield_by_family(spark, sf_dir)
