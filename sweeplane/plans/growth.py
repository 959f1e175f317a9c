"""Queries of the data source, the growing store and the trained surrogates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.tables import shared_path
from sweeplane.operators import goals, learned, network, search, transform
from sweeplane.operators.dataset import split
from sweeplane.plans.catalog import query
from sweeplane.plans.stores import KEY, POINT, networks
from sweeplane.plans.views import points, r6, rounded, sql_points, table
from sweeplane.sources import touchstone_format
from sweeplane.streaming.growing import drain, follow_store, live_totals
from sweeplane.streaming.running_yield import packed_verdicts

S4 = sql_points(4)


def _four_ports(spark, d) -> DataFrame:
    """Embeddings as four-port networks with all fields of the schema."""
    packed = network.to_packed(points(spark, d, 4))
    other = networks(spark, d).drop("n_ports", "f_hz", "s_re", "s_im")
    return other.join(packed, "sample_id").withColumn("z0_re", F.array_repeat(F.lit(50.0), 4)).withColumn("z0_im", F.array_repeat(F.lit(0.0), 4))


def _source(spark, d) -> str:
    """Two-port files of the even samples and four-port ones of the odd, by one writer."""
    touchstone_format.register(spark)
    folder = shared_path(spark, "touchstone-source")
    even = networks(spark, d).where("sample_id % 2 = 0")
    even.unionByName(_four_ports(spark, d).where("sample_id % 2 = 1")).write.format("touchstone").mode("append").save(folder)
    return folder


@query(f"WITH {S4} SELECT sample_id, k, i, j, {POINT} FROM s WHERE sample_id % 2 = 1")
def touchstone_source_points(spark, d):
    """Written and read by the data source; two-port files are left out by their names."""
    back = spark.read.format("touchstone").load(_source(spark, d)).where("n_ports = 4")
    own = F.regexp_extract("path", r"sample_(\d+)", 1).cast("long")
    return rounded(network.to_points(back.withColumn("sample_id", own)), "re", "im").select(*KEY, "re", "im")


@query("""SELECT vec_id AS sample_id, CAST(2 + 2 * (vec_id % 2) AS INTEGER) AS n_ports, coalesce(CAST(label AS DOUBLE), -1.0) AS label, 50.0 AS z0 FROM embeddings""")
def touchstone_source_headers(spark, d):
    """Parameters and option lines of all files, of which no data line is read."""
    back = spark.read.format("touchstone").schema("path string, n_ports int, params map<string,double>, z0_re array<double>").load(_source(spark, d))
    own = F.regexp_extract("path", r"sample_(\d+)", 1).cast("long").alias("sample_id")
    return back.select(own, "n_ports", F.try_element_at("params", F.lit("label")).alias("label"), F.get("z0_re", F.lit(0)).alias("z0"))


_ARRIVALS = 3


@query(f"""WITH {sql_points(2)}, v AS (SELECT sample_id, coalesce(CAST(any_value(label) AS VARCHAR), '-') AS family, sample_id % {_ARRIVALS} AS arrival, max(sqrt(re*re + im*im)) <= 0.25 AS ok FROM s WHERE i = 0 AND j = 0 GROUP BY sample_id),
a AS (SELECT family, arrival, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM v GROUP BY ALL)
SELECT family, arrival, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(n_ok) OVER w AS BIGINT) AS n_ok FROM a WINDOW w AS (PARTITION BY family ORDER BY arrival)""")
def growing_store(spark, d):
    """Counts and yield of each family after each of three arrivals in a store; each is taken in by a stream that starts anew from its checkpoint."""
    spec = goals.Specification((goals.Criterion(goals.SMag(None, 1, 1, False), goals.MaxAgg(), goals.LE(0.25)),))
    nets = networks(spark, d)
    store, out, checkpoint = (shared_path(spark, name) for name in ("growing", "totals", "stream"))
    arrival = (F.col("sample_id") % _ARRIVALS).cast("long")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + arrival * 3600)
    rows = nets.withColumns({"family": F.coalesce(F.when(F.element_at("params", "label") >= 0, F.element_at("params", "label").cast("long").cast("string")), F.lit("-")), "arrival": arrival, "ts": stamp})
    for n in range(_ARRIVALS):
        rows.where(F.col("arrival") == n).write.mode("append").parquet(store)
        seen = follow_store(spark, store, rows.schema)
        drain(live_totals(packed_verdicts(seen, spec)), out, checkpoint)
    return spark.read.parquet(out).select("family", "arrival", "n", "n_ok")


_TARGETS = "SELECT label, k, 1e9 + 3.5e9 * pow(k / (5.0 + label % 4), 1 + label % 3) AS f FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL), range(9) t(k) WHERE k <= 5 + label % 4"


@query(f"""WITH {sql_points(2)}, t AS ({_TARGETS}), n AS (SELECT *, lead(f_hz) OVER w AS f1, lead(re) OVER w AS re1, lead(im) OVER w AS im1 FROM s WINDOW w AS (PARTITION BY sample_id, i, j ORDER BY k))
SELECT n.sample_id, t.k, n.i, n.j, round(t.f / 1e9, 6) + 0.0 AS f_ghz, round(re + coalesce((t.f - f_hz) / (f1 - f_hz) * (re1 - re), 0), 6) + 0.0 AS re, round(im + coalesce((t.f - f_hz) / (f1 - f_hz) * (im1 - im), 0), 6) + 0.0 AS im
FROM n JOIN t ON n.label = t.label AND t.f >= f_hz AND (t.f < f1 OR f1 IS NULL)""")
def resample_by_family(spark, d):
    """Every family has a grid of its own, of its own spacing; the grids are a table."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("label")).where("label IS NOT NULL")
    last = 5 + F.col("label") % 4
    grids = own.select("label").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    grids = grids.withColumn("f_hz", 1e9 + 3.5e9 * F.pow(F.col("k") / last.cast("double"), (1 + F.col("label") % 3).cast("double")))
    out = transform.resample_targets(points(spark, d), own.join(grids, "label").select("sample_id", "k", "f_hz"))
    return rounded(out.withColumn("f_ghz", F.col("f_hz") / 1e9), "f_ghz", "re", "im").select(*KEY, "f_ghz", "re", "im")


_BAND = "SELECT p_partkey AS point_id, p_size / 25.0 - 1 AS x, p_retailprice / 50.0 - 19 AS y, 0.6 * abs(p_size / 25.0 - 1) + abs(p_retailprice / 50.0 - 19) <= 0.4 AS ok FROM part"


@query(f"""WITH c AS ({_BAND}), b AS (SELECT point_id AS cid, -abs(x) AS lx, abs(x) AS hx, -abs(y) AS ly, abs(y) AS hy FROM c WHERE ok)
SELECT cid, count(*) AS inside, count(*) FILTER (c.ok) AS good FROM b JOIN c ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy GROUP BY cid""")
def box_index(spark, d):
    """Boxes around the middle of the parts' sizes and prices against all parts, by the cloud's index."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_size") / 25.0 - 1).alias("x"), (F.col("p_retailprice") / 50.0 - 19).alias("y"))
    cloud = p.withColumn("ok", 0.6 * F.abs("x") + F.abs("y") <= 0.4)
    boxes = search.candidate_boxes(cloud.where("ok"), {"x": 0.0, "y": 0.0})
    return search.score_boxes(boxes, cloud, ["x", "y"], direct=0).select("cid", "inside", "good")


# -- trained surrogates -------------------------------------------------------------------------------------------

_PART = "SELECT p_size / 50.0 AS a, p_retailprice / 2000.0 AS b, p_size * p_retailprice / 100000.0 AS y FROM part"


def _rows(spark, d, y=None) -> DataFrame:
    p = table(spark, d, "part")
    y = F.array(F.col("p_size") * F.col("p_retailprice") / 100000.0) if y is None else y
    return p.select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0).alias("x"), y.alias("y"), F.lit("train").alias("part"))


@query(f"""WITH p AS ({_PART}), one AS (SELECT 0.5 * 2 * avg(y * a) AS a1, 0.5 * 2 * avg(y * b) AS b1, 0.5 * 2 * avg(y) AS c1, avg(y * y) AS e0 FROM p),
r AS (SELECT p.*, one.*, a1 * a + b1 * b + c1 - y AS e FROM p, one), two AS (SELECT any_value(a1) - 0.5 * 2 * avg(e * a) AS a2, any_value(b1) - 0.5 * 2 * avg(e * b) AS b2, any_value(c1) - 0.5 * 2 * avg(e) AS c2,
 any_value(e0) AS e0, avg(e * e) AS e1 FROM r)
SELECT round(a2, 6) + 0.0 AS w_size, round(b2, 6) + 0.0 AS w_price, round(c2, 6) + 0.0 AS bias, round(e0, 6) + 0.0 AS loss_0, round(e1, 6) + 0.0 AS loss_1, round(avg(pow(a2 * a + b2 * b + c2 - y, 2)), 6) + 0.0 AS loss_2
FROM two, p GROUP BY ALL""")
def gradient_steps(spark, d):
    """Two steps along the gradient over all parts from zero, for a network without a hidden layer: weights and losses."""
    fit = learned.fit_network(_rows(spark, d), learned.Network.start((2, 1), zero=True), 2, 0.5, "sgd", patience=None)
    losses = {f"loss_{n}": float(train) for n, (train, _) in enumerate(fit.history)}
    names = ("w_size", "w_price", "bias")
    last = dict(zip(names, fit.network.weights.tolist(), strict=True))
    out = spark.createDataFrame([last | losses])
    return rounded(out, *out.columns)


@query("SELECT count(*) AS n, true AS fits, true AS stopped_at_best FROM part")
def neural_surrogate(spark, d):
    """A network with a hidden layer, trained on 80 % of the parts and stopped by the others, predicts the response of all."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 1000).alias("price"))
    parts = split(p.select("sample_id"), 0.2, 0.0, 5).withColumnRenamed("split", "part")
    re, im = F.tanh(F.col("size") / 25 - 1) * F.col("price"), F.col("size") * F.col("price") / 100
    samples = p.join(parts, "sample_id").withColumn("y", F.array(re, im))
    surrogate, fit = learned.NeuralSurrogate.fit(samples, ("size", "price"), (1e9,), hidden=(8,), epochs=60, rate=0.05, patience=10)
    surrogate = learned.NeuralSurrogate.loads(surrogate.dumps())
    found = surrogate.transform(samples.withColumnRenamed("sample_id", "point_id"))
    met = found.join(samples.select("sample_id", F.get("y", F.lit(0)).alias("t"), F.get("y", F.lit(1)).alias("u")), "sample_id")
    error = F.sum(F.pow(F.col("re") - F.col("t"), 2) + F.pow(F.col("im") - F.col("u"), 2)) / F.count("*")
    spread = F.var_pop("t") + F.var_pop("u")
    best = min(range(len(fit.history)), key=lambda n: fit.history[n][1])
    return met.agg(F.count("*").alias("n"), (error < 0.05 * spread).alias("fits")).withColumn("stopped_at_best", F.lit(best == fit.best))


@query(f"""WITH p AS ({_PART}), k AS (SELECT exp(-(pow(a - 0.5, 2) + pow(b - 0.5, 2)) / 2) AS k, y FROM p), s AS (SELECT sum(k * k) AS kk, sum(k * y) AS ky FROM k)
SELECT p_partkey, round(exp(-(pow(p_size / 50.0 - 0.5, 2) + pow(p_retailprice / 2000.0 - 0.5, 2)) / 2) * ky / (0.25 + kk), 6) + 0.0 AS mean,
 round(greatest(1 - exp(-(pow(p_size / 50.0 - 0.5, 2) + pow(p_retailprice / 2000.0 - 0.5, 2))) * (1 - 1 / (1 + kk / 0.25)), 0), 6) + 0.0 AS variance FROM part, s""")
def gaussian_process(spark, d):
    """A process seen through one inducing point, where mean and variance have a closed form."""
    rows = _rows(spark, d)
    model = learned.GaussianProcess.fit(rows, np.array([[0.5, 0.5]]), 1.0, 0.5, jitter=0.0)
    return model.predict(rows.select("p_partkey", "x")).select("p_partkey", r6(F.get("mean", F.lit(0)), "mean"), r6("variance", "variance"))


@query(f"""WITH p AS ({_PART}), k AS (SELECT exp(-(pow(a - 0.25, 2) + pow(b - 0.5, 2)) / 0.5) AS k, exp(-(pow(a - 0.75, 2) + pow(b - 0.5, 2)) / 0.5) AS l, y FROM p),
s AS (SELECT sum(k * k) AS kk, sum(k * l) AS kl, sum(l * l) AS ll, sum(k * y) AS ky, sum(l * y) AS ly FROM k)
SELECT p_partkey, round((exp(-(pow(p_size / 50.0 - 0.25, 2) + pow(p_retailprice / 2000.0 - 0.5, 2)) / 0.5) * (ky * ll - kl * ly) + exp(-(pow(p_size / 50.0 - 0.75, 2) + pow(p_retailprice / 2000.0 - 0.5, 2)) / 0.5) * (kk * ly - kl * ky)) / (kk * ll - kl * kl), 5) + 0.0 AS mean FROM part, s""")
def radial_basis(spark, d):
    """Least squares of two radial bases, by Cramer's rule in SQL."""
    rows = _rows(spark, d)
    model = learned.RadialBasis.fit(rows, np.array([[0.25, 0.5], [0.75, 0.5]]), 0.5, 0.0)
    return model.predict(rows.select("p_partkey", "x")).select("p_partkey", (F.round(F.get("mean", F.lit(0)), 5) + 0.0).alias("mean"))
