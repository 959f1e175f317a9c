"""Queries that write networks and tables and read them back: files, stores, exports, codecs, loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.tables import shared_path
from sweeplane.operators import analyze, codec, dataset, network, scale, transform
from sweeplane.plans.catalog import SQL, query
from sweeplane.plans.views import packed, parts, points, r6, rounded, sql_points, table
from sweeplane.sources import store, touchstone
from sweeplane.streaming.running_yield import packed_verdicts, running_yield

S2, S4 = sql_points(2), sql_points(4)
KEY = ("sample_id", "k", "i", "j")
POINT = "round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im"


def networks(spark, d) -> DataFrame:
    """Packed networks with all fields of the schema; the label is a parameter, and a text one."""
    p = packed(spark, d)
    label = F.coalesce(F.col("label").cast("double"), F.lit(-1.0))
    return p.select(
        "sample_id", F.lit(None).cast("string").alias("path"), "n_ports", F.lit("GHz").alias("unit"), F.lit("power").alias("s_def"), "z0_re",
        F.array(F.lit(0.0), F.lit(0.0)).alias("z0_im"), F.array(F.lit("made by hand")).alias("comments"), F.create_map(F.lit("label"), label).alias("params"),
        F.create_map(F.lit("mat"), F.lit("Cu")).alias("params_str"), "f_hz", "s_re", "s_im",
    )


def _files(spark, d, form: str) -> DataFrame:
    folder = shared_path(spark, "touchstone")
    written = touchstone.write_touchstone(networks(spark, d), folder, form).agg(F.count("*")).first()[0]
    back = touchstone.read_touchstone(spark, folder)
    own = F.regexp_extract("path", r"sample_(\d+)", 1).cast("long")
    return back.withColumnsRenamed({"sample_id": "rank"}).withColumns({"sample_id": own, "written": F.lit(written)})


@query(f"WITH {S2} SELECT sample_id, k, i, j, round(f_hz / 1e9, 6) + 0.0 AS f_ghz, {POINT} FROM s")
def touchstone_points(spark, d):
    """Written as files and scanned again."""
    back = network.to_points(_files(spark, d, "RI").drop("rank", "written"))
    return rounded(back.withColumn("f_ghz", F.col("f_hz") / 1e9), "f_ghz", "re", "im").select(*KEY, "f_ghz", "re", "im")


@query(f"WITH {S2} SELECT sample_id, k, i, j, {POINT} FROM s")
def touchstone_db(spark, d):
    """The same by amplitudes in dB and phases in degrees."""
    return rounded(network.to_points(_files(spark, d, "DB").drop("rank", "written")), "re", "im").select(*KEY, "re", "im")


@query("""SELECT vec_id AS sample_id, row_number() OVER (ORDER BY lpad(CAST(vec_id AS VARCHAR), CAST(greatest(6, length(CAST(vec_id AS VARCHAR))) AS INT), '0')) - 1 AS rank, count(*) OVER () AS written,
 coalesce(CAST(label AS DOUBLE), -1.0) AS label, 'Cu' AS mat, 50.0 AS z0, 'GHz' AS unit FROM embeddings""")
def touchstone_params(spark, d):
    """Ids by the order of paths; parameters, option line and count of files."""
    back = _files(spark, d, "MA")
    one = lambda c, k: F.try_element_at(c, F.lit(k)).alias(k)
    return back.select("sample_id", F.col("rank").cast("long").alias("rank"), F.col("written").cast("long").alias("written"), one("params", "label"), one("params_str", "mat"), F.get("z0_re", F.lit(0)).alias("z0"), "unit")


@query("""WITH e AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS re0 FROM embeddings), t AS (SELECT max(vec_id) + 1 AS top FROM embeddings)
SELECT vec_id AS sample_id, re0 FROM e UNION ALL SELECT vec_id + top, re0 FROM e, t""")
def store_append(spark, d):
    """A store, and the same samples appended with ids behind those stored."""
    path = shared_path(spark, "nets") + ".parquet"
    store.write_store(networks(spark, d), path)
    store.append_store(networks(spark, d), path)
    return store.open_networks(spark, path).select("sample_id", r6(F.get("s_re", F.lit(0)), "re0"))


@query("""WITH e AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS re0 FROM embeddings ), t AS (SELECT max(vec_id) + 1 AS top FROM e)
SELECT vec_id AS sample_id, re0 FROM e UNION ALL SELECT vec_id + top, re0 FROM e, t""")
def touchstone_append(spark, d):
    """Files added to a folder are numbered behind those it has."""
    folder, nets = shared_path(spark, "touchstone"), networks(spark, d)
    touchstone.write_touchstone(nets, folder).count()
    touchstone.append_touchstone(nets, folder).count()
    back = touchstone.read_touchstone(spark, folder)
    return back.select(F.regexp_extract("path", r"sample_(\d+)", 1).cast("long").alias("sample_id"), r6(F.get("s_re", F.lit(0)), "re0"))


@query("SELECT vec_id AS sample_id, 2 AS n_ports, round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS im0 FROM embeddings")
def pack_job(spark, d):
    """A folder of files packed into a store by the command line's function."""
    folder = shared_path(spark, "touchstone")
    touchstone.write_touchstone(networks(spark, d), folder).count()
    store.main(["--src", folder, "--dst", f"{folder}.parquet"])
    back = store.open_networks(spark, f"{folder}.parquet")
    return back.select(F.regexp_extract("path", r"sample_(\d+)", 1).cast("long").alias("sample_id"), "n_ports", r6(F.get("s_im", F.lit(0)), "im0"))


@query("SELECT vec_id AS sample_id, 'MHz' AS unit FROM embeddings WHERE vec_id % 11 = 5")
def unit_consistency(spark, d):
    n = networks(spark, d)
    return network.check_units(n.withColumn("unit", F.when(F.col("sample_id") % 11 == 5, "MHz").otherwise(F.col("unit"))))


@query("SELECT p_partkey AS sample_id, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS DOUBLE) END AS q FROM part")
def params_table(spark, d):
    """A column for each parameter."""
    wide = analyze.params_wide(parts(spark, d), ["size", "q"])
    return wide.select("sample_id", "size", F.when(~F.isnan("q"), F.col("q")).alias("q"))


@query(SQL["params_table"])
def params_csv(spark, d):
    """The same through CSV files."""
    path = shared_path(spark, "params-csv")
    assert store.export_params_csv(parts(spark, d), path, ["size", "q"])
    back = spark.read.option("header", "true").schema("sample_id long, size double, q double").csv(path)
    return back.select("sample_id", "size", F.when(~F.isnan("q"), F.col("q")).alias("q"))


@query(f"""WITH {S2} SELECT k, i, j, 'GHz' AS frequency_unit, round(avg(sqrt(re*re + im*im)), 6) + 0.0 AS mean, round(stddev_pop(sqrt(re*re + im*im)), 6) + 0.0 AS std FROM s GROUP BY ALL""")
def summary_export(spark, d):
    path = shared_path(spark, "summary")
    store.export_summary(analyze.summarize_s(points(spark, d), "mag"), path)
    return rounded(spark.read.parquet(path), "mean", "std").select("k", "i", "j", "frequency_unit", "mean", "std")


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS sample_id, 1 AS n_ports, (row_number() OVER (ORDER BY p_partkey) - 1) / 10.0 AS re, CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 8 AS DOUBLE) AS process FROM part")
def synthetic_source(spark, d):
    """A generated network for each part."""
    n = table(spark, d, "part").count()
    made = store.synthetic(spark, n, lambda i: {"n_ports": 1, "f_hz": [1e9], "s_re": [i / 10], "s_im": [0.0], "params": {"process": float(i % 8)}})
    return made.select("sample_id", "n_ports", F.get("s_re", F.lit(0)).alias("re"), F.try_element_at("params", F.lit("process")).alias("process"))


# -- codec, scalers, loaders --------------------------------------------------------------------------------------

CODEC = codec.Codec(("price", "q", "size"), ("S1_1.real", "S1_1.imag", "S1_2.mag"), tuple(1e9 + k * 5e8 for k in range(8)), backup=codec.Backup.FULL)


@query(f"""WITH {S2} SELECT sample_id, k, i, j, CASE WHEN k = 3 THEN 0.0 WHEN i = j THEN round(re, 6) + 0.0 ELSE round(sqrt(re*re + im*im), 6) + 0.0 END AS re,
 CASE WHEN k = 3 OR i <> j THEN 0.0 ELSE round(im, 6) + 0.0 END AS im FROM s WHERE i = 0""")
def decode_nan(spark, d):
    """NaN in any part decodes to zero."""
    y = CODEC.encode_s(points(spark, d)).withColumn("y", F.transform("y", lambda v: F.transform(v, lambda x, k: F.when(k == 3, F.lit(float("nan"))).otherwise(x))))
    return rounded(CODEC.decode_s(y), "re", "im").select(*KEY, "re", "im")


@query(f"WITH {S2} SELECT sample_id, k, i, j, {POINT} FROM s")
def backup_full(spark, d):
    """The whole matrix is kept where the channels leave a part of it out; the codec as read from its text."""
    return rounded(codec.Codec.loads(CODEC.dumps()).backup_points(points(spark, d)), "re", "im").select(*KEY, "re", "im")


@query("SELECT p_partkey AS sample_id, round(p_retailprice, 6) + 0.0 AS price, CAST(p_size AS DOUBLE) AS size FROM part")
def decode_x(spark, d):
    back = CODEC.decode_x(CODEC.encode_x(parts(spark, d)))
    one = lambda k: F.try_element_at("params", F.lit(k))
    return back.select("sample_id", r6(one("price"), "price"), one("size").alias("size"))


_SPLIT = """r AS (SELECT vec_id AS sample_id, row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings),
x AS (SELECT sample_id, r, CASE WHEN r < floor(n * 0.2) THEN 'val' WHEN r < floor(n * 0.2) + floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query(f"""WITH {S2}, {_SPLIT}, m AS (SELECT k, i, j, avg(re) AS m, greatest(stddev_pop(re), 1e-12) AS sd FROM s JOIN x USING (sample_id) WHERE split = 'train' GROUP BY ALL)
SELECT sample_id, k, i, j, round((re - m) / sd, 6) + 0.0 AS z FROM s JOIN m USING (k, i, j) JOIN x USING (sample_id) WHERE split <> 'train'""")
def scaler_of_train(spark, d):
    """Statistics of the training split alone, applied to the others."""
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"))
    p = points(spark, d).join(dataset.split(ids, 0.2, 0.1, 7), "sample_id").withColumn("z", F.col("re")).select(*KEY, "z", "split")
    s = scale.StdScaler(("k", "i", "j"))
    return rounded(s.forward(p.where("split <> 'train'").drop("split"), s.fit(dataset.subset(p, "train"), "z"), "z"), "z")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_tax, 6) + 0.0 AS v FROM lineitem")
def minmax_inverse(spark, d):
    m = scale.MinMaxScaler(("l_returnflag",), -2.0, 3.0)
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_tax").alias("v"))
    stats = m.fit(v, "v")
    return rounded(m.inverse(m.forward(v, stats, "v"), stats, "v"), "v").drop("l_returnflag")


@query(f"""WITH {_SPLIT}, c AS (SELECT split AS stage, count(*) AS n FROM x GROUP BY split UNION ALL SELECT 'predict', count(*) FROM x)
SELECT stage, n, CAST(ceil(n / 32.0) AS BIGINT) AS batches, least(n, 32) AS largest FROM c""")
def loader_batches(spark, d):
    """Batches of 32 in each stage."""
    splits = dataset.split(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), 0.2, 0.1, 7)
    out = None
    for name, loader in dataset.stage_loaders(splits, 32, 7):
        sizes = loader.groupBy("batch").agg(F.count("*").alias("m"))
        one = sizes.agg(F.sum("m").alias("n"), F.count("*").alias("batches"), F.max("m").alias("largest")).withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("stage", "n", "batches", "largest")


@query(f"WITH {_SPLIT} SELECT sample_id, label FROM x JOIN (SELECT vec_id AS sample_id, label FROM embeddings) USING (sample_id) WHERE split = 'val' AND sample_id BETWEEN 10 AND 300")
def lookup_meta(spark, d):
    """Samples by index, with what else is known of them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    return dataset.subset(dataset.split(e, 0.2, 0.1, 7), "val").where(F.col("sample_id").between(10, 300)).select("sample_id", "label")


# -- grids, ports, delays, streams --------------------------------------------------------------------------------


@query(f"""WITH {S2}, b AS (SELECT sample_id, k, i, j, re, im, 1e9 + k * k * 1e8 AS f FROM s),
n AS (SELECT *, lead(f) OVER w AS f1, lead(re) OVER w AS re1, lead(im) OVER w AS im1 FROM b WINDOW w AS (PARTITION BY sample_id, i, j ORDER BY k)), t AS (SELECT kk, 1e9 + kk * 4.9e9 / 12 AS ft FROM range(13) r(kk))
SELECT sample_id, kk AS k, i, j, round(ft / 1e9, 6) + 0.0 AS f_ghz, round(re + (ft - f) / (f1 - f) * (re1 - re), 6) + 0.0 AS re, round(im + (ft - f) / (f1 - f) * (im1 - im), 6) + 0.0 AS im
FROM n JOIN t ON (ft >= f AND ft < f1) OR (kk = 12 AND n.k = 6)""")
def resample_bent(spark, d):
    """Even frequencies out of a grid whose steps grow."""
    bent = packed(spark, d).withColumn("f_hz", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: 1e9 + k * k * 1e8))
    out = network.to_points(transform.resample_packed(bent, 13)).withColumn("f_ghz", F.col("f_hz") / 1e9)
    return rounded(out, "f_ghz", "re", "im").select(*KEY, "f_ghz", "re", "im")


@query(f"WITH {S4} SELECT sample_id, k, i, j, {POINT} FROM s")
def z0_shift_4port(spark, d):
    """Four-ports moved to another impedance and back."""
    there = transform.z0_shift(points(spark, d, 4), 10.0)
    return rounded(transform.z0_shift(there, -10.0, 60.0), "re", "im").select(*KEY, "re", "im")


@query(f"""WITH {S2}, p AS (SELECT *, degrees(atan2(im, re)) AS p FROM s), q AS (SELECT *, lead(p) OVER w - p AS dp, lead(f_hz) OVER w - f_hz AS df FROM p WINDOW w AS (PARTITION BY sample_id, i, j ORDER BY k))
SELECT sample_id, k, i, j, round(-radians(CASE WHEN abs(dp) < 180 THEN dp ELSE dp - 360 * floor((dp + 180) / 360) END) / (2 * pi() * df) * 1e9, 6) + 0.0 AS delay_ns FROM q""")
def group_delay(spark, d):
    out = transform.group_delay(points(spark, d)).withColumn("delay_ns", F.col("delay_s") * 1e9)
    return rounded(out, "delay_ns").select(*KEY, "delay_ns")


@query(f"""WITH {S2}, v AS (SELECT sample_id, max(sqrt(re*re + im*im)) <= 0.25 AS ok FROM s WHERE i = 0 AND j = 0 GROUP BY sample_id)
SELECT CAST(floor(floor(sample_id * 2000 / 3) / 60000) AS BIGINT) AS minute, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM v GROUP BY 1""")
def windowed_yield(spark, d):
    """Verdicts counted by event-time window: a sample comes every 2/3 of a second, 90 of them in a minute."""
    from sweeplane.operators import goals

    spec = goals.Specification((goals.Criterion(goals.SMag(None, 1, 1, False), goals.MaxAgg(), goals.LE(0.25)),))
    stamped = packed(spark, d).withColumn("ts", F.timestamp_millis((F.lit(1_699_999_980_000) + F.floor(F.col("sample_id") * 2000 / 3)).cast("long")))
    counts = running_yield(packed_verdicts(stamped, spec))
    minute = ((F.unix_seconds("window_start") - 1_699_999_980) / 60).cast("long").alias("minute")
    return counts.select(minute, "n", "n_ok")
