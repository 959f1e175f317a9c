"""Queries of stores that are kept: summaries that follow appends, snapshots, chunked arrays, lookups by id; and the search along axes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.tables import shared_path
from sweeplane.operators import search
from sweeplane.operators.rollup import Rollup
from sweeplane.plans.catalog import query
from sweeplane.plans.stores import POINT, networks
from sweeplane.plans.views import points, r6, rounded, sql_points, table
from sweeplane.sources import chunks, indexed, snapshot, store

S2 = sql_points(2)
_SETS = (("label", "i", "j"), ("label",), ("i", "j"), ())
_BATCHES = 3


def _appended(spark, d, k: int) -> tuple[Rollup, DataFrame]:
    """States of the real parts of all elements, stored in three batches."""
    rollup, path = Rollup(("label", "i", "j"), "re", k), shared_path(spark, "rollup")
    rows = points(spark, d)
    for n in range(_BATCHES):
        rollup.append(rows.where(F.col("sample_id") % _BATCHES == n), path, str(n))
    return rollup, rollup.stored(spark, path)


@query(f"""WITH {S2} SELECT CASE grouping(label, i, j) WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS level, label, i, j, count(re) AS n,
round(avg(re), 6) + 0.0 AS mean, round(stddev_pop(re), 6) + 0.0 AS std, round(min(re), 6) + 0.0 AS lo, round(max(re), 6) + 0.0 AS hi FROM s GROUP BY GROUPING SETS ((label, i, j), (label), (i, j), ())""")
def rollup_appended(spark, d):
    """Statistics by family and port pair, by each, and of all, from the states of three batches alone."""
    rollup, states = _appended(spark, d, 200)
    out = rollup.finish(rollup.sets(states, _SETS))
    return rounded(out, "mean", "std", "lo", "hi").drop("nan_n")


@query(f"WITH {S2} SELECT label, count(*) AS n, true AS near FROM s GROUP BY label")
def rollup_quantiles(spark, d):
    """Tenths, medians and nine tenths of a family, told by merged sketches, have nearly these ranks among its values."""
    rollup, states = _appended(spark, d, 1000)
    shares = (0.1, 0.5, 0.9)
    told = rollup.finish(rollup.merge(states, ["label"]), shares).withColumnRenamed("label", "family")
    met = points(spark, d).join(F.broadcast(told), F.col("label").eqNullSafe(F.col("family")))
    near = F.lit(True)
    for n, share in enumerate(shares):
        near = near & (F.abs(F.avg((F.col("re") <= F.col(f"q_{n}")).cast("double")) - share) < 0.02)
    return met.groupBy("label").agg(F.count("*").alias("n"), near.alias("near"))


@query(f"""WITH {S2}, t AS (SELECT sample_id, round(sum(re), 6) + 0.0 AS re, round(sum(im), 6) + 0.0 AS im FROM s GROUP BY sample_id)
SELECT 'first' AS name, 0 AS changed_files, * FROM t WHERE sample_id % 2 = 0 UNION ALL SELECT 'second', 0, * FROM t""")
def snapshot_restore(spark, d):
    """A store before and after an append, both restored from their snapshots; no file of the first changes until the second."""
    nets = networks(spark, d)
    path, home = f"{shared_path(spark, 'kept')}.parquet", shared_path(spark, "snapshots")
    store.write_store(nets.where("sample_id % 2 = 0"), path)
    snapshot.take_snapshot(spark, path, home, "first")
    nets.where("sample_id % 2 = 1").write.mode("append").partitionBy("n_ports").parquet(path)
    snapshot.take_snapshot(spark, path, home, "second", since="first")
    changed = snapshot.changes(spark, home, "first", "second").where("change <> 'added'").count()
    out = None
    for name in ("first", "second"):
        place = shared_path(spark, name)
        snapshot.restore(spark, home, name, place)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        one = store.read_store(spark, place).select(F.lit(name).alias("name"), F.lit(changed).alias("changed_files"), "sample_id", r6(total("s_re"), "re"), r6(total("s_im"), "im"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {S2} SELECT sample_id, k, round(f_hz / 1e9, 6) + 0.0 AS f_ghz, i, j, {POINT} FROM s WHERE f_hz BETWEEN 1.9e9 AND 3.1e9 AND i <> j")
def array_band(spark, d):
    """A band of two port pairs out of a chunked array of all networks."""
    path = shared_path(spark, "array")
    chunks.write_chunks(networks(spark, d), path, (256, 3, 1))
    band = chunks.read_chunks(spark, path, (1.9e9, 3.1e9), [(0, 1), (1, 0)])
    return rounded(band.withColumn("f_ghz", F.col("f_hz") / 1e9).drop("f_hz"), "f_ghz", "re", "im")


@query("""WITH m AS (SELECT max(vec_id) AS m FROM embeddings) SELECT a.vec_id AS position, b.vec_id AS sample_id, round(CAST(b.embedding[1] AS DOUBLE), 6) + 0.0 AS re,
b.label FROM embeddings a, m, embeddings b WHERE b.vec_id = m - a.vec_id""")
def take_by_index(spark, d):
    """All networks in the order of a list of ids, the last first, out of a table in buckets, joined there with their families."""
    nets, names = networks(spark, d), [f"{kind}_{uuid.uuid4().hex}" for kind in ("networks", "families")]
    family = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    for df, name in zip((nets.select("sample_id", "s_re"), family), names, strict=True):
        indexed.write_indexed(df, name, shared_path(spark, "indexed"), buckets=16)
    top = family.agg(F.max("sample_id").alias("top"))
    listed = family.join(F.broadcast(top)).select(F.col("sample_id").alias("position"), (F.col("top") - F.col("sample_id")).alias("sample_id"))
    found = indexed.take(spark, names[0], listed).join(spark.table(names[1]).hint("merge"), "sample_id")
    return found.select("position", "sample_id", r6(F.get("s_re", F.lit(0)), "re"), "label")


@query("""WITH c AS (SELECT abs(p_size - 25) AS d, p_size BETWEEN 8 AND 45 AND p_partkey % 20 <> 0 AS ok FROM part), n AS (SELECT d, sum(count(*)) OVER w AS inside, sum(count(*) FILTER (ok)) OVER w AS good
FROM c GROUP BY d WINDOW w AS (ORDER BY d)) SELECT 'size' AS param, CAST(25 - d AS DOUBLE) AS lo, CAST(25 + d AS DOUBLE) AS hi, CAST(inside AS BIGINT) AS inside, CAST(good AS BIGINT) AS good FROM n WHERE good >= 0.9 * inside ORDER BY d DESC LIMIT 1""")
def axis_zoom_size(spark, d):
    """The widest range of sizes around 25 of whose parts nine tenths pass."""
    p = table(spark, d, "part")
    cloud = p.select(F.col("p_size").alias("size"), (F.col("p_size").between(8, 45) & (F.col("p_partkey") % 20 != 0)).alias("ok"))
    box = search.axis_zoom(cloud, {"size": 25.0}, 0.9)
    return spark.createDataFrame([("size", 25 - box.half["size"], 25 + box.half["size"], box.inside, box.good)], "param string, lo double, hi double, inside long, good long")


@query("SELECT param, true AS holds, true AS widest, count(*) AS n FROM part, (VALUES ('x'), ('y')) t(param) GROUP BY param")
def axis_zoom_parts(spark, d):
    """A box around the middle of the parts' sizes and prices whose parts all pass, and that takes in a failing one when either side is widened."""
    p = table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    spread = p.agg(*(f(c).alias(f"{name}_{c}") for c in ("size", "price") for name, f in (("mean", F.avg), ("std", F.stddev_pop))))
    near = lambda c, name: ((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(name)
    cloud = p.join(F.broadcast(spread)).select(near("size", "x"), near("price", "y")).withColumn("ok", F.abs("x") + F.abs("y") <= 0.9)
    box = search.axis_zoom(cloud, {"x": 0.0, "y": 0.0}, 1.0, bins=32, zooms=8)
    out = None
    for v, w in ("xy", "yx"):
        beyond = (F.abs(v) > box.half[v]) & (F.abs(w) <= box.half[w])
        nearest = F.min(F.when(beyond, F.struct(F.abs(v).alias("d"), "ok")))  # of those at one distance a failing one
        holds = (F.count_if(box.within()) == box.inside) & (F.count_if(box.within() & F.col("ok")) == box.inside)
        one = cloud.agg(F.lit(v).alias("param"), holds.alias("holds"), (~F.coalesce(nearest["ok"], F.lit(False))).alias("widest"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
