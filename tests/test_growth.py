"""The Touchstone data source, the growing store, trained surrogates, and unwrapping in linear time."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweeplane.operators import learned, network, transform
from sweeplane.sources import touchstone, touchstone_format
from sweeplane.streaming import growing


def _nets(spark, n, ports=2):
    rows = []
    for i in range(n):
        s = np.random.default_rng(i).normal(size=(3, ports * ports, 2))
        rows.append((i, None, ports, "GHz", "power", [50.0] * ports, [0.0] * ports, ["made"], {"w": float(i)}, {"mat": "Cu"}, [1e9, 2e9, 3e9], s[..., 0].ravel().tolist(), s[..., 1].ravel().tolist()))
    return spark.createDataFrame(rows, network.NETWORK_SCHEMA).repartition(3)


def _folder(tmp_path):
    return sorted(f for f in os.listdir(tmp_path))


def test_source_round_trip_and_header_reads(spark, tmp_path):
    touchstone_format.register(spark)
    folder = str(tmp_path / "nets")
    _nets(spark, 20).write.format("touchstone").mode("append").save(folder)
    assert _folder(folder) == [f"sample_{n:06d}.s2p" for n in range(20)]
    same = lambda df: sorted(df.selectExpr("sample_id", "n_ports", "params", "params_str", "f_hz", "s_re", "s_im").collect(), key=lambda r: r.sample_id)
    back = same(spark.read.format("touchstone").load(folder))
    want = same(touchstone.read_touchstone(spark, folder))
    assert back == want and len(back) == 20
    # Files whose data lines are no numbers: headers are read, data are not.
    for name in _folder(folder):
        text = open(f"{folder}/{name}").read()
        with open(f"{folder}/{name}", "w") as f:
            f.write("".join(line if line.startswith(("!", "#")) else "no number\n" * 50_000 for line in text.splitlines(keepends=True)))
    heads = spark.read.format("touchstone").schema("sample_id long, params map<string,double>, unit string").load(folder)
    assert {r.params["w"] for r in heads.collect()} == set(map(float, range(20)))
    with pytest.raises(Exception, match="could not convert"):
        spark.read.format("touchstone").load(folder).collect()
    with pytest.raises(Exception, match="has no"):
        spark.read.format("touchstone").schema("odd long").load(folder).collect()
    with pytest.raises(Exception, match="no Touchstone file"):
        spark.read.format("touchstone").load(str(tmp_path)).where("1 = 1").select("path").collect() if os.listdir(tmp_path) == [] else spark.read.format("touchstone").option("pathGlobFilter", "*.x").load(folder).collect()


def test_source_leaves_out_files_by_filter(spark, tmp_path):
    touchstone_format.register(spark)
    folder = str(tmp_path)
    _nets(spark, 6).write.format("touchstone").mode("append").save(folder)
    _nets(spark, 3, 1).write.format("touchstone").mode("append").save(folder)
    # A four-port file that cannot be read: what is filtered by name is never opened.
    with open(f"{folder}/sample_000099.s4p", "w") as f:
        f.write("# GHz S RI R 50\nbroken")
    read = spark.read.format("touchstone").load(folder)
    assert read.where("n_ports = 1").count() == 3 and read.where("n_ports < 4 AND sample_id >= 2").count() == 7
    assert read.where(F.col("path").endswith("000003.s2p")).select("params").first().params == {"w": 3.0}
    reader = touchstone_format.TouchstoneReader(folder, touchstone.GLOB, read.schema)
    from pyspark.sql.datasource import EqualTo, IsNull

    left = list(reader.pushFilters([EqualTo(("n_ports",), 2), IsNull(("unit",))]))
    assert left == [IsNull(("unit",))] and sum(len(p.files) for p in reader.partitions()) == 6


def test_source_aborts_and_overwrites_whole(spark, tmp_path):
    touchstone_format.register(spark)
    folder = str(tmp_path)
    _nets(spark, 4).write.format("touchstone").mode("append").save(folder)
    before = {n: open(f"{folder}/{n}").read() for n in _folder(folder)}
    broken = _nets(spark, 30).withColumn("sample_id", F.when(F.col("sample_id") == 29, F.raise_error(F.lit("broken task"))).otherwise(F.col("sample_id")).cast("long"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken task|aborted"):
            broken.write.format("touchstone").mode(mode).save(folder)
        assert {n: open(f"{folder}/{n}").read() for n in _folder(folder)} == before
    with pytest.raises(Exception, match="repeat"):
        _nets(spark, 2).unionByName(_nets(spark, 2)).write.format("touchstone").mode("append").save(folder)
    assert _folder(folder) == sorted(before)
    _nets(spark, 2, 1).write.format("touchstone").mode("overwrite").option("form", "MA").save(folder)
    assert _folder(folder) == ["sample_000000.s1p", "sample_000001.s1p"]


def test_growing_store_restarts_late_rows_and_timers(spark, tmp_path):
    store, out, checkpoint = (str(tmp_path / n) for n in ("store", "out", "checkpoint"))
    schema = "family string, arrival long, ts timestamp, ok boolean"
    hour = 3600
    arrivals = [
        [("a", 0, 10, True), ("a", 0, 20, False), ("b", 0, 30, True)], [("a", 1, hour, True)],
        # Later than the watermark, which is ten minutes behind an hour: left out. A family of that time is not.
        [("b", 2, 40, True), ("c", 2, hour + 5, False)], [("a", 3, 3 * hour, True)],
    ]
    seen = []
    for n, rows in enumerate(arrivals):
        spark.createDataFrame([(f, a, t, ok) for f, a, t, ok in rows], "family string, arrival long, t long, ok boolean").select(
            "family", "arrival", F.timestamp_seconds("t").alias("ts"), "ok"
        ).coalesce(1).write.mode("append").parquet(store)
        # Each drain is a new query from the checkpoint of the one before.
        growing.drain(growing.live_totals(growing.follow_store(spark, store, schema), idle_ms=1_800_000), out, checkpoint)
        seen.append(sorted((r.family, r.arrival, r.n, r.n_ok, r.closed) for r in spark.read.parquet(out).collect()))
    changes = [sorted(set(b) - set(a)) for a, b in zip([[]] + seen, seen, strict=False)]
    assert changes[0] == [("a", 0, 2, 1, False), ("b", 0, 1, 1, False)]
    # The second arrival moves the watermark beyond half an hour of silence of b.
    assert ("a", 1, 3, 2, False) in changes[1]
    assert ("b", 0, 1, 1, True) in changes[1] + changes[2]
    assert ("c", 2, 1, 0, False) in changes[2] and not any(r[0] == "b" and r[1] == 2 for r in seen[-1])
    assert ("a", 3, 4, 3, False) in changes[3] and ("c", 2, 1, 0, True) in seen[-1]
    again = len(seen[-1])
    growing.drain(growing.live_totals(growing.follow_store(spark, store, schema), idle_ms=1_800_000), out, checkpoint)
    assert spark.read.parquet(out).count() >= again and spark.read.parquet(out).where("NOT closed").count() == sum(not r[4] for r in seen[-1])


def _samples(spark, n=300, parts=3):
    x = np.random.default_rng(4).uniform(-1, 1, (n, 2))
    y = np.stack([np.sin(2 * x[:, 0]) + x[:, 1], x[:, 0] * x[:, 1]], axis=1)
    part = np.where(np.arange(n) % 5 == 0, "val", "train")
    rows = [(a.tolist(), b.tolist(), str(p)) for a, b, p in zip(x, y, part, strict=True)]
    return x, y, part, spark.createDataFrame(rows, "x array<double>, y array<double>, part string").repartition(parts)


def _plain_fit(x, y, part, net, epochs, rate):
    """The same in plain numpy, all rows at once."""
    shapes = list(zip(net.layers, net.layers[1:], strict=False))
    w, m, v, history = net.weights.copy(), 0.0, 0.0, []
    for epoch in range(epochs + 1):
        at, layers = 0, []
        for a, b in shapes:
            layers.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        hidden = np.tanh(x @ layers[0][0] + layers[0][1])
        error = hidden @ layers[1][0] + layers[1][1] - y
        t = part == "train"
        history.append(((error[t] ** 2).mean(), (error[~t] ** 2).mean()))
        e = np.where(t[:, None], 2 * error / y[t].size, 0)
        back = (e @ layers[1][0].T) * (1 - hidden**2)
        g = np.concatenate([(x.T @ back).ravel(), back.sum(0), (hidden.T @ e).ravel(), e.sum(0)])
        if epoch == epochs:
            return history
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)


def test_network_equals_plain_numpy_whatever_the_partitions(spark):
    x, y, part, rows = _samples(spark)
    net = learned.Network.start((2, 6, 2), 1)
    want = np.array(_plain_fit(x, y, part, net, 12, 0.05))
    got = learned.fit_network(rows, net, 12, 0.05, patience=None)
    other = learned.fit_network(rows.repartition(7), net, 12, 0.05, patience=None)
    assert np.abs(np.array(got.history) - want).max() < 1e-9 and np.abs(got.network.weights - other.network.weights).max() < 1e-9
    assert want[-1, 0] < want[0, 0]


def test_network_stops_early_and_checks_rows(spark):
    _, _, _, rows = _samples(spark, 60)
    odd = spark.createDataFrame([(None, [1.0, 1.0], "train"), ([1.0, float("nan")], [1.0, 1.0], "train"), ([1.0], [1.0, 1.0], "val"), ([1.0, 1.0], [None, 1.0], "val"), ([0.0, 0.0], [9.0, 9.0], "test")], rows.schema)
    net = learned.Network.start((2, 2), 1)
    fit = learned.fit_network(rows.unionByName(odd), net, 40, 5.0, "sgd", "step", patience=3)
    plain = learned.fit_network(rows, net, 40, 5.0, "sgd", "step", patience=3)
    assert np.allclose(fit.history, plain.history) and len(fit.history) <= fit.best + 4
    assert fit.history[fit.best][1] == min(v for _, v in fit.history)
    with pytest.raises(ValueError, match="no row"):
        learned.fit_network(odd, net, 1)
    with pytest.raises(ValueError, match="weights"):
        learned.Network.start((2000, 2000))


def test_neural_surrogate_predicts_networks(spark):
    x, y, part, rows = _samples(spark, 200)
    samples = rows.select(F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), "y", "part", F.xxhash64("x").alias("point_id"))
    s, _ = learned.NeuralSurrogate.fit(samples, ("a", "b"), (1e9,), hidden=(4,), epochs=3)
    s = learned.NeuralSurrogate.loads(s.dumps())
    got = s.transform(samples.select("point_id", "a", "b")).join(samples, F.col("sample_id") == F.col("point_id")).collect()
    for r in got[:20]:
        want = s.forward(np.array([[r.a, r.b]]))[0, 0, 0, 0]
        assert abs(complex(r.re, r.im) - want) < 1e-9


def test_gaussian_process_and_radial_basis_equal_dense_solutions(spark):
    x, y, part, rows = _samples(spark, 60)
    t = part == "train"
    centres = learned.choose_centres(rows, 200)
    assert len(centres) == t.sum()
    model = learned.GaussianProcess.fit(rows, centres, 0.7, 0.3)
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * 0.7**2))
    inner = np.linalg.inv(k(x[t], x[t]) + 0.09 * np.eye(t.sum()))
    mean, var = k(x, x[t]) @ inner @ y[t], 1 - np.einsum("ij,jk,ik->i", k(x, x[t]), inner, k(x, x[t]))
    got = {tuple(r.x): r for r in model.predict(rows.select("x")).collect()}
    for a, m, v in zip(x, mean, var, strict=True):
        r = got[tuple(a)]
        assert np.allclose(r["mean"], m, atol=1e-5) and abs(r.variance - v) < 1e-5
    few = learned.choose_centres(rows, 10)
    basis = learned.RadialBasis.fit(rows, few, 0.7, 1e-6)
    design = k(x[t], few)
    want = k(x, few) @ np.linalg.solve(design.T @ design + 1e-6 * np.eye(10), design.T @ y[t])
    got = {tuple(r.x): r["mean"] for r in basis.predict(rows.select("x")).collect()}
    assert all(np.allclose(got[tuple(a)], w, atol=1e-6) for a, w in zip(x, want, strict=True))
    with pytest.raises(ValueError):
        learned.choose_centres(rows, 0)


def _sweeps(spark, n, points):
    phase = np.cumsum(np.random.default_rng(points).uniform(-170, 170, (n, points, 4)), axis=1)
    s = np.exp(1j * np.radians(phase)).reshape(n, -1)
    rows = [(i, 2, [1e9 + k for k in range(points)], s[i].real.tolist(), s[i].imag.tolist()) for i in range(n)]
    return phase, spark.createDataFrame(rows, "sample_id long, n_ports int, f_hz array<double>, s_re array<double>, s_im array<double>")


def test_unwrapping_is_right_and_linear(spark):
    took = {}
    for points in (400, 4000):
        phase, df = _sweeps(spark, 8, points)
        best = float("inf")
        for _ in range(3):
            began = time.time()
            rows = transform.unwrapped_packed(df).collect()
            best = min(best, time.time() - began)
        took[points] = best
        for r in rows:
            got = np.array(r.s_deg).reshape(points, 4)
            assert np.allclose(np.diff(got, axis=0), np.diff(phase[r.sample_id], axis=0), atol=1e-6)
    assert took[4000] < 30 * took[400]


def test_unwrapping_of_nulls_and_odd_shapes(spark):
    nan = float("nan")
    rows = [
        (1, 1, [1.0, 2.0, 3.0], [-1.0, None, -1.0], [0.1, 0.0, -0.1]), (2, 1, [1.0, 2.0, 3.0], [-1.0, nan, -1.0], [0.1, 0.0, -0.1]), (3, 1, [], [], []),
        (4, None, [1.0], [1.0], [1.0]), (5, 1, [1.0], None, [1.0]), (6, 2, [1.0, 2.0], [-1.0] * 8, [0.1, 0.2, 0.3, 0.4, -0.1, -0.2, -0.3, -0.4]),
    ]
    df = spark.createDataFrame(rows, "sample_id long, n_ports int, f_hz array<double>, s_re array<double>, s_im array<double>")
    got = {r.sample_id: r.s_deg for r in transform.unwrapped_packed(df).collect()}
    assert got[1][1] is None and np.allclose([got[1][0], got[1][2]], np.degrees(np.arctan2([0.1, -0.1], -1)))
    assert np.isnan(got[2][1:]).all() and got[3] == [] and got[4] is None and got[5] is None
    points = {(r.k, r.i, r.j): r.deg for r in transform.unwrapped_deg(network.to_points(df.where("sample_id = 6"))).collect()}
    assert np.allclose(got[6], [points[k, i, j] for k in range(2) for i in range(2) for j in range(2)])


def test_resampling_to_targets_of_each_sample(spark):
    rng = np.random.default_rng(8)
    source, targets = [], []
    for s in range(5):
        f = np.sort(rng.uniform(1e9, 2e9, 6))
        for k, x in enumerate(f):
            source += [(s, k, float(x), 0, j, float(rng.normal()), float(rng.normal())) for j in range(2)]
        want = np.concatenate([f[:1], rng.uniform(f[0], f[-1], s), f[-1:], f[2:3]]) if s else []
        targets += [(s, k, float(x)) for k, x in enumerate(want)]
    targets += [(99, 0, 1e9)]
    points = spark.createDataFrame(source, "sample_id long, k long, f_hz double, i long, j long, re double, im double")
    out = transform.resample_targets(points, spark.createDataFrame(targets, "sample_id long, k long, f_hz double"))
    got = {(r.sample_id, r.k, r.j): (r.re, r.im) for r in out.collect()}
    assert len(got) == 2 * sum(t[0] != 99 for t in targets)
    for s, k, x in targets:
        for j in range(2):
            if s != 99:
                of = [r for r in source if r[0] == s and r[4] == j]
                assert np.allclose(got[s, k, j], [np.interp(x, [r[2] for r in of], [r[c] for r in of]) for c in (5, 6)])
    with pytest.raises(Exception, match="outside"):
        transform.resample_targets(points, spark.createDataFrame([(1, 0, 3e9)], "sample_id long, k long, f_hz double")).collect()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_boxes_by_index_equal_brute_force(spark, monkeypatch, dims):
    from sweeplane.operators import search

    rng = np.random.default_rng(dims)
    x = np.round(rng.uniform(-1, 1, (400, dims)), 2)
    x[:130] = x[0]  # a third of the points is one
    ok = x.sum(axis=1) > -0.5
    names = ["a", "b", "c"][:dims]
    cloud = spark.createDataFrame([(i, *map(float, p), bool(o)) for i, (p, o) in enumerate(zip(x, ok, strict=True))], f"point_id long, {', '.join(f'{v} double' for v in names)}, ok boolean")
    boxes = search.candidate_boxes(cloud.where("ok"), {v: 0.05 for v in names}, "asym")
    monkeypatch.setattr(search, "CELLS", 9**dims)
    monkeypatch.setattr(search, "BLOCK", 50)
    for r in search.score_boxes(boxes, cloud, names, direct=0).collect():
        within = np.all([(x[:, n] >= r[f"lo_{v}"]) & (x[:, n] <= r[f"hi_{v}"]) for n, v in enumerate(names)], axis=0)
        assert (r.inside, r.good) == (within.sum(), (within & ok).sum())
    assert search.score_boxes(boxes.where("false"), cloud, names, direct=0).count() == 0


def test_index_compares_few_pairs(spark):
    from sweeplane.operators import search

    x = np.random.default_rng(1).uniform(-1, 1, (3000, 2))
    cloud = spark.createDataFrame([(i, float(a), float(b), bool(abs(a) < 0.7)) for i, (a, b) in enumerate(x)], "point_id long, x double, y double, ok boolean")
    compared, pairs = search.compared_pairs(search.candidate_boxes(cloud.where("ok"), {"x": 0.0, "y": 0.0}), cloud, ["x", "y"])
    assert 0 < compared < pairs / 25
