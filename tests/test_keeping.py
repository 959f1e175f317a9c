"""Summaries that follow appends, snapshots, chunked arrays, tables in buckets, and the search along axes."""

import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweeplane.operators import design, network, search
from sweeplane.operators.rollup import Rollup
from sweeplane.sources import chunks, indexed, snapshot


def _values(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, n), rng.integers(0, 2, n)
    v = rng.normal(1e9, 1, n)
    rows = [(None if x == 2 else str(x), int(y), None if i % 11 == 0 else math.nan if i % 13 == 0 else float(z)) for i, (x, y, z) in enumerate(zip(a, b, v, strict=True))]
    return rows, spark.createDataFrame(rows, "a string, b int, v double").repartition(5)


def _plain(rows, by):
    groups = {}
    for a, b, v in rows:
        groups.setdefault(tuple({"a": a, "b": b}[c] for c in by), []).append(v)
    out = {}
    for key, vs in groups.items():
        x = np.array([v for v in vs if v is not None and not math.isnan(v)])
        out[key] = (len(x), len(vs) - len(x), x.mean(), x.std(), x.min(), x.max())
    return out


def test_rollup_of_batches_is_that_of_all_rows(spark, tmp_path):
    rows, df = _values(spark)
    r, path = Rollup(("a", "b"), "v"), str(tmp_path / "states")
    for n in range(4):
        r.append(df.where(F.pmod(F.xxhash64("v", "a", "b"), F.lit(4)) == n), path, f"x{n}")
    r.append(df.where(F.pmod(F.xxhash64("v", "a", "b"), F.lit(4)) == 1), path, "x1")  # tried anew
    states = r.stored(spark, path)
    for by in (("a", "b"), ("a",), ("b",), ()):
        got = {tuple(x[c] for c in by): x for x in r.finish(r.merge(states, by), (0.0, 0.5, 1.0)).collect()}
        want = _plain(rows, by)
        assert got.keys() == want.keys()
        for key, (n, missing, mean, std, lo, hi) in want.items():
            x = got[key]
            assert (x.n, x.nan_n, x.lo, x.hi) == (n, missing, lo, hi)
            # About 1e9 a sum of squares would have lost the deviation altogether.
            assert abs(x["mean"] - mean) < 1e-5 and abs(x["std"] - std) < 1e-6
            assert x.q_0 == lo and x.q_2 == hi and abs(x.q_1 - mean) < 0.3
    r.compact(spark, path, str(tmp_path / "less"))
    less = r.stored(spark, str(tmp_path / "less"))
    assert less.count() == len(_plain(rows, ("a", "b")))
    level = lambda s: sorted((x.level, str(x.a), str(x.b), x.n) for x in r.sets(s, [("a",), ()]).collect())
    assert level(less) == level(states)


def test_rollup_of_odd_tables(spark, tmp_path):
    r = Rollup(("a",), "v")
    empty = spark.createDataFrame([], "a string, v double")
    assert r.merge(r.states(empty)).count() == 0
    (none,) = r.finish(r.merge(r.states(spark.createDataFrame([("x", None), ("x", math.nan)], "a string, v double"))), (0.5,)).collect()
    assert (none.n, none.nan_n, none["mean"], none["std"], none.lo, none.q_0) == (0, 2, None, None, None, None)
    # A batch without any value beside one with values.
    both = r.states(spark.createDataFrame([("x", None)], "a string, v double")).unionByName(r.states(spark.createDataFrame([("x", 2.0), ("x", 4.0)], "a string, v double")))
    (x,) = r.finish(r.merge(both), (0.5,)).collect()
    assert (x.n, x.nan_n, x["mean"], x["std"]) == (2, 1, 3.0, 1.0)
    for keys in (("n",), ("a", "a"), ("__a",)):
        with pytest.raises(ValueError):
            Rollup(keys, "v")
    with pytest.raises(ValueError):
        r.merge(both, ["b"])


def _tree(folder):
    return {os.path.relpath(os.path.join(at, f), folder): open(os.path.join(at, f), "rb").read() for at, _, files in os.walk(folder) for f in files}


def test_snapshots_share_contents_and_restore_bit_for_bit(spark, tmp_path):
    folder, home = tmp_path / "data it's", str(tmp_path / "home")
    (folder / "x=1").mkdir(parents=True)
    (folder / "a.bin").write_bytes(b"one")
    (folder / "x=1" / "b c.bin").write_bytes(b"one")
    (folder / "x=1" / "big.bin").write_bytes(os.urandom(3 * snapshot.PIECE + 7))
    (folder / "empty.bin").write_bytes(b"")
    (folder / "_temporary").mkdir()
    first = _tree(folder)
    assert snapshot.take_snapshot(spark, str(folder), home, "first").count() == 4
    assert len([f for f in os.listdir(f"{home}/objects") if f[0] != "."]) == 3
    (folder / "a.bin").write_bytes(b"three")
    (folder / "new.bin").write_bytes(b"4")
    (folder / "empty.bin").unlink()
    snapshot.take_snapshot(spark, str(folder), home, "second", since="first")
    assert {(r.path, r.change) for r in snapshot.changes(spark, home, "first", "second").collect()} == {("a.bin", "changed"), ("new.bin", "added"), ("empty.bin", "removed")}
    second = _tree(folder)
    for name, want in (("first", first), ("second", second)):
        (folder / "_temporary" / "half.bin").write_bytes(b"5")
        back = str(tmp_path / f"back_{name}")
        assert snapshot.restore(spark, home, name, back) == len(want)
        assert _tree(back) == want
    with pytest.raises(Exception, match="exist"):
        snapshot.take_snapshot(spark, str(folder), home, "first")
    with pytest.raises(FileExistsError):
        snapshot.restore(spark, home, "first", str(folder))
    with pytest.raises(ValueError):
        snapshot.take_snapshot(spark, str(folder), home, "../x")


def test_damage_is_found_and_nothing_is_left_of_a_failed_restore(spark, tmp_path):
    folder, home = tmp_path / "data", str(tmp_path / "home")
    folder.mkdir()
    for n in range(6):
        (folder / f"{n}.bin").write_bytes(bytes([n]) * 1000)
    rows = {r.path: r.sha256 for r in snapshot.take_snapshot(spark, str(folder), home, "one").collect()}
    assert {r.state for r in snapshot.verify(spark, home, "one").collect()} == {"ok"}
    with open(f"{home}/objects/{rows['2.bin']}", "r+b") as f:
        f.write(b"x")
    os.remove(f"{home}/objects/{rows['4.bin']}")
    state = {r.sha256: r.state for r in snapshot.verify(spark, home, "one").collect()}
    assert (state[rows["2.bin"]], state[rows["4.bin"]], state[rows["0.bin"]]) == ("damaged", "missing", "ok")
    before = sorted(os.listdir(tmp_path))
    with pytest.raises(Exception):
        snapshot.restore(spark, home, "one", str(tmp_path / "back"))
    assert sorted(os.listdir(tmp_path)) == before


def _nets(spark, ids, grid=(1e9, 2e9, 3e9, 4e9, 5e9), ports=2):
    rows = []
    for i in ids:
        s = np.random.default_rng(abs(i)).normal(size=(len(grid), ports * ports, 2))
        rows.append((i, None, ports, "GHz", "power", [50.0] * ports, [0.0] * ports, [], {"w": float(i)}, {}, list(grid), s[..., 0].ravel().tolist(), s[..., 1].ravel().tolist()))
    return spark.createDataFrame(rows, network.NETWORK_SCHEMA).repartition(3)


def test_array_round_trip_and_selections(spark, tmp_path):
    ids = [-7, -1, 0, 1, 5, 9, 10, 11, 12345678901234567]
    nets, path = _nets(spark, ids, ports=3), str(tmp_path / "array")
    chunks.write_chunks(nets, path, (4, 2, 4))
    every = lambda df: sorted(map(tuple, df.select("sample_id", "k", "f_hz", "i", "j", "re", "im").collect()))
    want = every(network.to_points(nets))
    assert every(chunks.read_chunks(spark, path)) == want
    some = chunks.read_chunks(spark, path, (1.5e9, 3e9), [(2, 1), (0, 0)], (-1, 10))
    assert every(some) == [r for r in want if 1.5e9 <= r[2] <= 3e9 and r[3:5] in ((2, 1), (0, 0)) and -1 <= r[0] <= 10]
    assert chunks.read_chunks(spark, path, (8e9, 9e9)).count() == 0
    with pytest.raises(ValueError):
        chunks.read_chunks(spark, path, pairs=[(3, 0)])


def test_a_band_opens_its_chunks_alone(spark, tmp_path):
    path = str(tmp_path / "array")
    chunks.write_chunks(_nets(spark, range(20)), path, (8, 2, 1))
    for at, _, files in os.walk(f"{path}/data"):
        for f in files:
            if "f_chunk=0" not in at or "p_chunk=2" not in at:
                os.remove(os.path.join(at, f))
                if f.endswith(".parquet"):
                    open(os.path.join(at, f), "w").write("no table")
    assert chunks.read_chunks(spark, path, (1e9, 2e9), [(1, 0)]).count() == 40
    with pytest.raises(Exception):
        chunks.read_chunks(spark, path, (1e9, 3e9), [(1, 0)]).collect()


def test_arrays_refuse_what_they_cannot_hold(spark, tmp_path):
    mixed = _nets(spark, [1]).unionByName(_nets(spark, [2], (1e9, 2e9)))
    for n, (nets, error) in enumerate([(mixed, "one grid"), (_nets(spark, [1]).limit(0), "no sample"), (_nets(spark, [3, 3]), "repeated"), (_nets(spark, [1]).withColumn("sample_id", F.lit(None).cast("long")), "ids")]):
        with pytest.raises(Exception, match=error):
            chunks.write_chunks(nets, str(tmp_path / str(n)))
    with pytest.raises(FileNotFoundError):
        chunks.read_chunks(spark, str(tmp_path / "2"))  # its data failed: no grid was written


@pytest.fixture
def bucketed(spark, tmp_path):
    name, path = f"nets_{uuid.uuid4().hex}", str(tmp_path / "indexed")
    indexed.write_indexed(_nets(spark, range(200)), name, path, buckets=8)
    yield name, path
    spark.sql(f"DROP TABLE {name}")


def test_lookup_opens_the_buckets_of_its_ids(spark, bucketed):
    name, path = bucketed
    got = indexed.take(spark, name, [7, 3, 7, None, 999]).orderBy("position").select("position", "sample_id", "params").collect()
    assert [(r.position, r.sample_id, r.params["w"]) for r in got] == [(0, 7, 7.0), (1, 3, 3.0), (2, 7, 7.0)]
    own = spark.table(name).where("sample_id = 7").select(F.input_file_name()).first()[0].rsplit("/", 1)[1]
    for f in os.listdir(path):
        if f != own and f.endswith(".parquet"):
            open(f"{path}/{f}", "w").write("no table")
            os.path.exists(f"{path}/.{f}.crc") and os.remove(f"{path}/.{f}.crc")
    assert indexed.take(spark, name, [7]).count() == 1


def test_long_lists_and_joins_leave_stored_rows_in_place(spark, bucketed, monkeypatch):
    name, _ = bucketed
    monkeypatch.setattr(indexed, "FILTER_IDS", 2)
    many = lambda: indexed.take(spark, name, [5, 199, 5, 0])
    assert sorted((r.position, r.sample_id) for r in many().collect()) == [(0, 5), (1, 199), (2, 5), (3, 0)]
    listed = spark.range(50).select(F.col("id").alias("position"), (F.col("id") * 3).alias("sample_id"))
    for df in (many(), indexed.take(spark, name, listed)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert indexed.take(spark, name, listed).count() == 50
    both = spark.table(name).join(spark.table(name).select("sample_id", F.col("params").alias("p")).hint("merge"), "sample_id")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 200
    assert indexed.take(spark, name, []).count() == 0


def _cloud(spark, x, ok):
    rows = [(*map(float, p), None if o is None else bool(o)) for p, o in zip(x, ok, strict=True)]
    return spark.createDataFrame(rows, "x double, y double, ok boolean").repartition(4)


def test_axis_zoom_is_exact_and_widest_where_all_must_pass(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, 2))
    ok = np.abs(x[:, 0]) + 0.5 * np.abs(x[:, 1]) <= 0.5
    box = search.axis_zoom(_cloud(spark, x, ok), {"x": 0.0, "y": 0.0}, 1.0, bins=16, zooms=10)
    d, h = np.abs(x), np.array([box.half["x"], box.half["y"]])
    within = (d <= h).all(axis=1)
    assert box.converged and box.inside == box.good == within.sum() and ok[within].all() and box.inside > 100
    for v in (0, 1):
        beyond = (d[:, v] > h[v]) & (d[:, 1 - v] <= h[1 - v])
        assert not ok[beyond][np.argmin(d[beyond, v])]


@pytest.mark.parametrize("alpha", [0.8, 0.95])
def test_axis_zoom_equals_a_scan_of_all_distances_along_one_axis(spark, alpha):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (800, 2)), 1)
    ok = (np.abs(x[:, 0] - 0.2) <= 1) & (rng.random(800) < 0.97)
    box = search.axis_zoom(_cloud(spark, x, ok), {"x": 0.2}, alpha)
    d = np.abs(x[:, 0] - 0.2)
    fit = [h for h in np.unique(d) if ok[d <= h].sum() >= alpha * (d <= h).sum()]
    assert box.half["x"] == max(fit) and box.inside == (d <= max(fit)).sum() and box.good == ok[d <= max(fit)].sum()


def test_axis_zoom_of_odd_clouds(spark):
    center = {"x": 0.0, "y": 0.0}
    # Only the two nearest of many points on a diagonal pass: sizes are taken anew below the least.
    x = np.stack([np.arange(1, 2001), np.arange(1, 2001)], axis=1) / 100
    box = search.axis_zoom(_cloud(spark, x, np.arange(2000) < 2), center, 1.0, bins=8)
    assert (box.half, box.inside) == ({"x": 20.0, "y": 0.02}, 2)
    # All pass, a point has no coordinate, verdicts are missing, the centre itself is a point.
    box = search.axis_zoom(_cloud(spark, [(0, 0), (1, 2), (math.nan, 0), (5, 5)], [1, 1, 1, None]), center, 1.0)
    assert (box.half, box.inside, box.good) == ({"x": 5.0, "y": 2.0}, 2, 2)
    for cloud in (_cloud(spark, [], []), _cloud(spark, [(1, 1)], [0])):
        with pytest.raises(RuntimeError):
            search.axis_zoom(cloud, center, 0.5)
    short = search.axis_zoom(_cloud(spark, x, np.ones(2000)), center, 1.0, bins=4, rounds=1)
    assert not short.converged or short.inside == 2000
    with pytest.raises(ValueError):
        search.axis_zoom(_cloud(spark, x, np.ones(2000)), center, 0.0)


def test_space_of_a_table(spark):
    df = spark.createDataFrame([(1, 2.0, None), (5, math.nan, None), (None, -3.0, None)], "a int, b double, c double")
    assert {n: v.bounds for n, v in design.DesignSpace.of_table(df, ["b", "a"]).variables.items()} == {"b": (-3.0, 2.0), "a": (1.0, 5.0)}
    for rows, columns in ((df, ["c"]), (df.limit(0), ["a"]), (df.where("a = 1"), ["a"])):
        with pytest.raises(ValueError):
            design.DesignSpace.of_table(rows, columns)
