"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sweeplane.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(rows, columns):
    key = lambda v: "" if v is None else str(round(v, 4) + 0.0) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    as_number = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted(tuple(key(as_number(r[c])) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, (float(v) if type(v).__name__ == "Decimal" else v for v in r), strict=True)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    a, b = _plain(rows, sorted(names)), _plain(want, sorted(names))
    assert len(a) == len(b)
    assert a == b


def test_band_is_cut_before_exploding_and_scan_is_pruned(spark):
    plan = QUERIES["flagship_yield_by_family"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan
    assert "Python" not in plan and "Arrow" not in plan
    narrow = QUERIES["split_members"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<vec_id:bigint>" in narrow
    report = QUERIES["touchstone_params"].__name__ and QUERIES["constraint_filter"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,5.0)]" in report and "l_orderkey" not in report.split("ReadSchema")[-1]


def test_sweeps_are_resampled_and_scanned_within_their_rows(spark):
    for name in ("resample_uniform", "resample_grid", "resample_bent", "s_real_imag", "s_deg_packed"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Pandas" not in plan


def test_entry_module_lists_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 110
