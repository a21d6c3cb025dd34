"""Every tracking query against its SQL in DuckDB, over the same tables."""

import duckdb
import pytest

from trackweave.queries import QUERIES, SQL

TABLES = ("events", "embeddings", "part", "supplier", "orders")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(value):
    return round(float(value), 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({SQL[name]}) AS q").fetchall()
    rows = sorted((tuple(plain(v) for v in r) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=repr)


@pytest.mark.parametrize("name", ["jon03_best_iou", "jon07_stitch_candidates", "jon08_helmet_hits", "jon10_overlapping_pairs", "jon17_rows_of_segments", "jon19_neighbours", "win15_flips_at_cuts"])
def test_range_joins_are_equi_joins(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_events_scan_is_pruned(spark, sf):
    plan = QUERIES["agg01_per_frame"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema: struct<")[1].split(">")[0]
