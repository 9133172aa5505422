"""Registered queries against the SQL that states their results, on the smallest tables."""

import math
from pathlib import Path

import pytest

from strandline import registry

DATA = "/root/testdata/sf0.001"
#: A query of each family; the driver compares all of them.
NAMES = (
    "p01_reached", "p08_decision_changed", "p22_height_codec", "p28_relative_risk", "p33_in_ring", "s02_mosaic", "a02_block_mean", "g03_h_conn_tiled", "w07_min_filter", "g06_d8_directions",
    "g14_basin_outlets", "a26_pit_stats", "j01_assign_area", "j05_frontage", "slice_zone_flood", "a08_regulation_counts", "a13_usage_counts", "g23_graph_components", "g24_shortest_paths", "g17_upstream_closure",
    "j21_level_at", "w01_best_window", "s13_tide_lines", "s11_census_values", "t06_budget_prefix", "k07_index_upsert",
)


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if isinstance(v, int) else str(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no bench tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in con.fetchall()), key=str)
    assert sorted(names) == columns and got == want


def test_every_query_has_a_plan_module_and_most_have_sql():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries)
    assert len(queries) - len(sql) < 10
