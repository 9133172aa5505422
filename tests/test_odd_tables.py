"""Queries on small tables of their own, with what large or odd tables hold and the bench tables do not."""

import math
import random
import statistics
from pathlib import Path

from strandline import registry
from strandline.operators import polygons, raster, spatial

#: Suppliers 7 and 1007 (3 and 2003) stand at one place, so the edge between them has no length; nobody gets to 3 and 2003.
SAME_PLACE = {
    "supplier": ("s_suppkey long, s_nationkey int", [(7, 1), (1007, 2), (8, 2), (3, 2), (2003, 2)]),
    "lineitem": ("l_orderkey long, l_linenumber int, l_suppkey long", [(1, 1, 7), (1, 2, 1007), (2, 1, 1007), (2, 2, 8), (3, 1, 3), (3, 2, 2003)]),
}


def written(spark, folder, tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def agrees(spark, name, folder):
    """The query's rows, which are those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}/*.parquet'")
    con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    got = sorted(map(tuple, registry.queries()[name](spark, folder).select(*names).collect()))
    assert got == sorted(con.fetchall())
    return got


def test_partial_edges_without_length(spark, tmp_path):
    assert (7, 1007, 0, 1.0, 0.0) in agrees(spark, "g25_partial_edges", written(spark, tmp_path, SAME_PLACE))


def test_isochrone_outline_with_an_edge_without_length(spark, tmp_path):
    """What is reached goes from supplier 7 through 1007 to 8, in one ring with no hole."""
    rows = registry.queries()["g26_isochrone_outline"](spark, written(spark, tmp_path, SAME_PLACE)).collect()
    assert len(rows) == 1 and rows[0]["shell"] == rows[0]["ring"] and rows[0]["area"] > math.pi * 30 * 30


def test_walk_reach_with_an_edge_without_length(spark, tmp_path):
    ((edges, metres, nodes),) = agrees(spark, "g27_walk_reach", written(spark, tmp_path, SAME_PLACE))
    assert (edges, nodes) == (2, 2) and 0 < metres < 580


def test_content_hashes_of_ids_beyond_two_levels(spark, tmp_path):
    """Ids of 65536 and more: the SQL hashes blocks of 256 lines, then all blocks of a nation at once."""
    keys = [*range(0, 1500, 7), *range(65_000, 65_600), 131_072, 20_000_000]
    customers = [(i, i % 3, "BUILDING") for i in keys]
    assert len(agrees(spark, "k09_content_hash", written(spark, tmp_path, {"customer": ("c_custkey long, c_nationkey int, c_mktsegment string", customers)}))) == 3


def test_content_hashes_of_a_level_or_two(spark, tmp_path):
    for most in (200, 256, 5000):
        (tmp_path / str(most)).mkdir()
        customers = [(i, i % 3, "BUILDING") for i in range(most)]
        agrees(spark, "k09_content_hash", written(spark, tmp_path / str(most), {"customer": ("c_custkey long, c_nationkey int, c_mktsegment string", customers)}))


def test_despiking_neither_joins_nor_broadcasts_the_grid(spark):
    """A grid's file is much smaller than its rows in memory, so a join of grids may broadcast what no driver holds."""
    rng = random.Random(5)
    cells = {(r, c): rng.choice([None, rng.randrange(0, 2000, 10)]) for r in range(12) for c in range(9) if rng.random() < 0.8}
    out = raster.despiked(spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, elev long"), 1, 400)
    assert out.columns == ["row", "col", "elev"] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for (r, c), z in cells.items():
        around = [v for (a, b), v in cells.items() if abs(a - r) <= 1 and abs(b - c) <= 1 and v is not None]
        want[r, c] = None if z is not None and statistics.median(around) - z > 400 else z
    assert {(r["row"], r["col"]): r["elev"] for r in out.collect()} == want and want != cells


def parts(keys):
    rng = random.Random(3)
    return {"part": ("p_partkey long, p_size int", [(k, rng.randrange(1, 50)) for k in keys])}


def test_nearest_water_of_a_grid_with_gaps_compares_no_pairs(spark, tmp_path, monkeypatch):
    """Rows of 20 cells; a third of them are missing, and so are the last row's ends."""
    monkeypatch.setattr(spatial, "near_pairs", None)
    rng = random.Random(11)
    (tmp_path / "gaps").mkdir()
    assert len(agrees(spark, "j12_nearest_water", written(spark, tmp_path / "gaps", parts([k for k in range(1, 509) if rng.random() < 0.66 or k % 100 == 0])))) > 200
    (tmp_path / "dry").mkdir()
    assert agrees(spark, "j12_nearest_water", written(spark, tmp_path / "dry", parts([k for k in range(300) if k % 20]))) == []


def streets(copies):
    """Suppliers and customers at few places, each of them ``copies`` times by keys that are 7000 apart."""
    places = [(k, k + 7000 * n) for n in range(copies) for k in range(0, 90, 3)]
    return {
        "supplier": ("s_suppkey long, s_nationkey int", [(s, 1) for k, s in places]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(s + 1, 1, "BUILDING") for k, s in places]),
    }


def test_like_shapes_are_compared_once(spark, tmp_path, monkeypatch):
    compared = []
    plain = polygons.shapes_within

    def watched(left, right, *rest):
        compared.append((left.count(), right.count()))
        return plain(left, right, *rest)

    monkeypatch.setattr(polygons, "shapes_within", watched)
    rows = agrees(spark, "j05_line_frontage", written(spark, tmp_path, streets(4)))
    assert compared == [(30, 22)] and rows and all(n % 4 == 0 for r in rows for n in r[1:])


def watched_pairs(monkeypatch):
    """Rows of both sides of every comparison by distance, and the distance."""
    compared = []
    plain = spatial.near_pairs

    def near_pairs(left, right, distance):
        compared.append((left.count(), right.count(), distance))
        return plain(left, right, distance)

    monkeypatch.setattr(spatial, "near_pairs", near_pairs)
    return compared


def test_points_at_one_place_are_searched_once(spark, tmp_path, monkeypatch):
    compared = watched_pairs(monkeypatch)
    rows = agrees(spark, "j16_nearest_node", written(spark, tmp_path, streets(4)))
    assert len(rows) == 120 and max(r[1] for r in rows) < 90
    assert compared[0][:2] == (30, 30) and all(c[0] < 30 for c in compared[1:])


def test_dense_points_are_searched_nearby(spark, monkeypatch):
    """A lattice of places, some with two ids: the first radius holds few of them; points far off are found in later rounds."""
    compared = watched_pairs(monkeypatch)
    to = [(40 * r + k + d, 2.0 * k, 2.0 * r) for r in range(40) for k in range(40) for d in ((0, 5000) if k % 7 == 0 else (5000,))]
    rng = random.Random(4)
    at = [(i, rng.choice([1.0, 1.7, 30.0, 77.7]), rng.choice([3.0, 40.5, 79.0])) for i in range(50)] + [(90, 5000.0, -9.0), (91, None, 3.0), (92, 8.0, None)]
    got = spatial.nearest_anywhere(spark.createDataFrame(at, "id long, x double, y double"), spark.createDataFrame(to, "rid long, rx double, ry double"), 1000.0).collect()
    want = {i: min((math.hypot(x - rx, y - ry), rid) for rid, rx, ry in to) if x is not None and y is not None else (None, None) for i, x, y in at}
    assert len(got) == len(at) and all(r["rid"] == want[r["id"]][1] and (r["d"] is None) == (want[r["id"]][0] is None) for r in got)
    assert all(r["d"] is None or abs(r["d"] - want[r["id"]][0]) < 1e-9 for r in got)
    assert compared[0][1] == 1600 and compared[0][2] < 20 and compared[-1][0] == 1


def test_frontage_counts_points_at_one_place_together(spark, tmp_path, monkeypatch):
    compared = watched_pairs(monkeypatch)
    tables = streets(4)
    tables["customer"][1].extend((s + 40 * 7000, 1, "BUILDING") for s, _ in tables["supplier"][1])
    rows = agrees(spark, "j05_frontage", written(spark, tmp_path, tables))
    assert len(rows) == 120 and any(r[2] for r in rows) and all(n % 4 == 0 for r in rows for n in r[2:])
    assert compared[0][:2] == (30, 60) and all(n <= 30 and m == 60 for n, m, _ in compared)


def test_status_by_the_nearest_road_of_a_place(spark, tmp_path, monkeypatch):
    compared = watched_pairs(monkeypatch)
    rows = agrees(spark, "m05_isochrone_status", written(spark, tmp_path, streets(4)))
    assert len(rows) == 120 and {r[1] for r in rows} == {"ok", "no_nearby_road", "outside_aoi"}
    assert compared == [(30, 30, 40.0)]
