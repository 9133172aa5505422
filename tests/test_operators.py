import heapq
import math
import random

import numpy as np
import pytest

from strandline.operators import flow, networks, raster, spatial
from strandline.sources import parsers
from strandline.streaming import levels


def grid(seed, rows, cols):
    rng = random.Random(seed)
    return {(r, c): None if rng.random() < 0.06 else rng.randrange(-200, 3300, 10) for r in range(rows) for c in range(cols)}


def brute_levels(elev, sources):
    best, heap = dict(sources), [(h, rc) for rc, h in sources.items()]
    heapq.heapify(heap)
    while heap:
        h, (r, c) = heapq.heappop(heap)
        if h > best[(r, c)]:
            continue
        for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            z = elev.get(n)
            if z is not None:
                new = max(h, math.ceil(max(z, 0) / 50) * 50)
                if new <= 3000 and new < best.get(n, math.inf):
                    best[n] = new
                    heapq.heappush(heap, (new, n))
    return best


def test_connection_levels_over_tiles(spark):
    elev = grid(1, 17, 23)
    cells = spark.createDataFrame([(r, c, z, c == 0 and z is not None) for (r, c), z in elev.items()], "row long, col long, elev long, seed boolean")
    outfalls = spark.createDataFrame([(8, 15, 420), (3, 20, 9000)], "row long, col long, invert long")
    want = brute_levels(elev, {rc: 0 for rc, z in elev.items() if rc[1] == 0 and z is not None} | {(8, 15): 450})
    for tile in (256, 6):
        got = {(r["row"], r["col"]): r["h"] for r in raster.connection_levels(cells, outfalls, tile=tile).collect()}
        assert len(got) == len(elev)
        assert {k: v for k, v in got.items() if v is not None} == want


def test_flow_conserves_and_fills(spark):
    elev = grid(2, 12, 14)
    cells = spark.createDataFrame([(r, c, z) for (r, c), z in elev.items()], "row long, col long, elev long")
    fill = {(r["row"], r["col"]): (r["elev"], r["fill"]) for r in flow.filled(cells, tile=5).collect()}
    assert all(f >= e for e, f in fill.values()) and len(fill) == sum(z is not None for z in elev.values())
    d = flow.facet_directions(cells).collect()
    for r in d:
        if r["slope"] is not None:
            assert r["slope"] > 0 and abs(r["p1"] + r["p2"] - 1) < 1e-12 and 0 <= r["p2"] <= 1
            assert elev[(r["to1"]["row"], r["to1"]["col"])] is not None and elev[(r["to2"]["row"], r["to2"]["col"])] is not None
    node = lambda r, c: r * 1000 + c
    edges = [(node(r["row"], r["col"]), node(r["to_row"], r["to_col"])) for r in flow.directions(cells).collect() if r["to_row"] is not None]
    nodes = [node(*k) for k, z in elev.items() if z is not None]
    acc = flow.accumulated(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, share double"), spark.createDataFrame([(n, 1.0) for n in nodes], "node long, w double"))
    doubled = flow.accumulated_paths(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n, 1.0) for n in nodes], "node long, w double"))
    assert sorted(map(tuple, doubled.collect())) == sorted(map(tuple, acc.collect()))
    ends = set(nodes) - {a for a, _ in edges}
    assert sum(r["acc"] for r in acc.collect() if r["node"] in ends) == len(nodes)


def test_long_paths_and_cycles(spark):
    chain = [(n, n + 1) for n in range(700)]
    acc = flow.accumulated_paths(spark.createDataFrame(chain, "a long, b long"), spark.createDataFrame([(n, 1.0) for n in range(701)], "node long, w double"))
    assert {r["node"]: r["acc"] for r in acc.collect()} == {n: n + 1.0 for n in range(701)}
    donors = spark.createDataFrame([(b, a, 1, 0) for a, b in chain] + [(5000, 3, 1, 1)], "a long, b long, acc long, k long")
    starts = spark.createDataFrame([(0,), (690,)], "node long")
    want = sorted([(0, i, i) for i in range(701)] + [(690, i, 690 + i) for i in range(11)])
    assert sorted(map(tuple, networks.main_channel(donors, starts).collect())) == want
    ring = spark.createDataFrame([(0, 1), (1, 0)], "a long, b long")
    with pytest.raises(RuntimeError):
        flow.accumulated_paths(ring, spark.createDataFrame([(0, 1.0)], "node long, w double"))


def test_circle_overlap_matches_sampling(spark):
    boxes = [(i, float(x), float(y), float(x) + 30.0, float(y) + 20.0) for i, (x, y) in enumerate((a, b) for a in np.arange(-60.0, 60.0, 30) for b in np.arange(-60.0, 60.0, 20))]
    df = spark.createDataFrame(boxes, "area int, xmin double, ymin double, xmax double, ymax double")
    rows = {r["area"]: r["overlap"] for r in spatial.circle_overlap(df, 3.0, -2.0, 40.0).collect()}
    assert abs(sum(rows.values()) - math.pi * 1600) < 1e-6
    for i, x0, y0, x1, y1 in boxes:
        gx, gy = np.meshgrid(np.linspace(x0, x1, 400, endpoint=False) + (x1 - x0) / 800, np.linspace(y0, y1, 400, endpoint=False) + (y1 - y0) / 800)
        share = (((gx - 3) ** 2 + (gy + 2) ** 2) <= 1600).mean() * 600
        assert abs(rows.get(i, 0.0) - share) < 2.0


def test_text_formats(spark, tmp_path):
    (tmp_path / "census.csv").write_bytes("地域,人口\nコード,総数\n001,X\n".encode("cp932"))
    rows = parsers.census_table(spark, str(tmp_path / "census.csv")).orderBy("line").collect()
    assert [list(r["fields"]) for r in rows] == [["地域", "人口"], ["コード", "総数"], ["001", "X"]]
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:6674"}},"features":[{"type":"Feature","properties":{"pit_id":"3","area_ha":"0.5"},"geometry":{"type":"Point","coordinates":[1.0,2.0,0.75]}},{"type":"Feature","properties":{"pit_id":"4","unreliable":"true"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    pits = parsers.pits_of(parsers.feature_collection(spark, str(tmp_path / "f.json"), "EPSG:6674")).collect()
    assert [(p["pit_id"], p["x"], p["spill"], p["area"]) for p in pits] == [(3, 1.0, 0.75, 5000.0)]
    (tmp_path / "city.xml").write_text('<c><Building id="b1"><usage>411</usage><measuredHeight>3.5</measuredHeight><lod0RoofEdge>35.0 135.0 1 35.1 135.1 1</lod0RoofEdge></Building></c>')
    b = parsers.city_objects(spark, str(tmp_path / "city.xml"), "Building").collect()
    assert b[0]["gml_id"] == "b1" and b[0]["usage"] == "411" and b[0]["ring"] == [[35.0, 135.0, 1.0], [35.1, 135.1, 1.0]]


def test_hourly_peaks_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", f"2024-01-01 0{h}:{m:02d}:00", 100 * h + m) for h in range(4) for m in (0, 30)], "series string, ts string, level long").selectExpr("series", "cast(ts as timestamp) as ts", "level").write.parquet(str(source))
    stream = levels.hourly_peaks(spark.readStream.schema("series string, ts timestamp, level long").parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("peaks").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["peak"] for r in spark.table("peaks").collect()) == [30, 130, 230, 330]
    known = spark.createDataFrame([(0,), (100,), (100,), (310,), (9000,), (None,)], "h long")
    high = spark.table("peaks").union(spark.createDataFrame([("b", None, 50_000), ("b", None, -60)], spark.table("peaks").schema))
    got = {r["peak"]: r["flooded"] for r in levels.flooded_counts(high, known).collect()}
    assert got == {30: 1, 130: 3, 230: 3, 330: 4, 50_000: 5}


def test_region_rings_and_shared_areas(spark):
    from strandline.functions import geo
    from strandline.operators import polygons

    rows = ["#####..", "#...#..", "#.#.#..", "#...#.#", "#####.."]
    cells = spark.createDataFrame([(r, k, 1 if x == "#" else None) for r, line in enumerate(rows) for k, x in enumerate(line)], "row long, col long, v int")
    got = sorted((r["sides"], r["area"]) for r in polygons.region_rings(cells, "v").collect())
    assert got == [(4, 1.0), (4, 1.0), (12, -9.0), (20, 25.0)]
    square = spark.sql("select array(named_struct('x', -1D, 'y', -1D), named_struct('x', 1D, 'y', -1D), named_struct('x', 1D, 'y', 1D), named_struct('x', -1D, 'y', 1D)) as ring")
    for radius, want in ((0.5, 3.14159265 * 0.25), (5.0, 4.0)):
        assert abs(square.select(geo.circle_area(square["ring"], 0.0, 0.0, radius)).first()[0] - want) < 1e-6
    assert abs(square.select(geo.circle_area(square["ring"], 1.0, 0.0, 0.5)).first()[0] - 3.14159265 * 0.125) < 1e-6


def test_numbers_and_sums_in_one_order(spark):
    from pyspark.sql import functions as F

    from strandline.operators import order

    df = spark.range(1000).withColumn("v", (F.col("id") * 7919 % 1000))
    got = {r["id"]: r["n"] for r in order.numbered(df, [F.desc("v")], "n").collect()}
    assert got == {i: 1000 - i * 7919 % 1000 for i in range(1000)}
    got = {r["v"]: r["s"] for r in order.running_sums(df, [F.col("v")], {"s": F.col("v") * 2}).collect()}
    assert got == {v: v * (v + 1) for v in range(1000)}
    assert order.numbered(df.where("id < 0"), [F.col("v")], "n").count() == 0
