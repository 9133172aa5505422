"""Distance fields, outlines, coalesced ranges and pruned trees against direct computations."""

import math
import random

import pytest

from strandline.operators import distance, hierarchy, networks, polygons, pyramid, ranges


def mask_frame(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, v int")


@pytest.mark.parametrize("share", [0.02, 0.3])
def test_every_cell_knows_its_nearest_seed(spark, share):
    rng = random.Random(3)
    cells = {(r, c): rng.random() < share for r in range(19) for c in range(27)}
    seeds = [k for k, s in cells.items() if s]
    df = spark.createDataFrame([(*k, s) for k, s in cells.items()], "row long, col long, seed boolean").repartition(5)
    for r in distance.seed_field(df).collect():
        k = (r["row"], r["col"])
        want = min((math.dist(k, s) ** 2, s[1], s[0]) for s in seeds)
        assert (r["d2"], r["seed_col"], r["seed_row"]) == (round(want[0]), want[1], want[2])
    none = distance.seed_field(df.selectExpr("row", "col", "false as seed")).select("d2").distinct().collect()
    assert [r["d2"] for r in none] == [None]
    grown = {(r["row"], r["col"]) for r in distance.within(df, "seed", 2.5).where("grown").collect()}
    assert grown == {k for k in cells if min(math.dist(k, s) for s in seeds) <= 2.5}
    slopes = {(r["row"], r["col"]): r for r in distance.gradient(distance.seed_field(df)).collect()}
    d = {k: min(math.dist(k, s) for s in seeds) for k in cells}
    assert all(abs(slopes[(5, c)]["d_col"] - (d[(5, c + 1)] - d[(5, c - 1)]) / 2) < 1e-9 for c in range(1, 26))
    assert all(abs(slopes[(0, c)]["d_row"] - (d[(1, c)] - d[(0, c)])) < 1e-9 for c in range(27))


def test_sections_cross_the_shore(spark):
    """A shore along a diagonal: the line through the lowest cell inland runs at right angles to it."""
    cells = [(r, c, r + c < 8, float(abs(r - 9) + abs(c - 9))) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(cells, "row long, col long, seed boolean, h double")
    (line,) = distance.first_section(df.select("row", "col", "h"), distance.seed_field(df), 2.0, 1.0, 10.0, 20.0).collect()
    assert (line["row"], line["col"]) == (9, 9)
    dx, dy = line["to_x"] - line["from_x"], line["to_y"] - line["from_y"]
    assert abs(math.hypot(dx, dy) - 30) < 0.2 and abs(dx + dy) < 0.2 and dx > 0
    assert distance.first_section(df.selectExpr("row", "col", "cast(null as double) as h"), distance.seed_field(df), 2.0, 1.0, 10.0, 20.0).count() == 0


def rings_of(rows):
    rings = {}
    for r in rows:
        rings.setdefault((r["label"], r["shell"], r["ring"]), {})[r["place"]] = (r["row"], r["col"])
    return {k: [p for _, p in sorted(v.items())] for k, v in rings.items()}


def inside(ring, y, x):
    hit = False
    for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (r0 > y) != (r1 > y) and x < (c1 - c0) * (y - r0) / (r1 - r0) + c0:
            hit = not hit
    return hit


def shoelace(ring):
    return sum(c1 * r0 - c0 * r1 for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_outlines_rebuild_the_mask(spark, seed):
    rng = random.Random(seed)
    cells = {(r, c): rng.choice([None, 1, 1, 2] if seed == 1 else [None, 1, 1, 1]) for r in range(9) for c in range(11)}
    corners = polygons.outlines(mask_frame(spark, cells), "v").cache()
    rings = rings_of(corners.collect())
    areas = {r["ring"]: r["area"] for r in corners.collect()}
    for (label, shell, ring), line in rings.items():
        assert (areas[ring] > 0) == (shell == ring) and abs(shoelace(line)) == abs(areas[ring]) and math.copysign(1, shoelace(line)) == math.copysign(1, areas[ring]) * math.copysign(1, shoelace(rings[(label, shell, shell)]))
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(line, line[1:] + line[:1], strict=True))
    for (r, c), v in cells.items():
        around = {label for (label, shell, ring) in rings if sum(inside(line, r + 0.5, c + 0.5) for (la, s, _), line in rings.items() if (la, s) == (label, shell)) % 2}
        assert around == ({v} if v else set())
    # holes lie in the shell of their region
    for (label, shell, ring), line in rings.items():
        if ring != shell:
            (r0, c0), (r1, c1) = line[0], line[1]
            side = [((r0 + r1) / 2 + a, (c0 + c1) / 2 + b) for a, b in ((0.25, 0), (-0.25, 0), (0, 0.25), (0, -0.25))]
            assert any(inside(rings[(label, shell, shell)], y, x) for y, x in side)
    large = rings_of(polygons.outlines(mask_frame(spark, cells), "v", 4.0).collect())
    assert set(large) == {k for k in rings if areas[k[1]] >= 4.0}


def test_thinned_outlines(spark):
    stairs = {(r, c): 1 if c <= r else None for r in range(12) for c in range(12)}
    corners = polygons.outlines(mask_frame(spark, stairs), "v").cache()
    assert polygons.simplified(corners, 0.0).count() == corners.count()
    thin = rings_of(polygons.simplified(corners, 1.5).collect())
    (line,) = thin.values()
    assert 4 <= len(line) < corners.count() and set(line) <= {(r["row"], r["col"]) for r in corners.collect()}
    assert abs(abs(shoelace(line)) - 78) < 0.15 * 78


def greedy(rows, gap, span):
    out, cur = [], None
    for lo, _, hi in sorted((lo, i, hi) for i, lo, hi in rows):
        if cur and lo - cur[1] <= gap and max(cur[1], hi) - cur[0] <= span:
            cur[1], cur[2], cur[3] = max(cur[1], hi), cur[2] + 1, cur[3] + hi - lo
        else:
            cur = [lo, hi, 1, hi - lo]
            out.append(cur)
    return sorted((lo, hi, n, hi - lo - useful) for lo, hi, n, useful in out)


@pytest.mark.parametrize(("gap", "span", "seed"), [(8, 60, 1), (0, 25, 2), (500, 90, 3)])
def test_coalescing_equals_the_greedy_pass(spark, gap, span, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(3000), rng.choice([1, 5, 20, 200])) for i in range(500)]
    rows = [(k, i, lo, lo + n) for k, i, lo, n in rows]
    got = ranges.coalesced(spark.createDataFrame(rows, "key int, id long, lo long, hi long").repartition(6), gap, span).collect()
    for key in (1, 2, 3):
        mine = sorted((r["lo"], r["hi"], r["parts"], r["extra"]) for r in got if r["key"] == key)
        assert mine == greedy([r[1:] for r in rows if r[0] == key], gap, span)


def test_pruned_trees(spark):
    rng = random.Random(5)
    area = (30.0, 30.0, 60.0, 60.0)
    rows = []
    for i in range(200):
        x, y, n = rng.uniform(0, 100), rng.uniform(0, 100), 200 if i < 15 else rng.choice([5, 30, 120])
        box = None if rng.random() < 0.1 else (x - n, y - n, x + n, y + n)
        own = None if rng.random() < 0.5 else (x - 3, y - 3, x + 3, y + 3)
        rows.append((i, None if i == 0 else (i - 1) // 2 if i % 3 else i // 3, box if i else None, own, i * 10 if rng.random() < 0.6 else None))
    meets = lambda b: b is None or (b[0] <= area[2] and b[2] >= area[0] and b[1] <= area[3] and b[3] >= area[1])
    below = {}
    for r in rows:
        below.setdefault(r[1], []).append(r)
    want = {}

    def walk(r):
        if not meets(r[2]):
            return False
        content = r[4] if meets(r[3] if r[3] is not None else r[2]) else None
        kids = [walk(k) for k in below.get(r[0], [])]
        if content is None and not any(kids):
            return False
        want[r[0]] = (r[1], content)
        return True

    walk(rows[0])
    box = "struct<west:double,south:double,east:double,north:double>"
    got = hierarchy.pruned(spark.createDataFrame(rows, f"id long, parent long, box {box}, content_box {box}, content long"), area)
    assert {r["id"]: (r["parent"], r["content"]) for r in got.collect()} == want and len(want) > 5
    batch = spark.createDataFrame([(c, i) for c in range(0, 2000, 10) for i in range(2)], "content long, batch int")
    assert hierarchy.trimmed(batch, got).count() == 2 * sum(c is not None for _, c in want.values())


def test_isochrone_outlines(spark):
    """Streets of a lattice within 250 m: the outline holds all of them, and lies in the plain buffer."""
    lines = [(0.0, 100.0 * i, 250.0, 100.0 * i) for i in range(3)] + [(100.0 * i, 0.0, 100.0 * i, 250.0) for i in range(3)]
    cell, radius = 5.0, 25.0
    corners = networks.isochrone_outline(spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double"), cell, radius).collect()
    rings = rings_of(corners)
    away = lambda x, y: min(math.hypot(x - min(max(x, a), c), y - min(max(y, b), d)) for a, b, c, d in lines)
    covered = lambda x, y: sum(inside(line, y, x) for line in rings.values()) % 2 == 1
    for x in range(-60, 320, 13):
        for y in range(-60, 320, 17):
            if away(x, y) < radius - 1.5 * cell:
                assert covered(x, y)
            if away(x, y) > radius + 1.5 * cell:
                assert not covered(x, y)
    plain = 6 * 250 * 2 * radius
    assert sum(r["area"] for r in {r["ring"]: r for r in corners}.values()) < plain * 1.05


def test_pyramids_unpack_to_their_cells(spark):
    rng = random.Random(9)
    cells = {(r, c): (rng.choice([None, rng.randrange(-5000, 90_000)]), rng.choice([None, 50 * rng.randrange(80)])) for r in range(21) for c in range(30)}
    tiles = pyramid.pyramid(spark.createDataFrame([(*k, *v) for k, v in cells.items()], "row long, col long, elev long, h long"), 3, 8).cache()
    assert {len(r["pixels"]) for r in tiles.collect()} == {8 * 8 * 4}
    got = {(r["zoom"], r["row"], r["col"]): (r["elev"], r["h"]) for r in pyramid.unpacked(tiles, 8).collect()}
    want = {(z, r >> z, c >> z): v for z in range(3) for (r, c), v in cells.items() if r % 2**z == 2**z // 2 and c % 2**z == 2**z // 2 and v != (None, None)}
    assert set(got) == set(want)
    for k, (elev, h) in want.items():
        assert got[k][1] == h and (got[k][0] is None) == (elev is None) and (elev is None or abs(got[k][0] - elev) <= 4)


def test_content_versions_by_blocks(spark):
    import hashlib

    from strandline.sources import sinks

    lines = {("a", i): f"line {i}" for i in range(0, 90, 2)} | {("b", 70): "one"}

    def level(nodes, width):
        out = {}
        for k in sorted(nodes):
            out.setdefault((k[0], k[1] // width), []).append(nodes[k])
        return {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in out.items()}

    want = level(level(level(lines, 5), 5), 5)
    got = sinks.content_versions(spark.createDataFrame([(*k, v) for k, v in lines.items()], "asset string, id long, line string").repartition(3), 5).collect()
    assert {(r["asset"], 0): r["version"] for r in got} == want
