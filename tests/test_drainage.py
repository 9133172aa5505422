"""Drainage, basins and their coarsening against sequential passes over small grids."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandline.operators import basins as bs
from strandline.operators import drainage as dr
from strandline.operators import flow, networks

WIDE = 10**9
AROUND = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def grid(spark, elev):
    return spark.createDataFrame([(r, c, None if z is None else int(z)) for (r, c), z in sorted(elev.items())], "row long, col long, elev long")


def terrain(seed, rows, cols, steps=12, hole=0.03):
    rng = random.Random(seed)
    return {(r, c): None if rng.random() < hole else rng.randrange(steps) * 100 for r in range(rows) for c in range(cols)}


def filled(spark, elev, tile=9):
    return flow.filled(grid(spark, elev), tile=tile).select("row", "col", "fill")


def drained(spark, elev, weights=None, **params):
    box = (0, max(r for r, _ in elev), 0, max(c for _, c in elev))
    return dr.drained(filled(spark, elev), weights, box=box, **params)


def heights(elev):
    """Fill and steps by relaxation, cell by cell."""
    wet = {k: z for k, z in elev.items() if z is not None}
    outlet = {k for k in wet if any(elev.get((k[0] + a, k[1] + b)) is None for a, b in AROUND)}
    fill = {k: wet[k] if k in outlet else math.inf for k in wet}
    changed = True
    while changed:
        changed = False
        for k in wet:
            new = min([fill[k], *(max(wet[k], fill[n]) for a, b in AROUND if (n := (k[0] + a, k[1] + b)) in fill)])
            if new < fill[k]:
                fill[k], changed = new, True
    steps = {k: 0 if k in outlet or any(fill.get((k[0] + a, k[1] + b), math.inf) < fill[k] for a, b in AROUND) else math.inf for k in wet}
    changed = True
    while changed:
        changed = False
        for k in wet:
            new = min([steps[k], *(steps[n] + 1 for a, b in AROUND if (n := (k[0] + a, k[1] + b)) in fill and fill[n] == fill[k])])
            if new < steps[k]:
                steps[k], changed = new, True
    return fill, steps


def facet(elev, z, k):
    """(receivers, sink): the steepest of eight triangles around a cell, one after another."""
    best = (0.0, None, None, 0.0)
    for (a1, b1), (a2, b2) in flow.FACETS:
        n1, n2 = (k[0] + a1, k[1] + b1), (k[0] + a2, k[1] + b2)
        if n1 not in elev or n2 not in elev:
            continue
        e1, e2 = z.get(n1, -1e18), z.get(n2, -1e18)
        s1, s2 = z[k] - e1, e1 - e2
        angle = math.atan2(s2, s1)
        slope = s1 if angle < 0 else (z[k] - e2) / math.sqrt(2) if angle > math.pi / 4 else math.hypot(s1, s2)
        if slope > best[0]:
            best = (slope, n1, n2, min(max(angle, 0.0), math.pi / 4) / (math.pi / 4))
    to = [] if best[1] is None else [(n, p) for n, p in ((best[1], 1 - best[3]), (best[2], best[3])) if p > 0]
    return ([], True) if any(n not in z for n, _ in to) else (to, False)


def sequential(elev):
    fill, steps = heights(elev)
    z = {k: fill[k] + steps[k] * 2.0**-28 for k in fill}
    to = {k: facet(elev, z, k) for k in z}
    rows, cols = max(r for r, _ in elev), max(c for _, c in elev)
    order = sorted(z, key=lambda k: -z[k])
    acc = dict.fromkeys(z, 1.0)
    for k in order:
        for n, p in to[k][0]:
            acc[n] += p * acc[k]
    edge = {}
    for k in reversed(order):
        border = k[0] in (0, rows) or k[1] in (0, cols)
        edge[k] = sum(p * edge[n] for n, p in to[k][0]) if to[k][0] else float(border and not to[k][1])
    return fill, steps, to, acc, edge


def key(n):
    return n[0] * WIDE + n[1]


@pytest.fixture(scope="module")
def valley(spark):
    """A Y-shaped valley: two branches meet at (12, 12) and run out at the southern edge."""
    h, w = 26, 25
    yy, xx = np.mgrid[0:h, 0:w].astype(float)

    def off(ax, ay, bx, by):
        vx, vy = bx - ax, by - ay
        t = np.clip(((xx - ax) * vx + (yy - ay) * vy) / (vx * vx + vy * vy), 0, 1)
        return np.hypot(xx - ax - t * vx, yy - ay - t * vy), t

    (dt, tt), (dl, tl), (dr_, tr) = off(12, 12, 12, h - 1), off(3, 1, 12, 12), off(w - 4, 1, 12, 12)
    along = np.where((dt <= dl) & (dt <= dr_), (1 - tt) * 13, 13 + 14 * np.where(dl <= dr_, 1 - tl, 1 - tr))
    z = np.rint((along + 5 * np.minimum(dt, np.minimum(dl, dr_))) * 1000)
    elev = {(r, c): int(z[r, c]) for r in range(h) for c in range(w)}
    return elev, drained(spark, elev, size=10).cache()


@pytest.mark.parametrize(("seed", "size", "region"), [(1, 8, 20), (2, 64, 4096)])
def test_drainage_equals_a_sequential_pass(spark, seed, size, region):
    elev = terrain(seed, 21, 33, steps=7 if seed == 1 else 40)
    fill, steps, to, acc, edge = sequential(elev)
    got = {(r["row"], r["col"]): r for r in drained(spark, elev, size=size, region=region).collect()}
    assert set(got) == set(fill)
    for k, r in got.items():
        assert (r["fill"], r["steps"]) == (fill[k], steps[k])
        mine = {n: p for n, p in ((r["to1"], r["p1"]), (r["to2"], r["p2"])) if p > 0}
        assert mine == pytest.approx({key(n): p for n, p in to[k][0]}, abs=1e-12) and r["sink"] == to[k][1]
        assert r["acc"] == pytest.approx(acc[k], rel=1e-12) and r["edge_share"] == pytest.approx(edge[k], abs=1e-12)
        assert mine or r["sink"] or r["edge"]  # no pit is left
    assert sum(r["acc"] for r in got.values() if r["to1"] is None and r["to2"] is None) == pytest.approx(len(got))


def test_flats_and_long_ways_over_tiles(spark):
    """A winding trench of one height across many tiles, with one outlet."""
    elev = {(r, c): 5000 for r in range(8) for c in range(22)}
    for k in [(1 + 2 * i, c) for i in range(3) for c in range(1, 20)] + [(2, 1), (4, 19)]:
        elev[k] = 1000
    elev[(0, 19)] = 900
    fill, steps, to, acc, edge = sequential(elev)
    got = {(r["row"], r["col"]): r for r in drained(spark, elev, size=6, region=12).collect()}
    assert {k: r["steps"] for k, r in got.items()} == steps
    assert all(got[k]["acc"] == pytest.approx(acc[k], rel=1e-12) for k in acc)


def test_weights_and_steepest(spark):
    elev = terrain(4, 14, 17, steps=30)
    rain = {k: (k[0] * 3 + k[1]) % 5 * 0.5 for k, z in elev.items() if z is not None}
    weights = spark.createDataFrame([(*k, w) for k, w in rain.items() if w], "row long, col long, w double")
    got = drained(spark, elev, weights, steepest=True, size=6, region=20).collect()
    assert all(r["p1"] in (0.0, 1.0) and r["p2"] == 0.0 for r in got)
    assert sum(r["acc"] for r in got if r["to1"] is None) == pytest.approx(sum(rain.values()))
    z = {key((r["row"], r["col"])): (r["fill"] + r["steps"] * 2.0**-28) for r in got}
    for r in got:
        if r["to1"] is not None:
            here = z[key((r["row"], r["col"]))]
            slopes = {(r["row"] + a) * WIDE + r["col"] + b: (here - z[(r["row"] + a) * WIDE + r["col"] + b]) / math.hypot(a, b) for a, b in AROUND if (r["row"] + a) * WIDE + r["col"] + b in z}
            assert slopes[r["to1"]] == max(slopes.values()) > 0


def test_collars(spark):
    aoi = {(r, c): 100_000 - 1000 * r for r in range(8) for c in range(8)}
    wide = {(r, c): 100_000 - 1000 * r for r in range(-3, 11) for c in range(-3, 11)}
    own = {(r["row"], r["col"]): r["acc"] for r in drained(spark, aoi, size=8).collect()}
    got, audit = dr.routed_with_collar(grid(spark, aoi), grid(spark, wide), size=8)
    assert {(r["row"], r["col"]): r["acc"] for r in got.collect()} == pytest.approx({k: a + 3 for k, a in own.items()})
    assert audit.first()["sound"] and audit.first()["valid"] == len(wide)
    # west falls to a sea in the collar: without it all is cut by the edge, with it nothing is
    aoi = {(r, c): 100_000 + 1000 * c for r in range(6) for c in range(6)}
    wide = {(r, c): None if c == -3 else 100_000 + 1000 * c for r in range(-3, 9) for c in range(-3, 9)}
    assert {r["edge_share"] for r in drained(spark, aoi, size=4).collect()} == {1.0}
    got, _ = dr.routed_with_collar(grid(spark, aoi), grid(spark, wide), size=4)
    assert {r["edge_share"] for r in got.collect()} == {0.0}
    # no collar at all is the plain routing, whatever lies inside the wide grid
    rough = terrain(7, 11, 12, steps=20)
    plain = sorted(map(tuple, drained(spark, rough, size=5).collect()))
    got, audit = dr.routed_with_collar(grid(spark, rough), grid(spark, dict.fromkeys(rough, 0)), size=5)
    assert sorted(map(tuple, got.drop("leaves").collect())) == plain and audit.first()["sound"]


def test_junctions_part_a_valley(spark, valley):
    elev, cells = valley
    labels, basins = bs.junction_basins(cells, 50.0)
    rows = {r["basin"]: r for r in basins.collect()}
    acc = {key((r["row"], r["col"])): r["acc"] for r in cells.collect()}
    trunk = [b for b, r in rows.items() if r["downstream"] is None]
    assert len(rows) == 3 and len(trunk) == 1 and rows[trunk[0]]["edge"]
    assert {r["downstream"] for b, r in rows.items() if b != trunk[0]} == set(trunk)
    assert rows[trunk[0]]["outlet"] // WIDE >= 23 and rows[trunk[0]]["max_accum"] == pytest.approx(len(elev))
    assert all(r["max_accum"] == pytest.approx(acc[r["outlet"]]) for r in rows.values())
    assert labels.count() == len(elev) and {r["basin"] for r in labels.collect()} == {1, 2, 3}
    up = defaultdict(set)
    for r in bs.upstream_of(basins, basins.select("basin")).collect():
        up[r["start"]].add(r["basin"])
    assert up == {b: {1, 2, 3} if b in trunk else {b} for b in rows}
    climbed = bs.channels(cells, labels, basins).cache()
    # main channels climb inside their basin to the donor that gathers most
    walked = climbed.collect()
    label = {r["node"]: r["basin"] for r in labels.collect()}
    main = {r["node"]: r["main"] for r in bs.main_tree(cells).collect()}
    lines = defaultdict(dict)
    for r in walked:
        lines[r["basin"]][r["i"]] = r["node"]
    for b, line in lines.items():
        assert line[0] == rows[b]["outlet"] and sorted(line) == list(range(len(line)))
        for i in range(len(line)):
            donors = [n for n in main if main[n] == line[i] and label[n] == b]
            assert (line[i + 1] in donors and acc[line[i + 1]] == max(acc[d] for d in donors)) if i + 1 < len(line) else not donors
    # a box over the middle cuts all of them
    out, own, kept = bs.clipped(labels, basins, climbed, (4, 20, 4, 20))
    clip = {r["basin"]: r for r in own.collect()}
    assert out.count() == 17 * 17 and set(clip) == {r["basin"] for r in out.collect()} and all(r["edge"] for r in clip.values())
    assert any(r["outlet"] is None for r in clip.values())
    assert all(4 <= r["node"] // WIDE <= 20 and 4 <= r["node"] % WIDE <= 20 for r in kept.collect())
    table = {r["basin"]: r for r in bs.exported(labels, basins, climbed, 5.0).collect()}
    assert sum(r["area"] for r in table.values()) == len(elev) * 25
    for b, line in lines.items():
        want = sum(5 * math.dist(divmod(line[i], WIDE), divmod(line[i - 1], WIDE)) for i in range(1, len(line)))
        assert table[b]["channel_length"] == pytest.approx(want)


def one_at_a_time(nodes, borders, least, most):
    cnt, macc, gen = ({b: x[i] for b, x in nodes.items()} for i in (0, 1, 2))
    around = defaultdict(lambda: defaultdict(int))
    for (a, b), n in borders.items():
        around[a][b] += n
        around[b][a] += n
    into = {b: b for b in nodes}
    while True:
        place = lambda b: (0, float(cnt[b]), gen[b], b) if cnt[b] < least else (1, macc[b], gen[b], b)
        able = [b for b in cnt if around[b] and (cnt[b] < least or (most and len(cnt) > most))]
        if not able:
            return into
        b = min(able, key=place)
        p = max(around[b], key=lambda q: (around[b][q], macc[q], q))
        for q, n in around.pop(b).items():
            around[q].pop(b)
            if q != p:
                around[q][p] += n
                around[p][q] += n
        cnt[p] += cnt.pop(b)
        macc[p] = max(macc[p], macc.pop(b))
        gen[p] += 1
        into = {k: p if v == b else v for k, v in into.items()}


def patches(seed):
    """Nodes, borders and places of random basins; a row between two parts that never meet is missing."""
    rng = random.Random(seed)
    rows, cols = 16, 18
    seeds = [(rng.randrange(rows), rng.randrange(cols)) for _ in range(60)]
    label = {(r, c): min(range(len(seeds)), key=lambda i: (math.dist(seeds[i], (r, c)), i)) + 1 for r in range(rows) for c in range(cols) if r != 7}
    nodes, borders = {}, defaultdict(int)
    for (r, c), b in label.items():
        nodes[b] = (nodes.get(b, (0,))[0] + 1, float(rng.randrange(4) if b not in nodes else nodes[b][1]), 0)
        for n in ((r + 1, c), (r, c + 1)):
            if n in label and label[n] != b:
                borders[tuple(sorted((b, label[n])))] += 1
    return nodes, borders, {b: seeds[b - 1] for b in nodes}


def by_regions(nodes, borders, places, least, most, region):
    """The rounds of ``coarsened`` with plain dictionaries around its region step."""
    state, into, links = {b: [n, m, 0] for b, (n, m, _) in nodes.items()}, {b: b for b in nodes}, defaultdict(int)
    for (a, b), n in borders.items():
        links[(a, b)] += n
        links[(b, a)] += n
    for i in range(500):
        place = lambda b: (0, float(state[b][0]), state[b][2], b) if state[b][0] < least else (1, state[b][1], state[b][2], b)
        able = sorted(place(b) for b in {a for a, _ in links})
        spare = len(state) - most if most else 0
        if not able or (able[0][0] and spare <= 0):
            return into
        limit = able[min(spare, len(able)) - 1] if able[0][0] else (0, math.inf, 0, 0)
        at = lambda b: tuple((x + region // 2 * (i % 2)) // region for x in places[b])
        rows = defaultdict(list)
        for b in state:
            rows[at(b)].append((False, b, *state[b], 0, 0))
        for (a, b), n in links.items():
            rows[at(a)].append((True, b, *state[b], a, n))
        merges, taken = {}, defaultdict(int)
        for some in rows.values():
            table = pa.table({k: [r[j] for r in some] for j, k in enumerate(("other", "basin", "cnt", "macc", "gen", "near", "n"))})
            out = bs._merges(least, limit, able[0])(table)
            merges.update(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
        assert merges
        for p in merges.values():
            taken[p] += 1

        def root(b):
            while b in merges:
                b = merges[b]
            return b

        new, old, links = {}, links, defaultdict(int)
        for b, (n, m, _) in state.items():
            r = root(b)
            had = new.get(r, [0, 0.0])
            new[r] = [had[0] + n, max(had[1], m), state[r][2] + taken[r]]
        for (a, b), n in old.items():
            if root(a) != root(b):
                links[(root(a), root(b))] += n
        state, into = new, {k: root(v) for k, v in into.items()}
    raise AssertionError("no end")


@pytest.mark.parametrize(("least", "most", "region"), [(6, 0, 9), (0, 12, 7), (5, 9, 12), (400, 0, 6), (3, 1, 40)])
def test_regions_merge_as_one_at_a_time(least, most, region):
    for seed in range(40):
        some = patches(seed)
        assert by_regions(*some, least, most, region) == one_at_a_time(*some[:2], least, most)


def test_coarsening_equals_one_at_a_time(spark):
    nodes, borders, places = patches(3)
    df = spark.createDataFrame([(b, n, m, *places[b]) for b, (n, m, _) in nodes.items()], "basin long, cnt long, macc double, row long, col long")
    edges = spark.createDataFrame([(*k, n) for k, n in borders.items()], "a long, b long, n long")
    got = {r["basin"]: r["into"] for r in bs.coarsened(df, edges, 5, 9, region=12).collect()}
    assert got == one_at_a_time(nodes, borders, 5, 9)


def test_coarsened_valley(spark, valley):
    elev, cells = valley
    labels, basins = bs.junction_basins(cells, 12.0)
    assert basins.count() > 2
    few, own = bs.merged(labels, basins, most=2)
    own = own.cache()
    assert own.count() == 2 and sorted(r["basin"] for r in few.select("basin").distinct().collect()) == [1, 2]
    one, own = bs.merged(*bs.junction_basins(cells, 50.0), least_cells=10_000)
    row = own.collect()
    assert len(row) == 1 and row[0]["basin"] == 1 and row[0]["downstream"] is None and one.count() == len(elev)


def test_upstream_by_doubling(spark):
    links = [(n, n // 2) for n in range(2, 300)] + [(1000 + i, 1001 + i) for i in range(200)]
    starts = [1, 5, 40, 1200, 7777]
    up = defaultdict(set)
    for a, b in links:
        up[b].add(a)
    want = set()
    for s in starts:
        todo = [s]
        while todo:
            n = todo.pop()
            want.add((s, n))
            todo += up[n]
    got = networks.upstream(spark.createDataFrame(links, "node long, to long"), spark.createDataFrame([(s,) for s in starts], "node long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
