"""Drainage over filled surfaces: an order on flats, facet and steepest directions, accumulation with its edge-drained
share, and collars of surrounding terrain.

Flats drain to their outlets by geodesic steps, a second key below the filled height: routing heights are
``fill + steps * STEP_HEIGHT``, exact in doubles for fills below 16 km and flats of less than 2^24 steps. Accumulation
eliminates the cells of each tile once, into a sparse transfer from the cells where water enters it to the cells where it
leaves; the system of those cells is solved by regions of many tiles whose borders shift from round to round, and a last pass
over the tiles spreads its solution. The same transfers turned round carry the edge-drained shares upstream.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import flow
from strandline.operators.iterate import checkpointed
from strandline.operators.raster import EIGHT
from strandline.operators.tiles import MARGIN, WIDE, Arrays, Frame, each_tile, extent, node, settled, tiled, with_margins

STEP_HEIGHT = 2.0**-28
NO_DATA = -1e18  # water always falls into cells without data
TILE, REGION = 256, 4096


def _around(z: np.ndarray, step: tuple[int, int]) -> np.ndarray:
    """The neighbour in a direction of all cells but the outermost."""
    side = len(z)
    return z[1 + step[0] : side - 1 + step[0], 1 + step[1] : side - 1 + step[1]]


def flat_steps(frame: Frame, arrays: Arrays, margin: np.ndarray) -> np.ndarray:
    """Steps over cells of one filled height to a cell that has a lower neighbour, no data or the grid's edge beside it."""
    fill = arrays["fill"]
    inside = frame.mask()
    core = fill[1:-1, 1:-1]
    lowest = np.full_like(core, np.inf)
    for step in EIGHT:
        near = _around(fill, step)
        lowest = np.minimum(lowest, np.where(np.isnan(near), -np.inf, near))
    dist = np.full(fill.shape, np.inf)
    dist[1:-1, 1:-1] = margin[1:-1, 1:-1]
    dist[1:-1, 1:-1][lowest < core] = 0
    dist[~inside & ~np.isfinite(margin)] = np.inf
    dist[~inside] = np.minimum(dist, margin)[~inside]
    level, flat, open_ = fill.reshape(-1), dist.reshape(-1), (inside & ~np.isnan(fill)).reshape(-1)
    ring = np.zeros_like(inside)
    ring[MARGIN - 1 : -MARGIN + 1, MARGIN - 1 : -MARGIN + 1] = True  # the tile and the cells that touch it
    start = np.flatnonzero(np.isfinite(flat) & ring.reshape(-1))
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    for d in np.unique(flat[start]):
        waiting[int(d)].append(start[flat[start] == d])
    offsets = np.array([a * frame.side + b for a, b in EIGHT])
    while waiting:
        d = min(waiting)
        at = np.unique(np.concatenate(waiting.pop(d)))
        at = at[flat[at] == d]
        near = (at[:, None] + offsets).reshape(-1)
        near = near[open_[near] & (level[near] == np.repeat(level[at], 8)) & (flat[near] > d + 1)]
        if len(near):
            flat[near] = d + 1
            waiting[d + 1].append(near)
    return dist


def surface(fill: DataFrame, size: int = TILE, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Tiles of a filled surface (row, col, fill) with their margins, and the steps that settled on those: the input of all
    that follows. Cells that are missing, or null in ``fill``, have no data; ``box`` is the grid's extent."""
    box = box or extent(fill)
    tiles = checkpointed(tiled(fill, {"fill": F.col("fill")}, size, box))
    return checkpointed(settled(tiles, ["fill"], size, box, flat_steps))


def _heights(frame: Frame, arrays: Arrays, rest: dict) -> tuple[np.ndarray, np.ndarray]:
    """Routing heights and steps of a tile and its margin, NaN without data."""
    margin = np.full((frame.side, frame.side), np.inf)
    if rest.get("places"):
        margin.reshape(-1)[np.frombuffer(rest["places"], np.int32)] = np.frombuffer(rest["values"])
    steps = np.where(frame.mask(), flat_steps(frame, arrays, margin), margin)
    steps = np.where(np.isfinite(steps), steps, 0.0)
    return arrays["fill"] + steps * STEP_HEIGHT, steps


class Routes:
    """Receivers (places in the array; the cell itself for none) and shares of a tile and the cells that touch it."""

    def __init__(self, frame: Frame, z: np.ndarray, box: tuple[int, int, int, int], steepest: bool = False):
        side = frame.side
        valid = ~np.isnan(z)
        within = frame.within(box)
        walls = np.where(within, np.where(valid, z, NO_DATA), np.inf)
        here = walls[1:-1, 1:-1]
        own = np.arange(side * side).reshape(side, side)[1:-1, 1:-1]
        best = np.zeros_like(here)
        r1, r2, p2 = own.copy(), own.copy(), np.zeros_like(here)
        with np.errstate(invalid="ignore"):
            if steepest:
                for a, b in EIGHT:
                    near = _around(walls, (a, b))
                    slope = (here - near) / (math.sqrt(2) if a and b else 1.0)
                    take = np.isfinite(near) & (slope > best)
                    best, r1 = np.where(take, slope, best), np.where(take, own + a * side + b, r1)
                r2 = r1
            else:
                for straight, corner in flow.FACETS:
                    e1, e2 = _around(walls, straight), _around(walls, corner)
                    s1, s2 = here - e1, e1 - e2
                    angle = np.arctan2(s2, s1)
                    slope = np.where(angle < 0, s1, np.where(angle > math.pi / 4, (here - e2) / math.sqrt(2), np.hypot(s1, s2)))
                    take = np.isfinite(e1) & np.isfinite(e2) & (slope > best)
                    best = np.where(take, slope, best)
                    r1 = np.where(take, own + straight[0] * side + straight[1], r1)
                    r2 = np.where(take, own + corner[0] * side + corner[1], r2)
                    p2 = np.where(take, np.clip(angle, 0.0, math.pi / 4) / (math.pi / 4), p2)
        wet = valid[1:-1, 1:-1]
        flows = wet & (r1 != own) | wet & (r2 != own)
        p1 = np.where(flows, 1.0 - p2, 0.0)
        p2 = np.where(flows, p2, 0.0)
        dry = ~valid.reshape(-1)
        sink = flows & ((dry[r1] & (p1 > 0)) | (dry[r2] & (p2 > 0)))
        ends = sink | ~flows
        r1, r2 = np.where(ends | (p1 == 0), own, r1), np.where(ends | (p2 == 0), own, r2)
        p1, p2 = np.where(ends, 0.0, p1), np.where(ends, 0.0, p2)

        def whole(x: np.ndarray, rest) -> np.ndarray:
            out = np.full((side, side), rest, x.dtype)
            out[1:-1, 1:-1] = x
            return out.reshape(-1)

        self.to1, self.to2 = whole(r1, -1), whole(r2, -1)
        self.to1[self.to1 < 0], self.to2[self.to2 < 0] = np.flatnonzero(self.to1 < 0), np.flatnonzero(self.to2 < 0)
        self.p1, self.p2, self.sink = whole(p1, 0.0), whole(p2, 0.0), whole(sink, False)
        rows, cols = frame.row + np.arange(side)[:, None], frame.col + np.arange(side)[None, :]
        border = ((rows == box[0]) | (rows == box[1]) | (cols == box[2]) | (cols == box[3])).reshape(-1)
        self.edge = valid.reshape(-1) & border & ~self.sink & (self.p1 + self.p2 == 0)
        inner = np.flatnonzero((frame.mask() & valid).reshape(-1))
        self.down = inner[np.argsort(-z.reshape(-1)[inner], kind="stable")]  # highest first
        self.valid, self.inner = valid.reshape(-1), frame.mask().reshape(-1)

    def receivers(self, c: int) -> list[tuple[int, float]]:
        out = []
        if self.p1[c] > 0:
            out.append((int(self.to1[c]), float(self.p1[c])))
        if self.p2[c] > 0:
            out.append((int(self.to2[c]), float(self.p2[c])))
        return out

    def lists(self) -> list[list[tuple[int, float]]]:
        """Receivers of every place."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(self.p1))]
        for to, p in ((self.to1, self.p1), (self.to2, self.p2)):
            for c in np.flatnonzero(p > 0).tolist():
                out[c].append((int(to[c]), float(p[c])))
        return out


TRANSFER = "kind int, tr long, tc long, a long, b long, share double"
OUT, THROUGH, EDGE = 0, 1, 2
DRAINED = "row long, col long, fill double, steps double, to1 long, p1 double, to2 long, p2 double, sink boolean, edge boolean, acc double, edge_share double"


def _transfer(box, steepest: bool, weighted: bool):
    """Rows of a tile: OUT, water of its own that leaves to b; THROUGH, the share of what enters at a that leaves to b; EDGE,
    the share of what enters at a that leaves the grid over its edge inside this tile."""

    def work(frame: Frame, arrays: Arrays, rest: dict) -> Iterator[dict]:
        z, _ = _heights(frame, arrays, rest)
        r = Routes(frame, z, box, steepest)
        to, inner = r.lists(), r.inner.tolist()
        water = np.nan_to_num(arrays["w"].reshape(-1)).tolist() if weighted else [1.0] * len(inner)
        entered = set()
        for c in np.flatnonzero(~r.inner & r.valid).tolist():
            entered.update(t for t, _ in to[c] if inner[t])
        out: dict[int, float] = defaultdict(float)
        reached = set(entered)
        down = r.down.tolist()
        for c in down:
            for t, p in to[c]:
                if inner[t]:
                    water[t] += p * water[c]
                    if c in reached:
                        reached.add(t)
                else:
                    out[t] += p * water[c]
        leaves: dict[int, dict[int, float]] = {}
        edge: dict[int, float] = {}
        for c in reversed(down):
            if c in reached:
                shares: dict[int, float] = defaultdict(float)
                e = 1.0 if r.edge[c] else 0.0
                for t, p in to[c]:
                    if inner[t]:
                        e += p * edge[t]
                        for k, s in leaves[t].items():
                            shares[k] += p * s
                    else:
                        shares[t] += p
                leaves[c], edge[c] = shares, e
        rows = [(OUT, -1, t, w) for t, w in out.items()]
        rows += [(THROUGH, c, t, s) for c in entered for t, s in leaves[c].items()]
        rows += [(EDGE, c, c, edge[c]) for c in entered]
        if rows:
            kind, a, b, share = zip(*rows, strict=True)
            name = lambda x: np.where(np.array(x) < 0, -1, frame.nodes(np.array(x, np.int64)))
            yield {"kind": pa.array(kind, pa.int32()), "tr": np.full(len(rows), rest["tr"]), "tc": np.full(len(rows), rest["tc"]), "a": name(a), "b": name(b), "share": np.array(share)}

    return work


def _drain(box, steepest: bool, weighted: bool):
    """All cells of a tile, from what enters it (``given`` of kind OUT) and the edge shares where it leaves (kind EDGE)."""

    def work(frame: Frame, arrays: Arrays, rest: dict) -> Iterator[dict]:
        z, steps = _heights(frame, arrays, rest)
        r = Routes(frame, z, box, steepest)
        to, inner = r.lists(), r.inner.tolist()
        acc = np.nan_to_num(arrays["w"].reshape(-1)).tolist() if weighted else [1.0] * len(inner)
        share = [0.0] * len(inner)
        for g in rest["given"] or []:
            place = int(frame.places(np.int64(g["node"])))
            if g["kind"] == OUT:
                acc[place] += g["value"]
            else:
                share[place] = g["value"]
        down = r.down.tolist()
        for c in down:
            for t, p in to[c]:
                if inner[t]:
                    acc[t] += p * acc[c]
        for c in reversed(down):
            share[c] = sum(p * share[t] for t, p in to[c]) if to[c] else float(r.edge[c])
        at = r.down
        if len(at):
            nodes = frame.nodes(at)
            receiver = lambda to, p: pa.array(frame.nodes(to[at]), mask=p[at] <= 0)
            yield {
                "row": nodes // WIDE, "col": nodes % WIDE, "fill": arrays["fill"].reshape(-1)[at], "steps": steps.reshape(-1)[at],
                "to1": receiver(r.to1, r.p1), "p1": r.p1[at], "to2": receiver(r.to2, r.p2), "p2": r.p2[at], "sink": r.sink[at], "edge": r.edge[at],
                "acc": np.array(acc)[at], "edge_share": np.array(share)[at],
            }

    return work


def accumulated_by_regions(edges: DataFrame, weights: DataFrame, size: int = REGION, most_rounds: int = 10_000) -> DataFrame:
    """node, acc: own weight and all that comes along edges (a, b, share) of an acyclic graph whose nodes are cells.

    Each round takes what moves as far as it gets within a square region; regions shift by half their size from round to
    round, so a path along a border crosses none for long. A region without moving parcels is not read.
    """
    edges = checkpointed(edges.select("a", "b", "share"))
    moving = checkpointed(weights.groupBy("node").agg(F.sum("w").alias("w")).where("w <> 0"))
    total = None
    for i in range(most_rounds):
        if not moving.limit(1).count():
            break
        shift = size // 2 * (i % 2)
        at = lambda c, shift=shift: (F.floor((F.floor(F.col(c) / WIDE) + shift) / size).alias("rr"), F.floor((F.col(c) % WIDE + shift) / size).alias("rc"))
        parcels = moving.select(*at("node"), F.lit(True).alias("moves"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.col("w").alias("share"))
        links = edges.select(*at("a"), F.lit(False).alias("moves"), "a", "b", "share").join(parcels.select("rr", "rc").distinct(), ["rr", "rc"], "left_semi")

        def solve(table: pa.Table) -> pa.Table:
            to: dict[int, list[tuple[int, float]]] = defaultdict(list)
            amount: dict[int, float] = defaultdict(float)
            rr, rc = table.column("rr")[0].as_py(), table.column("rc")[0].as_py()
            for moves, a, b, s in zip(*(table.column(c).to_pylist() for c in ("moves", "a", "b", "share")), strict=True):
                if moves:
                    amount[a] += s
                else:
                    to[a].append((b, s))
            near = lambda n: (n // WIDE + shift) // size == rr and (n % WIDE + shift) // size == rc
            arrivals: dict[int, int] = defaultdict(int)
            stack, seen = list(amount), set(amount)
            while stack:
                for b, _ in to.get(stack.pop(), ()):
                    if near(b):
                        arrivals[b] += 1
                        if b not in seen:
                            seen.add(b)
                            stack.append(b)
            ready = [n for n in amount if not arrivals[n]]
            out: dict[int, float] = defaultdict(float)
            done = 0
            while ready:
                n = ready.pop()
                done += 1
                for b, s in to.get(n, ()):
                    if near(b):
                        amount[b] += amount[n] * s
                        arrivals[b] -= 1
                        if not arrivals[b]:
                            ready.append(b)
                    else:
                        out[b] += amount[n] * s
            if done < len(seen):
                raise RuntimeError("the graph has a cycle")
            return pa.table({"node": [*amount, *out], "w": [*amount.values(), *out.values()], "here": [True] * len(amount) + [False] * len(out)}, schema=pa.schema([("node", pa.int64()), ("w", pa.float64()), ("here", pa.bool_())]))

        met = checkpointed(parcels.unionByName(links).groupBy("rr", "rc").applyInArrow(solve, "node long, w double, here boolean"))
        part = met.where("here").select("node", "w")
        total = part if total is None else total.unionByName(part)
        moving = checkpointed(met.where("NOT here").groupBy("node").agg(F.sum("w").alias("w")))
    else:
        raise RuntimeError("the graph has a cycle or a longer path than allowed")
    return (weights if total is None else total).groupBy("node").agg(F.sum("w").alias("acc"))


def drained(fill: DataFrame, weights: DataFrame | None = None, steepest: bool = False, size: int = TILE, region: int = REGION, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """All cells with data of a filled surface (row, col, fill): their steps on flats, up to two receivers and shares,
    whether they end at no data (sink) or over the grid's edge, the water that comes together there (acc) and the share of it
    that leaves over the grid's edge in the end.

    ``box`` is the grid's extent (that of the rows if not given): cells of it that are missing or null have no data. Facets give two receivers; ``steepest`` takes the steepest of eight neighbours alone. ``weights`` (row, col, w) is the rain
    on a cell, 1 everywhere without it. Ends have no receiver; what they gather is all rain.
    """
    box = box or extent(fill)
    if weights is not None:
        fill = fill.join(weights.select("row", "col", "w"), ["row", "col"], "left")
    tiles = surface(fill, size, box)
    fields = ["fill"]
    if weights is not None:
        rain = tiled(fill.where("w IS NOT NULL"), {"w": F.col("w")}, size, box)
        tiles = checkpointed(tiles.join(rain, ["tr", "tc"]))
        fields.append("w")
    rows = checkpointed(each_tile(tiles, fields, size, _transfer(box, steepest, weights is not None), TRANSFER))
    through = rows.where(F.col("kind") == THROUGH)
    enters = accumulated_by_regions(through, rows.where(F.col("kind") == OUT).select(F.col("b").alias("node"), F.col("share").alias("w")), region)
    back = through.select(F.col("b").alias("a"), F.col("a").alias("b"), "share")
    shares = accumulated_by_regions(back, rows.where(F.col("kind") == EDGE).select(F.col("a").alias("node"), F.col("share").alias("w")), region)
    at = lambda kind: F.struct(F.lit(kind).alias("kind"), "node", F.col("acc").alias("value")).alias("given")
    own = [F.floor(F.floor(F.col("node") / WIDE) / size).alias("tr"), F.floor(F.col("node") % WIDE / size).alias("tc")]
    exits = rows.where(F.col("kind") != EDGE).select("tr", "tc", F.col("b").alias("node")).distinct().join(shares, "node")
    given = enters.select(*own, at(OUT)).unionByName(exits.select("tr", "tc", at(EDGE)))
    given = checkpointed(given.groupBy("tr", "tc").agg(F.collect_list("given").alias("given")))  # the margin of a tile
    return each_tile(with_margins(tiles, given), fields, size, _drain(box, steepest, weights is not None), DRAINED)


def ends(cells: DataFrame) -> DataFrame:
    """Drained cells that give to none."""
    return cells.where("to1 IS NULL AND to2 IS NULL")


def main_receiver():
    """The receiver of the larger share, the first of two equal ones; null at ends."""
    return F.when(F.col("p2") > F.col("p1"), F.col("to2")).otherwise(F.coalesce("to1", "to2"))


def collared(cells: DataFrame, around: DataFrame) -> DataFrame:
    """cells (row, col, elev) laid over a wider grid (on the same rows and columns) that shows only around them."""
    own = cells.select("row", "col", "elev")
    return around.select("row", "col", "elev").join(own, ["row", "col"], "left_anti").unionByName(own)


def routed_with_collar(cells: DataFrame, around: DataFrame, steepest: bool = False, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The drained cells of a grid routed over the wider grid around it, and a row (valid, gathered, sound): whether all rain of
    the wider grid comes together at its ends, to max(0.5, a millionth).

    Receivers that lie outside the grid are null and ``leaves`` is true for cells with one.
    """
    wide = collared(cells, around)
    box, first = extent(cells), extent(wide)
    down, right = max(0, -first[0]), max(0, -first[2])  # cells are numbered from row and column 0 at least
    moved = wide.select((F.col("row") + down).alias("row"), (F.col("col") + right).alias("col"), "elev")
    reach = (first[0] + down, first[1] + down, first[2] + right, first[3] + right)
    all_cells = checkpointed(drained(flow.filled(moved, size), steepest=steepest, size=size, box=reach))
    all_cells = all_cells.withColumns({"row": F.col("row") - down, "col": F.col("col") - right})
    audit = all_cells.agg(F.count(F.lit(1)).alias("valid"), F.coalesce(F.sum(F.when(F.col("to1").isNull() & F.col("to2").isNull(), F.col("acc"))), F.lit(0.0)).alias("gathered"))
    sound = F.abs(F.col("gathered") - F.col("valid")) <= F.greatest(F.lit(0.5), 1e-6 * F.col("valid"))
    inside = all_cells.join(cells.select("row", "col"), ["row", "col"], "left_semi")
    within = lambda c: (F.floor(F.col(c) / WIDE) - down).between(box[0], box[1]) & (F.col(c) % WIDE - right).between(box[2], box[3])
    out = F.coalesce(~within("to1"), F.lit(False)) | F.coalesce(~within("to2"), F.lit(False))
    own = {c: F.when(within(c), F.col(c) - down * WIDE - right) for c in ("to1", "to2")}
    return inside.withColumn("leaves", out).withColumns(own), audit.withColumn("sound", sound)
