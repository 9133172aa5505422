"""Basins of a drained grid: sub-basins between the junctions of channels, coarsening by merging across the longest border, main
channels, clipping and summaries.

Coarsening merges basins one after another in a fixed order, and each merge changes its neighbours. It runs in parallel all the
same: a region of the map takes merges in that order as far as it can be sure of them. A basin is sure of its choice
when none of its neighbours could have merged before it; what a basin outside may do from its place in the order on makes its
neighbours unsure. Keys only grow as basins merge, so merges done in one round are the ones of the one-at-a-time order, and
shifted regions take up the rest in the next.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import flow, networks
from strandline.operators.drainage import REGION, main_receiver
from strandline.operators.iterate import checkpointed
from strandline.operators.order import numbered
from strandline.operators.raster import EIGHT
from strandline.operators.tiles import WIDE, node


def stops(edges: DataFrame, nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, stop: where each node's path along single edges (a, b) ends, by doubling jumps. Nodes that have arrived rest, so no
    join has a key of more rows than one node has donors of its round."""
    state = nodes.select("node").join(edges.select(F.col("a").alias("node"), F.col("b").alias("at")), "node", "left")
    state = checkpointed(state.select("node", F.coalesce("at", "node").alias("at"), F.col("at").isNull().alias("done")))
    for _ in range(most_rounds):
        live = state.where("NOT done")
        if not live.limit(1).count():
            return state.select("node", F.col("at").alias("stop"))
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("done").alias("arrived"))
        moved = live.join(ahead, "at", "left").select("node", F.coalesce("next", "at").alias("at"), F.coalesce("arrived", F.lit(True)).alias("done"))
        state = checkpointed(state.where("done").unionByName(moved))
    raise RuntimeError("the graph has a cycle")


def main_tree(cells: DataFrame) -> DataFrame:
    """node, main (null at ends), acc, edge_share of drained cells."""
    return cells.select(node("row", "col").alias("node"), main_receiver().alias("main"), "acc", "edge_share")


def junction_basins(cells: DataFrame, channel_least: float) -> tuple[DataFrame, DataFrame]:
    """Labels (node, basin) of all drained cells, and basins (basin, outlet, downstream, max_accum, edge).

    Along main receivers, channel cells (acc of ``channel_least`` or more) that flow into a cell where channels meet end a basin,
    and so do ends. The cell where they meet belongs to the basin below. Basins are numbered from 1 by their outlets in row-major
    order; ``max_accum`` is the outlet's, ``edge`` whether more than half of its water leaves over the grid's edge, downstream is
    null for basins that end.
    """
    tree = checkpointed(main_tree(cells).withColumn("channel", F.col("acc") >= channel_least))
    giving = tree.where("channel AND main IS NOT NULL")
    meets = giving.groupBy(F.col("main").alias("m")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    meets = meets.join(tree.where("channel").select(F.col("node").alias("m")), "m", "left_semi").select("m", F.lit(True).alias("meets"))
    tree = checkpointed(tree.join(meets, F.col("main") == F.col("m"), "left").withColumn("outlet", F.col("main").isNull() | (F.col("channel") & F.coalesce("meets", F.lit(False)))).drop("m", "meets", "channel"))
    stop = stops(tree.where("NOT outlet").select(F.col("node").alias("a"), F.col("main").alias("b")), tree)
    outlets = tree.where("outlet").select(F.col("node").alias("stop"), "main", "acc", "edge_share")
    outlets = checkpointed(numbered(outlets, [F.col("stop")], "basin"))
    labels = checkpointed(stop.join(outlets.select("stop", "basin"), "stop").select("node", "basin"))
    below = labels.select(F.col("node").alias("main"), F.col("basin").alias("downstream"))
    basins = outlets.join(below, "main", "left").select("basin", F.col("stop").alias("outlet"), "downstream", F.col("acc").alias("max_accum"), (F.col("edge_share") > 0.5).alias("edge"))
    return labels, basins


def _key(cnt: Column, macc: Column, gen: Column, basin: Column, least: int) -> Column:
    """A basin's place in the merge order: too small ones by cells, then the others by what they gather."""
    forced = cnt < least
    return F.struct(F.when(forced, 0).otherwise(1).alias("c"), F.when(forced, cnt.cast("double")).otherwise(macc).alias("m"), gen.alias("g"), basin.alias("b"))


def _merges(least: int, limit: tuple, first: tuple):
    """The sure merges of one region, in order, up to ``limit``; ``first`` is the first key of all."""

    def place(cnt: int, macc: float, gen: int, b: int) -> tuple:
        return (0, float(cnt), gen, b) if cnt < least else (1, macc, gen, b)

    def run(table: pa.Table) -> pa.Table:
        own: dict[int, list] = {}
        links: dict[int, dict[int, int]] = {}
        outside: dict[int, set[int]] = {}
        seen: dict[int, tuple] = {}
        for other, b, cnt, macc, gen, q, n in zip(*(table.column(c).to_pylist() for c in ("other", "basin", "cnt", "macc", "gen", "near", "n")), strict=True):
            if other:  # a link of own basin ``near`` with ``basin``, whatever region that is in
                links.setdefault(q, {})[b] = n
                seen[b] = (cnt, macc, gen)
            else:
                own[b] = [cnt, macc, gen]
        for b in seen:
            if b not in own:
                outside[b] = {a for a in links if b in links[a]}
        heap = [(place(*v, b), b) for b, v in own.items()] + [(place(*seen[b], b), b) for b in outside]
        heapq.heapify(heap)
        maccs = {b: v[1] for b, v in own.items()} | {b: seen[b][1] for b in outside}
        unsure: set[int] = set()
        merged: list[tuple[int, int]] = []
        while heap:
            key, b = heapq.heappop(heap)
            if key > limit:
                break
            if b in outside:
                unsure |= outside[b]
                continue
            if b not in own or key != place(*own[b], b):
                continue
            around = links.get(b, {})
            if not around:
                continue
            longest = max(around.values())
            tied = [q for q, n in around.items() if n == longest]
            vague = {q for q in tied if q in outside or q in unsure}
            p = max(tied, key=lambda q: (maccs[q], q))
            # what a vague basin gathers decides ties, here and for those that wait their turn: it must not have changed, nor change now
            if b in unsure or (key != first and vague and (len(tied) > 1 or maccs[p] < own[b][1])):
                unsure.add(b)
                unsure |= {q for q in around if q in own}
                continue
            merged.append((b, p))
            cnt, macc, _ = own.pop(b)
            links.pop(b, None)
            for q, n in around.items():
                if q in outside:
                    outside[q].discard(b)
                else:
                    links[q].pop(b)
                if q == p:
                    continue
                if q not in outside:
                    links[q][p] = links[q].get(p, 0) + n
                if p not in outside:
                    links[p][q] = links[p].get(q, 0) + n
                if p in outside and q not in outside:
                    outside[p].add(q)
                elif q in outside and p not in outside:
                    outside[q].add(p)
            maccs[p] = max(maccs[p], macc)
            if p in own:
                own[p] = [own[p][0] + cnt, maccs[p], own[p][2] + 1]
                heapq.heappush(heap, (place(*own[p], p), p))
        return pa.table({"a": pa.array([a for a, _ in merged], pa.int64()), "b": pa.array([p for _, p in merged], pa.int64())})

    return run


def coarsened(nodes: DataFrame, borders: DataFrame, least_cells: int = 0, most: int = 0, region: int = REGION, most_rounds: int = 1000) -> DataFrame:
    """basin, into: the basin that each is part of in the end.

    ``nodes`` has basin, cnt (cells), macc and row, col (anywhere in it); ``borders`` (a, b, n) each pair of neighbours once.
    Basins of fewer than ``least_cells`` cells merge, smallest first, then those that gather least until ``most`` are left (0: no
    such bound); each into the neighbour with the longest shared border, of equal ones the one that gathers more, then the larger
    number. Basins without neighbours stay.
    """
    state = checkpointed(nodes.select("basin", F.col("cnt").cast("long"), F.col("macc").cast("double"), F.lit(0).cast("long").alias("gen"), "row", "col"))
    edges = checkpointed(borders.select("a", "b", F.col("n").cast("long").alias("n")).unionByName(borders.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").cast("long").alias("n"))))
    every, done = state.select(F.col("basin").alias("node")), None
    key = _key(F.col("cnt"), F.col("macc"), F.col("gen"), F.col("basin"), least_cells)
    for i in range(most_rounds):
        able = state.join(edges.select(F.col("a").alias("basin")).distinct(), "basin", "left_semi").select(key.alias("key"))
        first = able.agg(F.min("key")).first()[0]
        if first is None:
            break
        if first["c"] == 0:
            limit = (0, math.inf, 0, 0)
        else:
            spare = state.count() - most if most else 0
            if spare <= 0:
                break
            # as many keys as merges are due: no merge at or before the last of them is one too many
            last = able.orderBy("key").limit(spare).agg(F.max("key")).first()[0] if spare <= 1000 else _place(able, spare)
            limit = (last["c"], last["m"], last["g"], last["b"])
        shift = region // 2 * (i % 2)
        at = [F.floor((F.col(c) + shift) / region).alias(r) for c, r in (("row", "rr"), ("col", "rc"))]
        where = state.select(F.col("basin").alias("near"), *at)
        links = edges.select(F.col("a").alias("near"), F.col("b").alias("basin"), "n").join(where, "near").join(state.select("basin", "cnt", "macc", "gen"), "basin")
        rows = state.select(F.lit(False).alias("other"), "basin", "cnt", "macc", "gen", F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("n"), *at)
        rows = rows.unionByName(links.select(F.lit(True).alias("other"), "basin", "cnt", "macc", "gen", "near", "n", "rr", "rc"))
        merges = checkpointed(rows.groupBy("rr", "rc").applyInArrow(_merges(least_cells, limit, tuple(first)), "a long, b long"))
        done = merges if done is None else done.unionByName(merges)
        into = checkpointed(stops(merges, state.select(F.col("basin").alias("node"))).select(F.col("node").alias("basin"), "stop"))
        taken = merges.groupBy(F.col("b").alias("stop")).agg(F.count(F.lit(1)).alias("taken"))
        sums = state.join(into, "basin").groupBy("stop").agg(F.sum("cnt").alias("cnt"), F.max("macc").alias("macc"))
        kept = state.select(F.col("basin").alias("stop"), "gen", "row", "col")
        state = checkpointed(sums.join(kept, "stop").join(taken, "stop", "left").select(F.col("stop").alias("basin"), "cnt", "macc", (F.col("gen") + F.coalesce("taken", F.lit(0))).alias("gen"), "row", "col"))
        ends = [into.select(F.col("basin").alias(c), F.col("stop").alias(f"{c}2")) for c in ("a", "b")]
        edges = checkpointed(edges.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2").groupBy(F.col("a2").alias("a"), F.col("b2").alias("b")).agg(F.sum("n").alias("n")))
    else:
        raise RuntimeError("basins did not settle")
    if done is None:
        return every.select(F.col("node").alias("basin"), F.col("node").alias("into"))
    return stops(done, every).select(F.col("node").alias("basin"), F.col("stop").alias("into"))


def _place(able: DataFrame, n: int):
    """The n-th key in order, or the last."""
    placed = numbered(able, [F.col("key")], "place")
    return placed.where(F.col("place") <= n).agg(F.max("key")).first()[0]


def merged(labels: DataFrame, basins: DataFrame, least_cells: int = 0, most: int = 0, region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """Labels and basins after coarsening, numbered anew in the order of the old numbers. A basin keeps its own outlet and
    downstream side; what flowed to a merged basin flows to what it became, and to nowhere if that is the basin itself."""
    cells = labels.select(F.floor(F.col("node") / WIDE).alias("row"), (F.col("node") % WIDE).alias("col"), F.col("basin").alias("label"))
    counts = labels.groupBy("basin").agg(F.count(F.lit(1)).alias("cnt"))
    nodes = basins.join(counts, "basin").select("basin", "cnt", F.col("max_accum").alias("macc"), F.floor(F.col("outlet") / WIDE).alias("row"), (F.col("outlet") % WIDE).alias("col"))
    into = checkpointed(coarsened(nodes, flow.border_lengths(cells), least_cells, most, region))
    names = checkpointed(numbered(into.select("into").distinct(), [F.col("into")], "name"))
    into = checkpointed(into.join(names, "into").select("basin", "into", "name"))
    gathers = basins.join(into, "basin").groupBy("into").agg(F.max("max_accum").alias("max_accum"))
    own = basins.drop("max_accum").join(gathers, F.col("basin") == F.col("into")).drop("into").join(into.select("basin", "name"), "basin")
    below = into.select(F.col("basin").alias("downstream"), F.col("name").alias("below"))
    own = own.join(below, "downstream", "left").select(F.col("name").alias("basin"), "outlet", F.when(F.col("below") != F.col("name"), F.col("below")).alias("downstream"), "max_accum", "edge")
    return labels.join(into.select("basin", "name"), "basin").select("node", F.col("name").alias("basin")), own


def channels(cells: DataFrame, labels: DataFrame, basins: DataFrame) -> DataFrame:
    """basin, i, node: each basin's main channel from its outlet up, always to the donor inside the basin that gathers most
    (ties in the order of EIGHT), to a cell without donors in it."""
    tree = main_tree(cells).join(labels, "node")
    side = tree.select("node", "basin", "acc", "main").join(labels.select(F.col("node").alias("main"), F.col("basin").alias("m_basin")), "main").where("basin = m_basin")
    step = (F.floor(F.col("node") / WIDE) - F.floor(F.col("main") / WIDE)) * 10 + F.col("node") % WIDE - F.col("main") % WIDE
    k = F.coalesce(*(F.when(step == a * 10 + b, i) for i, (a, b) in enumerate(EIGHT)))
    donors = side.select(F.col("node").alias("a"), F.col("main").alias("b"), "acc", k.alias("k"))
    walked = networks.main_channel(donors, basins.select(F.col("outlet").alias("node")))
    return walked.join(basins.select(F.col("outlet").alias("start"), "basin"), "start").select("basin", "i", "node")


def clipped(labels: DataFrame, basins: DataFrame, walked: DataFrame, box: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, basins and channels within a box of rows and columns, numbered anew.

    A basin with cells or its outlet outside counts as cut by the edge and loses an outlet that is outside (null); a downstream
    basin without cells inside becomes null. Channels end where they first leave the box, and are empty without their
    outlet; ``truncated`` says that one was cut. max_accum stays what the whole grid gave.
    """
    inside = lambda c: F.floor(F.col(c) / WIDE).between(box[0], box[1]) & (F.col(c) % WIDE).between(box[2], box[3])
    counts = labels.groupBy("basin").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(inside("node"), 1)).alias("here")).where("here > 0")
    names = checkpointed(numbered(counts, [F.col("basin")], "name"))
    out = labels.where(inside("node")).join(names.select("basin", "name"), "basin").select("node", F.col("name").alias("basin"))
    first_out = walked.groupBy("basin").agg(F.min(F.when(~inside("node"), F.col("i"))).alias("cut"), F.count(F.lit(1)).alias("steps"))
    kept = walked.join(first_out, "basin").join(names.select("basin", "name"), "basin").where("cut IS NULL OR i < cut").select(F.col("name").alias("basin"), "i", "node")
    below = names.select(F.col("basin").alias("downstream"), F.col("name").alias("below"))
    own = basins.join(names, "basin").join(below, "downstream", "left").join(first_out, "basin", "left")
    held = inside("outlet")
    own = own.select(
        F.col("name").alias("basin"), F.when(held, F.col("outlet")).alias("outlet"), F.col("below").alias("downstream"), "max_accum",
        (F.col("edge") | (F.col("here") < F.col("total")) | ~held).alias("edge"), F.col("cut").isNotNull().alias("truncated"),
    )
    return out, own, kept


def exported(labels: DataFrame, basins: DataFrame, walked: DataFrame, cell: float) -> DataFrame:
    """A row a basin: area and box from its cells, outlet, downstream, length of the main channel (straight and diagonal steps)
    and its source."""
    place = [F.floor(F.col("node") / WIDE).alias("row"), (F.col("node") % WIDE).alias("col")]
    areas = labels.select("basin", *place).groupBy("basin").agg((F.count(F.lit(1)) * cell * cell).alias("area"), F.min("row").alias("north"), F.max("row").alias("south"), F.min("col").alias("west"), F.max("col").alias("east"))
    steps = walked.select("basin", "i", *place)
    after = steps.select("basin", (F.col("i") - 1).alias("i"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    length = F.sum(F.when((F.col("row") != F.col("r2")) & (F.col("col") != F.col("c2")), math.sqrt(2)).when(F.col("r2").isNotNull(), 1.0).otherwise(0.0)) * cell
    lines = steps.join(after, ["basin", "i"], "left").groupBy("basin").agg(length.alias("channel_length"), F.max_by(F.struct("row", "col"), "i").alias("source"))
    return basins.join(areas, "basin").join(lines, "basin", "left")


def upstream_of(basins: DataFrame, starts: DataFrame) -> DataFrame:
    """start, basin: each start (basin) and all basins above it."""
    links = basins.where("downstream IS NOT NULL").select(F.col("basin").alias("node"), F.col("downstream").alias("to"))
    return networks.upstream(links, starts.select(F.col("basin").alias("node"))).select("start", F.col("node").alias("basin"))


def catchments(basins: DataFrame, starts: DataFrame, areas: DataFrame) -> DataFrame:
    """start, area, max_accum, edge, lowest: sums over all basins above each start; lowest is the one that gathers most."""
    up = upstream_of(basins, starts).join(basins, "basin").join(areas.select("basin", "area"), "basin")
    return up.groupBy("start").agg(F.sum("area").alias("area"), F.max("max_accum").alias("max_accum"), F.bool_or("edge").alias("edge"), F.max_by("basin", F.struct("max_accum", "basin")).alias("lowest"))
