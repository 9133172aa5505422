"""Drainage and basins of the test bed's grid over its filled surface.

The SQL follows cells one after another: flats and receivers by neighbour joins, flow by recursion along receivers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import testbed as tb
from strandline.operators import basins, drainage, flow, tiles
from strandline.operators.iterate import checkpointed
from strandline.operators.order import numbered
from strandline.plans import rasters

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col
TILE, CHANNEL, LEAST, MOST = 64, 12.0, 6, 40
BOX = (5, 30, 5, 40)


def _register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def _drained(spark, sf_dir, steepest: bool = False):
    cells = tb.cells(spark, sf_dir)
    return drainage.drained(flow.filled(cells, TILE), steepest=steepest, size=TILE, box=tiles.extent(cells))


def _basins(spark, sf_dir):
    cells = checkpointed(_drained(spark, sf_dir))
    return cells, *basins.junction_basins(cells, CHANNEL)


#: surf: filled heights with steps on flats as a second key, from ``cell`` (row, col, elev).
SURF = f"""{rasters.FILL}, dim as (select max(row) as rows, max(col) as cols from cell),
zero as (select a.row, a.col from fil a, dim where a.row in (0, rows) or a.col in (0, cols) or exists (select 1 from cell b where greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1 and b.elev is null) or exists (select 1 from fil b where greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1 and b.fill < a.fill)),
flat(row, col, steps) using key (row, col) as (select row, col, 0::bigint from zero union select n.row, n.col, r.steps + 1 from flat r join fil f on f.row = r.row and f.col = r.col join fil n on greatest(abs(n.row - r.row), abs(n.col - r.col)) = 1 and n.fill = f.fill left join recurring.flat v on v.row = n.row and v.col = n.col where v.row is null or v.steps > r.steps + 1),
surf as (select fil.row, fil.col, fil.row * 1000000000 + fil.col as node, fil.fill, steps, fil.fill + steps * pow(2.0, -28) as z from fil join flat using (row, col))"""
_FACETS = " union all ".join(f"select {k} as k, {s[0]} as r1, {s[1]} as c1, {d[0]} as r2, {d[1]} as c2" for k, (s, d) in enumerate(flow.FACETS))
#: link: receivers and shares; term: cells that end (sink, edge).
LINKS = f"""facet as ({_FACETS}),
tri as (select s.node, s.row, s.col, s.z as e0, k, s.row + r1 as ra, s.col + c1 as ca, s.row + r2 as rb, s.col + c2 as cb, n1.node as na, n2.node as nb, coalesce(n1.z, -1e18) as e1, coalesce(n2.z, -1e18) as e2
  from surf s cross join facet, dim left join surf n1 on n1.row = s.row + r1 and n1.col = s.col + c1 left join surf n2 on n2.row = s.row + r2 and n2.col = s.col + c2
  where s.row + r1 between 0 and rows and s.row + r2 between 0 and rows and s.col + c1 between 0 and cols and s.col + c2 between 0 and cols),
ang as (select *, atan2(e1 - e2, e0 - e1) as a from tri),
best as (select * from (select *, row_number() over (partition by node order by s desc, k) as n from (select *, case when a < 0 then e0 - e1 when a > pi() / 4 then (e0 - e2) / sqrt(2) else sqrt((e0 - e1) * (e0 - e1) + (e1 - e2) * (e1 - e2)) end as s, least(greatest(a, 0), pi() / 4) / (pi() / 4) as p from ang) where s > 0) where n = 1),
ends as (select node, (p < 1 and na is null) or (p > 0 and nb is null) as sink from best),
link as (select b.node as a, na as b, 1 - p as share from best b join ends using (node) where not sink and p < 1 union all select b.node, nb, p from best b join ends using (node) where not sink and p > 0),
term as (select s.node, coalesce(sink, false) as sink, not coalesce(sink, false) and (s.row in (0, rows) or s.col in (0, cols)) as edge from surf s left join ends using (node), dim where not exists (select 1 from link where link.a = s.node))"""
#: acc and share by node: flow moves along links level by level.
SUMS = """down(node, w) as (select node, 1.0::double from surf union all select link.b, sum(down.w * link.share) from down join link on link.a = down.node group by link.b),
back(node, w) as (select node, 1.0::double from term where edge union all select link.a, sum(back.w * link.share) from back join link on link.b = back.node group by link.a),
total as (select d.node, d.acc, coalesce(b.share, 0) as share from (select node, sum(w) as acc from down group by 1) d left join (select node, sum(w) as share from back group by 1) b using (node))"""
FLOW = f"{rasters.CELL}, {SURF}, {LINKS}, {SUMS}"
#: outlet: where basins end; label: each cell's outlet and basin; bs: basins.
BASINS = f"""main as (select s.node, (select l.b from link l where l.a = s.node order by l.share desc, (l.b = (select coalesce(na, nb) from best where best.node = s.node)) desc limit 1) as main from surf s),
tree as (select main.*, acc, share, acc >= {CHANNEL} as channel from main join total using (node)),
meet as (select t.main as node from tree t join tree m on m.node = t.main where t.channel and m.channel group by 1 having count(*) >= 2),
outlet as (select node from tree where main is null or (channel and main in (select node from meet))),
id as (select node, row_number() over (order by node) as basin from outlet),
up(node, basin) as (select node, basin from id union all select t.node, up.basin from up join tree t on t.main = up.node where t.node not in (select node from outlet)),
bs as (select id.basin, id.node as outlet, d.basin as downstream, t.acc as max_accum, t.share > 0.5 as edge from id join tree t using (node) left join up d on d.node = t.main)"""


@_register("g05_flat_steps", f"with recursive {rasters.CELL}, {SURF} select row, col, fill, steps from surf")
def flat_steps(spark, sf_dir):
    """The order on flats of the filled surface: steps to the nearest outlet of a flat."""
    return _drained(spark, sf_dir, steepest=True).select("row", "col", c("fill").cast("long").alias("fill"), c("steps").cast("long").alias("steps"))


@_register("g10_drain_order", f"with recursive {rasters.CELL}, {SURF} select row, col, row_number() over (order by fill desc, steps desc, row, col) as place from surf")
def drain_order(spark, sf_dir):
    """Cells from the highest down, flats from the far end to their outlets: each after all that flow into it."""
    return numbered(flat_steps(spark, sf_dir), [F.desc("fill"), F.desc("steps"), c("row"), c("col")], "place").select("row", "col", "place")


@_register("g09_filled_facets", f"with recursive {rasters.CELL}, {SURF}, {LINKS} select s.row, s.col, round(max(l.share), 6) as larger, count(l.b) as receivers, coalesce(t.sink, false) as sink from surf s left join link l on l.a = s.node left join term t using (node) group by s.row, s.col, t.sink")
def filled_facets(spark, sf_dir):
    d = _drained(spark, sf_dir)
    larger = F.when((c("p1") > 0) | (c("p2") > 0), F.round(F.greatest("p1", "p2"), 6))
    return d.select("row", "col", larger.alias("larger"), ((c("p1") > 0).cast("long") + (c("p2") > 0).cast("long")).alias("receivers"), "sink")


@_register("g11_facet_accumulation", f"with recursive {FLOW} select node, round(acc, 5) as acc, round(share, 5) as edge_share from total")
def facet_accumulation(spark, sf_dir):
    return _drained(spark, sf_dir).select(tiles.node("row", "col").alias("node"), F.round("acc", 5).alias("acc"), F.round("edge_share", 5).alias("edge_share"))


INNER = tb.cells_sql("inner_", "highres")
COLLAR = f"{INNER}, wide as (select row, col, elev from base), cell as (select w.row, w.col, case when w.row >= 4 and w.row <= (select max(row) - 4 from base) and w.col >= 4 and w.col <= (select max(col) - 4 from base) then i.elev else w.elev end as elev from wide w join inner_ i using (row, col))"
COLLAR_FLOW = f"{tb.cells_sql('base', 'baseline')}, {COLLAR}, {SURF}, {LINKS}, {SUMS}"


def _collared(spark, sf_dir):
    """The inner part of one condition's grid, four cells off its edge, within the terrain of another condition."""
    around = tb.cells(spark, sf_dir, "baseline")
    r0, r1, c0, c1 = tiles.extent(around)
    own = tb.cells(spark, sf_dir).where(c("row").between(r0 + 4, r1 - 4) & c("col").between(c0 + 4, c1 - 4))
    return drainage.routed_with_collar(own, around, size=TILE)


@_register("g12_collar_routing", f"with recursive {COLLAR_FLOW} select s.row, s.col, round(acc, 5) as acc, round(share, 5) as edge_share from total join surf s using (node), dim where s.row between 4 and rows - 4 and s.col between 4 and cols - 4")
def collar_routing(spark, sf_dir):
    return _collared(spark, sf_dir)[0].select("row", "col", F.round("acc", 5).alias("acc"), F.round("edge_share", 5).alias("edge_share"))


@_register("g12_collar_conservation", f"with recursive {COLLAR_FLOW} select (select count(*) from surf) as valid, (select round(sum(acc), 4) from total join term using (node)) as gathered, true as sound")
def collar_conservation(spark, sf_dir):
    """All rain of the wider grid comes together at its ends."""
    return _collared(spark, sf_dir)[1].select("valid", F.round("gathered", 4).alias("gathered"), "sound")


@_register("g13_edge_truncated_share", f"with recursive {FLOW} select round(avg(share), 6) as share from total")
def edge_truncated_share(spark, sf_dir):
    """The mean share of a cell's water that leaves over the grid's edge."""
    return _drained(spark, sf_dir).agg(F.round(F.avg("edge_share"), 6).alias("share"))


@_register("g14_junction_basins", f"with recursive {FLOW}, {BASINS} select basin, outlet, downstream, round(max_accum, 5) as max_accum, edge from bs")
def junction_basins(spark, sf_dir):
    return _basins(spark, sf_dir)[2].withColumn("max_accum", F.round("max_accum", 5))


@_register("g14_junction_labels", f"with recursive {FLOW}, {BASINS} select node, basin from up")
def junction_labels(spark, sf_dir):
    return _basins(spark, sf_dir)[1]


@_register("g15_coarsened_basins")
def coarsened_basins(spark, sf_dir):
    """Basins after merging those of fewer than LEAST cells and then down to MOST; compared with one merge after another in tests."""
    _, labels, found = _basins(spark, sf_dir)
    _, own = basins.merged(labels, found, LEAST, MOST)
    return own.withColumn("max_accum", F.round("max_accum", 5))


@_register("g16_clipped_basins", f"with recursive {FLOW}, {BASINS}, i as (select basin, count(*) as total, count(*) filter (where node // 1000000000 between {BOX[0]} and {BOX[1]} and node % 1000000000 between {BOX[2]} and {BOX[3]}) as here from up group by 1), n as (select basin, row_number() over (order by basin) as name, total, here from i where here > 0), h as (select bs.*, outlet // 1000000000 between {BOX[0]} and {BOX[1]} and outlet % 1000000000 between {BOX[2]} and {BOX[3]} as held from bs) select n.name as basin, case when held then outlet end as outlet, d.name as downstream, (edge or n.here < n.total or not held) as edge from n join h using (basin) left join n d on d.basin = h.downstream")
def clipped_basins(spark, sf_dir):
    cells, labels, found = _basins(spark, sf_dir)
    return basins.clipped(labels, found, basins.channels(cells, labels, found), BOX)[1].select("basin", "outlet", "downstream", "edge")


CLOSURE = "closure(start, basin) as (select basin, basin from bs union all select k.start, bs.basin from closure k join bs on bs.downstream = k.basin)"


@_register("g17_upstream_closure", f"with recursive {FLOW}, {BASINS}, {CLOSURE} select start, basin from closure")
def upstream_closure(spark, sf_dir):
    found = checkpointed(_basins(spark, sf_dir)[2])
    return basins.upstream_of(found, found.select("basin"))


@_register("a28_catchment_summary", f"with recursive {FLOW}, {BASINS}, {CLOSURE}, n as (select basin, count(*) * 25 as area from up group by 1) select start, sum(area)::bigint as area, round(max(max_accum), 5) as max_accum, bool_or(edge) as edge from closure join bs using (basin) join n using (basin) group by 1")
def catchment_summary(spark, sf_dir):
    _, labels, found = _basins(spark, sf_dir)
    found = checkpointed(found)
    areas = labels.groupBy("basin").agg((F.count(F.lit(1)) * 25).alias("area"))
    return basins.catchments(found, found.select("basin"), areas).select("start", "area", F.round("max_accum", 5).alias("max_accum"), "edge")


@_register("g18_main_channel")
def main_channel(spark, sf_dir):
    """Main channels of all basins, outlet first; compared with a walk cell by cell in tests."""
    return basins.channels(*_basins(spark, sf_dir))


@_register("g28_basin_export", f"with recursive {FLOW}, {BASINS} select b.basin, outlet, downstream, edge, count(*) * 25.0::double as area, min(u.node // 1000000000) as north, max(u.node // 1000000000) as south, min(u.node % 1000000000) as west, max(u.node % 1000000000) as east from bs b join up u using (basin) group by all")
def basin_export(spark, sf_dir):
    cells, labels, found = _basins(spark, sf_dir)
    out = basins.exported(labels, checkpointed(found), basins.channels(cells, labels, found), 5.0)
    return out.select("basin", "outlet", "downstream", "edge", "area", "north", "south", "west", "east")


@_register("a33_flow_summary", f"with recursive {FLOW}, {BASINS}, wet as (select greatest(fill - elev, 0) as d from fil) select (select count(*) from bs) as basins, (select count(*) from total) as cells, (select round(max(acc), 5) from total) as most, (select sum(d)::bigint * 25 from wet) as fill_volume, (select round(avg(share), 6) from total) as edge_share")
def flow_summary(spark, sf_dir):
    """Counts, filled volume (mm on square metres) and the share of cells cut by the edge."""
    cells, _, found = _basins(spark, sf_dir)
    depth = tb.cells(spark, sf_dir).join(cells.select("row", "col", "fill"), ["row", "col"])
    volume = depth.agg((F.sum(F.greatest(c("fill").cast("long") - c("elev"), F.lit(0))) * 25).alias("fill_volume"))
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), F.round(F.max("acc"), 5).alias("most"), F.round(F.avg("edge_share"), 6).alias("edge_share"))
    count = found.agg(F.count(F.lit(1)).alias("basins"))
    return count.join(F.broadcast(sums), F.lit(True)).join(F.broadcast(volume), F.lit(True))  # a row each
