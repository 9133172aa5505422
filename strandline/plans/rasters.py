"""Grid operators on the test bed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import testbed as tb
from strandline.functions import flood
from strandline.operators import flow, pyramid, raster

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col
CELL, BASE = tb.cells_sql(), tb.cells_sql("base", "baseline")
LEV, LEVB = tb.level_sql(), tb.level_sql("levb", "base", "select row, col, cast(0 as bigint) as h from base where seed")


def _register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


@_register("s01_raster_read", f"with {CELL} select row, col, elev, (col + 0.5::double) * 5 as x, ((select max(row) from cell) - row + 0.5::double) * 5 as y from cell")
def raster_read(spark, sf_dir):
    cells = tb.cells(spark, sf_dir)
    last = cells.agg(F.max("row").alias("last"))
    return cells.join(F.broadcast(last), F.lit(True)).select("row", "col", "elev", ((c("col") + 0.5) * 5).alias("x"), ((c("last") - c("row") + 0.5) * 5).alias("y"))


@_register("s02_mosaic", f"with {CELL} select row, col, case when (row + col) % 3 = 0 then elev when (row + col) % 2 = 0 then elev + 7 end as elev from cell")
def mosaic(spark, sf_dir):
    cells = tb.cells(spark, sf_dir)
    first = cells.where((c("row") + c("col")) % 3 == 0).select("row", "col", "elev", F.lit(1).alias("priority"))
    second = cells.where((c("row") + c("col")) % 2 == 0).select("row", "col", (c("elev") + 7).alias("elev"), F.lit(2).alias("priority"))
    return raster.mosaic(cells, first.unionByName(second))


@_register("j20_priority_fill", f"with {CELL}, {tb.cells_sql('pc', 'pointcloud')} select cell.row, cell.col, coalesce(case when cell.col % 3 = 0 then pc.elev end, cell.elev) as elev from cell join pc using (row, col)")
def priority_fill(spark, sf_dir):
    cells, cloud = tb.cells(spark, sf_dir), tb.cells(spark, sf_dir, "pointcloud").where("col % 3 = 0").select("row", "col", c("elev").alias("cloud"))
    return cells.join(cloud, ["row", "col"], "left").select("row", "col", F.coalesce("cloud", "elev").alias("elev"))


@_register("s16_dem_coalesce", f"with {CELL}, {BASE} select cell.row, cell.col, coalesce(case when cell.row % 4 <> 0 then cell.elev end, base.elev) as elev from cell join base using (row, col)")
def dem_coalesce(spark, sf_dir):
    fine = tb.cells(spark, sf_dir).where("row % 4 <> 0").select("row", "col", c("elev").alias("fine"))
    return tb.cells(spark, sf_dir, "baseline").join(fine, ["row", "col"], "left").select("row", "col", F.coalesce("fine", "elev").alias("elev"))


@_register("a02_block_mean", f"with {CELL} select row // 3 as row, col // 3 as col, round(avg(elev), 6) as elev from cell where row // 3 < (select (max(row) + 1) // 3 from cell) and col // 3 < (select (max(col) + 1) // 3 from cell) group by 1, 2")
def block_mean(spark, sf_dir):
    return raster.block_mean(tb.cells(spark, sf_dir), 3).withColumn("elev", F.round("elev", 6))


@_register("a03_seed_downsample", f"with {CELL} select row // 2 as row, col // 2 as col, avg(cast(seed as int)) >= 0.5 as seed from cell where row // 2 < (select (max(row) + 1) // 2 from cell) group by 1, 2")
def seed_downsample(spark, sf_dir):
    mask = tb.cells(spark, sf_dir).select("row", "col", c("seed").cast("int").alias("seed"))
    return raster.block_mean(mask, 2, "seed").select("row", "col", (c("seed") >= 0.5).alias("seed"))


@_register("j11_upsample", f"with {CELL}, co as (select row // 5 as r, col // 5 as k, avg(elev) as m from cell group by 1, 2) select row, col, elev, round(m, 6) as coarse_elev from cell left join co on row // 5 = r and col // 5 = k")
def upsample(spark, sf_dir):
    cells = tb.cells(spark, sf_dir).drop("seed")
    return raster.upsample(cells, raster.block_mean(cells, 5), 5).withColumn("coarse_elev", F.round("coarse_elev", 6))


@_register("g03_h_conn", f"with recursive {CELL}, {LEV} select cell.row, cell.col, cell.elev, lev.h from cell left join lev using (row, col)")
def h_conn(spark, sf_dir):
    return raster.connection_levels(tb.cells(spark, sf_dir))


DRAIN = "select row, col, cast(0 as bigint) as h from cell where seed union all select row, col, cast(500 as bigint) from cell where (row * 7 + col * 13) % 211 = 5 and not seed"
LEV2 = tb.level_sql("lev2", "cell", DRAIN)


def _outfalls(cells):
    return cells.where("(row * 7 + col * 13) % 211 = 5").select("row", "col", F.lit(480).alias("invert"))


@_register("g04_h_conn_outfalls", f"with recursive {CELL}, {LEV2} select cell.row, cell.col, cell.elev, lev2.h from cell left join lev2 using (row, col)")
def h_conn_outfalls(spark, sf_dir):
    cells = tb.cells(spark, sf_dir)
    return raster.connection_levels(cells, _outfalls(cells))


@_register("g03_h_conn_tiled", f"with recursive {CELL}, {LEV} select cell.row, cell.col, cell.elev, lev.h from cell left join lev using (row, col)")
def h_conn_tiled(spark, sf_dir):
    return raster.connection_levels(tb.cells(spark, sf_dir), tile=tb.width(spark, sf_dir) // 2)


SWEEP = "(values (500), (1000), (1500), (2000), (2500)) as s(level)"


@_register("a31_flood_meta", f"with recursive {CELL}, {LEV} select count(*) as reached, count(*) * 25 as area, median(h)::double as median_h from lev")
def flood_meta(spark, sf_dir):
    h = h_conn(spark, sf_dir).where("h is not null")
    return h.agg(F.count("h").alias("reached"), (F.count("h") * 25).alias("area"), F.median("h").cast("double").alias("median_h"))


@_register("a32_wet_area_by_level", f"with recursive {CELL}, {LEV2}, w as (select level, count(*) filter (h <= level) * 25 as area from lev2, {SWEEP} group by level) select level, area, area >= coalesce(lag(area) over (order by level), 0) as rising from w")
def wet_area_by_level(spark, sf_dir):
    h = h_conn_outfalls(spark, sf_dir).where("h is not null").withColumn("level", F.explode(F.array(*map(F.lit, (500, 1000, 1500, 2000, 2500)))))
    area = h.groupBy("level").agg((F.count_if(c("h") <= c("level")) * 25).alias("area"))
    return area.withColumn("rising", c("area") >= F.coalesce(F.lag("area").over(Window.orderBy("level")), F.lit(0)))


@_register("j10_condition_algebra", f"with recursive {CELL}, {LEV}, {BASE}, {LEVB} select cell.row, cell.col, cell.elev - base.elev as d_elev, lev.h - levb.h as d_h from cell join base using (row, col) left join lev using (row, col) left join levb using (row, col)")
def condition_algebra(spark, sf_dir):
    a = h_conn(spark, sf_dir)
    b = raster.connection_levels(tb.cells(spark, sf_dir, "baseline")).select("row", "col", c("elev").alias("elev_b"), c("h").alias("h_b"))
    return a.join(b, ["row", "col"]).select("row", "col", (c("elev") - c("elev_b")).alias("d_elev"), (c("h") - c("h_b")).alias("d_h"))


@_register("a15_level_differences", f"with recursive {CELL}, {LEV}, {BASE}, {LEVB}, d as (select lev.h - levb.h as d from lev join levb using (row, col)) select quantile_cont(d, 0.05)::double as p5, quantile_cont(d, 0.5)::double as p50, quantile_cont(d, 0.95)::double as p95, round(avg(cast(abs(d) > 250 as int)), 6) as beyond from d")
def level_differences(spark, sf_dir):
    d = condition_algebra(spark, sf_dir).where("d_h is not null")
    return d.agg(*(F.percentile("d_h", p).alias(n) for n, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))), F.round(F.avg((F.abs("d_h") > 250).cast("int")), 6).alias("beyond"))


@_register("a16_compare_by_level", f"with recursive {CELL}, {LEV}, {BASE}, {LEVB}, j as (select level, coalesce(lev.h <= level, false) as wa, coalesce(levb.h <= level, false) as wb, base.elev - cell.elev as dd from cell join base using (row, col) left join lev using (row, col) left join levb using (row, col), {SWEEP}) select level, count(*) filter (wa) as wet_a, count(*) filter (wb) as wet_b, count(*) filter (wb and not wa) as newly_wet, count(*) filter (wa and not wb) as newly_dry, round(avg(dd) filter (wa and wb), 6) as mean_depth, max(dd) filter (wa and wb) as max_depth from j group by level")
def compare_by_level(spark, sf_dir):
    a = h_conn(spark, sf_dir)
    b = raster.connection_levels(tb.cells(spark, sf_dir, "baseline")).select("row", "col", c("elev").alias("elev_b"), c("h").alias("h_b"))
    j = a.join(b, ["row", "col"]).withColumn("level", F.explode(F.array(*map(F.lit, (500, 1000, 1500, 2000, 2500)))))
    j = j.withColumns({"wa": flood.reached(c("h"), c("level")), "wb": flood.reached(c("h_b"), c("level")), "dd": c("elev_b") - c("elev")})
    both = F.when(c("wa") & c("wb"), c("dd"))
    return j.groupBy("level").agg(
        F.count_if("wa").alias("wet_a"), F.count_if("wb").alias("wet_b"), F.count_if(c("wb") & ~c("wa")).alias("newly_wet"), F.count_if(c("wa") & ~c("wb")).alias("newly_dry"),
        F.round(F.avg(both), 6).alias("mean_depth"), F.max(both).alias("max_depth"),
    )


@_register("u02_mask_sets", f"with {CELL} select row, col, seed and coalesce(elev < 1000, false) as both, coalesce(elev < 1000, false) and not seed as only_low, seed or coalesce(elev < 1000, false) as either from cell")
def mask_sets(spark, sf_dir):
    low = F.coalesce(c("elev") < 1000, F.lit(False))
    return tb.cells(spark, sf_dir).select("row", "col", (c("seed") & low).alias("both"), (low & ~c("seed")).alias("only_low"), (c("seed") | low).alias("either"))


@_register("a04_zonal_percentile", f"with recursive {CELL}, {LEV} select row // 10 as zr, col // 10 as zc, round(quantile_cont(elev, 0.1), 6) as ground, min(h) as h from cell left join lev using (row, col) group by 1, 2")
def zonal_percentile(spark, sf_dir):
    return h_conn(spark, sf_dir).groupBy(F.floor(c("row") / 10).alias("zr"), F.floor(c("col") / 10).alias("zc")).agg(F.round(F.percentile("elev", 0.1), 6).alias("ground"), F.min("h").alias("h"))


@_register("a05_water_fraction", f"with {CELL} select row // 10 as zr, col // 10 as zc, round(avg(cast(seed as int)), 6) as water from cell group by 1, 2")
def water_fraction(spark, sf_dir):
    return tb.cells(spark, sf_dir).groupBy(F.floor(c("row") / 10).alias("zr"), F.floor(c("col") / 10).alias("zc")).agg(F.round(F.avg(c("seed").cast("int")), 6).alias("water"))


@_register("m03_zone_mask_share", f"with {CELL} select row // 8 as zr, count(*) filter (elev > 1500) as high, round(avg(cast((row * 50 + col) % 13 = 0 as int)), 6) as share from cell group by 1")
def zone_mask_share(spark, sf_dir):
    return tb.cells(spark, sf_dir).groupBy(F.floor(c("row") / 8).alias("zr")).agg(F.count_if(c("elev") > 1500).alias("high"), F.round(F.avg(((c("row") * 50 + c("col")) % 13 == 0).cast("int")), 6).alias("share"))


@_register("w05_flatness", f"with {CELL} select a.row, a.col, max(b.elev) - min(b.elev) <= 500 as flat from cell a join cell b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2")
def flatness(spark, sf_dir):
    cells = tb.cells(spark, sf_dir).select("row", "col", "elev")
    high = raster.box_filter(cells, 1, F.max).withColumnRenamed("elev", "high")
    return raster.box_filter(cells, 1, F.min).join(high, ["row", "col"]).select("row", "col", (c("high") - c("elev") <= 500).alias("flat"))


@_register("w06_despike", f"with {CELL}, m as (select a.row, a.col, any_value(a.elev) as z, quantile_cont(b.elev, 0.5) as med from cell a join cell b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) select row, col, case when coalesce(med - z <= 400, true) then z end as elev from m")
def despike(spark, sf_dir):
    return raster.despiked(tb.cells(spark, sf_dir).select("row", "col", "elev"), 1, 400)


@_register("w07_min_filter", f"with {CELL}, m as (select a.row, a.col, any_value(a.elev) as z, min(b.elev) as low from cell a join cell b on abs(a.row - b.row) <= 2 and abs(a.col - b.col) <= 2 group by 1, 2) select row, col, low, coalesce(z - low <= 500, false) as ground from m")
def min_filter(spark, sf_dir):
    cells = tb.cells(spark, sf_dir).select("row", "col", "elev")
    low = raster.box_filter(cells, 2).withColumnRenamed("elev", "low")
    return cells.join(low, ["row", "col"]).select("row", "col", "low", F.coalesce(c("elev") - c("low") <= 500, F.lit(False)).alias("ground"))


@_register("w09_closing", f"with {CELL}, m as (select row, col, cast(coalesce(elev > 1200, false) as int) as v from cell), d as (select a.row, a.col, max(b.v) as v from m a join m b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) select a.row, a.col, min(b.v) = 1 as closed from d a join d b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2")
def closing(spark, sf_dir):
    mask = tb.cells(spark, sf_dir).select("row", "col", F.coalesce(c("elev") > 1200, F.lit(False)).cast("int").alias("v"))
    return raster.closing(mask, 1, "v").select("row", "col", (c("v") == 1).alias("closed"))


@_register("w10_gradient", f"with {CELL} select row, col, (lead(elev) over (partition by row order by col) - lag(elev) over (partition by row order by col)) / 2.0::double as gx, (lead(elev) over (partition by col order by row) - lag(elev) over (partition by col order by row)) / 2.0::double as gy from cell")
def gradient(spark, sf_dir):
    along, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    central = lambda w: (F.lead("elev").over(w) - F.lag("elev").over(w)) / 2.0
    return tb.cells(spark, sf_dir).select("row", "col", central(along).alias("gx"), central(down).alias("gy"))


@_register("a22_crest_blocks", f"with {CELL} select row // 4 as block, max(elev) as crest, count(elev) as cells from cell where col <= 1 group by 1 having count(elev) >= 4")
def crest_blocks(spark, sf_dir):
    band = tb.cells(spark, sf_dir).where("col <= 1").groupBy(F.floor(c("row") / 4).alias("block")).agg(F.max("elev").alias("crest"), F.count("elev").alias("cells"))
    return band.where("cells >= 4")


@_register("a23_spill_level", f"with recursive {CELL}, {LEV}, i as (select * from lev where col >= 2 and h is not null) select min(h) as spill, (select count(*) from i where h = (select min(h) from i)) as cells, (select min(row * 1000000000 + col) from i where h = (select min(h) from i)) as first_cell, quantile_cont(h, 0.05)::double as p5, quantile_cont(h, 0.5)::double as p50 from i")
def spill_level(spark, sf_dir):
    inland = h_conn(spark, sf_dir).where("col >= 2 and h is not null").withColumn("cell", c("row") * 1000000000 + c("col"))
    low = inland.groupBy("h").agg(F.count(F.lit(1)).alias("cells"), F.min("cell").alias("first_cell")).agg(F.min("h").alias("spill"), F.min_by("cells", "h").alias("cells"), F.min_by("first_cell", "h").alias("first_cell"))
    return low.join(F.broadcast(inland.agg(F.percentile("h", 0.05).alias("p5"), F.percentile("h", 0.5).alias("p50"))), F.lit(True))


BORDER = "row in (0, (select max(row) from cell)) or col in (0, (select max(col) from cell))"
N8 = "greatest(abs(n.row - r.row), abs(n.col - r.col)) = 1"
FILL = f"out_ as (select a.row, a.col, a.elev from cell a where elev is not null and ({BORDER} or exists (select 1 from cell b where b.elev is null and greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1))), fr(row, col, f) as (select row, col, elev from out_ union select n.row, n.col, greatest(r.f, n.elev) from fr r join cell n on {N8} where n.elev is not null), fil as (select cell.row, cell.col, cell.elev, m.f as fill from cell join (select row, col, min(f) as f from fr group by 1, 2) m using (row, col))"


@_register("g05_fill", f"with recursive {CELL}, {FILL} select cell.row, cell.col, cell.elev, fil.fill from cell join fil using (row, col)")
def fill(spark, sf_dir):
    return flow.filled(tb.cells(spark, sf_dir))


SLOPES = "nb as (select a.row, a.col, b.row as tr, b.col as tc, (a.elev - b.elev) / (case when a.row <> b.row and a.col <> b.col then sqrt(2) else 1 end) as s, case when b.row < a.row and b.col = a.col then 0 when b.row > a.row and b.col = a.col then 1 when b.row = a.row and b.col < a.col then 2 when b.row = a.row then 3 when b.row < a.row and b.col < a.col then 4 when b.row < a.row then 5 when b.col < a.col then 6 else 7 end as k from cell a join cell b on greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1 where a.elev > b.elev), rec as (select row, col, tr, tc from (select *, row_number() over (partition by row, col order by s desc, k) as n from nb) where n = 1)"


@_register("g06_d8_directions", f"with {CELL}, {SLOPES} select row, col, elev, tr as to_row, tc as to_col from cell left join rec using (row, col) where elev is not null")
def d8_directions(spark, sf_dir):
    return flow.directions(tb.cells(spark, sf_dir))


def _d8_edges(spark, sf_dir):
    node = lambda r, k: F.col(r) * 1000000000 + F.col(k)
    d = d8_directions(spark, sf_dir).select(node("row", "col").alias("a"), node("to_row", "to_col").alias("b"))
    return d.select(c("a").alias("node")), d.where("b is not null")


PATHS = f"{SLOPES}, walk(src, row, col) as (select row * 1000000000 + col, row, col from cell where elev is not null union all select w.src, rec.tr, rec.tc from walk w join rec on rec.row = w.row and rec.col = w.col)"


@_register("g08_d8_accumulation", f"with recursive {CELL}, {PATHS} select row * 1000000000 + col as node, count(*)::double as acc from walk group by 1")
def d8_accumulation(spark, sf_dir):
    nodes, edges = _d8_edges(spark, sf_dir)
    return flow.accumulated_paths(edges, nodes.withColumn("w", F.lit(1.0)))


@_register("g14_basin_outlets", f"with recursive {CELL}, {PATHS} select w.src as node, w.row * 1000000000 + w.col as root from walk w where not exists (select 1 from rec where rec.row = w.row and rec.col = w.col)")
def basin_outlets(spark, sf_dir):
    nodes, edges = _d8_edges(spark, sf_dir)
    return flow.terminals(edges, nodes)


@_register("g09_facet_directions")
def facet_directions(spark, sf_dir):
    out = flow.facet_directions(tb.cells(spark, sf_dir))
    return out.select("row", "col", F.round("slope", 6).alias("slope"), c("to1.row").alias("row1"), c("to1.col").alias("col1"), F.round("p1", 9).alias("p1"), c("to2.row").alias("row2"), c("to2.col").alias("col2"), F.round("p2", 9).alias("p2"))


WETCELLS = "wet as (select row, col, elev, fill, row * 1000000000 + col as node from fil where fill - elev > 10), cc(node, row, col, root) as (select node, row, col, node from wet union select n.node, n.row, n.col, r.root from cc r join wet n on greatest(abs(n.row - r.row), abs(n.col - r.col)) = 1), rt as (select node, min(root) as root from cc group by node), pit as (select wet.*, dense_rank() over (order by root) as pit from wet join rt using (node))"


@_register("g19_pit_labels", f"with recursive {CELL}, {FILL}, {WETCELLS} select row, col, elev, fill, pit from pit")
def pit_labels(spark, sf_dir):
    return flow.pits(fill(spark, sf_dir).where("fill is not null"))


@_register("a26_pit_stats", f"with recursive {CELL}, {FILL}, {WETCELLS} select pit, count(*) * 25.0::double as area, max(fill - elev) as depth, sum(fill - elev)::bigint as volume, max(fill) as spill, max(elev) as top, min(elev) as bottom from pit group by pit")
def pit_stats(spark, sf_dir):
    return flow.pit_stats(pit_labels(spark, sf_dir), 25.0)


@_register("t04_top_pits", f"with recursive {CELL}, {FILL}, {WETCELLS} select pit, count(*) * 25.0::double as area from pit group by pit having count(*) >= 2 order by area desc, pit limit 20")
def top_pits(spark, sf_dir):
    return pit_stats(spark, sf_dir).where("area >= 50").select("pit", "area").orderBy(F.desc("area"), "pit").limit(20)


@_register("g20_pour_points", f"with recursive {CELL}, {FILL}, {WETCELLS}, rim as (select p.pit, p.row, p.col, p.fill, n.row as nr, n.col as nc, n.elev as z from pit p join cell n on greatest(abs(n.row - p.row), abs(n.col - p.col)) = 1 left join pit q on q.row = n.row and q.col = n.col where n.elev is not null and (q.pit is null or q.pit <> p.pit)) select pit, row, col, z as outside from (select *, row_number() over (partition by pit order by abs(z - fill), z, row, col) as k from rim) where k = 1")
def pour_points(spark, sf_dir):
    return flow.pour_points(pit_labels(spark, sf_dir), tb.cells(spark, sf_dir))


@_register("a27_basin_borders", f"with {CELL}, l as (select row, col, coalesce(elev, 0) // 700 as label from cell) select least(a.label, b.label) as a, greatest(a.label, b.label) as b, count(*) as n from l a join l b on (b.row = a.row and b.col = a.col + 1) or (b.row = a.row + 1 and b.col = a.col) where a.label <> b.label group by 1, 2")
def basin_borders(spark, sf_dir):
    return flow.border_lengths(tb.cells(spark, sf_dir).select("row", "col", F.floor(F.coalesce("elev", F.lit(0)) / 700).alias("label")))


SEEDC = f"low as (select row, col, row * 1000000000 + col as node from cell where coalesce(elev <= 1400, true)), cs(node, row, col, root) as (select node, row, col, node from low union select n.node, n.row, n.col, r.root from cs r join low n on abs(n.row - r.row) + abs(n.col - r.col) = 1), rs as (select node, min(root) as root from cs group by node), sz as (select root, count(*) as n, bool_or({BORDER}) as edge from rs join low using (node) group by root)"


@_register("g02_open_water", f"with recursive {CELL}, {SEEDC} select low.row, low.col, root from low join rs using (node) join sz using (root) where n >= 5 and edge")
def open_water(spark, sf_dir):
    from strandline.operators.iterate import components

    cells = tb.cells(spark, sf_dir)
    low = cells.where(F.coalesce(c("elev") <= 1400, F.lit(True))).withColumn("node", c("row") * 1000000000 + c("col"))
    pairs = raster.neighbours(low.select("row", "col", "node"), raster.structure(4), "node").select(c("node").alias("a"), c("n_node").alias("b"))
    ends = F.broadcast(cells.agg(F.max("row").alias("r1"), F.max("col").alias("c1")))
    roots = low.join(components(low.select("node"), pairs), "node").join(ends, F.lit(True))
    edge = (c("row") == 0) | (c("col") == 0) | (c("row") == c("r1")) | (c("col") == c("c1"))
    good = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.bool_or(edge).alias("edge")).where("n >= 5 and edge").select("root")
    return roots.join(good, "root").select("row", "col", "root")


@_register("a25_component_stats", f"with recursive {CELL}, {SEEDC} select root, count(*) as n, round(avg(low.row), 6) as mid_row, round(avg(low.col), 6) as mid_col from low join rs using (node) group by root having count(*) >= 3")
def component_stats(spark, sf_dir):
    from strandline.operators.iterate import components

    low = tb.cells(spark, sf_dir).where(F.coalesce(c("elev") <= 1400, F.lit(True))).withColumn("node", c("row") * 1000000000 + c("col"))
    pairs = raster.neighbours(low.select("row", "col", "node"), raster.structure(4), "node").select(c("node").alias("a"), c("n_node").alias("b"))
    roots = low.join(components(low.select("node"), pairs), "node")
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("row"), 6).alias("mid_row"), F.round(F.avg("col"), 6).alias("mid_col")).where("n >= 3")


@_register("g21_region_edges", f"with {CELL}, m as (select row, col, coalesce(elev > 1500, false) as v from cell) select a.row, a.col, count(*) as sides from m a join m b on abs(a.row - b.row) + abs(a.col - b.col) = 1 where a.v and not b.v group by 1, 2")
def region_edges(spark, sf_dir):
    mask = tb.cells(spark, sf_dir).select("row", "col", F.coalesce(c("elev") > 1500, F.lit(False)).alias("v"))
    return raster.neighbours(mask, raster.structure(4), "v").where(c("v") & ~c("n_v")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("sides"))


@_register("j15_seed_components", f"with recursive {CELL}, {SEEDC} select distinct rs.root from rs join low using (node) join cell on cell.row = low.row and cell.col = low.col where cell.seed")
def seed_components(spark, sf_dir):
    from strandline.operators.iterate import components

    low = tb.cells(spark, sf_dir).where(F.coalesce(c("elev") <= 1400, F.lit(True))).withColumn("node", c("row") * 1000000000 + c("col"))
    pairs = raster.neighbours(low.select("row", "col", "node"), raster.structure(4), "node").select(c("node").alias("a"), c("n_node").alias("b"))
    return components(low.select("node"), pairs).join(low.where("seed").select("node"), "node", "left_semi").select("root").distinct()


_ZOOM = " union all ".join(f"select {z} as zoom, row // {1 << z} as row, col // {1 << z} as col, elev, h from both_ where row % {1 << z} = {(1 << z) // 2} and col % {1 << z} = {(1 << z) // 2}" for z in range(3))


@_register("k08_tile_pyramid", f"with recursive {CELL}, {LEV}, both_ as (select cell.row, cell.col, elev, h from cell left join lev on lev.row = cell.row and lev.col = cell.col), px as (select zoom, row // 16 as ty, col // 16 as tx, row % 16 * 16 + col % 16 as place, case when elev is null then 0 else cast(floor((cast(elev as double) / 1000 + 32768) * 256) as bigint) end as v, case when h is null then 0 else least(h // 50 + 1, 255) end as a from ({_ZOOM}) where elev is not null or h is not null), tile as (select distinct zoom, ty, tx from px), full_ as (select tile.*, g.place from tile, (select unnest(range(256)) as place) g) select zoom, ty, tx, string_agg(case when v is null then '00000000' else printf('%06x%02x', v, a) end, '' order by f.place) as pixels from full_ f left join px using (zoom, ty, tx, place) group by zoom, ty, tx")
def tile_pyramid(spark, sf_dir):
    """Three zooms of tiles of 16 by 16 pixels with heights and connecting levels, their bytes in hexadecimal."""
    cells = h_conn(spark, sf_dir).select("row", "col", "elev", "h")
    return pyramid.pyramid(cells, 3, 16).withColumn("pixels", F.lower(F.hex("pixels")))


_POUR = "rim as (select p.pit, p.row, p.col, p.fill, n.elev as z from pit p join cell n on greatest(abs(n.row - p.row), abs(n.col - p.col)) = 1 left join pit q on q.row = n.row and q.col = n.col where n.elev is not null and (q.pit is null or q.pit <> p.pit)), pour as (select pit, row * 1000000000 + col as node from (select *, row_number() over (partition by pit order by abs(z - fill), z, row, col) as k from rim) where k = 1), area as (select pit, count(*) * 25.0::double as area from pit group by pit)"


@_register("j14_pit_of_basin", f"with recursive {CELL}, {FILL}, {WETCELLS}, {_POUR}, {PATHS}, e as (select w.src as node, w.row * 1000000000 + w.col as root from walk w where not exists (select 1 from rec where rec.row = w.row and rec.col = w.col)) select root, arg_max(pit, area * 1000000 - pit) as pit, max(area) as area from pour join e using (node) join area using (pit) group by root")
def pit_of_basin(spark, sf_dir):
    """For each basin the largest of the pits that spill into it: pour points take the basin of their cell."""
    at = pour_points(spark, sf_dir).select("pit", (c("row") * 1000000000 + c("col")).alias("node"))
    sized = at.join(pit_stats(spark, sf_dir).select("pit", "area"), "pit").join(basin_outlets(spark, sf_dir), "node")
    return sized.groupBy("root").agg(F.max_by("pit", F.struct("area", (-c("pit")).alias("p"))).alias("pit"), F.max("area").alias("area"))
