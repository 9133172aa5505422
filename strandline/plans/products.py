"""Derived products: tile rows, outlines, dissolved areas, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import testbed as tb
from strandline.functions import codec
from strandline.operators import distance, raster
from strandline.operators.iterate import checkpointed, shared_folder
from strandline.plans import rasters

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col
CELL = rasters.CELL


def _register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


@_register("k08_tile_rows", f"with {CELL}, p as (select row, col, cast(floor((cast(elev as double) / 1000 + 32768) * 256) as bigint) as v from cell) select row // 16 as ty, col // 16 as tx, count(*) as cells, sum(coalesce((v >> 8) & 255, 0))::bigint as g, sum(coalesce(v & 255, 0))::bigint as b from p group by 1, 2 having count(v) > 0")
def tile_rows(spark, sf_dir):
    packed = codec.pack_height(c("elev") / 1000.0)
    t = tb.cells(spark, sf_dir).select(F.floor(c("row") / 16).alias("ty"), F.floor(c("col") / 16).alias("tx"), "elev", packed.alias("p"))
    return t.groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("cells"), F.sum("p.g").alias("g"), F.sum("p.b").alias("b"), F.count("elev").alias("n")).where("n > 0").drop("n")


@_register("a34_covered_outline", f"with {CELL}, m as (select row, col, cast(coalesce(elev > 2800, false) as int) as v from cell), d as (select a.row, a.col, max(b.v) as v from m a join m b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2), k as (select a.row, a.col, min(b.v) as v from d a join d b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) select a.row, a.col, count(*) as sides from k a join k b on abs(a.row - b.row) + abs(a.col - b.col) = 1 where a.v = 1 and b.v = 0 group by 1, 2")
def covered_outline(spark, sf_dir):
    mask = tb.cells(spark, sf_dir).select("row", "col", F.coalesce(c("elev") > 2800, F.lit(False)).cast("int").alias("v"))
    return raster.neighbours(raster.closing(mask, 1, "v"), raster.structure(4), "v").where("v = 1 and n_v = 0").groupBy("row", "col").agg(F.count(F.lit(1)).alias("sides"))


@_register("s10_dissolved_areas", f"with {tb.FEATURES_SQL} select code as key, count(*) as rings, min(id) as first_id, min(x) as xmin, max(x) + 20 as xmax from fc group by code having min(x) <= 600 and max(x) + 20 >= 100 and min(y) <= 600 and max(y) + 10 >= 100")
def dissolved_areas(spark, sf_dir):
    f = tb.features(spark, sf_dir).groupBy(c("code").alias("key")).agg(F.count(F.lit(1)).alias("rings"), F.min("id").alias("first_id"), F.min("x").alias("xmin"), (F.max("x") + 20).alias("xmax"), F.min("y").alias("ymin"), (F.max("y") + 10).alias("ymax"))
    return f.where("xmin <= 600 and xmax >= 100 and ymin <= 600 and ymax >= 100").drop("ymin", "ymax")


#: dist: every cell's distance to its nearest seed; first_: the first lowest cell inland with the distances around it.
SECTION = "dist as (select a.row, a.col, min(sqrt((a.row - s.row) * (a.row - s.row) + (a.col - s.col) * (a.col - s.col))) as d from cell a join cell s on s.seed group by 1, 2), first_ as (select lev.row, lev.col, dist.d, e.d as e, w.d as w, n.d as n, s.d as s from lev join dist using (row, col) left join dist e on e.row = lev.row and e.col = lev.col + 1 left join dist w on w.row = lev.row and w.col = lev.col - 1 left join dist n on n.row = lev.row - 1 and n.col = lev.col left join dist s on s.row = lev.row + 1 and s.col = lev.col where dist.d > 1.5 order by h, lev.row, lev.col limit 1), slope as (select row, col, (coalesce(e, d) - coalesce(w, d)) / (case when e is null or w is null then 1 else 2 end) as gx, (coalesce(s, d) - coalesce(n, d)) / (case when s is null or n is null then 1 else 2 end) as gy from first_), unit as (select row, col, case when sqrt(gx * gx + gy * gy) < 1e-9 then 0 else gx / sqrt(gx * gx + gy * gy) end as ex, case when sqrt(gx * gx + gy * gy) < 1e-9 then 1 else -gy / sqrt(gx * gx + gy * gy) end as ny from slope)"


@_register("m08_default_section", f"with recursive {CELL}, {rasters.LEV}, {SECTION} select row, col, round((col + 0.5) * 5 - ex * 80, 1)::double as from_x, round((row + 0.5) * -5 - ny * 80, 1)::double as from_y, round((col + 0.5) * 5 + ex * 160, 1)::double as to_x, round((row + 0.5) * -5 + ny * 160, 1)::double as to_y from unit")
def default_section(spark, sf_dir):
    """The section through the first lowest cell inland, from the water to the land across the shore."""
    field = checkpointed(distance.seed_field(tb.cells(spark, sf_dir)))
    return distance.first_section(rasters.h_conn(spark, sf_dir), field, 1.5, 5.0, 80.0, 160.0)


@_register("s25_typed_reread", f"with {tb.FEATURES_SQL} select id, id % 2 = 0 as flag from fc")
def typed_reread(spark, sf_dir):
    text = tb.features(spark, sf_dir).select("id", F.when(c("id") % 2 == 0, "true").otherwise("false").alias("flag"))
    return text.select("id", c("flag").try_cast("boolean").alias("flag"))


@_register("k01_layer_round_trip", f"with {CELL} select row, col, elev from cell")
def layer_round_trip(spark, sf_dir):
    """A layer written as Parquet by area and condition in the shared folder and read again."""
    import uuid

    from strandline.sources.sinks import write_cells

    path = f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}"
    cells = tb.cells(spark, sf_dir).select(F.lit("bench").alias("aoi"), F.lit("highres").alias("cond"), "row", "col", "elev", F.lit(None).cast("long").alias("h"))
    write_cells(cells, path)
    return spark.read.parquet(path).where("cond = 'highres'").select("row", "col", "elev")
