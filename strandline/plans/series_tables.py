"""Tide series, rain, parsing and client tables on the test bed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import testbed as tb
from strandline.functions import geo
from strandline.operators.iterate import checkpointed
from strandline.operators.order import running_sums
from strandline.operators import hierarchy, ranges, series
from strandline.sources import parsers, sinks

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col
FC = tb.FEATURES_SQL
#: Hourly levels: the largest event value of the hour for each event type, in mm.
HOURLY = "hourly as (select event_type as series, date_trunc('hour', ts) as ts, cast(round(max(value) * 10) as bigint) as level from events group by 1, 2)"
DAILY = HOURLY + ", daily as (select series, cast(ts as date) as day, max(level) as high, max(level) - min(level) as range from hourly group by 1, 2)"


def _register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def hourly(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    return e.groupBy(c("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.max("value") * 10).cast("long").alias("level"))


def daily(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("series", c("ts").cast("date").alias("day")).agg(F.max("level").alias("high"), (F.max("level") - F.min("level")).alias("range"))


@_register("s14_observed_peak", f"with {HOURLY} select series, max(level) as peak, strftime(arg_min(ts, (-level) * 10000000 + epoch(ts) / 3600), '%Y-%m-%d %H') as at from hourly group by 1")
def observed_peak(spark, sf_dir):
    return series.first_peak(hourly(spark, sf_dir), ["series"]).select("series", "peak", F.date_format("at", "yyyy-MM-dd HH").alias("at"))


@_register("a24_daily_maxima", f"with {DAILY}, k as (select *, row_number() over (partition by series order by high desc, day) as n from daily) select series, max(high) as highest, round(avg(high), 6) as mean_high, round(avg(high) filter (n <= 24), 6) as top24 from k group by 1")
def daily_maxima(spark, sf_dir):
    k = daily(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("high"), "day")))
    return k.groupBy("series").agg(F.max("high").alias("highest"), F.round(F.avg("high"), 6).alias("mean_high"), F.round(F.avg(F.when(c("n") <= 24, c("high"))), 6).alias("top24"))


@_register("w01_best_window", f"with {DAILY}, s as (select series, day, sum(range) over w as total, count(*) over w as n from daily window w as (partition by series order by day rows between current row and 13 following)) select series, max(total)::bigint as total, cast(arg_min(day, (-total) * 100000 + (day - date '2024-01-01')) as varchar) as start from s where n = 14 group by 1")
def best_window(spark, sf_dir):
    return series.best_window(daily(spark, sf_dir), ["series"], "range", 14).select("series", "total", c("start").cast("string").alias("start"))


POINTS = "pt as (select series, cast(epoch(ts) / 3600 as bigint) - 473352 as t, level as l from hourly)"


def _points(spark, sf_dir):
    hours = F.floor(F.unix_timestamp(c("ts").cast("timestamp")) / 3600) - 473352
    return hourly(spark, sf_dir).select("series", hours.alias("t"), "level")


@_register("w02_lead_intervals", f"with {HOURLY}, {POINTS} select series, t as t0, l as l0, lead(t) over w as t1, lead(l) over w as l1, row_number() over w as piece from pt window w as (partition by series order by t)")
def lead_intervals(spark, sf_dir):
    return series.intervals(_points(spark, sf_dir), ["series"]).withColumn("piece", c("piece").cast("long"))


@_register("j21_level_at", f"with {HOURLY}, {POINTS}, q as (select distinct series, x * 37 % 800 - 20 as q from pt, range(40) r(x)), w as (select series, t as t0, l as l0, lead(t) over (partition by series order by t) as t1, lead(l) over (partition by series order by t) as l1 from pt), b as (select series, min(t) as lo, max(t) as hi from pt group by 1) select q.series, q.q, round(case when t1 is null then l0 else l0 + (least(greatest(q, lo), hi) - t0) / (t1 - t0) * (l1 - l0) end, 6)::double as level from q join b using (series) join w on w.series = q.series and least(greatest(q, lo), hi) >= t0 and least(greatest(q, lo), hi) < coalesce(t1, t0 + 1)")
def level_at(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.select("series").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("series", (c("x") * 37 % 800 - 20).cast("long").alias("q")).distinct()
    return series.interpolated(q, p, "series", 24).withColumn("level", F.round("level", 6))


@_register("w03_playback", f"with {HOURLY}, {POINTS} select series, t, least(t + 6, max(t) over (partition by series)) as next_t from pt")
def playback(spark, sf_dir):
    return _points(spark, sf_dir).select("series", "t", F.least(c("t") + 6, F.max("t").over(Window.partitionBy("series"))).alias("next_t"))


NOW = "timestamp '2024-01-10 00:00:00'"


@_register("r01_forecast_window", f"with {HOURLY}, f as (select * from hourly where ts >= {NOW} and ts <= {NOW} + interval 168 hours) select series, count(*) as points, max(level) as peak, min(ts) - {NOW} > interval 1 hour as late_start, {NOW} + interval 168 hours - max(ts) > interval 12 hours as early_end from f group by 1")
def forecast_window(spark, sf_dir):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    f = series.forecast(hourly(spark, sf_dir), now).groupBy("series").agg(F.count(F.lit(1)).alias("points"), F.max("level").alias("peak"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return f.select("series", "points", "peak", (c("a") > now + F.expr("interval 1 hour")).alias("late_start"), (c("b") < now + F.expr("interval 156 hours")).alias("early_end"))


@_register("r02_client_refilter", f"with {HOURLY}, f as (select series, count(*) as points from hourly where ts >= {NOW} group by 1) select series, points from f where points >= 2")
def client_refilter(spark, sf_dir):
    f = hourly(spark, sf_dir).where(c("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).groupBy("series").agg(F.count(F.lit(1)).alias("points"))
    return f.where("points >= 2")


@_register("r03_last_good", f"with {HOURLY}, {POINTS}, g as (select series, t, case when t % 3 <> 0 then l end as v from pt) select series, t, last_value(v ignore nulls) over (partition by series order by t rows between unbounded preceding and current row) as shown from g")
def last_good(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = _points(spark, sf_dir).withColumn("v", F.when(c("t") % 3 != 0, c("level")))
    return g.select("series", "t", F.last("v", ignorenulls=True).over(w).alias("shown"))


@_register("r04_series_sweep", f"with {HOURLY}, {FC}, n as (select h1, count(*) as n from fc where h1 is not null group by 1) select series, strftime(ts, '%Y-%m-%d %H') as hour, coalesce(sum(n) filter (h1 <= level), 0)::bigint as flooded from hourly, n group by 1, 2")
def series_sweep(spark, sf_dir):
    """Counts up to a level are a running sum over the steps that occur, so a reading needs one look-up."""
    upto = checkpointed(series.level_bands(tb.features(spark, sf_dir), "h1"))
    most = F.broadcast(upto.agg(F.max("most").alias("most")))  # one row
    h = hourly(spark, sf_dir).join(most, F.lit(True)).withColumn("band", F.least(F.floor(c("level") / 50), c("most")))
    return h.join(upto.select("band", "flooded"), "band", "left").select("series", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.coalesce("flooded", F.lit(0)).alias("flooded"))


@_register("p37_local_time", f"with {HOURLY} select distinct strftime(ts + interval 9 hours, '%Y-%m-%d %H:%M') as jst, year(ts + interval 9 hours) as jst_year from hourly")
def local_time(spark, sf_dir):
    there = F.from_utc_timestamp(c("ts").cast("timestamp"), "Asia/Tokyo")
    return hourly(spark, sf_dir).select(F.date_format(there, "yyyy-MM-dd HH:mm").alias("jst"), F.year(there).cast("long").alias("jst_year")).distinct()


#: Fixed-width lines made of a customer's key: 24 heights, a date and the station.
def _tide_text(spark, sf_dir):
    f = tb.features(spark, sf_dir)
    cm = [F.when((c("id") + i) % 29 == 0, F.lit("   ")).otherwise(F.lpad(((c("id") * 7 + i * 11) % 200).cast("string"), 3, " ")) for i in range(24)]
    date = [F.lpad(x.cast("string"), 2, " ") for x in (F.when(c("id") % 2 == 0, 24).otherwise(99), c("id") % 12 + 1, c("id") % 28 + 1)]
    return f.select(F.concat(*cm, *date, F.when(c("id") % 5 == 0, "XX").otherwise("OS")).alias("value"))


TIDE = "t as (select make_date(cast(case when id % 2 = 0 then 2024 else 1999 end as bigint), id % 12 + 1, id % 28 + 1) as day, h as hour, (id * 7 + h * 11) % 200 as cm, (id + h) % 29 = 0 as blank, id from fc, range(24) r(h) where id % 5 <> 0)"


@_register("s13_tide_lines", f"with {FC}, {TIDE} select cast(day as varchar) as day, hour, cm from t where not blank")
def tide_lines(spark, sf_dir):
    return parsers.tide_lines(_tide_text(spark, sf_dir), "OS").select(c("day").cast("string").alias("day"), "hour", "cm")


@_register("s15_tide_lines_strict", f"with {FC}, {TIDE} select cast(day as varchar) as day, hour, case when blank then 0 else cm end as cm from t")
def tide_lines_strict(spark, sf_dir):
    return parsers.tide_lines(_tide_text(spark, sf_dir), "OS", strict=True).select(c("day").cast("string").alias("day"), "hour", "cm")


@_register("s11_census_values", f"with {FC} select cast(id as varchar) as key, case when id % 8 = 7 then null else id end as pop, case when id % 9 = 0 then 0 else 1 end as young, 2 as grown, 3 as old, id % 8 = 7 as suppressed, case when id % 8 <> 7 then id - (case when id % 9 = 0 then 0 else 1 end) - 5 end as age_unknown from fc where id % 4 <> 3")
def census_values(spark, sf_dir):
    f = tb.features(spark, sf_dir)
    key = F.when(c("id") % 4 == 3, "").otherwise(c("id").cast("string"))
    fields = F.array(key, F.when(c("id") % 8 == 7, "X").otherwise(c("id").cast("string")), F.when(c("id") % 9 == 0, "-").otherwise("1"), F.lit("2"), F.lit("3"))
    rows = f.select((c("id") + 2).alias("line"), fields.alias("fields"))
    return parsers.census_values(rows, ["pop", "young", "grown", "old"])


QUERIES["s12_area_stats"], ORACLES["s12_area_stats"] = census_values, ORACLES["s11_census_values"]


@_register("s16_elevation_tile", f"with {FC} select id as row, i as col, case when (id + i) % 5 = 0 then null else (id * 10 + i) / 4.0::double end as metres from fc, range(4) r(i)")
def elevation_tile(spark, sf_dir):
    cell = [F.when((c("id") + i) % 5 == 0, "e").otherwise(((c("id") * 10 + i) / 4.0).cast("string")) for i in range(4)]
    return parsers.elevation_tile(tb.features(spark, sf_dir).select(c("id").alias("row"), F.concat_ws(",", *cell).alias("value")))


@_register("s07_positions", f"with {FC} select id, i as place, (x + i)::double as lat, (y + i)::double as lon from fc, range(2) r(i)")
def positions(spark, sf_dir):
    text = F.concat_ws(" ", *(e.cast("string") for e in (c("x"), c("y"), F.lit(1), c("x") + 1, c("y") + 1, F.lit(2))))
    p = tb.features(spark, sf_dir).select("id", F.posexplode(parsers.positions(text)).alias("place", "p"))
    return p.select("id", "place", c("p")[0].alias("lat"), c("p")[1].alias("lon"))


@_register("s03_vertices_in_box", f"with {FC} select id, (y + 1)::double as lon, (x + 1)::double as lat from fc where y + 1 between 200 and 700 and x + 1 between 100 and 600")
def vertices_in_box(spark, sf_dir):
    text = F.concat_ws(" ", (c("x") + 1).cast("string"), (c("y") + 1).cast("string"), F.lit("5"))
    p = tb.features(spark, sf_dir).select("id", F.explode(parsers.positions(text)).alias("p")).select("id", c("p")[1].alias("lon"), c("p")[0].alias("lat"))
    return p.where("lon between 200 and 700 and lat between 100 and 600")


@_register("s06_rings_meeting_box", f"with {FC} select id, 1 as rings from fc where y <= 700 and y + 30 >= 200 and x <= 600 and x + 20 >= 100")
def rings_meeting_box(spark, sf_dir):
    p = lambda dx, dy: F.array((c("x") + dx).cast("double"), (c("y") + dy).cast("double"), F.lit(0.0))
    rings = F.array(F.array(p(0, 0), p(20, 0), p(20, 30), p(0, 30)), F.array(p(0, 0), p(1, 1)))
    return tb.features(spark, sf_dir).select("id", F.size(parsers.outer_rings(rings, 200.0, 100.0, 700.0, 600.0)).alias("rings")).where("rings > 0")


@_register("s24_pit_features", f"with {FC} select id as pit_id, x::double as x, y::double as y, (case when id % 2 = 0 then id * 0.5::double else id * 0.25::double end) as spill, section * 100.0::double as area from fc")
def pit_features(spark, sf_dir):
    f = tb.features(spark, sf_dir)
    props = F.map_from_arrays(F.array(F.lit("pit_id"), F.lit("area_ha"), F.lit("spill_elev_m_tp")), F.array(c("id").cast("string"), (c("section") / 100).cast("string"), F.when(c("id") % 2 == 0, (c("id") * 0.5).cast("string"))))
    geometry = F.to_json(F.struct(F.array(c("x").cast("double"), c("y").cast("double"), c("id") * 0.25).alias("coordinates")))
    return parsers.pits_of(f.select(props.alias("properties"), geometry.alias("geometry"))).withColumns({"pit_id": c("pit_id").cast("long"), "area": F.round("area", 6)})


@_register("t03_truncation_guard", f"with {FC} select count(*) as listed, min(section) as smallest, count(*) < 1000000 or min(section) < 1 as sound from fc")
def truncation_guard(spark, sf_dir):
    n = tb.features(spark, sf_dir).agg(F.count(F.lit(1)).alias("listed"), F.min("section").alias("smallest"))
    sound = (c("listed") < 1_000_000) | (c("smallest") < 1)
    return n.withColumn("sound", F.when(sound, True).otherwise(F.raise_error("the list was cut above the least area").cast("boolean")))


@_register("t06_budget_prefix", f"with {FC}, r as (select id, sum(section * 10 + 1) over (order by frontage nulls last, id) as points, sum(section * 100 + 5) over (order by frontage nulls last, id) as bytes from fc) select id from r where points <= 8000 and bytes <= 90000")
def budget_prefix(spark, sf_dir):
    """Nodes in order until a budget is spent: the sums only grow, so the prefix is a filter on them."""
    r = running_sums(tb.features(spark, sf_dir), [F.asc_nulls_last("frontage"), F.col("id")], {"points": c("section") * 10 + 1, "bytes": c("section") * 100 + 5})
    return r.where("points <= 8000 and bytes <= 90000").select("id")


@_register("t07_range_coalescing", f"with recursive {FC}, p as (select code, id, id as lo, id + 3 + id % 5 as hi, row_number() over (partition by code order by id) as n from fc), g(code, n, first, lo, hi) as (select code, n, n, lo, hi from p where n = 1 union all select p.code, p.n, case when joins then g.first else p.n end, case when joins then g.lo else p.lo end, case when joins then greatest(g.hi, p.hi) else p.hi end from g join p on p.code = g.code and p.n = g.n + 1, lateral (select p.lo - g.hi <= 20 and greatest(g.hi, p.hi) - g.lo <= 100 as joins)) select g.code, min(g.lo) as lo, max(g.hi) as hi, count(*) as parts, (max(g.hi) - min(g.lo) - sum(p.hi - p.lo))::bigint as extra from g join p using (code, n) group by g.code, first")
def range_coalescing(spark, sf_dir):
    """Reads of at most 100 bytes over gaps of at most 20, greedy from the left within a code."""
    p = tb.features(spark, sf_dir).select(c("code").alias("key"), "id", c("id").alias("lo"), (c("id") + 3 + c("id") % 5).alias("hi"))
    return ranges.coalesced(p, 20, 100).withColumnRenamed("key", "code")


#: A tree of boxes over the features: node n // 4 is the parent of n, a box holds what lies below, some nodes have content.
TREE = f"{FC}, tree as (select id, case when id > 0 then id // 4 end as parent, case when id % 3 <> 0 then id end as content, case when id < 60 then 0 else x - 60 end as west, case when id < 60 then 1000 else x + 60 end as east, case when id < 60 then 0 else y - 90 end as south, case when id < 60 then 1000 else y + 90 end as north, id % 5 = 0 as bare from fc)"


@_register("k11_pruned_tree", f"with recursive {TREE}, hit as (select *, west <= 600 and east >= 250 and south <= 700 and north >= 300 as meets from tree), alive(id) as (select id from hit where parent is null and meets union all select h.id from hit h join alive a on h.parent = a.id where h.meets), kept as (select hit.id, parent, case when bare or (west + 30 <= 600 and east - 30 >= 250 and south + 30 <= 700 and north - 30 >= 300) then content end as content from hit join alive using (id)), stay(id) as (select id from kept where content is not null union select k.parent from stay s join kept k on k.id = s.id where k.parent is not null) select id, parent, content from kept where id in (select id from stay)")
def pruned_tree(spark, sf_dir):
    """The boxes of a tree that meet an area, with their ancestors; content goes where its own smaller box misses it."""
    f = tb.features(spark, sf_dir)
    wide = lambda a, b: F.when(c("id") < 60, a).otherwise(b)
    west, east, south, north = wide(0, c("x") - 60), wide(1000, c("x") + 60), wide(0, c("y") - 90), wide(1000, c("y") + 90)
    box = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    inner = F.when(c("id") % 5 != 0, box(west + 30, south + 30, east - 30, north - 30))
    tree = f.select("id", F.when(c("id") > 0, F.floor(c("id") / 4)).alias("parent"), box(west, south, east, north).alias("box"), inner.alias("content_box"), F.when(c("id") % 3 != 0, c("id")).alias("content"))
    return hierarchy.pruned(tree, (250, 300, 600, 700))


@_register("k05_client_csv", f"with {FC} select id, cast(id as varchar) || ',\"a\"\"b,' || coalesce(cast(ground as varchar), '') || '\"' as line from fc")
def client_csv(spark, sf_dir):
    name = F.concat(F.lit('a"b,'), F.coalesce(c("ground").cast("string"), F.lit("")))
    return tb.features(spark, sf_dir).withColumn("name", name).select("id", sinks.csv_line("id", "name").alias("line"))


@_register("k05_feature_json", f"with {FC} select id, cast(json_extract(json_object('x', x), '$.x') as bigint) as x, id as pid from fc")
def feature_json(spark, sf_dir):
    text = sinks.feature_json("x", "y", ["id"])
    return tb.features(spark, sf_dir).select("id", F.get_json_object(text, "$.geometry.coordinates[0]").cast("long").alias("x"), F.get_json_object(text, "$.properties.id").cast("long").alias("pid"))


@_register("m14_point_buffer", f"with {FC} select id, section as pop, null::bigint as missing from fc")
def point_buffer(spark, sf_dir):
    text = F.concat(F.lit('{"id":"p","radii":{"250":{"pop":'), c("section").cast("string"), F.lit("}}}"))
    b = parsers.point_buffer(text)
    return tb.features(spark, sf_dir).select("id", b["radii"]["250"]["pop"].alias("pop"), F.try_element_at(b["radii"], F.lit("500"))["pop"].alias("missing"))


RAINS = "(values ('r10', 10.0::double, 1.0::double), ('r50', 50, 1), ('r120', 120, 3), ('r300', 300, 24)) as s(name, mm, hours)"


@_register("p30_scenarios", f"with {FC} select id, coalesce(case when section = 0 then 'r50' when section = 1 then 'r120' when section = 2 then 'r300' end, 'r10') as name from fc")
def rain_scenarios(spark, sf_dir):
    wanted = F.concat(F.lit("r"), F.when(c("section") == 0, 50).when(c("section") == 1, 120).when(c("section") == 2, 300).otherwise(999).cast("string"))
    known = F.array(*map(F.lit, ("r10", "r50", "r120", "r300")))
    return tb.features(spark, sf_dir).select("id", F.when(F.array_contains(known, wanted), wanted).otherwise(F.get(known, F.lit(0))).alias("name"))


@_register("p36_affine_fit", f"with {FC}, s as (select count(*)::double as n, sum(x)::double as sx, sum(y)::double as sy, sum(x * x)::double as sxx, sum(x * y)::double as sxy, sum(y * y)::double as syy from fc) select 3.0::double as ax, -2.0::double as ay, 7.0::double as a0 from s")
def affine_fit(spark, sf_dir):
    """Least squares of z = ax x + ay y + a0 by the normal equations: six sums and one 3 x 3 solution."""
    f = tb.features(spark, sf_dir).withColumn("z", 3.0 * c("x") - 2.0 * c("y") + 7.0)
    m = f.agg(*(F.avg(c(a) * c(b)).alias(a + b) for a, b in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "z"), ("y", "z"))), *(F.avg(k).alias(k) for k in "xyz"))
    cov = lambda a, b: c(a + b) - c(a) * c(b)
    det = cov("x", "x") * cov("y", "y") - cov("x", "y") * cov("x", "y")
    ax, ay = (cov("x", "z") * cov("y", "y") - cov("y", "z") * cov("x", "y")) / det, (cov("y", "z") * cov("x", "x") - cov("x", "z") * cov("x", "y")) / det
    return m.select(F.round(ax, 6).alias("ax"), F.round(ay, 6).alias("ay"), F.round(c("z") - ax * c("x") - ay * c("y"), 4).alias("a0"))


@_register("m01_ring_groups", f"with {FC} select code, count(*) as parts, sum(200)::double as area from fc group by code")
def ring_groups(spark, sf_dir):
    p = lambda dx, dy: F.struct((c("x") + dx).cast("double").alias("x"), (c("y") + dy).cast("double").alias("y"))
    f = tb.features(spark, sf_dir).select("code", geo.ring_area(F.array(p(0, 0), p(20, 0), p(20, 10), p(0, 10))).alias("a")).where("a > 0")
    return f.groupBy("code").agg(F.count(F.lit(1)).alias("parts"), F.sum("a").alias("area"))


@_register("m04_road_parts", f"with {FC} select id, i as part from fc, range(2) r(i) where kind = 'road' and section not in (2, 3, 5, 6)")
def road_parts(spark, sf_dir):
    f = tb.features(spark, sf_dir).where((c("kind") == "road") & ~c("section").isin(2, 3, 5, 6))
    return f.select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("part"))


@_register("m22_members", f"with {FC} select code, count(*) as members from fc where id % 10 <> 3 group by code")
def members(spark, sf_dir):
    return tb.features(spark, sf_dir).where(c("id") % 10 != 3).groupBy("code").agg(F.count(F.lit(1)).alias("members"))


@_register("m13_summary_projection", f"with {FC} select id, ground is not null as has_shape, coalesce(ground, 0) as metres from fc")
def summary_projection(spark, sf_dir):
    layer = F.struct(c("ground").alias("polygon"), F.coalesce("ground", F.lit(0)).alias("metres"))
    return tb.features(spark, sf_dir).select("id", layer.alias("l")).select("id", c("l.polygon").isNotNull().alias("has_shape"), "l.metres")
