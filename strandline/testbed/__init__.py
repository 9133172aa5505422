"""Grids, features, zones and series derived from the bench tables by integer arithmetic.

The SQL texts state the same derivations for an oracle; expressions shared by both engines are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = (1000, 1500, 2000)

GROUND = "70 * (c_custkey % 50 + 1)"
UP = f"cast(ceil(({GROUND}) / 50.0) as bigint) * 50"
FEATURE = {
    "id": "c_custkey",
    "kind": "case when c_custkey % 4 = 0 then 'road' else 'building' end",
    "section": "c_custkey % 8",
    "water": "cast(c_custkey % 10 as double) / 10",
    "ground": f"case when c_custkey % 13 = 0 then null else {GROUND} end",
    "h1": f"case when c_custkey % 11 = 0 then null else {UP} + 50 * (c_custkey % 5) end",
    "h2": f"case when c_custkey % 17 = 0 then null else {UP} + 50 * (c_custkey % 3) end",
    "frontage": "case when c_custkey % 7 = 0 then null else c_custkey % 3 end",
    "x": "c_custkey * 7919 % 1000",
    "y": "c_custkey * 104729 % 1000",
    "code": "c_nationkey",
    "usage": "c_mktsegment",
}
FEATURES_SQL = "fc as (select " + ", ".join(f"{e} as {n}" for n, e in FEATURE.items()) + " from customer)"
SCENARIO_SQL = FEATURES_SQL + ", fs as (select fc.*, unnest([1000, 1500, 2000]) as level from fc)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} as {n}" for n, e in FEATURE.items()))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features at each reporting level."""
    return features(spark, sf_dir).withColumn("level", F.explode(F.array(*(F.lit(x).cast("long") for x in LEVELS))))


def width(spark: SparkSession, sf_dir: str) -> int:
    n = table(spark, sf_dir, "part").count()
    return 20 if n < 1000 else 50 if n < 10_000 else 200


W_SQL = "(select case when count(*) < 1000 then 20 when count(*) < 10000 then 50 else 200 end from part)"
#: Heights of the conditions in mm from a part's size; null is no data.
CONDITIONS = {
    "highres": "70 * p_size",
    "baseline": "greatest(70 * p_size + (p_partkey * 7 % 5 - 2) * 50, 0)",
    "pointcloud": "case when p_partkey % 13 = 0 then 70 * p_size - 35 else 70 * p_size end",
}


def cells(spark: SparkSession, sf_dir: str, cond: str = "highres") -> DataFrame:
    """row, col, elev (mm, null: no data), seed (open water): a dense grid."""
    w = width(spark, sf_dir)
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / w).cast("long").alias("row"), (F.col("p_partkey") % w).alias("col"),
        F.expr(f"cast(case when p_partkey % 97 = 0 then null else {CONDITIONS[cond]} end as bigint)").alias("elev"),
        F.expr(f"p_partkey % {w} = 0 and p_partkey % 97 <> 0").alias("seed"),
    )


def cells_sql(name: str = "cell", cond: str = "highres") -> str:
    return f"{name} as (select p_partkey // {W_SQL} as row, p_partkey % {W_SQL} as col, cast(case when p_partkey % 97 = 0 then null else {CONDITIONS[cond]} end as bigint) as elev, (p_partkey % {W_SQL} = 0 and p_partkey % 97 <> 0) as seed from part)"


def level_sql(name: str = "lev", cell: str = "cell", start: str = "select row, col, cast(0 as bigint) as h from cell where seed") -> str:
    """Recursive SQL for the least connecting level (4 neighbours, 50 mm sweep up to 3 m)."""
    return (
        f"{name}_r(row, col, h) as ({start} union select n.row, n.col, greatest(r.h, cast(ceil(greatest(n.elev, 0) / 50.0) as bigint) * 50) "
        f"from {name}_r r join {cell} n on abs(n.row - r.row) + abs(n.col - r.col) = 1 where n.elev is not null and n.elev <= 3000), "
        f"{name} as (select row, col, min(h) as h from {name}_r group by row, col)"
    )
