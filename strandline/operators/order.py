"""Numbers and running sums in one order over whole tables, without sending a table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.iterate import checkpointed

_ROW = (1 << 33) - 1  # the row's place in its partition within monotonically_increasing_id


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """Rows in sorted ranges, one a partition, with their place (_at) in the order of all; fixed by a checkpoint."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _before(parts: DataFrame, names: list[str]) -> DataFrame:
    """What came before each partition: a row a partition, so one task and a broadcast do."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select(F.col("_part").alias("_p"), *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_{n}") for n in names)))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place (from 1) of each row in an order that tells all rows apart."""
    rows = _dealt(df, order).withColumn("_part", F.shiftright("_at", 33))
    before = _before(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    place = F.col("_rows") + F.col("_at").bitwiseAND(F.lit(_ROW)) + 1
    return rows.join(before, F.col("_part") == F.col("_p")).withColumn(name, place.cast("long")).drop("_at", "_part", "_p", "_rows")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with running sums (inclusive) of some columns in an order that tells all rows apart."""
    rows = _dealt(df.withColumns(sums), order).withColumn("_part", F.shiftright("_at", 33))
    before = _before(rows.groupBy("_part").agg(*(F.sum(n).alias(n) for n in sums)), list(sums))
    within = Window.partitionBy("_part").orderBy("_at")
    out = rows.withColumns({n: F.sum(n).over(within) for n in sums}).join(before, F.col("_part") == F.col("_p"))
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_at", "_part", "_p", *(f"_{n}" for n in sums))
