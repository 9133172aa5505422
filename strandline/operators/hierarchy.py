"""Pruning of a tree of boxes to those that meet an area, by doubling jumps to ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.iterate import checkpointed
from strandline.operators.ranges import reached


def meets(box: str, area: tuple[float, float, float, float]) -> Column:
    """Whether a struct column (west, south, east, north) meets an area, edges included; null for a null box."""
    b = F.col(box)
    return (b["west"] <= area[2]) & (b["east"] >= area[0]) & (b["south"] <= area[3]) & (b["north"] >= area[1])


def pruned(nodes: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """id, parent, content: the nodes of a tree (id, parent, box, content_box, content) that stay, content null where it goes.

    A node whose box misses the area goes with all below it. Content stays where its own box (the node's, if it has none) meets
    the area or neither has one; a node stays if its content does or a node below it stays.
    """
    rows = nodes.select("id", "parent", "content", F.coalesce(meets("box", area), F.lit(True)).alias("open"), F.coalesce(meets("content_box", area), meets("box", area), F.lit(True)).alias("shown"))
    rows = checkpointed(rows)
    # open as far up as 2^round ancestors
    state = checkpointed(rows.select("id", F.col("parent").alias("up"), "open"))
    while state.where("up IS NOT NULL").limit(1).count():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("open").alias("up_open"))
        state = checkpointed(state.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("open") & F.coalesce("up_open", F.lit(True))).alias("open")))
    kept = rows.drop("open").join(state.where("open").select("id"), "id", "left_semi").withColumn("content", F.when(F.col("shown"), F.col("content"))).drop("shown")
    kept = checkpointed(kept)
    leaves = kept.where("content IS NOT NULL").select(F.col("id").alias("node"))
    stays = reached(leaves, kept.select(F.col("id").alias("node"), F.col("parent").alias("to")))
    return kept.join(stays.select(F.col("node").alias("id")), "id", "left_semi").select("id", "parent", "content")


def trimmed(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of batch tables (content, ...) whose content stays."""
    return rows.join(kept.where("content IS NOT NULL").select("content").distinct(), "content", "left_semi")
