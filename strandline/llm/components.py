"""Connected components of an edge list by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two edges down, or edges on both sides."""
    ends = edges.select(F.inline(F.array(_row(node="a", down=F.lit(1)), _row(node="b", down=F.lit(0)))))
    sides = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return sides.where("down > 1 OR down = 1 AND least = 0").count() == 0


def _row(**columns) -> Column:
    return F.struct(*(F.col(c).alias(name) if isinstance(c, str) else c.alias(name) for name, c in columns.items()))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it is linked with) for every node of the edges (a, b); loops are ignored.

    Each round at least halves the distances to the roots for chains of stars, so a few rounds do for copy groups;
    edges that are stars already take none. A round reads its edges twice, once for both ends of an edge, and writes
    them once, since on small tables its cost is that of its tasks. Edges are aggregated on the map side first, so that
    a hot node's edges meet as one row a task.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _settled(edges):
            break
        # large star: larger neighbours go to the smallest neighbour
        both = edges.select(F.inline(F.array(_row(node="a", other="b"), _row(node="b", other="a"))))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = edges.join(least, F.col("b") == F.col("node")).select("a", F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("node")).select(F.inline(F.array(_row(a="a", b="m"), _row(a="b", b="m"))))
        edges = checkpointed(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.inline(F.array(_row(node="a", root="b"), _row(node="b", root="b")))).distinct()
