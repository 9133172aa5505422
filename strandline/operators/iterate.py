"""Fixpoints over DataFrames: stable checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only on a local master (as in tests), where all tasks can reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder of spark.checkpoint.dir.

    A written table has the size of its files. ``DataFrame.checkpoint`` would keep the optimiser's estimate instead, which is a
    product over all joins before it and grows by a power each round, to numbers that take the planner longer than the work.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: each node's smallest reachable node. Labels hook to the least label around and then jump to their
    label's label, so rounds grow with the logarithm of a component's width."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = labels.join(around, "node", "left").select("node", "root", F.least("root", "low").alias("low"))
        best = hooked.groupBy("root").agg(F.min("low").alias("best"))  # a whole tree hooks together
        hooked = hooked.join(best, "root").select("node", F.col("root").alias("was"), F.least("low", "best").alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = checkpointed(hooked.join(jump, "root").select("node", "was", F.least("root", "far").alias("root")))
        changed = now.where("root <> was").limit(1).count()
        labels = now.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
