"""Coalescing of byte ranges into reads of a bounded span, greedy from the left, for keys of any size.

Where a read ends depends on where it began, so each range first finds the range that would begin the next read if it began
one; a read is no longer than its span, so that lies in the same or the next bin of that width. The beginnings that
really occur are those reached from the first range of a key, by doubling jumps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.iterate import checkpointed


def reached(firsts: DataFrame, jumps: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node: all that is reached from ``firsts`` (node) by single jumps (node, to), those included; rounds grow with the
    logarithm of the longest way."""
    jump = checkpointed(jumps.where("to IS NOT NULL").select("node", "to"))
    out = checkpointed(firsts.select("node").distinct())
    for _ in range(most_rounds):
        if not jump.limit(1).count():
            return out
        far = out.join(jump, "node").select(F.col("to").alias("node"))
        out = checkpointed(out.unionByName(far).distinct())
        jump = checkpointed(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
    raise RuntimeError("the jumps have a cycle")


def coalesced(ranges: DataFrame, gap: int, span: int) -> DataFrame:
    """key, lo, hi, parts, extra: reads of ``ranges`` (key, id, lo, hi; hi is exclusive, ids tell all ranges apart).

    From the left by (lo, id), a range joins the read before it if it begins at most ``gap`` beyond its end and the read then
    spans no more than ``span``; extra is what is read for nothing (negative where ranges overlap). A range longer than the
    span is a read of its own.
    """
    rows = checkpointed(ranges.select("key", "id", "lo", "hi", F.floor(F.col("lo") / span).alias("bin")))
    bins = rows.groupBy("key", "bin").agg(F.min(F.struct("lo", "id")).alias("first"))
    # the first range of the first bin after the next one: where a read of this bin ends at the latest
    later = Window.partitionBy("key").orderBy("bin")  # a row a bin
    nxt, after = F.lead("bin", 1).over(later), F.lead("first", 1).over(later)
    bins = bins.withColumn("beyond", F.when(nxt > F.col("bin") + 1, after["id"]).otherwise(F.lead("first", 2).over(later)["id"]))
    own = rows.select("key", "id", "lo", "hi", "bin", F.lit(True).alias("own"))
    halo = rows.select("key", "id", "lo", "hi", (F.col("bin") - 1).alias("bin"), F.lit(False).alias("own"))
    near = own.unionByName(halo).join(bins.select("key", "bin", "beyond"), ["key", "bin"])

    def jumps(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lo", "ascending"), ("id", "ascending")])
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        ids, is_own, beyond = table.column("id").to_pylist(), table.column("own").to_pylist(), table.column("beyond")[0].as_py()
        node, to = [], []
        for i in range(len(lo)):
            if not is_own[i]:
                continue
            end, j = hi[i], i + 1
            while j < len(lo) and lo[j] - end <= gap and max(end, hi[j]) - lo[i] <= span:
                end = max(end, hi[j])
                j += 1
            node.append(ids[i])
            to.append(ids[j] if j < len(lo) else beyond)
        return pa.table({"node": pa.array(node, pa.int64()), "to": pa.array(to, pa.int64())})

    links = near.groupBy("key", "bin").applyInArrow(jumps, "node long, to long")
    firsts = rows.groupBy("key").agg(F.min_by("id", F.struct("lo", "id")).alias("node"))
    starts = reached(firsts, links).select(F.col("node").alias("id"), F.lit(True).alias("starts"))
    marked = checkpointed(rows.join(starts, "id", "left").withColumn("starts", F.coalesce("starts", F.lit(False))))
    own = marked.withColumn("own", F.lit(True))
    halo = marked.where("starts").withColumns({"bin": F.col("bin") + 1, "own": F.lit(False)}).join(bins.select("key", "bin"), ["key", "bin"], "left_semi")

    def groups(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lo", "ascending"), ("id", "ascending")])
        begins = np.maximum.accumulate(np.where(table.column("starts").to_numpy(zero_copy_only=False), np.arange(len(table)), 0))
        ids = table.column("id").to_numpy()
        out = table.append_column("begin", pa.array(ids[begins])).filter(table.column("own"))
        return out.select(["key", "begin", "lo", "hi"])

    types = dict(ranges.dtypes)
    parts = own.unionByName(halo).select("key", "id", "lo", "hi", "bin", "starts", "own").groupBy("key", "bin").applyInArrow(groups, f"key {types['key']}, begin long, lo {types['lo']}, hi {types['hi']}")
    return parts.groupBy("key", "begin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("parts"), (F.max("hi") - F.min("lo") - F.sum(F.col("hi") - F.col("lo"))).alias("extra")).drop("begin")
