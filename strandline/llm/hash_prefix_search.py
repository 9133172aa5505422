"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Vectors are dealt to shards of a bounded number of rows. A shard keeps, for each tree, its rows sorted by a long
string of sign bits, so the rows that share a prefix with a query are one interval. A query descends to its longest
matching prefixes and then ascends in all trees together: each step widens the intervals, the candidates
are scored exactly, and the ascent ends when a row as near as the current r-th best would have been met
with the target probability, whatever number of candidates that takes. For inner products the vectors are first
lifted by one component to equal lengths, so that the angle orders like the product. Queries go through in blocks;
shards' best lists are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, partitions, table

TREES, BITS, SHARD_ROWS, RECALL, NEIGHBOURS = 64, 20, 65_536, 0.92, 20
LEAST_SHARD = 8192  # shards of fewer than SHARD_ROWS rows, while there are fewer of them than partitions
QUERY_BLOCK = 16_384  # queries of a task, on average; every shard is read once for each block
FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Sorted hash strings of a shard's vectors (lifted to the length ``most``)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, trees: int, bits: int, seed: int = 11):
        self.ids, self.vectors, self.length, self.bits, self.trees = ids, vectors, most, bits, trees
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        lift = np.sqrt(np.maximum(most * most - (vectors * vectors).sum(axis=1), 0.0))
        self.single = vectors.astype(np.float32)
        self.repeats = len(np.unique(ids)) < len(ids)
        strings = self.strings(np.column_stack([vectors, lift]))
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, lifted: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lifted), self.trees), np.int64)
        for lo in range(0, len(lifted), 2048):
            sign = (lifted[lo : lo + 2048].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[lo : lo + 2048] = sign @ (1 << np.arange(self.bits - 1, -1, -1))
        return out

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, rank: int, recall: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores): the k best rows found for each query, its own row left out."""
        strings = self.strings(np.column_stack([queries, np.zeros(len(queries))]))
        lo, hi = (np.zeros((self.bits + 1, len(queries), self.trees), np.int64) for _ in range(2))
        for depth in range(self.bits + 1):
            prefix = strings >> (self.bits - depth) << (self.bits - depth)
            for t in range(self.trees):
                lo[depth, :, t] = np.searchsorted(self.sorted[:, t], prefix[:, t], "left")
                hi[depth, :, t] = np.searchsorted(self.sorted[:, t], prefix[:, t] + (1 << (self.bits - depth)), "left")
        size = (hi - lo).sum(axis=2)
        norm = np.linalg.norm(queries, axis=1)
        longest = float(np.sqrt((self.vectors**2).sum(axis=1)).max(initial=0.0))
        for q in range(len(queries)):
            depth = self.bits
            while depth and size[depth, q] < min(2 * rank, len(self.ids)):
                depth -= 1  # the longest prefixes that give enough rows
            single = queries[q].astype(np.float32)
            own = int((self.ids == query_ids[q]).sum())
            while True:
                mark = np.zeros(len(self.ids), bool)
                for t in np.flatnonzero(hi[depth, q] > lo[depth, q]):
                    mark[self.order[lo[depth, q, t] : hi[depth, q, t], t]] = True
                mark[self.ids == query_ids[q]] = False
                rows = np.flatnonzero(mark)
                rough = self.single[rows] @ single
                if not depth or len(rows) + own >= len(self.ids):
                    break
                enough = 0
                if len(rows) >= rank:
                    near = float(np.partition(rough, len(rows) - rank)[len(rows) - rank])
                    enough = self.enough_depth(near / max(norm[q] * self.length, 1e-30), recall)
                if enough >= depth:
                    break
                depth -= max(1, (depth - enough) // 2)  # nearer rows found on the way only raise the depth that is enough
            if len(rows) > 2 * k and not self.repeats:  # single precision may not part near ties: keep all within its error
                least = np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-4 * (norm[q] * longest)
                rows = rows[rough >= least]
            score = self.vectors[rows] @ queries[q]
            best = np.lexsort((self.ids[rows], -score))
            if self.repeats:  # an id counts once, with its nearest vector
                best = best[np.sort(np.unique(self.ids[rows[best]], return_index=True)[1])]
            best = best[:k]
            yield q, rows[best], score[best]

    def enough_depth(self, cosine: float, recall: float) -> int:
        """The longest prefix at which a row at this cosine shares some tree's interval with the target probability."""
        same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        depth = self.bits
        while depth and 1 - (1 - same**depth) ** self.trees < recall:
            depth -= 1
        return depth


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): rows with an id whose vector is neither null nor zero and has finite components."""
    v = F.col("embedding").cast("array<double>")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0.0))


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, trees: int = TREES, bits: int = BITS, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for each row with ``is_query`` (a condition on vec_id) against all other rows.

    Vectors that are null, zero or not finite take no part, nor do rows without an id. Vectors of another length
    than the most frequent one are compared with those of their own length only. Rows that repeat a vec_id with another vector
    are candidates like others: the id counts once, with the best score of its vectors, and a query with several vectors takes
    the best score of any; rows with the query's own id are no candidates. Ties in score go to the smaller vec_id. An empty table gives no rows.
    """
    rows = checkpointed(usable(vectors).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))
    shape = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("queries"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("most")).collect()  # a row for each vector length
    parts = None
    for s in shape:
        shards = max(math.ceil(s["n"] / shard_rows), min(partitions(rows), math.ceil(s["n"] / LEAST_SHARD)))
        some = rows.where(F.col("dim") == s["dim"])
        # a task holds one shard and one block of queries
        dealt = max(1, math.ceil(s["queries"] / QUERY_BLOCK))
        block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(dealt)).cast("int")
        queries = some.where(is_query).select(block.alias("block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        blocks = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        base = some.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
        base = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
        found = base.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(_search(s["dim"], float(s["most"]), k, shards, trees, bits, recall), FOUND)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = vectors.sparkSession.createDataFrame([], FOUND)
    parts = parts.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # one exchange for this and the ranks
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows for each shard
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(dim: int, most: float, k: int, shards: int, trees: int, bits: int, recall: float):
    share = k / shards
    rank = min(k, math.ceil(share + 3 * math.sqrt(share)))  # so many of the k nearest may lie in one shard

    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        base = base.sort_values("vec_id")
        ids = base["vec_id"].to_numpy(np.int64)
        forest = Forest(ids, np.stack(base["v"].to_list()).astype(np.float64), most, trees, bits)
        qid, vid, score = [], [], []
        for lo in range(0, len(queries), 256):
            block = queries.iloc[lo : lo + 256]
            ids_of = block["query_id"].to_numpy(np.int64)
            for q, rows, s in forest.search(np.stack(block["q"].to_list()).astype(np.float64), ids_of, k, rank, recall):
                qid.append(np.full(len(rows), ids_of[q]))
                vid.append(ids[rows])
                score.append(s)
        return pd.DataFrame({"query_id": np.concatenate(qid), "vec_id": np.concatenate(vid), "score": np.concatenate(score)})

    return run


def op3_hash_prefix_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
