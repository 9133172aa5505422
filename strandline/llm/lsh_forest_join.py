"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its five-word shingles. Each tree of the forest is a sorted prefix trie: the texts' signatures
of ``depth`` min-hashes, sorted; equal prefixes are neighbours there. One pass over the sorted signatures links every
text with the first one of its longest matching prefix and notes that prefix's length, so the links of at least some
length span the trie's nodes of that depth, as stars and never as pairs. The join starts with whole signatures: linked
texts form components, which are verified exactly: within a component the shingle sets are bit rows, and
intersections are counted tile by tile, so that no task holds more than two blocks of a component. How many links were
missed follows from those found: a link of similarity s shares a prefix of length d in some of t trees with
probability 1 - (1 - s^d)^t. As long as the recall so estimated is below the target, the matched prefixes are shortened
to the longest length at which the links found so far let the target be expected, and the wider components are verified.
Verified links give each document its number of links and spanning edges of its class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WordHashes, checkpointed, grouped_stream, mix64, partitions, table, window_hashes, words_of
from strandline.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, BLOCK = 32, 8, 0.9999, 1500


def estimated_recall(found: dict[float, float], threshold: float, trees: int, depth: int) -> float:
    """Share of the links that prefixes of this length meet, from the numbers of links found by similarity. One link
    at the threshold is counted besides, so that a table with few links is not judged by easy ones alone."""
    links = [*found.items(), (threshold, 1)]
    met = [(n, 1 - (1 - s**depth) ** trees) for s, n in links]
    return sum(n for n, _ in met) / sum(n / p for n, p in met)


def next_prefix(found: dict[float, int], threshold: float, trees: int, depth: int, floor: int, recall: float) -> int:
    """The longest prefix below ``depth`` that is expected to reach the recall, from the links that ``depth`` found."""
    for d in range(depth - 1, floor, -1):
        expected = {s: n * (1 - (1 - s**d) ** trees) / (1 - (1 - s**depth) ** trees) for s, n in found.items()}
        if estimated_recall(expected, threshold, trees, d) >= recall:
            return d
    return floor


def shortest_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which the recall is reached even if all links are just at the threshold."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


class Forest:
    """Signatures of all trees for a shingle set: ``depth`` min-hashes each, 16 bits of every one."""

    def __init__(self, trees: int, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = trees * depth
        self.mul = (rng.integers(0, 2**31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.add = rng.integers(0, 2**32, n, dtype=np.uint32)

    def signatures(self, s: np.ndarray) -> bytes:
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        least = np.full(len(self.mul), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 512):
            y = x[at : at + 512, None] * self.mul + self.add
            y ^= y >> np.uint32(15)
            np.minimum(least, y.min(axis=0), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes()  # the low ends of minima alone are even


def _nodes(trees: int, depth: int, floor: int):
    """key, node (tree and signature), rep, head: a row for each text and tree. A text whose whole signature is another
    one's in its batch has that one as its head and goes anywhere; all others are dealt by the shortest prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            nodes = np.empty((n * trees, depth + 1), np.uint16)
            nodes[:, 0] = np.tile(np.arange(trees, dtype=np.uint16), n)
            nodes[:, 1:] = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(n * trees, depth)
            rep = np.repeat(batch["rep"].to_numpy(), trees)
            _, first, group = np.unique(nodes.view(f"V{2 * depth + 2}").ravel(), return_index=True, return_inverse=True)
            head = first[group]
            follows = head != np.arange(len(rep))
            key = np.zeros(len(rep), np.uint64)
            for level in range(floor + 1):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + nodes[:, level])
            key[follows] = mix64(rep[follows].astype(np.uint64))
            width = 2 * depth + 2
            data = pa.Array.from_buffers(pa.binary(), len(rep), [None, pa.py_buffer(np.arange(0, width * len(rep) + 1, width, dtype=np.int32)), pa.py_buffer(nodes)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), data, pa.array(rep), pa.array(rep[head], mask=~follows)], ["key", "node", "rep", "head"])

    return run


def _tries(depth: int, floor: int):
    """a, b, shared: from rows of _nodes sorted by node, each text with the first one of its longest matching prefix of
    at least ``floor`` min-hashes. Holds a batch and the first texts of the present prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, heads = None, np.zeros(depth + 1, np.int64)  # the last node; the first text of its prefix of each length
        for batch in batches:
            head = batch["head"].to_pandas()
            follows = head.notna().to_numpy()
            rep = batch["rep"].to_numpy()
            out = [(rep[follows], head[follows].to_numpy(np.int64), np.full(int(follows.sum()), depth))]
            rep = rep[~follows]
            if len(rep):
                nodes = np.frombuffer(b"".join(x for x, f in zip(batch["node"].to_pylist(), follows.tolist(), strict=True) if not f), np.uint16).reshape(len(rep), depth + 1)
                equal = np.vstack([nodes[:1] == before if before is not None else np.zeros((1, depth + 1), bool), nodes[1:] == nodes[:-1]])
                shared = np.cumprod(equal, axis=1).sum(axis=1) - 1  # min-hashes shared with the row before; -1: another tree
                at = np.arange(len(rep))
                for d in range(floor, depth + 1):
                    start = np.maximum.accumulate(np.where(shared < d, at, -1))
                    first = np.where(start < 0, heads[d], rep[start])
                    mine = shared == d
                    out.append((rep[mine], first[mine], np.full(int(mine.sum()), d)))
                    heads[d] = first[-1]
                before = nodes[-1]
            a, b, shared = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared)], ["a", "b", "shared"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sketch(trees: int, depth: int):
    """doc_id, digest and signatures; of copies in a task the first alone has signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, forest, seen = WordHashes(), Forest(trees, depth), set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                if words:
                    same = _digest(words)
                    rows.append((doc_id, same, None if same in seen else forest.signatures(shingles(words, hashes))))
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(same)
            yield pd.DataFrame(rows, columns=["doc_id", "same", "sig"])

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets of the rows whose text is the wanted one; repeated rows of a task once."""
    hashes, seen = WordHashes(), set()
    for batch in batches:
        rows = []
        for rep, copies, same, text in batch.itertuples(index=False):
            words = words_of(text)
            if rep not in seen and _digest(words) == bytes(same):
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(rep)
                rows.append((rep, copies, shingles(words, hashes).tobytes()))
        yield pd.DataFrame(rows, columns=["rep", "copies", "shingles"])


def links_of(sets: list[np.ndarray], block: np.ndarray, copies: np.ndarray, threshold: float, cross: bool) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Verified links of each set (copies counted), edges of each linked set to the first one of its class here, and
    numbers of links by similarity in hundredths (rounded down); with ``cross`` only between blocks."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(df > 1) - 1
    owner = np.repeat(np.arange(m), size)
    shared = df[inverse] > 1
    owner, column = owner[shared], column[inverse[shared]]
    width, step = int((df > 1).sum()), max(64, (48_000_000 // max(m, 1)) // 8 * 64)
    both = np.zeros((m, m), np.int32)
    for lo in range(0, width, step):
        here = (column >= lo) & (column < lo + step)
        cols = column[here] - lo
        bits = np.zeros((m, (min(step, width - lo) + 63) // 64), np.uint64)
        np.bitwise_or.at(bits, (owner[here], cols >> 6), np.uint64(1) << (cols & 63).astype(np.uint64))
        for i in range(m - 1):
            both[i, i + 1 :] += np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int32)
    links, parent, near = np.zeros(m, np.int64), list(range(m)), np.zeros(101, np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(m - 1):
        inter = both[i, i + 1 :]
        union = size[i] + size[i + 1 :] - inter
        ok = inter >= threshold * union - 1e-9
        if cross:
            ok &= block[i + 1 :] != block[i]
        near += np.bincount(100 * inter[ok] // union[ok], minlength=101)
        j = np.flatnonzero(ok) + i + 1
        links[i] += copies[j].sum()
        links[j] += copies[i]
        for x in j.tolist():
            a, b = root(i), root(x)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return links, [(root(i), i) for i in range(m) if root(i) != i], near


def _verify(threshold: float):
    """a, b, n: n links of a where a = b, an edge to the first of a tile's class where they differ, and without a: n links of similarity b / 100."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped_stream(batches, ["comp", "ti", "tj"]):
            g = g.drop_duplicates("rep")
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            links, edges, near = links_of(sets, g["blk"].to_numpy(), g["copies"].to_numpy(np.int64), threshold, bool(g["ti"].iloc[0] != g["tj"].iloc[0]))
            rep, some = g["rep"].to_numpy(np.int64), np.flatnonzero(near)
            rows = [*zip(rep, rep, links), *((rep[i], rep[j], 0) for i, j in edges), *((None, s, near[s]) for s in some)]
            yield pd.DataFrame(rows, columns=["a", "b", "n"]).astype("Int64")

    return run


def prefix_links(texts: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """a, b, shared: links between texts that span the nodes of all tries down to the depth ``floor``."""
    nodes = texts.select("rep", "sig").mapInArrow(_nodes(trees, depth, floor), "key long, node binary, rep long, head long")
    tries = nodes.repartition(partitions(texts), "key").sortWithinPartitions("node").mapInArrow(_tries(depth, floor), "a long, b long, shared long")
    return checkpointed(tries.groupBy("a", "b").agg(F.max("shared").alias("shared")))


def shingle_sets(texts: DataFrame, known: DataFrame, linked: DataFrame) -> DataFrame:
    """rep, copies, shingles of the texts that have a link; read from one row of each, once for all prefixes."""
    wanted = linked.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = wanted.join(texts.select("rep", "copies", "same", "least"), "rep")
    texted = wanted.join(known, F.col("least") == F.col("doc_id")).select("rep", "copies", "same", "text")
    return checkpointed(texted.mapInPandas(_sets, "rep long, copies long, shingles binary"))


def verified_links(sets: DataFrame, comps: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows of _verify for the components (node, root) of the links."""
    sizes = comps.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).withColumnRenamed("root", "comp")
    members = comps.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(sizes, "comp").withColumn("blk", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    members = members.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = members.select("comp", F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"), "blk", "rep", "copies", "shingles")
    dealt = tiles.repartition(partitions(sets), "comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj", "rep")
    return checkpointed(dealt.mapInPandas(_verify(threshold), "a long, b long, n long"))


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest doc_id linked with it, over any number of links), n_links (other documents with a
    similarity of at least ``threshold``; exact copies count) for each document with a doc_id.

    Documents with the same words are copies; null, empty and word-less texts are alone (no links), as are rows
    without a doc_id, which are returned with a null class. Every row is a document: rows that repeat a doc_id are
    returned as often, and count as copies of each other if their words agree. An empty table gives no rows; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sketches = checkpointed(known.mapInPandas(_sketch(trees, depth), "doc_id long, same binary, sig binary"))
    texts = sketches.groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig", ignorenulls=True).alias("sig"))  # copies agree in sig
    texts = checkpointed(texts).withColumn("rep", F.monotonically_increasing_id())  # numbers of rows that lie fixed
    floor = shortest_prefix(threshold, trees, depth, recall)
    linked = prefix_links(texts, trees, depth, floor)
    sets, prefix = shingle_sets(texts, known, linked), depth
    stars = linked.where(F.col("shared") >= prefix).select("a", "b")
    while True:
        comps = checkpointed(components(stars))
        verified = verified_links(sets, comps, threshold, block)
        found = {r["b"] / 100: r["n"] for r in verified.where("a IS NULL").groupBy("b").agg(F.sum("n").alias("n")).collect()}  # hundredths
        if prefix <= floor or estimated_recall(found, threshold, trees, prefix) >= recall:
            break
        before, prefix = prefix, next_prefix(found, threshold, trees, prefix, floor, recall)
        shorter = linked.where((F.col("shared") >= prefix) & (F.col("shared") < before))  # the longer ones are in the components
        stars = comps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(shorter.select("a", "b"))
    links = verified.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    rooted = components(verified.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), "root")
    first = rooted.join(texts.select("rep", "least"), "rep").groupBy("root").agg(F.min("least").alias("class"))
    by_text = texts.select("rep", "same", "least", "copies").join(links, "rep", "left").join(rooted.join(first, "root").select("rep", "class"), "rep", "left")
    by_text = by_text.select("same", F.coalesce("class", "least").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = sketches.select("doc_id", "same").join(by_text, "same").select("doc_id", "class_id", "n_links")
    hollow = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) | F.col("doc_id").isNull())
    return found.unionByName(hollow.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def op2_lsh_forest_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: doc_ids of the table are unique.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT array_to_string(ws, ' ') AS k, any_value(ws) AS ws, min(doc_id) AS t, count(*) AS copies FROM d WHERE len(ws) > 0 GROUP BY 1),
w AS (SELECT t, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t),
s AS (SELECT DISTINCT t, hash(array_to_string(ws[i:i + 4], ' ')) AS s FROM w),
n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
p AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.t <> b.t GROUP BY a.t, b.t),
l AS (SELECT a, b FROM p JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE c >= 0.8 * (x.n + y.n - c)),
r(t, least) AS (SELECT t, t FROM t UNION SELECT l.b, r.least FROM r JOIN l ON r.t = l.a),
c AS (SELECT t, min(least) AS class_id FROM r GROUP BY t),
k AS (SELECT a AS t, sum(copies) AS links FROM l JOIN t ON t.t = l.b GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copies - 1 + coalesce(links, 0), 0)::BIGINT AS n_links
FROM d LEFT JOIN t ON t.k = array_to_string(d.ws, ' ') AND len(d.ws) > 0 LEFT JOIN c ON c.t = t.t LEFT JOIN k ON k.t = t.t
"""
