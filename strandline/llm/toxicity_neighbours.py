"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents is the example set (``max_examples`` of each label, the smallest hashes of
doc_id and text). Terms are words and word beginnings; those whose document frequencies depend on the label at the 1 %
level (either way) form the vocabulary. Every document becomes a sparse TF-IDF vector over it (document frequencies are
counted over all documents), and the k nearest examples are found exactly: the index keeps for each term and block of
examples the largest weight, so blocks whose summed maxima cannot reach the k-th score are never opened. Votes are
weighted by nearness and by the labels' true rates, which makes the score a calibrated probability; the neighbours
are the evidence. Examples with the text that is scored have no vote, so a document's own label is no input of its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, table

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
STEMS = (4, 5, 6)
BLOCK = 64
SCHEMA = "doc_id long, score double, predicted int, evidence array<long>"


class Terms(dict):
    """The terms of a lower-case word: itself and its beginnings, kept for as many words as fit the bound."""

    def __init__(self, known: dict[str, int] | None = None, bound: int = 400_000):
        super().__init__()
        self.known, self.bound = known, bound

    def __missing__(self, word: str) -> tuple:
        if len(self) >= self.bound:
            self.clear()
        terms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]
        value = self[word] = tuple(terms) if self.known is None else tuple(self.known[t] for t in terms if t in self.known)
        return value

    def count(self, text: str | None) -> Counter:
        found: Counter = Counter()
        for word, n in Counter(TOKEN.findall((text or "").lower())).items():
            for term in self[word]:
                found[term] += n
        return found


def vocabulary(examples: DataFrame, least_g: float, least_docs: int) -> list[str]:
    """Terms in ``least_docs`` examples whose document frequencies depend on the label (G statistic); the examples are a
    bounded number of documents, and so are their terms."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms()
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch["text"], batch["y"], strict=True):
                counts.update((t, y) for t in of.count(text))
            yield pd.DataFrame([(t, int(y), n) for (t, y), n in counts.items()], columns=["term", "y", "n"])

    n1, n0 = (examples.where(F.col("y") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return []
    df = (
        examples.select("text", "y").mapInPandas(terms, "term string, y int, n long")
        .groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
        .where(F.col("a") + F.col("b") >= least_docs)
    )

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    a, b, n = F.col("a"), F.col("b"), n1 + n0
    g = 2 * (part(a, (a + b) * n1 / n) + part(b, (a + b) * n0 / n) + part(n1 - a, (n - a - b) * n1 / n) + part(n0 - b, (n - a - b) * n0 / n))
    return sorted(r["term"] for r in df.where(g >= least_g).select("term").collect())  # of a bounded number of documents


class BlockMaxIndex:
    """Postings of examples' unit vectors in blocks of BLOCK examples, with each term's largest weight in a block.

    rows: (doc_id, label, key of the text, terms, weights) of each example."""

    def __init__(self, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]], terms: int):
        rows = sorted(rows, key=lambda r: (r[0], r[2]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.y = np.array([r[1] for r in rows], np.int64)
        self.n, blocks = len(rows), max(1, -(-len(rows) // BLOCK))
        at = np.concatenate([np.full(len(r[3]), i) for i, r in enumerate(rows)] or [np.empty(0)]).astype(np.int64)
        term = np.concatenate([r[3] for r in rows] or [np.empty(0)]).astype(np.int64)
        weight = np.concatenate([r[4] for r in rows] or [np.empty(0)]).astype(np.float64)
        order = np.lexsort((at, term))
        self.at, self.weight = at[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1)).tolist()
        self.most = np.zeros((terms, blocks))
        np.maximum.at(self.most, (term, at // BLOCK), weight)
        self.same: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            self.same.setdefault(r[2], []).append(i)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, key: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a positive cosine, those with this key of the text left
        out; ties to the smaller id."""
        upper = weight @ self.most[term]
        spans = [(self.first[t], self.first[t + 1]) for t in term.tolist()]
        at = np.concatenate([self.at[a:b] for a, b in spans])
        part = np.concatenate([self.weight[a:b] for a, b in spans]) * np.repeat(weight, [b - a for a, b in spans])
        block, skip = at // BLOCK, self.same.get(key, [])
        best_at, best = np.empty(0, np.int64), np.empty(0)
        order = np.argsort(-upper, kind="stable")
        opened = np.zeros(len(upper), bool)
        while True:
            # the most promising blocks first, then all that can still reach the k-th score
            todo = order[:8] if not opened.any() else np.flatnonzero(~opened & (upper >= (best[-1] - 1e-12 if len(best) == k else 0.0)))
            todo = todo[upper[todo] > 0]
            if not len(todo):
                return best_at, best
            now = np.zeros(len(upper), bool)
            now[todo] = True
            opened |= now
            here = now[block]
            score = np.bincount(at[here], part[here], minlength=self.n)
            score[skip] = 0.0
            found = np.flatnonzero(score > 0)
            positions, s = np.concatenate([best_at, found]), np.concatenate([best, score[found]])
            keep = np.lexsort((positions, -s.round(12)))[:k]
            best_at, best = positions[keep], s[keep]


class Voter:
    """Score and evidence of a sparse vector; equal texts are looked up once."""

    def __init__(self, rows, terms: int, rates: tuple[float, float], k: int):
        self.index, self.k, self.memo = BlockMaxIndex(rows, terms), k, {}
        self.rate = np.array(rates)  # documents of each label that an example stands for
        empty = np.array([float(sum(1 for r in rows if not len(r[3]) and r[1] == y)) for y in (0, 1)]) * self.rate
        self.base = float((empty[1] + 0.5 * self.rate[1]) / max(empty.sum() + self.rate.sum(), 1e-9)) if len(rows) else 0.0

    def __call__(self, term: np.ndarray, weight: np.ndarray, key: int) -> tuple[float, list[int]]:
        if not len(term):
            return self.base, []
        if key not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            at, cosine = self.index.nearest(term, weight, self.k, key)
            y = self.index.y[at]
            vote = self.rate[y] / (1.05 - np.minimum(cosine, 1.0))
            against = 0.5 * self.base  # half a vote of a document without any term
            score = float((vote @ y + against * self.base) / (vote.sum() + against)) if len(at) else self.base
            self.memo[key] = score, self.index.ids[at].tolist()
        return self.memo[key]


def example_rows(labelled: DataFrame, max_examples: int) -> DataFrame:
    """doc_id, text, y, key of at most ``max_examples`` rows of each label; rows that repeat all of these count once.

    Documents are chosen by their ids alone, so that only their texts are read; where ids repeat, rows are chosen again
    by id and text."""

    def smallest(rows: DataFrame, *by: str) -> DataFrame:
        out = None
        for y in (0, 1):
            some = rows.where(F.col("y") == y).select("y", *by, F.xxhash64(*by).alias("h")).distinct().orderBy("h", *by).limit(max_examples)
            out = some if out is None else out.unionByName(some)
        return out.select(*(F.col(c).alias(f"e_{c}") for c in ("y", *by)))

    ids = F.broadcast(smallest(labelled, "doc_id").select("e_doc_id").distinct())  # at most 2 * max_examples
    some = labelled.join(ids, F.col("doc_id").eqNullSafe(F.col("e_doc_id")), "left_semi")
    some = checkpointed(some.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))))
    ids = F.broadcast(smallest(some, "doc_id", "key"))  # at most 2 * max_examples
    same = F.col("doc_id").eqNullSafe(F.col("e_doc_id")) & (F.col("key") == F.col("e_key")) & (F.col("y") == F.col("e_y"))
    return checkpointed(some.join(ids, same, "left_semi").dropDuplicates(["doc_id", "key", "y"]))


def score(docs: DataFrame, labelled: DataFrame, max_examples: int = 1024, k: int = 25, threshold: float = 0.7, least_g: float = 6.63, least_docs: int = 8) -> DataFrame:
    """One row for each document: doc_id, score (0 to 1), predicted (score >= threshold), evidence (example doc_ids).

    labelled: doc_id, text, y (0 or 1; other labels and null ones are left out). A text without vocabulary terms
    (empty and null ones too) gets the rate of toxic documents among examples without any. Without examples of
    both labels every score is 0. Repeated rows are scored alike; null doc_ids are kept, and -1 in the evidence; other
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    labelled = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("y").cast("int")).where("y in (0, 1)")
    totals = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    examples = example_rows(labelled, max_examples)
    names = vocabulary(examples, least_g, least_docs)
    known = {t: i for i, t in enumerate(names)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms(known)
        for batch in batches:
            found = [sorted(of.count(t).items()) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "y": batch["y"].astype("Int32"), "key": batch["key"], "term": [np.array([t for t, _ in f], np.int32) for f in found], "tf": [np.array([n for _, n in f], np.int32) for f in found]})

    sparse = "doc_id long, y int, key long, term array<int>, tf array<int>"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("int").alias("y")).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    counted = checkpointed(texts.mapInPandas(count, sparse))
    n_docs = counted.count()

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms, n = np.unique(np.concatenate([np.asarray(t, np.int64) for t in batch["term"]]), return_counts=True) if len(batch) else ([], [])
            yield pd.DataFrame({"term": terms, "n": n}).astype("int64")

    found = counted.select("term").mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("count")).collect()  # at most a row for each vocabulary term
    idf = np.full(len(names) + 1, math.log(1 + n_docs) + 1.0)
    for r in found:
        idf[r["term"]] = math.log((1 + n_docs) / (1 + r["count"])) + 1.0

    def weights(term, tf) -> tuple[np.ndarray, np.ndarray]:
        term = np.asarray(term, np.int64)
        w = (1.0 + np.log(np.asarray(tf, np.float64))) * idf[term]
        return term, w / (math.sqrt(float(w @ w)) or 1.0)

    vectors = examples.select("doc_id", "text", "y", "key").mapInPandas(count, sparse).collect()  # at most 2 * max_examples
    rows = [(r["doc_id"] if r["doc_id"] is not None else -1, r["y"], r["key"], *weights(r["term"], r["tf"])) for r in vectors]
    n = [sum(1 for r in rows if r[1] == y) for y in (0, 1)]
    rates = tuple(totals.get(y, 0) / n[y] if n[y] else 0.0 for y in (0, 1))
    shared = spark.sparkContext.broadcast((rows, len(names), rates))  # bounded by max_examples

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, terms, rates = shared.value
        voter = Voter(rows, terms, rates, k) if rates[0] and rates[1] else None
        for batch in batches:
            out = [voter(*weights(t, f), key) if voter else (0.0, []) for t, f, key in zip(batch["term"], batch["tf"], batch["key"].tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [min(1.0, max(0.0, s)) for s, _ in out], "predicted": [int(s >= threshold) for s, _ in out], "evidence": [e for _, e in out]})

    return counted.mapInPandas(vote, SCHEMA)


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labelled documents that may be learned from."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("l_id")))
    return docs.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "y")


def op9_toxicity_neighbours(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, training_rows(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
