"""What the training-data operators share: reading, words, stable checkpoints and grouped streams."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a Java pattern: space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A single file may be one task's work, so texts and pages of one are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = {"documents": "doc_id", "pages": "page_id"}.get(name)
    return df.repartition(spark.sparkContext.defaultParallelism, key) if key and len(df.inputFiles()) == 1 else df


def words_column(text: Column) -> Column:
    """The words of a text as an array, without empty ones (null text: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at exactly the separators of GAP."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until it differs from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


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
    """Cut the lineage in the shared folder of spark.checkpoint.dir, so that a lost executor loses nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def grouped_stream(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by key; holds one group at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key]
        change = np.flatnonzero((values != values.shift()).any(axis=1).to_numpy())
        bounds = np.append(change, len(frame))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            now = tuple(values.iloc[lo])
            if held and now != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            last = now
            held.append(frame.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for as many words as fit the bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words (order counts)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(size):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return acc


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again."""
    import re
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{re.sub(r'[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
