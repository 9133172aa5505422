"""Exact deduplication: counting quotient filters find the fingerprints that occur twice, and their texts are compared byte by byte.

A filter holds one page of the fingerprints (their leading bits). What is left of a fingerprint is cut into a quotient, kept
as a place in a bit row, and a remainder, kept in sorted runs, so nothing of it is lost; counts above one stand beside the
remainders. Every partition builds filters of its own and the filters of a page merge by their sorted remainders, whatever
number of rows a copied text has: it is one entry a partition. Texts whose merged count is above one are grouped by their
bytes, after partial aggregation in each partition; all others are known to be single and never leave their partition.

Texts are equal when they are identical after lower-casing A-Z only. The fingerprint may ignore more than that (it takes the
lower case of all letters): unequal texts that share one are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, partitions, table

#: Fingerprints of a page, about; fingerprints a task holds before it writes its filters; groups that are a
#: thousandth of all rows (so a thousand of them at most) meet their rows by broadcast; words of the routing bit set.
PAGE_ROWS, HELD, HOT, WORDS = 1 << 20, 1 << 20, 1000, 1 << 20
FILTERS = "page int, filter binary"


def encoded(values: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A filter of sorted distinct values of ``width`` bits and their counts: header, occupied quotients, ends of runs,
    marks of counts above one, remainders in whole bytes, those counts."""
    n = len(values)
    q = min(width, max(0, int(np.ceil(np.log2(max(n, 1) / 0.75)))), 30)
    r = width - q
    quotients = (values >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    remainders = values & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotients] = 1
    ends = np.ones(n, np.uint8)
    ends[:-1] = quotients[:-1] != quotients[1:]
    size = (r + 7) // 8
    low = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]
    again = counts > 1
    return b"".join((struct.pack("<IBB", n, q, size), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(again).tobytes(), low.tobytes(), counts[again].astype("<u8").tobytes()))


def decoded(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values and counts of a filter."""
    n, q, size = struct.unpack_from("<IBB", data)
    at, rows = 6, []
    for bits in (1 << q, n, n):
        size_of = (bits + 7) // 8
        rows.append(np.unpackbits(np.frombuffer(data, np.uint8, size_of, at), count=bits))
        at += size_of
    occupied, ends, again = rows
    low = np.zeros((n, 8), np.uint8)
    low[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    counts = np.ones(n, np.int64)
    counts[again == 1] = np.frombuffer(data, "<u8", int(again.sum()), at + n * size).astype(np.int64)
    runs = np.flatnonzero(occupied).astype(np.uint64)
    run_of = np.concatenate(([0], np.cumsum(ends[:-1], dtype=np.int64))) if n else np.empty(0, np.int64)
    r = width - q
    high = runs[run_of] << np.uint64(r) if r < 64 else np.zeros(n, np.uint64)
    return high | low.view("<u8").ravel(), counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (values, counts) as one; equal values add up."""
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")  # merges sorted runs
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def page_bits(rows: int, least_pages: int) -> int:
    """Leading bits of a fingerprint that name its page."""
    return max(1, int(np.ceil(np.log2(max(rows / PAGE_ROWS, least_pages, 2)))))


def filters(prints: DataFrame, bits: int, held: int = HELD) -> DataFrame:
    """page, filter: what each partition holds of the column ``print`` (long), in filters of 2^bits pages."""
    width = 64 - bits

    def pages(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        page = values >> np.uint64(width)
        cuts = np.append(np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1]))), len(values))
        low = values & np.uint64((1 << width) - 1)
        made = [encoded(low[a:b], counts[a:b], width) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(page[cuts[:-1]].astype(np.int32)), pa.array(made, pa.binary())], ["page", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
            n += len(waiting[-1][0])
            if n >= held:
                yield pages(*merged(waiting))
                waiting, n = [], 0
        if n:
            yield pages(*merged(waiting))

    return prints.select("print").mapInArrow(build, FILTERS)


def merge(some: DataFrame, bits: int) -> DataFrame:
    """One filter a page. A page's filters are about PAGE_ROWS entries, whatever the size of the table."""
    width = 64 - bits

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = merged([decoded(f, width) for f in rows["filter"]])
        return pd.DataFrame({"page": rows["page"].iloc[:1].astype("int32"), "filter": [encoded(values, counts, width)]})

    return some.groupBy("page").applyInPandas(join, FILTERS)


def counted(some: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """print, n: the fingerprints that merged filters count ``least`` times or more."""
    width = 64 - bits

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, data in zip(batch["page"], batch["filter"], strict=True):
                values, counts = decoded(data, width)
                values = (values | np.uint64(page << width))[counts >= least]
                yield pd.DataFrame({"print": values.view(np.int64), "n": counts[counts >= least]})

    return some.mapInPandas(read, "print long, n long")


def fingerprint(text: Column) -> Column:
    return F.xxhash64(F.lower(text))


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second column's bytes with A-Z in lower case."""
    for batch in batches:
        texts = pa.array([t.lower() for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([hashlib.sha256(t.lower()).digest() for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["doc_id", "print", "digest"])


def _routed(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows whose ``print`` may be among prints: a bit set of WORDS words, so no more rows to broadcast than that. Bits that
    fingerprints share let more texts through, which the comparison of bytes then finds single."""
    word, bit = F.shiftright("print", 6).bitwiseAND(F.lit(WORDS - 1)), F.col("print").bitwiseAND(F.lit(63)).cast("int")
    mark = F.expr("shiftleft(1L, cast(print & 63 as int))")
    words = prints.groupBy(word.alias("word")).agg(F.bit_or(mark).alias("bits"))
    on = rows.withColumns({"r_word": word, "r_bit": bit}).join(F.broadcast(words), F.col("r_word") == F.col("word"))
    return on.where(F.getbit("bits", F.col("r_bit")) == 1).select(*rows.columns)


def _with(rows: DataFrame, groups: DataFrame, on: Callable[[], Column], hot: Column) -> DataFrame:
    """rows left-joined with groups; those where ``hot`` holds (HOT at most, as each has that share of the rows) by broadcast."""
    new = groups.columns
    near = rows.join(F.broadcast(groups.where(hot)), on(), "left")
    far = near.where(F.col(new[0]).isNull()).drop(*new).join(groups.where(~hot), on(), "left")
    return near.where(F.col(new[0]).isNotNull()).unionByName(far)


def dedupe(docs: DataFrame, print_of: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; of equal texts the largest doc_id stays.

    A null text counts as empty. A null doc_id is below all others. Of rows that repeat both doc_id and text one stays.
    Other columns are ignored, whatever their names. An empty table gives no rows. Very long texts are texts like others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("print", print_of(F.col("text")).cast("long"))
    rows = docs.select("doc_id", "print", F.col("text").cast("binary")).mapInArrow(_digests, "doc_id long, print long, digest binary")
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    bits = page_bits(total, 2 * partitions(rows))
    again = checkpointed(counted(merge(filters(rows, bits), bits), bits))
    texts = _routed(docs.select("doc_id", "print", F.col("text").cast("binary").alias("text")), again).select("doc_id", "text").mapInArrow(_lowered, "doc_id long, text binary")
    groups = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where("n > 1")  # grouped by the bytes; copies in one partition meet there
    groups = checkpointed(groups.select(F.unhex(F.sha2("text", 256)).alias("g_digest"), "n", "keep"))
    hot = F.col("n") * HOT >= total
    out = _with(rows, groups, lambda: F.col("digest") == F.col("g_digest"), hot)
    # rows that repeat doc_id and text: the first of them stands for all
    same = checkpointed(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1"))
    largest = F.col("doc_id").eqNullSafe(F.col("keep"))
    if not same.isEmpty():
        same = same.select(F.col("digest").alias("s_digest"), F.col("doc_id").alias("s_doc_id"), F.col("n").alias("s_n"), "first")
        out = _with(out, same, lambda: (F.col("digest") == F.col("s_digest")) & F.col("doc_id").eqNullSafe(F.col("s_doc_id")), F.col("s_n") * HOT >= total)
        largest = largest & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    single = F.col("n").isNull()
    return out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | largest).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op11_quotient_filter_dedup(spark, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
