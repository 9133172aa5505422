"""Harmonic packing of tokenised documents into fixed-capacity training sequences.

A piece of class k has exactly ``capacity // k`` tokens and a sequence of class k holds exactly k of them, so
sequences fill up without any search and workers need no more than the counts per class and partition to know
where their pieces go. A document gives whole sequences first, then repeatedly the largest class size that its
rest still covers (at most a few pieces). The last, unfilled sequence of each class (fewer than ``capacity``
tokens for each of some 130 classes, whatever the input's size) is repacked in one small best-fit step.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, table

CAPACITY, END = 4096, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, idx long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The vocabulary's own pre-tokens of a lower-case chunk, and its writing of bytes as characters (fixed values).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PLAIN)))}


class PieceBytes(dict):
    """Ids of lower-case pre-tokens by the tokenizer's model, as little-endian unsigned 32-bit."""

    def __init__(self, model, bound: int):
        super().__init__()
        self.model, self.bound, self.written = model, bound, IdBytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        characters = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)
        written = self.written
        value = self[piece] = b"".join([written[t.id] for t in self.model.tokenize(characters)])
        return value


class IdBytes(dict):
    def __missing__(self, token: int) -> bytes:
        value = self[token] = token.to_bytes(4, "little")
        return value


class TokenBytes(dict):
    """Ids of white-space-free chunks as little-endian unsigned 32-bit; the vocabulary never joins across such gaps.

    Chunks and their pre-tokens are kept for as many as fit the bound. Pre-tokens of Latin chunks go straight to
    the tokenizer's model, a chunk of letters alone as it is; all other chunks, and those that hold an added token's text
    (one id wherever it stands), take its whole path (added tokens, normaliser and pre-tokenizer included).
    """

    def __init__(self, path: str, bound: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.bound = bound
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # a handful; none has white space
        self.holds_added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.pieces, self.split = PieceBytes(self.tokenizer.model, bound), regex.compile(PRE_TOKEN).findall

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        if not chunk:  # beside leading and trailing white space
            return b""
        text = chunk.decode("utf-8", "replace")
        if (chunk.isascii() or max(text) < "\u0250") and not self.holds_added(text):  # precomposed Latin letters: composing changes nothing, lower case is by character
            lower, pieces = text.lower(), self.pieces
            value = pieces[lower] if lower.isalpha() else b"".join([pieces[x] for x in self.split(lower)])
        else:
            value = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = value
        return value

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text (null: none); a chunk is looked up once in these texts."""
        chunks = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = chunks.flatten().dictionary_encode()
        found = [self[x] for x in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        which = coded.indices.to_numpy()
        each = sizes[which]
        ends = np.append(0, np.cumsum(each))
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], each)
        at += np.arange(len(at))
        ids, bounds = ids[at], ends[chunks.offsets.to_numpy()]
        return (ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True))


def class_of(rest: int, capacity: int) -> int:
    """The class whose piece size is the largest one within ``rest`` tokens."""
    k = capacity // rest
    return k if capacity // k == rest else k + 1


def cuts(tokens: int, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces: whole sequences, then largest class sizes."""
    out = [(at, capacity, 1) for at in range(0, tokens - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < tokens:
        k = class_of(min(tokens - at, capacity), capacity)
        out.append((at, capacity // k, k))
        at += capacity // k
    return out


def blocks(texts: pa.Array, bound: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts of about ``bound`` bytes together, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(ends):
        to = max(first + 1, int(np.searchsorted(ends, bound + (ends[first - 1] if first else 0), "right")))
        yield first, to - first
        first = to


def tokenised_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    end = np.asarray([END], "<u4").tobytes()
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]
    names = [x.split(" ")[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, seen = TaskContext.get().partitionId(), TokenBytes(path), {}
        for batch in batches:
            for first, number in blocks(batch["text"]):
                rows = []
                for doc_id, tokens in zip(batch["doc_id"].slice(first, number).to_pylist(), ids.of(batch["text"].slice(first, number)), strict=True):
                    data = memoryview(tokens.tobytes() + end)
                    total = len(data) // 4
                    for start, length, k in cuts(total, capacity):
                        idx = seen[k] = seen.get(k, -1) + 1
                        rows.append((doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total, k, part, idx))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) by decreasing best fit, in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    bins = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        j = bisect_left(room, (lengths[i], -1))
        free, b = room.pop(j) if j < len(room) else (capacity, bins)
        bins += b == bins
        out[i] = (b, capacity - free)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, class, sequence_id, offset.

    A null or empty text has the end id alone. Null doc_ids and repeated rows are packed like others, each row
    for itself. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    pieces = checkpointed(tokenised_pieces(docs, path or vocabulary_path(), capacity))
    # A row for each class and partition, however many documents there are.
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")
    counts = counts.select(F.col("class").alias("c_class"), F.col("part").alias("c_part"), before.alias("before"), F.sum("n").over(Window.partitionBy("class")).alias("total"))
    full = F.floor(F.col("total") / F.col("class"))
    totals = counts.groupBy(F.col("c_class").alias("class")).agg(F.max("total").alias("total")).withColumn("full", full)
    totals = totals.select(F.col("class").alias("t_class"), "full", (F.sum("full").over(Window.orderBy("class")) - F.col("full")).alias("base"), F.sum("full").over(Window.partitionBy(F.lit(0))).alias("all_full"))
    placed = (
        pieces.join(counts, (F.col("class") == F.col("c_class")) & (F.col("part") == F.col("c_part")))
        .join(F.broadcast(totals), F.col("class") == F.col("t_class"))  # a row for each class: at most 2 * sqrt(capacity) of them
        .withColumn("at", F.col("before") + F.col("idx"))
        .withColumn("number", F.floor(F.col("at") / F.col("class")))
    )
    keep: list[Column | str] = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
    whole = placed.where("number < full").select(*keep, (F.col("base") + F.col("number")).alias("sequence_id"), (F.col("at") % F.col("class") * F.col("length")).alias("offset"))

    def repack(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["class", "at"], ignore_index=True)
        where = best_fit(rest["length"].tolist(), capacity)
        rest["sequence_id"] = rest["all_full"] + np.array([b for b, _ in where], dtype=np.int64)
        rest["offset"] = np.array([o for _, o in where], dtype=np.int64)
        return rest[[*keep, "sequence_id", "offset"]]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, offset long"
    rest = placed.where("number >= full").select(*keep, "at", "all_full").groupBy("all_full").applyInPandas(repack, schema)
    return whole.unionByName(rest)


def op6_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("class")
