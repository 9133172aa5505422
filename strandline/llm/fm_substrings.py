"""Repeated word passages by compressed FM-indexes, one for each shard of passages that share an anchor.

Every 13-word window has an anchor, the smallest hash of its 5-word runs; neighbouring windows with one anchor form
a super-window of at most 21 words. Equal windows have equal anchors, so only anchors that start in two or more
documents are followed up, and each shard of anchors can be indexed apart. Distinct super-windows of a shard are
concatenated, suffix-sorted, and their Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with
block ranks. The super-windows are then streamed through it: backward search extends all windows together, word by
word, and stops for those whose interval has shrunk to one suffix; what reaches the threshold is an interval of
suffixes whose smallest doc_id tells where the passage stood first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import GAP, WordHashes, partitions, stored, table, window_hashes, words_of

WINDOW, ANCHOR = 13, 5
SHARD_WORDS = 1_000_000
ANCHOR_BITS = np.uint64(24)  # 40 bits stay: a clash only costs a look-up


def super_windows(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the maximal runs of windows whose smallest run of words is the same one."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = window_hashes(h, anchor)
    best, at = runs[:n].copy(), np.arange(n)
    for i in range(1, window - anchor + 1):
        less = runs[i : i + n] < best
        best[less] = runs[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
    return (best[first] >> ANCHOR_BITS).astype(np.int64), first, np.diff(np.append(first, n))


class WaveletMatrix:
    """Ranks of symbols in a sequence: a packed bit vector with block ranks for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, n = [], len(symbols)
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros(n // 64 + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            block = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=block[1:])
            zeros = n - int(bit.sum())
            self.levels.append((level, packed, block, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Position after following the symbol's bits; differences of two positions are counts of the symbol."""
        i = i.copy()
        for level, packed, block, zeros in self.levels:
            word = i >> 6
            ones = block[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i


class FmIndex:
    """FM-index of sequences of symbols from 1 (0 ends each); ``owner`` is a value for each sequence."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, owner: np.ndarray):
        count = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(sequences) + count, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = sequences
        self.text, self.starts = text, ends - lengths
        rank = np.where(inside, text + count, 0)
        rank[ends] = np.arange(count)  # each end differs, so comparisons stop there
        n, step = len(text), 1
        while True:
            then = np.zeros(n, np.int64)
            then[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + then
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            rank, step = fresh, 2 * step
            if rank[order[-1]] == n - 1 or step > n:
                break
        self.first = np.searchsorted(np.sort(text), np.arange(int(text.max()) + 2))
        bits = max(1, int(text.max()).bit_length())
        self.bwt = WaveletMatrix(text[order - 1], bits)
        self.zero = self.bwt.descend(np.arange(len(self.first)), np.zeros(len(self.first), np.int64))
        self.owner = owner[np.searchsorted(ends, order)]

    def least_owner(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For every window of the sequences: its start in the text and the least owner of an equal window."""
        valid = np.lib.stride_tricks.sliding_window_view(self.text, window).min(axis=1) > 0
        start = np.flatnonzero(valid)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.text))
        live = np.arange(len(start))
        for back in range(window - 1, -1, -1):
            symbol = self.text[start[live] + back]
            base = self.first[symbol] - self.zero[symbol]
            lo[live] = base + self.bwt.descend(symbol, lo[live])
            hi[live] = base + self.bwt.descend(symbol, hi[live])
            live = live[hi[live] - lo[live] > 1]
        least = self.owner[lo]
        pairs, back = np.unique(lo[live] * (len(self.text) + 1) + hi[live], return_inverse=True)
        if len(pairs):
            a, b = np.divmod(pairs, len(self.text) + 1)
            edges = np.stack([a, b], axis=1).ravel()
            extended = np.append(self.owner, np.iinfo(np.int64).max)
            least[live] = np.minimum.reduceat(extended, edges)[::2][back]
        return start, least


def first_seen(seqs: list[bytes], owner: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """For each distinct passage (words joined by one space), the least owner of each of its windows."""
    words = [s.split() for s in seqs]
    lengths = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known) + 1) for ws in words for w in ws), np.int64, int(lengths.sum()))
    index = FmIndex(ids, lengths, owner)
    start, least = index.least_owner(window)
    parts = np.searchsorted(start, index.starts)
    return [least[a:b].tolist() for a, b in zip(parts, np.append(parts[1:], len(start)), strict=True)]


def known_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text of the rows that have both."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def _read(window: int):
    """Digest of the words and the super-windows of every text: anchors as int64, windows of each as one byte. The
    runs follow each other without a gap, so their first windows are sums of the windows before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                anchor, _, count = super_windows(hashes.of(words), window)
                rows.append((doc_id, hashlib.blake2b(b" ".join(words), digest_size=16).digest(), anchor.tobytes(), count.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "same", "anchors", "counts"])

    return run


def _anchors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """anchor, of (a hash of the text), n: a row for each anchor of a text."""
    for batch in batches:
        per = np.array([len(c) for c in batch["counts"]], np.int64)
        anchor = np.frombuffer(b"".join(batch["anchors"]), np.int64)
        of = np.frombuffer(b"".join(s[:8] for s in batch["same"]), np.int64) >> 16
        order = np.lexsort((anchor, np.repeat(np.arange(len(batch)), per)))
        anchor, of = anchor[order], np.repeat(of, per)
        at = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(of) != 0))) if len(anchor) else np.empty(0, np.int64)
        yield pd.DataFrame({"anchor": anchor[at], "of": of[at], "n": np.diff(np.append(at, len(anchor)))})


def _spans_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """anchor, doc_id, span: a row for each super-window; span is its first window and its number of windows."""
    for batch in batches:
        per = np.array([len(c) for c in batch["counts"]], np.int64)
        count = np.frombuffer(b"".join(batch["counts"]), np.uint8).astype(np.int64)
        ends = np.cumsum(count)
        before = np.repeat(np.append(0, ends)[np.append(0, np.cumsum(per))[:-1]], per) if len(count) else count
        yield pd.DataFrame({"anchor": np.frombuffer(b"".join(batch["anchors"]), np.int64), "doc_id": np.repeat(batch["doc_id"].to_numpy(np.int64), per), "span": (ends - count - before) * 256 + count})


def _passages(window: int):
    """anchor, seq, doc_id, first, passage of every span that may recur. A task sends the words of a passage once, and
    again only for a smaller doc_id. Spans of a hot anchor are parted into their windows, each its own anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        sent: dict[tuple[int, int], int] = {}
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = words_of(text)
                for span in found:
                    anchor, (first, n) = span["anchor"], divmod(span["span"], 256)
                    for lo, size in [(first + i, 1) for i in range(n)] if span["hot"] else [(first, n)]:
                        if lo + size + window - 1 > len(words):  # of another row with this doc_id
                            continue
                        passage = b" ".join(words[lo : lo + size + window - 1])
                        seq = xxhash.xxh3_64_intdigest(passage)
                        seq -= (seq >> 63) << 64
                        key = (seq if span["hot"] else anchor, seq)
                        if len(sent) > 200_000:
                            sent.clear()
                        fresh = sent.get(key, doc_id + 1) > doc_id
                        if fresh:
                            sent[key] = doc_id
                        rows.append((*key, doc_id, lo, passage if fresh else None))
            yield pd.DataFrame(rows, columns=["anchor", "seq", "doc_id", "first", "passage"])

    return run


def _search(window: int, shard_words: int):
    """seq, least: shards of whole anchors, from rows sorted by anchor and seq, each through its own FM-index."""

    def distinct(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby(["anchor", "seq"], sort=False, as_index=False).agg(doc_id=("doc_id", "min"), passage=("passage", "first"))

    def shard(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = distinct(pd.concat(parts))
        found = first_seen(rows["passage"].tolist(), rows["doc_id"].to_numpy(np.int64), window)
        return pd.DataFrame({"l_anchor": rows["anchor"].to_numpy(np.int64), "l_seq": rows["seq"].to_numpy(np.int64), "least": found})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None
        for batch in batches:
            batch = distinct(batch)
            if not len(batch):
                continue
            anchor = batch["anchor"].to_numpy()
            total = np.append(0, np.cumsum([p.count(b" ") + 2 for p in batch["passage"]]))
            turns, cut = (np.flatnonzero(np.diff(anchor)) + 1).tolist(), 0
            for at in [0, *turns] if last is not None and anchor[0] != last else turns:
                if size + total[at] - total[cut] >= shard_words:
                    yield shard([*held, batch.iloc[cut:at]])
                    held, size, cut = [], 0, at
            held.append(batch.iloc[cut:])
            size += int(total[-1] - total[cut])
            last = anchor[-1]
        if held:
            yield shard(held)

    return run


def repeated_windows(read: DataFrame, dealt: DataFrame, copied: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, starts: word positions of the windows that also start in a document with a smaller doc_id; copies are
    left out, since a smaller document has all their windows. ``read``: rows of _read; ``dealt``: the texts dealt by
    doc_id, one exchange for all that needs them. No task holds more than two shards of ``shard_words`` words: an
    anchor with more passages than that is parted into its windows, which still meet by their own hashes."""
    # anchors in two or more different texts; copies of a text count once
    shared = read.mapInPandas(_anchors_of, "anchor long, of long, n long").groupBy("anchor").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.sum("n").alias("n"))
    shared = stored(shared.where("lo < hi").select(F.col("anchor").alias("s_anchor"), (F.col("n") * (2 * window - ANCHOR) > shard_words).alias("hot")), "shared anchors")
    spans = read.mapInPandas(_spans_of, "anchor long, doc_id long, span long").join(shared, F.col("anchor") == F.col("s_anchor"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "span", "hot")).alias("spans"))  # of one document
    spans = spans.join(copied, F.col("doc_id") == F.col("c_id"), "left_anti")
    found = stored(dealt.join(spans, "doc_id").mapInPandas(_passages(window), "anchor long, seq long, doc_id long, first int, passage binary"), "passages")
    fresh = found.where(F.col("passage").isNotNull()).select("anchor", "seq", "doc_id", "passage")
    least = fresh.repartition(partitions(read), "anchor").sortWithinPartitions("anchor", "seq").mapInPandas(_search(window, shard_words), "l_anchor long, l_seq long, least array<long>")
    hits = found.select("anchor", "seq", "doc_id", "first").join(least, (F.col("seq") == F.col("l_seq")) & (F.col("anchor") == F.col("l_anchor")))
    starts = F.filter(F.transform("least", lambda d, i: F.when(d < F.col("doc_id"), F.col("first") + i)), lambda s: s.isNotNull())
    hits = hits.select("doc_id", starts.alias("starts")).where(F.size("starts") > 0)
    return hits.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # of one document


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, kept_sha256 for each document; windows of
    13 words unless stated, of at most 255.

    A word goes if a window that covers it also starts in a document with a smaller doc_id. Documents without a
    doc_id and null texts lose nothing; rows that share a doc_id do not count against each other. Texts shorter
    than a window are left. An empty table gives no rows; other columns are ignored.
    """
    known = known_texts(docs)
    read = stored(known.mapInPandas(_read(window), "doc_id long, same binary, anchors binary, counts binary"), "super-windows")
    # documents whose words are those of a document with a smaller doc_id (128-bit digests are compared)
    first = read.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("same", "rep")
    copied = read.select("doc_id", "same").join(first, "same").where("doc_id > rep").select(F.col("doc_id").alias("c_id")).distinct()
    copied = stored(copied, "copies")
    dealt = known.repartition(partitions(docs), "doc_id")
    starts = repeated_windows(read, dealt, copied, window, shard_words).select(F.col("doc_id").alias("r_id"), "starts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, at, copy in zip(batch["doc_id"], batch["text"], batch["starts"], batch["copy"], strict=True):
                words = words_of(text)
                n, kept = len(words), words
                if copy and n >= window:
                    kept = []
                elif at is not None:
                    gone = np.zeros(n + window + 1, np.int64)
                    at = np.unique(np.asarray(at, np.int64))
                    at = at[at + window <= n]  # rows of one doc_id may differ in length
                    gone[at] += 1
                    gone[at + window] -= 1
                    kept = [w for w, g in zip(words, np.cumsum(gone)[:n].tolist(), strict=True) if not g]
                data = b" ".join(kept)
                rows.append((doc_id, data.decode("utf-8", "replace"), n, n - len(kept), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})

    marked = dealt.join(starts, F.col("doc_id") == F.col("r_id"), "left").join(copied, F.col("doc_id") == F.col("c_id"), "left")
    marked = marked.select("doc_id", "text", "starts", F.col("c_id").isNotNull().alias("copy"))
    other = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNull() | F.col("text").isNull())
    other = other.select("doc_id", "text", F.lit(None).cast("array<long>").alias("starts"), F.lit(False).alias("copy"))
    return marked.unionByName(other).mapInPandas(cut, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


def op7_fm_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text")


#: doc_ids of the table are unique, as the query takes them.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w),
f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM k JOIN f USING (k) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS text, count(*) AS n FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
