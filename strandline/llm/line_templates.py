"""Line deduplication with a log-template tree.

Lines are parsed to a fixed depth: their number of tokens, then their leading constant tokens, lead to a leaf. Tokens
with digits are variable fields from the start; within a leaf, lines that agree in most positions share a template and
the positions where they differ become variable too. A line of variable fields alone has no template. Leaves of many
distinct lines are parsed in parts of a bounded number, whose templates are then merged. A template recurs if it stands in ``families`` documents
that are pairwise unrelated. Documents are compared by sketches of all their lines (min-hashes of word pairs, so an edited
line is still found): two are unrelated if each has enough text of its own that the other lacks, whatever they share.
Tasks pick unrelated documents for each template greedily and stop at ``families``. The picks of all tasks are merged in
``families`` - 1 rounds, each a comparison of a template's first pick left with its others; pairs of documents are compared
once, however many templates they share. Copies and near copies add no pick. Lines of recurring templates are dropped from every document but the first that
has the template.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import checkpointed, grouped_stream, mix64, partitions, table

LEADING, LEAST_TOKENS, SIMILARITY, FAMILIES = 3, 1, 0.6, 4.0
LEAF_LINES = 20_000  # distinct lines of a leaf that are parsed at once, on average
HELD_LINES = 20_000  # lines that a task holds before it hands them on, beside those of one document
HELD_TEXTS = 1_000  # texts that a task holds as Python strings while it cuts them
VARIABLE, DIGIT = b"<*>", re.compile(rb"[0-9]").search
HASHES, MATCHES = 8, 3  # a line is found in a document that has so many of its min-hashes
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a hash of each byte
OWN_LINES, OWN_SHARE, OWN_MOST = 2, 0.15, 0.5  # own text: so many lines and share of the words, or most of the words


def parsed(text: str, leading: int, least_tokens: int) -> list[tuple[int, int, bytes] | None]:
    """(leaf, form, masked line) of each line, or None for lines of fewer tokens and those without a constant token;
    tokens with digits are variable. Lines of up to ``leading`` tokens are alone with their like in a leaf."""
    out: list[tuple[int, int, bytes] | None] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        tokens = constant = line.split()
        if DIGIT(line):
            tokens = [VARIABLE if DIGIT(t) else t for t in tokens]
            constant = [t for t in tokens if t != VARIABLE]
        if len(tokens) < least_tokens or not constant:
            out.append(None)
            continue
        masked = b" ".join(tokens)
        leaf = b"%d %s" % (len(tokens), b" ".join(constant[:leading]))
        out.append((_signed(xxhash.xxh3_64_intdigest(leaf)), _signed(xxhash.xxh3_64_intdigest(masked)), masked))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parsed_lines(docs: DataFrame, leading: int, least_tokens: int) -> DataFrame:
    """doc_id, text_key, leaf, form for each distinct line of enough tokens."""
    columns = ["doc_id", "text_key", "leaf", "form"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                lines = {x[1]: x[0] for x in parsed(text, leading, least_tokens) if x}
                rows.extend((doc_id, key, leaf, form) for form, leaf in lines.items())
                if len(rows) >= HELD_LINES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return docs.mapInPandas(run, "doc_id long, text_key long, leaf long, form long")


def token_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of masked lines, and which of them end a line: sums over the bytes of a token, weighed by place."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts + 1
    weight = np.multiply.accumulate(np.full(int(sizes.max()), 0xD6E8FEB86659FD93, np.uint64))
    h = weight[np.arange(len(data)) - np.repeat(starts, sizes)]
    h *= BYTES[data]
    h[ends] = 0
    return np.add.reduceat(h, starts), data[ends] == 10


def line_rows(lines: list[bytes]) -> np.ndarray:
    """Number of tokens and min-hashes of the word pairs of each line."""
    h, last = token_hashes(lines)
    ends = np.flatnonzero(last) + 1
    sizes = np.diff(ends, prepend=0)
    pairs = h * np.uint64(0x9E3779B97F4A7C15)
    pairs[:-1] += h[1:]
    single = sizes == 1
    pairs[ends[single] - 1] = h[ends[single] - 1]  # a token alone stands for itself
    across = ends[~single] - 1
    rows = np.empty((len(lines), HASHES + 1), np.uint32)
    rows[:, 0] = sizes
    for k in range(0, HASHES, 2):  # two from each mixed value
        mixed = mix64(pairs + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))
        mixed[across] = 0xFFFFFFFFFFFFFFFF  # the pairs across two lines
        for i, half in enumerate((mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF))):
            rows[:, k + 1 + i] = np.minimum.reduceat(half, ends - sizes)
    return rows


def sketches_of(docs: list[list[bytes]]) -> list[bytes]:
    """For each document (its lines): number of tokens and min-hashes of every line."""
    lines = [x for mine in docs for x in mine]
    parts, first, size = [], 0, 0
    for i, line in enumerate(lines):  # all lines are hashed, in parts of a bounded size
        size += len(line)
        if size > 200_000 or i + 1 == len(lines):
            parts.append(line_rows(lines[first : i + 1]))
            first, size = i + 1, 0
    rows = np.concatenate(parts)
    ends = np.cumsum([len(mine) for mine in docs])
    return [rows[end - len(mine) : end].tobytes() for mine, end in zip(docs, ends, strict=True)]


def sketches(docs: DataFrame, leading: int, least_tokens: int) -> DataFrame:
    """s_id, s_key and the sketch of every document with lines of enough tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                lines = list({x[1]: x[2] for x in parsed(text, leading, least_tokens) if x}.values())
                if lines:
                    held.append((doc_id, key, lines))
                    size += len(text)
                if size > 200_000:
                    yield sketched(held)
                    held, size = [], 0
            if held:
                yield sketched(held)

    def sketched(held: list) -> pd.DataFrame:
        return pd.DataFrame({"s_id": [i for i, _, _ in held], "s_key": [k for _, k, _ in held], "sketch": sketches_of([x for _, _, x in held])})

    return docs.mapInPandas(run, "s_id long, s_key long, sketch binary")


class Sketch:
    def __init__(self, data: bytes, doc: int = 0):
        self.data, self.doc = data, doc
        rows = np.frombuffer(data, np.uint32).reshape(-1, HASHES + 1)
        self.sizes, self.values = rows[:, 0].astype(np.int64), rows[:, 1:]
        self.pool = np.unique(self.values)

    def has_own(self, other: Sketch) -> bool:
        """Whether this document has enough text that the other lacks."""
        at = np.minimum(np.searchsorted(other.pool, self.values), len(other.pool) - 1)
        own = (other.pool[at] == self.values).sum(axis=1) < MATCHES
        words = self.sizes[own].sum()
        return words > 0 and (words >= OWN_MOST * self.sizes.sum() or (own.sum() >= OWN_LINES and words >= OWN_SHARE * self.sizes.sum()))

    def unrelated(self, other: Sketch) -> bool:
        return bool(self.has_own(other) and other.has_own(self))


def _picked(families: int):
    """By task, the templates with ``families`` unrelated documents (full), else a row for each document picked (numbered
    by the task), and the sketches of these documents in rows of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, full, picks = TaskContext.get().partitionId() << 33, set(), {}
        for batch in batches:
            for data, templates in zip(batch["sketch"], batch["templates"], strict=True):
                sketch, known = None, {}
                doc += 1
                for template in map(int, templates):
                    if template in full:
                        continue
                    mine = picks.setdefault(template, [])
                    sketch = sketch or Sketch(data, doc)
                    for x in mine:
                        if x.doc not in known:
                            known[x.doc] = sketch.unrelated(x)
                        if not known[x.doc]:
                            break
                    else:
                        mine.append(sketch)
                        if len(mine) >= families:
                            full.add(template)
                            del picks[template]
        yield pd.DataFrame({"template": np.fromiter(full, np.int64), "full": True, "doc": 0, "sketch": None})
        rows = [(t, x.doc) for t, mine in picks.items() for x in mine]
        yield pd.DataFrame({"template": [t for t, _ in rows], "full": False, "doc": [d for _, d in rows], "sketch": None})
        held, size = {}, 0
        for x in {x.doc: x for mine in picks.values() for x in mine}.values():
            held[x.doc] = x.data
            size += len(x.data)
            if size > 4_000_000:
                yield pd.DataFrame({"template": 0, "full": False, "doc": list(held), "sketch": list(held.values())})
                held, size = {}, 0
        yield pd.DataFrame({"template": 0, "full": False, "doc": list(held), "sketch": list(held.values())})

    return run


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a_doc, a_first of the pairs of unrelated documents."""
    first = None
    for batch in batches:
        keep = []
        for doc, data, number, other in zip(batch["doc"], batch["sketch"], batch["first"], batch["f_sketch"], strict=True):
            if first is None or first.doc != number:
                first = Sketch(other, number)
            keep.append(first.unrelated(Sketch(data, doc)))
        yield batch.loc[np.array(keep, bool), ["doc", "first"]].set_axis(["a_doc", "a_first"], axis=1)


def merged_picks(picked: DataFrame, families: int) -> DataFrame:
    """r_template: the templates of enough picks, from rows of _picked. A round compares the first pick left of each
    template that may still reach ``families`` with its others, and those related to it go. A template has fewer than
    ``families`` picks from each task, so few rows meet in its window; only a round's pairs are written."""
    full = picked.where("full").select(F.col("template").alias("r_template")).distinct()
    left = picked.where("NOT full AND sketch IS NULL").select("template", "doc")
    left = left.join(full, F.col("template") == F.col("r_template"), "left_anti")
    sketch = picked.where("sketch IS NOT NULL").select("doc", "sketch")
    mine = Window.partitionBy("template")
    for needed in range(families, 1, -1):
        pairs = left.select("template", "doc", F.min("doc").over(mine).alias("first"), F.count(F.lit(1)).over(mine).alias("n"))
        pairs = checkpointed(pairs.where((F.col("n") >= needed) & (F.col("doc") > F.col("first"))).select("template", "doc", "first"))
        others = sketch.select(F.col("doc").alias("f_doc"), F.col("sketch").alias("f_sketch"))
        both = pairs.select("doc", "first").distinct().join(sketch, "doc").join(others, F.col("first") == F.col("f_doc"))
        apart = both.select("doc", "sketch", "first", "f_sketch").mapInPandas(_apart, "a_doc long, a_first long")
        left = pairs.join(apart, (F.col("doc") == F.col("a_doc")) & (F.col("first") == F.col("a_first"))).select("template", "doc")
    return full.unionByName(left.select(F.col("template").alias("r_template")).distinct())


def masked_lines(docs: DataFrame, leading: int, least_tokens: int) -> DataFrame:
    """leaf, form, line (masked) of every line of enough tokens; lines seen before by a task may be left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                for x in parsed(text, leading, least_tokens):
                    if x and x[1] not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(x[1])
                        rows.append(x)
                if len(rows) >= HELD_LINES:
                    yield pd.DataFrame(rows, columns=["leaf", "form", "line"])
                    rows = []
            yield pd.DataFrame(rows, columns=["leaf", "form", "line"])

    return docs.select("text").mapInPandas(run, "leaf long, form long, line binary")


def templates_of(lines: list[list[bytes]], similarity: float) -> list[int]:
    """Template number of each distinct line of a leaf (equal token counts); lines join the most similar template.

    Templates start with the most frequent tokens' lines in the order given; a position where a member differs is
    variable and agrees with everything, but counts as no agreement.
    """
    known: dict[bytes, int] = {VARIABLE: 0}
    codes = np.array([[known.setdefault(t, len(known)) for t in line] for line in lines], np.int64)
    groups = np.empty_like(codes)
    n, out = 0, []
    width = codes.shape[1]
    for code in codes:
        if n:
            same = (groups[:n] == code) & (groups[:n] != 0)
            free = groups[:n] == 0
            score = same.sum(axis=1) + 0.5 * free.sum(axis=1)
            best = int(np.argmax(score))
            if same[best].sum() + free[best].sum() >= similarity * width and score[best] >= similarity * width:
                groups[best][groups[best] != code] = 0
                out.append(best)
                continue
        groups[n] = code
        out.append(n)
        n += 1
    return out


def _parse(similarity: float):
    """leaf, form, template (the form of its first line) and pattern (the template's line) of each line, by part of a leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped_stream(batches, ["leaf", "part"]):
            lines = [x.split(b" ") for x in part["line"]]
            number = templates_of(lines, similarity)
            forms = part["form"].to_numpy()
            names: dict[int, int] = {}
            patterns: dict[int, list[bytes]] = {}
            for i, k in enumerate(number):
                names.setdefault(k, forms[i])
                mine = patterns.setdefault(k, lines[i])
                if mine != lines[i]:
                    patterns[k] = [x if x == y else VARIABLE for x, y in zip(mine, lines[i], strict=True)]
            yield pd.DataFrame({"leaf": part["leaf"], "form": forms, "template": [names[k] for k in number], "pattern": [b" ".join(patterns[k]) for k in number]})

    return run


def parsed_leaves(lines: DataFrame, leaves: DataFrame, similarity: float) -> DataFrame:
    """p_form, template: the distinct lines (leaf, form, line) of the leaves (leaf, forms) by their templates. Parts of
    leaves are dealt by the lines' hashes; the templates of leaves with several parts are parsed once more together."""
    parts = F.ceil(F.col("forms") / LEAF_LINES).cast("int")
    shared = lines.join(leaves.select(F.col("leaf").alias("l_leaf"), parts.alias("parts")), F.col("leaf") == F.col("l_leaf")).dropDuplicates(["leaf", "form"])
    shared = shared.select("leaf", "form", "line", F.pmod("form", "parts").cast("int").alias("part"))
    dealt = shared.repartition(partitions(lines), "leaf", "part").sortWithinPartitions("leaf", "part", "form")
    found = checkpointed(dealt.mapInPandas(_parse(similarity), "leaf long, form long, template long, pattern binary"))
    large = leaves.where(F.col("forms") > LEAF_LINES).select("leaf")
    first = found.where("form = template").join(large, "leaf", "left_semi").select("leaf", "form", F.col("pattern").alias("line"), F.lit(0).alias("part"))
    merged = first.repartition(partitions(lines), "leaf").sortWithinPartitions("leaf", "form").mapInPandas(_parse(similarity), "leaf long, form long, template long, pattern binary")
    merged = merged.select(F.col("form").alias("m_form"), F.col("template").alias("merged"))
    return found.join(merged, F.col("template") == F.col("m_form"), "left").select(F.col("form").alias("p_form"), F.coalesce("merged", "template").alias("template"))


def recurring_lines(docs: DataFrame, leading: int, least_tokens: int, similarity: float, families: float) -> DataFrame:
    """doc_id, text_key, form and first_id of the lines of recurring templates; first_id is the template's first document."""
    least = math.ceil(families)
    lines = checkpointed(parsed_lines(docs, leading, least_tokens))
    seen = checkpointed(lines.groupBy("leaf", "form").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")))
    # Leaves with two or more distinct lines, and with enough documents for one template, are parsed further; a line
    # alone in its leaf is its own template.
    leaves = seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows"))
    leaves = checkpointed(leaves.where((F.col("forms") > 1) & (F.col("rows") >= least)).select("leaf", "forms"))
    named = parsed_leaves(masked_lines(docs, leading, least_tokens), leaves, similarity)
    named = checkpointed(seen.join(named, F.col("form") == F.col("p_form"), "left").select("form", F.coalesce("template", "form").alias("template"), "n", "first_id"))
    # only templates of enough documents, related or not, can recur
    often = named.groupBy("template").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id")).where(F.col("n") >= least)
    often = often.select(F.col("template").alias("o_template"), "first_id")
    forms = named.select(F.col("form").alias("o_form"), "template").join(often, F.col("template") == F.col("o_template")).select("o_form", "template", "first_id")
    hits = lines.select("doc_id", "text_key", "form").join(forms, F.col("form") == F.col("o_form"))
    by_doc = checkpointed(hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("form", "template", "first_id")).alias("hits")))
    # A merge also of small tables: a broadcast would leave the sketches and the picks to one task, and an executor with
    # two Python workers a core, which stay.
    described = by_doc.hint("merge").join(sketches(docs, leading, least_tokens), (F.col("doc_id") == F.col("s_id")) & (F.col("text_key") == F.col("s_key")))
    described = described.select("sketch", F.array_distinct(F.col("hits.template")).alias("templates"))
    recurring = merged_picks(checkpointed(described.mapInPandas(_picked(least), "template long, full boolean, doc long, sketch binary")), least)
    each = by_doc.select("doc_id", "text_key", F.explode("hits").alias("hit")).select("doc_id", "text_key", "hit.*").where("doc_id > first_id")
    return each.join(recurring, F.col("template") == F.col("r_template")).select("doc_id", "text_key", "form")


def drop_templates(docs: DataFrame, leading: int = LEADING, least_tokens: int = LEAST_TOKENS, similarity: float = SIMILARITY, families: float = FAMILIES) -> DataFrame:
    """The documents with their columns (text without dropped lines), n_lines and n_dropped.

    Lines of fewer than ``least_tokens`` tokens and those without a token free of digits are kept, since they show no
    template. Null texts stay null and empty ones empty (0 lines). Null doc_ids sort last for which document is the
    first. Rows that repeat doc_id and text are treated alike. An empty table gives no rows; columns beside doc_id and
    text pass through unread, whatever their names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    slim = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), key.alias("text_key"), "text")
    gone = recurring_lines(slim, leading, least_tokens, similarity, families)
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).agg(F.collect_set("form").alias("g_forms"))  # of one document
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    others = [c for c in names if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("g_row"), F.col("text").cast("string").alias("text"), row_id.alias("g_doc"), key.alias("g_text"))
    rows = rows.join(gone, (F.col("g_doc") == F.col("g_id")) & (F.col("g_text") == F.col("g_key")), "left").select("g_row", "text", "g_forms")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, HELD_TEXTS) for whole in batches for at in range(0, whole.num_rows, HELD_TEXTS)):
            texts, total, dropped = [], [], []
            for text, forms in zip(batch["text"].to_pylist(), batch["g_forms"].to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                if forms:
                    out = set(forms)
                    kept = [x for x, p in zip(lines, parsed(text, leading, least_tokens), strict=True) if not p or p[1] not in out]
                    texts.append("\n".join(kept))
                    dropped.append(len(lines) - len(kept))
                else:
                    texts.append(text)
                    dropped.append(0)
                total.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch["g_row"], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["g_row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([rows.schema["g_row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = rows.mapInArrow(cut, schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"g_row.`{c}`") for c in names), "n_lines", "n_dropped")


def op5_line_templates(spark, sf_dir: str) -> DataFrame:
    return drop_templates(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")
