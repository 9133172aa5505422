"""A Merkle manifest of a dataset: mountain-range stacks over indexed partitions, merged where partitions do not align.

Rows become leaves; the leaves of a tree (a language) are sorted, cut into ranges and indexed from counts a range, and each
range runs its own stack: a level holds fewer than FANOUT nodes, and a full run of them carries their hash to the next
level. Runs that begin before a range or end after it stay as fragments, at most two a level and range, and meet level by
level in groups of at most FANOUT nodes. The last run of a level is hashed as short as it is, without padding. The roots of
the trees are the leaves of one more tree. Proofs take a second pass over the ranges: each is sent the runs on the paths of
its own leaves and holds one block of FANOUT ** BLOCK leaves at a time.

Hashes are sha256 of the joined lower-case hex texts of what they cover; digests are stored as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, partitions, table

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Levels of a block that proofs are made of at a time; rows of ranges and trees that may be broadcast; rows of a range at least.
BLOCK, SMALL, RANGE_ROWS = 5, 200_000, 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FRAGMENT = "part int, tree string, height int, level int, run long, first int, digests binary, whole boolean"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def a_to_z_lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; where all characters are of one byte the cheaper ``lower`` is the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language), digest of the row's fields, other: its digest if tampered with (null: it is not)."""
    row = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text").cast("string")]
    digest = lambda text: F.unhex(F.sha2(F.concat(*map(_field, [*row[:-1], text])), 256))
    hit = F.crc32(F.encode(row[0].cast("string"), "UTF-8")) % 3 == 0
    return docs.select(row[0].alias("doc_id"), F.col("lang").cast("string").alias("tree"), digest(row[-1]).alias("digest"), F.when(hit, digest(a_to_z_lowered(row[-1]))).alias("other"))


def indexed(items: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """items (tree, digest and others) sorted by tree and order, with part, idx in the tree, rows of the tree and height; and
    a row for each range and tree: part, tree, start, rows, total, height.

    Ranges are cut once and written; ties are told apart by a row number, so that repeated rows spread over ranges.
    """
    items = checkpointed(items.withColumn("tie", F.monotonically_increasing_id()))
    parts = max(1, min(partitions(items), -(-items.count() // RANGE_ROWS)))
    keys = [F.asc_nulls_first(k) for k in ("tree", *order, "digest", "tie")]
    rows = items.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    rows = checkpointed(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    ranges = rows.groupBy(F.col("part").alias("r_part"), F.col("tree").alias("r_tree")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    trees = Window.partitionBy("r_tree")  # a row a range
    ranges = ranges.withColumns({"start": F.sum("rows").over(trees.orderBy("r_part")) - F.col("rows"), "total": F.sum("rows").over(trees)})
    height = F.aggregate(F.sequence(F.lit(1), F.lit(62 // FANOUT_BITS)), F.lit(0), lambda h, k: h + (F.col("total") > F.pow(F.lit(float(FANOUT)), k - 1)).cast("int"))
    ranges = checkpointed(ranges.withColumn("height", height))
    # A row for each range and one more for each further tree: broadcast while few, else by a shuffle of the digests.
    few = ranges.count() <= SMALL
    out = rows.join(F.broadcast(ranges) if few else ranges, (F.col("part") == F.col("r_part")) & F.col("tree").eqNullSafe(F.col("r_tree")))
    out = out.withColumn("idx", F.col("at") - F.col("first") + F.col("start")).drop("r_part", "r_tree", "first", "at", "rows", "start")
    if not few:
        out = out.repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("tree"), "idx")
    return out, ranges.select(F.col("r_part").alias("part"), F.col("r_tree").alias("tree"), "start", "rows", "total", "height")


def peaks(rows: DataFrame, least_level: int) -> DataFrame:
    """What the stacks of the ranges leave: fragments of runs that a range holds in part (whole = false), runs of
    ``least_level`` or more that it holds wholly, and the roots (level = height) of trees that it holds wholly."""

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, height, total, part, waiting, out = None, -1, 0, 0, [], []

        def close(level: int) -> bytes | None:
            """The run that ends here: as a whole it is hashed and carried, else it stays as a fragment."""
            at, nodes = waiting[level]
            run, first = at // FANOUT, at % FANOUT
            whole = first == 0 and len(nodes) == min(FANOUT, -(-total // FANOUT**level) - at)
            if not whole or level >= least_level:
                out.append((part, tree, height, level, run, first, bytes.fromhex(b"".join(nodes).decode()), whole))
            waiting[level] = None
            return _hash(b"".join(nodes)) if whole else None

        def add(node: bytes, at: int, level: int = 0) -> None:
            while True:
                if level == height:
                    out.append((part, tree, height, level, 0, 0, bytes.fromhex(node.decode()), True))
                    return
                if waiting[level] is None:
                    waiting[level] = (at, [])
                waiting[level][1].append(node)
                if at % FANOUT != FANOUT - 1 and at != -(-total // FANOUT**level) - 1:
                    return
                carried = close(level)
                if carried is None:
                    return
                node, at, level = carried, at // FANOUT, level + 1

        def rest() -> None:
            for level in range(len(waiting)):
                if waiting[level] is not None:
                    close(level)

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in FRAGMENT.split(", ")])

        for batch in batches:
            for now_part, now, now_height, now_total, at, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if height < 0 or now != tree or now_part != part:
                    rest()
                    part, tree, height, total, waiting = now_part, now, now_height, now_total, [None] * now_height
                add(digest.hex().encode(), at)
            yield written()
            out.clear()
        rest()
        yield written()

    return rows.select("part", "tree", "height", "total", "idx", "digest").mapInArrow(stack, FRAGMENT)


def merged(fragments: DataFrame, most_height: int) -> tuple[DataFrame, DataFrame]:
    """(tree, level, run, digests) of the runs that no range holds wholly, and (tree, root) of the trees whose last run is
    one of them. A level's fragments and the nodes carried to it meet by run: FANOUT nodes at most."""
    runs, carried = None, None
    cut = fragments.where("NOT whole").select("tree", "height", "level", "run", "first", "digests")
    for level in range(most_height):
        here = cut.where(F.col("level") == level)
        if carried is not None:
            here = here.unionByName(carried.where(F.col("level") < F.col("height")))
        met = here.groupBy("tree", "height", "level", "run").agg(F.sort_array(F.collect_list(F.struct("first", "digests"))).alias("nodes"))  # FANOUT at most
        met = checkpointed(met.select("tree", "height", "level", "run", F.aggregate("nodes", F.lit(b""), lambda acc, x: F.concat(acc, x["digests"])).alias("digests")))
        runs = met if runs is None else runs.unionByName(met)
        node = F.unhex(F.sha2(F.lower(F.hex("digests")), 256))
        nodes = met.select("tree", "height", (F.col("level") + 1).alias("level"), F.shiftright("run", FANOUT_BITS).alias("run"), F.col("run").bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias("first"), node.alias("digests"))
        roots = nodes.where("level = height") if carried is None else roots.unionByName(nodes.where("level = height"))
        carried = nodes
    if runs is None:  # trees of one leaf alone
        none = cut.where("false")
        return none.select("tree", "level", "run", "digests"), none.select("tree", F.col("digests").alias("root"))
    return runs.select("tree", "level", "run", "digests"), roots.select("tree", F.col("digests").alias("root"))


def forest(items: DataFrame, order: list[str], least_level: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, ranges) of ``indexed``, the runs (part, tree, level, run, digests; part is null where ranges had to be merged)
    and the roots (tree, root) of the trees of items."""
    rows, ranges = indexed(items, order)
    left = checkpointed(peaks(rows, least_level))
    top = ranges.agg(F.max("height")).first()[0] or 0
    met, roots = merged(left, top)
    whole = left.where("whole AND level < height").select("part", "tree", "level", "run", "digests")
    roots = left.where("whole AND level = height").select("tree", F.col("digests").alias("root")).unionByName(roots)
    return rows, ranges, whole.unionByName(met.withColumn("part", F.lit(None).cast("int")).select(*whole.columns)), roots


def manifest(docs: DataFrame) -> DataFrame:
    """tree, level, run, digests, digest: every inner node of the trees of docs with what it covers. A tree of one leaf has none."""
    runs = forest(leaves(docs), ["doc_id"], 0)[2]
    return runs.select("tree", "level", "run", "digests", F.unhex(F.sha2(F.lower(F.hex("digests")), 256)).alias("digest"))


def _on_paths(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """part, tree, level, run, digests: the merged runs on the paths of a range's first and last leaf."""
    levels = F.explode(F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>")))
    ends = ranges.select("part", "tree", "start", (F.col("start") + F.col("rows") - 1).alias("end"), levels.alias("level"))
    shift = lambda c: F.expr(f"shiftright({c}, {FANOUT_BITS} * (level + 1))")
    wanted = ends.select("part", "tree", "level", F.explode(F.array_distinct(F.array(shift("start"), shift("end")))).alias("run"))
    met = runs.where("part IS NULL").select(F.col("tree").alias("m_tree"), F.col("level").alias("m_level"), F.col("run").alias("m_run"), "digests")
    same = F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("level") == F.col("m_level")) & (F.col("run") == F.col("m_run"))
    return wanted.join(met, same).select("part", "tree", "level", "run", "digests")


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the leaves of ranges, whose runs come first. A step of a path is (hashes before, hashes after)."""
    wide = 64
    part = tree = None
    begun, runs, above, subroot, root, block = False, {}, ((), b""), b"", b"", []
    out: list[tuple] = []

    def step(text: bytes, place: int) -> tuple[bytes, bytes]:
        return text[: wide * place], text[wide * (place + 1) :]

    def proved() -> None:
        """The leaves of a block: nodes upwards, then the paths downwards."""
        if not block:
            return
        height, start = block[0][1], block[0][0]
        nodes, firsts = [[leaf for _, _, _, leaf, _ in block]], [start]
        texts: list[dict[int, bytes]] = []
        for level in range(min(BLOCK, height)):
            below, base = nodes[level], firsts[level]
            first = base // FANOUT
            here = {}
            for run in range(first, (base + len(below) - 1) // FANOUT + 1):
                lo = run * FANOUT - base
                here[run] = runs.get((level, run)) or b"".join(below[max(lo, 0) : lo + FANOUT])
            texts.append(here)
            nodes.append([_hash(here[run]) for run in sorted(here)])
            firsts.append(first)
        steps, proof = above
        for level in range(height - 1, BLOCK - 1, -1):
            at = start >> (FANOUT_BITS * level)
            before, after = step(runs[(level, at // FANOUT)], at % FANOUT)
            steps, proof = ((before, after), *steps), before + after + proof
        paths = {firsts[-1]: (steps, proof)}
        for level in range(len(texts) - 1, -1, -1):
            down = {}
            for run, (steps, proof) in paths.items():
                text = texts[level][run]
                for place in range(len(text) // wide):
                    at = run * FANOUT + place
                    if firsts[level] <= at < firsts[level] + len(nodes[level]):
                        before, after = step(text, place)
                        down[at] = (((before, after), *steps), before + after + proof)
            paths = down
        for at, _, doc_id, leaf, other in block:
            steps, proof = paths[at]
            node = other or leaf
            for before, after in steps:
                node = _hash(before + node + after)
            out.append((doc_id, leaf.decode(), subroot.decode(), root.decode(), hashlib.sha256(proof).hexdigest(), node.decode(), node == root))
        block.clear()

    def written() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 7
        types = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in PROOF.split(", ")])

    for batch in batches:
        for now_part, now, kind, level, at, height, digests, doc_id, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or now != tree or now_part != part:
                proved()
                begun, part, tree, runs, above = True, now_part, now, {}, ((), b"")
            text = digests.hex().encode()
            if kind == 0:  # the subroot, the root, and the path between them
                subroot, root, rest = text[:wide], text[wide : 2 * wide], text[2 * wide :]
                steps, sizes = [], other or b""
                for place, size in zip(sizes[::2], sizes[1::2], strict=True):
                    steps.append(step(rest[: wide * size], place))
                    rest = rest[wide * size :]
                above = (tuple(steps), b"".join(a + b for a, b in steps))
            elif kind == 1:
                runs[(level, at)] = text
            else:
                if block and at >> (FANOUT_BITS * BLOCK) != block[0][0] >> (FANOUT_BITS * BLOCK):
                    proved()
                block.append((at, height, doc_id, text, other and other.hex().encode()))
        yield written()
        out.clear()
    proved()
    yield written()


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    Nulls in any field have a mark of their own; a null lang is a tree like others, the first. Leaves of a tree go by doc_id
    (nulls first, never tampered with), rows with one doc_id by digest, so that repeated rows have a leaf each. Empty and very
    long texts are fields like others. Other columns are ignored, whatever their names. An empty table gives no rows; a
    proof of no siblings is the hash of an empty text.
    """
    rows, ranges, runs, roots = forest(leaves(docs), ["doc_id"], BLOCK)
    # the tree of trees: its leaves are the subroots in the order of their trees
    roots = checkpointed(roots)
    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top_rows, top_ranges, top_runs, top_root = forest(tops, ["name"], 0)
    # a row a tree: its path through the tree of trees, at most FANOUT digests a level
    levels = F.explode_outer(F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)))
    path = top_rows.select("name", "digest", "idx", "height", levels.alias("level")).withColumn("node", F.expr(f"shiftright(idx, {FANOUT_BITS} * coalesce(level, 0))"))
    on = top_runs.select(F.col("level").alias("t_level"), F.col("run").alias("t_run"), "digests")
    path = path.join(on, (F.col("level") == F.col("t_level")) & (F.shiftright("node", FANOUT_BITS) == F.col("t_run")), "left")
    place = F.col("node").bitwiseAND(F.lit(FANOUT - 1))
    one = F.when(F.col("level").isNotNull(), F.struct("level", place.alias("place"), "digests"))
    path = path.groupBy("name", "digest").agg(F.sort_array(F.collect_list(one)).alias("steps"))
    hexes = F.aggregate("steps", F.lit(""), lambda acc, s: F.concat(acc, F.hex(s["digests"])))
    sizes = F.aggregate("steps", F.lit(""), lambda acc, s: F.concat(acc, F.lpad(F.hex(s["place"]), 2, "0"), F.lpad(F.hex(F.shiftright(F.octet_length(s["digests"]), 5)), 2, "0")))
    heads = path.join(F.broadcast(top_root.select(F.col("root").alias("all_root"))), F.lit(True))  # one row
    heads = heads.select(F.col("name").alias("h_tree"), F.unhex(F.concat(F.hex("digest"), F.hex("all_root"), hexes)).alias("digests"), F.unhex(sizes).alias("other"))
    heads = ranges.select("part", "tree").join(heads, F.col("tree").eqNullSafe(F.col("h_tree")))
    columns = ["part", "tree", "kind", "level", "at", "height", "digests", "doc_id", "other"]
    blank = {"level": F.lit(0), "at": F.lit(0).cast("long"), "height": F.lit(0), "doc_id": F.lit(None).cast("long"), "other": F.lit(None).cast("binary")}
    heads = heads.withColumns({"kind": F.lit(0), **{k: v for k, v in blank.items() if k != "other"}}).select(*columns)
    sent = runs.where("part IS NOT NULL").unionByName(_on_paths(ranges, runs))
    sent = sent.withColumns({"kind": F.lit(1), **{k: v for k, v in blank.items() if k not in ("level", "at")}, "at": F.col("run")}).select(*columns)
    stream = rows.withColumns({"kind": F.lit(2), "level": F.lit(0), "at": F.col("idx"), "digests": F.col("digest")}).select(*columns)
    stream = heads.unionByName(sent).unionByName(stream).withColumn("part", F.col("part").cast("int"))
    parts = (ranges.agg(F.max("part")).first()[0] or 0) + 1
    stream = stream.repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("tree"), "kind", "at")
    return stream.mapInArrow(_prove, PROOF)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


#: crc32 of an ASCII string by its bits.
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
#: Levels that the SQL states for a language and for the languages: up to 8^8 and 8^4 leaves.
SQL_LEVELS = (8, 4)


def _levels_sql(name: str, leaf: str, levels: int) -> str:
    """CTEs name_k: the nodes of level k by tree (idx, h, n nodes), one k after another; a tree's root repeats upwards."""
    out = [f"{name}_0 as (select tree, idx, h, count(*) over (partition by tree) as n from {leaf})"]
    for k in range(levels):
        below = f"{name}_{k}"
        out.append(
            f"{name}_{k + 1} as (select tree, idx // 8 as idx, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by idx)) end as h, any_value((n + 7) // 8) as n from {below} group by tree, idx // 8)"
        )
    return ",\n".join(out)


def _proof_sql(name: str, levels: int, out: str, source: str, start: str) -> str:
    """CTE out: for each row of source (tree, idx) the siblings of its path joined, and ``start`` folded along it."""
    text = f"{out}_0 as (select *, '' as proof, {start} as f from {source})"
    for k in range(levels):
        run = f"(select a.tree, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as lo, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as hi, any_value(a.n) as n from {name}_{k} a join {name}_{k} b on a.tree is not distinct from b.tree and a.idx // 8 = b.idx // 8 group by all)"
        text += f",\n{out}_{k + 1} as (select p.* exclude (proof, f), p.proof || r.lo || r.hi as proof, case when r.n = 1 then p.f else sha256(r.lo || p.f || r.hi) end as f from {out}_{k} p join {run} r on p.tree is not distinct from r.tree and p.idx // {8**k} = r.idx)"
    return text


def _op12_sql() -> str:
    field = lambda c: f"coalesce(octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    low, high = SQL_LEVELS
    return f"""
with d as (select doc_id, lang as tree, {leaf("text")} as h, case when {CRC.format("doc_id::varchar")} % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} end as other from documents),
leaf as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as idx from d),
{_levels_sql("l", "leaf", low)},
sub as (select tree as name, '' as tree, h, row_number() over (order by tree nulls first) - 1 as idx from l_{low}),
{_levels_sql("s", "sub", high)},
{_proof_sql("l", low, "p", "leaf", "coalesce(other, h)")},
{_proof_sql("s", high, "q", "sub", "h")},
low as (select p.doc_id, p.h as leaf, q.name, q.h as subroot, p.proof || q.proof as low_proof, p.f as folded, q.idx from p_{low} p join q_{high} q on p.tree is not distinct from q.name),
up as (select *, '' as tree from low),
{_proof_sql("s", high, "u", "up", "folded")}
select u.doc_id, u.leaf, u.subroot, t.h as root, sha256(low_proof) as proof_sha256, u.f as folded_root, u.f = t.h as verified
from (select doc_id, leaf, subroot, f, low_proof from u_{high}) u, (select h from s_{high}) t
"""


OP12_SQL = _op12_sql()
