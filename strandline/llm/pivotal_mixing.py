"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document should be taken ``target / source_size`` times. The whole part is taken for certain; the fractions
are rounded in pairs: words move at random from one document's fraction to the other's until one of them is 0 or 1,
so expectations hold and a pair's expected words never change. Chunks of a bounded number of documents, dealt by
hash, round in parallel and each leaves one fractional document; these residuals meet in the next level of the
reduction tree, until a source has one, which is rounded alone. A source so misses its target by less than one
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, let, stored, table, words_column

WEIGHTS, CAP, CHUNK = (5, 2, 1), 3, 128
CUR = "struct<doc_id:bigint,size:bigint,w:double,mass:double>"
DONE = "array<struct<doc_id:bigint,size:bigint,up:int>>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """t_source, source_size, target: weights in the order of the sources (nulls last), repeating; no target is above
    cap times its source's size, and the excess is reshared by weight. One row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("most", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    s = s.withColumns({
        "place": F.row_number().over(order),
        "spent": F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "heavy": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "all_size": F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"),
    })
    s = s.withColumn("level", (F.col("all_size") - F.coalesce("spent", F.lit(0.0))) / F.col("heavy"))
    free = F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(free).over(Window.partitionBy(F.lit(0)))["level"])
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
    return s.select(F.col("source").alias("t_source"), "source_size", target.alias("target"))


def _chance(seed: int, *keys: Column) -> Column:
    return (F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def _item(i: Column, mass: Column) -> Column:
    return F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"), i["w"].alias("w"), mass.alias("mass"))


def _round_pairs(items: Column, seed: int) -> Column:
    """Fold a chunk's documents: {cur: the fractional one that is left, done: the others with 0 or 1}."""

    def state(cur: Column, done: Column) -> Column:
        return F.struct(cur.alias("cur"), done.alias("done"))

    def settled(acc: Column, i: Column, up: int) -> Column:
        return F.concat(acc["done"], F.array(F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"), F.lit(up).alias("up"))))

    def step(acc: Column, b: Column) -> Column:
        a = acc["cur"]
        moves = F.struct(
            F.least(a["w"] - a["mass"], b["mass"]).alias("rise"),
            F.least(a["mass"], b["w"] - b["mass"]).alias("fall"),
            _chance(seed, a["doc_id"], a["size"], b["doc_id"], b["size"]).alias("u"),
        )

        def paired(m: Column) -> Column:
            rise, fall = m["rise"], m["fall"]
            risen = F.when(rise == a["w"] - a["mass"], state(_item(b, b["mass"] - rise), settled(acc, a, 1))).otherwise(state(_item(a, a["mass"] + rise), settled(acc, b, 0)))
            fallen = F.when(fall == a["mass"], state(_item(b, b["mass"] + fall), settled(acc, a, 0))).otherwise(state(_item(a, a["mass"] - fall), settled(acc, b, 1)))
            return F.when(m["u"] * (rise + fall) < fall, risen).otherwise(fallen)

        return F.when(a.isNull(), state(_item(b, b["mass"]), acc["done"])).otherwise(let(moves, paired))

    zero = state(F.lit(None).cast(CUR), F.array().cast(DONE))
    return F.aggregate(items, zero, step)


def copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, chunk: int = CHUNK, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, rows, base, extra: of the ``rows`` rows of ``sizes`` (doc_id, source,
    size) that agree in all three, ``extra`` are taken base + 1 times and the others base times.

    The fractions of rows that agree add up: their whole part is taken for certain, and what is left is rounded like a
    single document. Null doc_ids and sources are values like others; documents without words get whole copies only.
    An empty table gives no rows. Reruns agree.
    """
    t = source_targets(sizes, weights, cap)
    items = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = items.join(t, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("rate", rate).drop("t_source")
    items = items.withColumn("base", F.floor("rate"))
    share = F.when(F.col("size") > 0, F.col("rows") * (F.col("rate") - F.col("base"))).otherwise(0.0)
    items = checkpointed(items.withColumn("share", share).withColumn("sure", F.floor("share")))
    weight = F.col("size").cast("double")
    left = items.where(F.col("share") > F.col("sure")).select("source", "doc_id", "size", weight.alias("w"), (weight * (F.col("share") - F.col("sure"))).alias("mass"))
    decided, level = None, 0
    while True:
        counts = left.groupBy(F.col("source").alias("c_source")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
        most = counts.agg(F.max("chunks")).first()[0]
        key = F.xxhash64(F.lit(seed + level), "doc_id", "size")
        dealt = left.join(counts, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("chunk", F.pmod(key, "chunks"))
        folded = dealt.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(F.struct(key.alias("h"), "doc_id", "size", "w", "mass"))).alias("items"))  # about ``chunk`` documents by hash
        folded = checkpointed(folded.select("source", _round_pairs(F.col("items"), seed + level).alias("s")).select("source", "s.cur", "s.done"))
        done = folded.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.up")
        left = folded.select("source", "cur.*")
        decided = done if decided is None else decided.unionByName(done)
        level += 1
        if most is None or most <= 1:
            break
    last = left.select("source", "doc_id", "size", (_chance(seed, F.col("doc_id"), F.col("size"), F.lit("last")) * F.col("w") < F.col("mass")).cast("int").alias("up"))
    decided = decided.unionByName(last).select(*(F.col(c).alias(f"d_{c}") for c in ("source", "doc_id", "size", "up")))
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in ("source", "doc_id", "size")]
    out = items.join(decided, same, "left").withColumn("extra", F.col("sure") + F.coalesce("d_up", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "rows", "base", "extra")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words (null text: 0)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.size(words_column(F.col("text"))).cast("long").alias("size"))


def _numbered(rows: DataFrame) -> DataFrame:
    """A number from 1 for each row among those with its key, counted within stored partitions and then across them, so
    that no task needs all rows of a key."""
    rows = stored(rows.withColumn("m_part", F.spark_partition_id()), "repeated rows")
    key = ("m_doc_id", "m_source", "m_size")
    counts = rows.groupBy(*key, "m_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("m_part")) - F.col("n")
    counts = counts.select(*(F.col(c).alias(f"c_{c}") for c in (*key, "m_part")), before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*key, "m_part").orderBy(F.lit(1)))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in (*key, "m_part")]
    return rows.withColumn("within", within).join(counts, same).withColumn("number", F.col("within") + F.col("before"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as they are taken, with the columns of ``docs`` (whatever their names).

    Rows that agree in doc_id, source and number of words share what is taken of them, as evenly as whole copies allow.
    Null texts have no words. An empty table gives no rows.
    """
    taken = copies(checkpointed(sizes_of(docs)), **params).where("base + extra > 0")
    taken = checkpointed(taken.select(*(F.col(c).alias(f"t_{c}") for c in ("doc_id", "source", "size", "rows", "base", "extra"))))
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("m_row"), *(F.col(c).alias(f"m_{c}") for c in ("doc_id", "source")), F.col("text").alias("m_text"))
    sized = sized.select("m_row", F.col("m_doc_id").cast("long").alias("m_doc_id"), F.col("m_source").cast("string").alias("m_source"), F.size(words_column(F.col("m_text"))).cast("long").alias("m_size"))
    same = [F.col(f"m_{c}").eqNullSafe(F.col(f"t_{c}")) for c in ("doc_id", "source", "size")]
    out = sized.join(taken.where("t_rows = 1"), same).select("m_row", (F.col("t_base") + F.col("t_extra")).alias("m_copies"))
    repeated = taken.where("t_rows > 1")
    if not repeated.isEmpty():
        some = _numbered(sized.join(repeated, same))
        out = out.unionByName(some.select("m_row", (F.col("t_base") + (F.col("number") <= F.col("t_extra")).cast("int")).alias("m_copies")).where("m_copies > 0"))
    out = out.select("m_row", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))).alias("m_copy"))
    return out.select(*(F.col(f"m_row.`{c}`") for c in docs.columns))


def op10_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    sizes = checkpointed(sizes_of(table(spark, sf_dir, "documents")))
    out = copies(sizes).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    times = F.col("base") + (F.col("row") <= F.col("extra")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def targets_op10(spark, sf_dir: str) -> DataFrame:
    """The sizes and targets that op10's rounding starts from; SQL can state these, but not the random transfers."""
    sizes = sizes_of(table(spark, sf_dir, "documents"))
    out = sizes.join(source_targets(sizes), F.col("source").eqNullSafe(F.col("t_source")))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


#: With targets of all sources proportional to w at level x, a source takes least(3 * size, w * x); x makes them add up.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s),
x AS (SELECT a.source, 3.0 * a.source_size / a.w AS x FROM w a),
steps AS (SELECT x.x, sum(least(3.0 * w.source_size, w.w * x.x)) AS total, sum(CASE WHEN 3.0 * w.source_size / w.w > x.x THEN w.w ELSE 0 END) AS free FROM x, w GROUP BY x.x
       UNION ALL SELECT 0.0, 0.0, sum(w) FROM w),
best AS (SELECT x, total, free FROM steps WHERE total <= (SELECT sum(source_size) FROM w) ORDER BY x DESC LIMIT 1),
level AS (SELECT x + CASE WHEN free > 0 THEN ((SELECT sum(source_size) FROM w) - total) / free ELSE 0 END AS x FROM best)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(least(3.0 * source_size, w * x)::DOUBLE, 6) AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, level
"""
