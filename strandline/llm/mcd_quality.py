"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Every text gives counts (words, symbols, repeated lines and word windows). For each language and source the
minimum-covariance-determinant estimate of their transformed shares is found by concentration steps from a robust start
(medians and quartiles): distances to the current centre are histogrammed together with their moments, so one
aggregation over the statistics gives the moments of the nearest ``share`` of the rows for every group at once, whatever
a group's size. The moments of a group count together with those of its language, as much as ``prior`` rows of them, and
a language's with those of all; so small groups lean on the others and large ones stand alone, without a limit between.
After a reweighting step, documents beyond a chi-square quantile of the squared Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import GAP, checkpointed, let, table, words_column

FEATURES = ("f0", "f1", "f2", "f3")
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
FLOOR = (0.12, 0.35, 0.35, 0.35)  # least standard deviations: shares that are nearly always zero must not become singular
BINS = 32  # a factor of two of the squared distance
PRIOR = 50


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words that lie in windows of ``size`` words found twice or more (64-bit hashes of windows are compared)."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(size))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: F.coalesce((F.get(s, i - 1)["x"] == e["x"]) & (i > 0), F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x)

        return let(let(ordered, positions), length)

    def of(w: Column) -> Column:
        hashed = let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(w) > size, hashed).otherwise(0)

    return let(words, of)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (null text: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_words = let(words_column(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    doubles = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"), F.size(x).cast("long").alias("n")))
    out = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), by_words.alias("w"), doubles.alias("l"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    out = out.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features(counts: DataFrame) -> DataFrame:
    """Transformed statistics; shares of short texts are shrunk towards the usual."""
    words = F.col("n_words") + 20.0
    return counts.withColumns({
        "f0": F.log((F.col("word_chars") + 100.0) / words),
        "f1": F.log(F.col("n_symbols") / (F.col("word_chars") + 100.0) + 0.02),
        "f2": F.log(F.col("n_dup_lines") / (F.col("n_lines") + 5.0) + 0.1),
        "f3": F.log(F.col("n_repeat_words") / words + 0.1),
    })


GROUP = ("lang", "source")
MOMENTS = ("n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS))


# The small tables of estimates are written as SQL expressions: one call a table, not one for each operator.


def _moments() -> list[Column]:
    sums = [*(f"sum({f}) AS s{i}" for i, f in enumerate(FEATURES)), *(f"sum({FEATURES[i]} * {FEATURES[j]}) AS q{i}{j}" for i, j in PAIRS)]
    return [F.expr(x) for x in ("CAST(count(1) AS DOUBLE) AS n", *sums)]


def _summed(moments: DataFrame, *by: str) -> DataFrame:
    return moments.groupBy(*by).agg(*(F.expr(f"sum({x}) AS {x}") for x in MOMENTS))


def _with_prior(moments: DataFrame, prior: float) -> DataFrame:
    """Moments of each group, joined by ``prior`` rows like those of its language, joined by as many like all."""
    every = _summed(moments).selectExpr(*(f"{x} AS all_{x}" for x in MOMENTS))
    langs = _summed(moments, "lang").join(F.broadcast(every), F.lit(True))  # one row
    langs = langs.selectExpr("lang AS l_lang", *(f"{x} + {prior} * all_{x} / all_n AS lang_{x}" for x in MOMENTS))
    return moments.join(langs, F.expr("lang <=> l_lang")).selectExpr(*GROUP, *(f"{x} + {prior} * lang_{x} / lang_n AS {x}" for x in MOMENTS))


def _start(fit: DataFrame) -> DataFrame:
    """Moments with the medians as centre and the quartiles' distance as deviation of each feature, no feature going with
    another, of each group."""
    quartiles = fit.groupBy(*GROUP).agg(F.expr("CAST(count(1) AS DOUBLE) AS n"), *(F.expr(f"percentile_approx({f}, array(0.25, 0.5, 0.75), 10000) AS {f}") for f in FEATURES))
    spread = [f" + pow(({f}[2] - {f}[0]) / 1.349, 2)" for f in FEATURES]
    second = [f"n * ({FEATURES[i]}[1] * {FEATURES[j]}[1]{spread[i] if i == j else ''}) AS q{i}{j}" for i, j in PAIRS]
    return quartiles.selectExpr(*GROUP, "n", *(f"n * {f}[1] AS s{i}" for i, f in enumerate(FEATURES)), *second)


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """Centre m* and lower Cholesky factor l** of the scatter (times factor, plus the floors) of each group."""
    rows = [f"s{i} / n AS m{i}" for i in range(P)]
    for i, j in PAIRS:
        cov = f"{factor} * (q{i}{j} / n - m{i} * m{j})"
        if i == j:
            cov = f"greatest({cov}, 0D) + {FLOOR[i] ** 2}"
        inner = " - ".join([cov, *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        rows.append(f"sqrt(greatest({inner}, 1e-6)) AS l{i}{j}" if i == j else f"({inner}) / l{j}{j} AS l{i}{j}")
    return moments.selectExpr(*(f"{g} AS e_{g}" for g in GROUP), *rows)


def _distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance; null where a group has no estimate."""
    out = rows.join(estimate, F.expr(" AND ".join(f"{g} <=> e_{g}" for g in GROUP)), "left")
    z = ["(" + " - ".join([f"{f} - m{i}", *(f"l{i}{k} * z{k}" for k in range(i))]) + f") / l{i}{i} AS z{i}" for i, f in enumerate(FEATURES)]
    return out.selectExpr(*rows.columns, *z).selectExpr(*rows.columns, " + ".join(f"z{i} * z{i}" for i in range(P)) + " AS d2")


def judge(docs: DataFrame, share: float = 0.75, steps: int = 5, tail: float = 0.01, prior: float = PRIOR) -> DataFrame:
    """The base counts with base_failed, distance2 and kept, one row for each document.

    Null texts are empty (base_failed). Null languages and sources are values like others. Repeated rows count as
    often; an empty table gives no rows; other columns are ignored. kept is false if base_failed, else whether the
    distance is within the quantile 1 - ``tail``.
    """
    rows = checkpointed(features(base_counts(docs)))
    fit = rows.where(~F.col("base_failed")).select(*GROUP, *FEATURES)
    inside = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    estimate = checkpointed(_estimate(_with_prior(_start(fit), prior), 1.0))
    for _ in range(steps):  # concentration: moments of the nearest ``share`` of each group
        binned = _distances(fit, estimate).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS))
        bins = binned.groupBy(*GROUP, "bin").agg(*_moments())
        ranked = bins.withColumns({"up_to": F.sum("n").over(Window.partitionBy(*GROUP).orderBy("bin")), "all": F.sum("n").over(Window.partitionBy(*GROUP))})
        near = _summed(ranked.where(F.col("up_to") - F.col("n") < F.ceil(share * F.col("all"))), *GROUP)
        estimate = checkpointed(_estimate(_with_prior(near, prior), inside))
    weighted = 0.975
    cut = chi2_quantile(weighted, P)
    near = _distances(fit, estimate).where(F.col("d2") <= cut).groupBy(*GROUP).agg(*_moments())
    estimate = checkpointed(_estimate(_with_prior(near, prior), weighted / chi2_cdf(cut, P + 2)))
    out = _distances(rows, estimate)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_quantile(1 - tail, P))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))


def counts_op1(spark, sf_dir: str) -> DataFrame:
    """The base columns of op1, which SQL can state."""
    return base_counts(table(spark, sf_dir, "documents")).drop("lang", "source", "n_lines")


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM w),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS j FROM twice WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def op1_mcd_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("lang", "source")
