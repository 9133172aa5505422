"""Personal data by weak supervision, in DataFrame operations only.

Fixed patterns give the base spans (emails, IP addresses, card and phone numbers). For other candidates (long strings
with digits, groups of digits, account and identity numbers, names after a form of address, street addresses) six
labelers vote 1, 0 (abstain) or -1: two by pattern, two by gazetteer and two by context. Expectation-maximisation over
the counts of vote patterns (at most 3^6 rows, whatever the input) estimates prior and reliabilities without any gold
labels; its posteriors are soft labels for the final span classifier, a naive Bayes model over shape, length and context
features that is fitted by one aggregation. Base spans take part as candidates, which ties the classes down, and always
stay in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import checkpointed, let, table

# Possessive forms of the stated patterns: nothing follows the repeated groups, so they match the same strings. A match
# starts where its first run of characters does, or at the end of the match before: a start further on in the run could
# match only where that one does, and would be tried at each character of a long run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Gazetteers: forms of address and street words of candidates, words before personal data and before harmless numbers.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra|Sr)"
STREETS = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace|Way)"
NAME = TITLES + r"\.? \p{Lu}\p{L}++(?:[ -]\p{Lu}\p{L}++){0,2}+"
ADDRESS = r"[0-9]{1,5}+[a-zA-Z]? (?:\p{Lu}\p{L}++ ){1,3}" + STREETS + r"\b|\p{Lu}\p{L}*(?:straße|strasse|weg|platz|allee) [0-9]{1,4}+[a-z]?\b|\b(?:[Rr]ue|[Cc]alle|[Aa]venida|[Pp]laza) (?:de |del |la |las |los |du |des )*\p{Lu}\p{L}++,? [0-9]{1,4}+"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?+\b"
IDENTITY = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
CANDIDATE = rf"(?:\b{NAME}|\b(?:{ADDRESS})|\b{IBAN}|[A-Za-z0-9_/+-]{{8,}}+|\(?[0-9][0-9() ./-]{{4,}}[0-9])"
KINDS = ("email", "ip", "card", "phone")
VOTES, ROUNDS, ACCEPT, BEFORE = 6, 25, 0.9, 32
PRIVATE_WORDS = r"(?i)(passw|token|secret|api.?key|\bkey\b|\bpin\b|\bssn\b|social.security|iban|account|konto|cuenta|compte|\btel|phone|telefon|mobil|\bfax\b|e-?mail|contact|card|passport|login|address|adresse|dirección|\blives? (?:at|in)\b|wohnt|\bname\b|nombre|\bnom\b)"
HARMLESS_WORDS = r"(?i)(version|page|seite|página|chapter|section|isbn|issn|\bvol|\bno\.?\s*$|year|jahr|année|año|price|total|figure|table|[$€£]\s*$)"
SPAN = "array<struct<s:int,e:int,v:string,b:string>>"
STEP = 64


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: struct(s, e: code points, v: the match, b: what stands before it)."""

    def place(found: Column) -> Column:
        def gaps(parts: Column) -> Column:
            pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
            return let(pairs, in_steps)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), gaps)).otherwise(F.array().cast(SPAN))

    def in_steps(pairs: Column) -> Column:
        """Running sums by STEP matches at a time and then over the steps, so that the work hardly grows faster than a text."""
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STEP).cast("int")), lambda c: sums(F.slice(pairs, c * STEP + 1, F.lit(STEP))))

        def moved(found: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
            ahead = F.aggregate(found, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
            return F.flatten(F.zip_with(found, ahead["starts"], lambda x, start: F.transform(x["out"], lambda m: m.withField("s", m["s"] + start).withField("e", m["e"] + start))))

        return let(steps, moved)

    def sums(pairs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["g"])
            end = start + F.length(p["m"])
            span = F.struct(start.alias("s"), end.alias("e"), p["m"].alias("v"), F.right(p["g"], F.lit(BEFORE)).alias("b"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(pairs, zero, step)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

        return F.when(F.length(d).between(16, 19), F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) % 10 == 0).otherwise(False)

    return let(digits(value), check)


def small_parts(value: Column) -> Column:
    """Whether all parts are at most 255 (leading zeros do not count)."""
    short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: F.when(F.length(p) <= 3, p).otherwise(F.lit("999")).cast("int") <= 255)


def iban(value: Column) -> Column:
    """Whether the check digits of an international account number hold (remainder 1 of 97, letters as 10 to 35)."""

    def check(x: Column) -> Column:
        moved = F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4))

        def step(acc: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

        return F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1).otherwise(False)

    return let(F.regexp_replace(value, " ", ""), check)


def shaped(value: Column) -> Column:
    """The kind that a candidate's pattern tells: name, address, iban, identity, or null."""
    kind = F.when(value.rlike(rf"^{TITLES}\.? \p{{Lu}}"), "name").when(value.rlike(rf"^(?:{ADDRESS})$"), "address")
    return kind.when(value.rlike(IDENTITY), "identity").when(iban(value), "iban")


def base_spans(text: Column) -> list[Column]:
    """The spans of each of KINDS, in this order."""
    some = text.rlike("[0-9]")
    empty = F.array().cast(SPAN)
    return [
        F.when(text.contains("@"), matches(text, EMAIL)).otherwise(empty),
        F.when(some, F.filter(matches(text, IP), lambda m: small_parts(m["v"]))).otherwise(empty),
        F.when(some, F.filter(matches(text, CARD), lambda m: luhn(m["v"]))).otherwise(empty),
        F.when(some & text.contains("+"), F.filter(matches(text, PHONE), lambda m: F.length(digits(m["v"])).between(8, 15))).otherwise(empty),
    ]


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 1 abstains, 0 against."""
    out = F.when(yes, 2)
    return (out if no is None else out.when(no, 0)).otherwise(1)


def votes(c: Column) -> Column:
    v, b = c["v"], c["b"]
    letters, figures, kind = v.rlike("[A-Za-z]"), F.length(digits(v)), shaped(v)
    return F.array(
        _vote(kind.isNotNull() | (letters & (figures >= 3) & (F.length(v) >= 16)), ~letters & v.rlike(r"^\(?(19|20)[0-9]{2}[ ./-]")),  # pattern: shapes and secrets; years
        _vote(c["base"] | kind.isin("iban", "identity"), kind.isNull() & ~letters & (figures < 7)),  # pattern: validated numbers; short ones
        _vote(b.rlike(PRIVATE_WORDS) | kind.isin("name", "address")),  # gazetteers
        _vote(F.lit(False), b.rlike(HARMLESS_WORDS)),  # gazetteer
        _vote(b.rlike(r"""[=:]\s*["']?$""")),  # context: a value is assigned
        _vote(b.rlike(r"""["'(<]$""") & letters, b.rlike(r"[0-9][.,)]?\s*$") & ~letters),  # context: quoted; one of a list of numbers
    )


def traits(c: Column) -> Column:
    """Features of the span classifier; a bounded number of values."""
    v, b = c["v"], c["b"]
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[A-Za-z]+", "a"), "(9a|a9)+", "x"), 1, 6)
    word = F.regexp_extract(b, r"([A-Za-z]+)[^A-Za-z]*$", 1)
    return F.array(
        F.concat(F.lit("shape "), F.xxhash64(shape).bitwiseAND(F.lit(255)).cast("string")),
        F.concat(F.lit("length "), F.least(F.length(v), F.lit(48)).cast("string")),
        F.concat(F.lit("digits "), F.least(F.length(digits(v)), F.lit(32)).cast("string")),
        F.concat(F.lit("word "), F.xxhash64(F.lower(word)).bitwiseAND(F.lit(1023)).cast("string")),
        F.concat(F.lit("kind "), F.coalesce(shaped(v), F.lit(""))),
        F.concat(F.lit("before "), F.regexp_extract(b, r"([=:\"'(]?)\s*[\"']?$", 1)),
    )


def reliabilities(patterns: Column, rounds: int = ROUNDS) -> Column:
    """EM over array<struct<v array<int>, n>>: struct(pi, t) with t[6 j + 3 y + v] = P(labeler j votes v | class y)."""
    start = F.array(*(F.lit(x) for _ in range(VOTES) for x in (0.3, 0.65, 0.05, 0.05, 0.65, 0.3)))
    zero = F.struct(F.lit(0.5).alias("pi"), start.alias("t"))

    def score(p: Column, st: Column, y: int) -> Column:
        return sum((F.log(F.element_at(st["t"], F.element_at(p["v"], j + 1) + (6 * j + 3 * y + 1))) for j in range(1, VOTES)), F.log(F.element_at(st["t"], F.element_at(p["v"], 1) + (3 * y + 1))))

    def expect(st: Column) -> Column:
        def one(p: Column) -> Column:
            odds = F.log(st["pi"] / (1 - st["pi"])) + score(p, st, 1) - score(p, st, 0)
            return F.struct(p["v"].alias("v"), p["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("r"))

        return F.transform(patterns, one)

    def step(st: Column, _: Column) -> Column:
        def maximise(soft: Column) -> Column:
            def total(y: int, j: Column | None = None, v: Column | None = None) -> Column:
                def add(a: Column, p: Column) -> Column:
                    w = p["n"] * (p["r"] if y else 1 - p["r"])
                    return a + (w if j is None else F.when(F.element_at(p["v"], j) == v, w).otherwise(0.0))

                return F.aggregate(soft, F.lit(0.0), add)

            def cell(k: Column) -> Column:
                j, y, v = (F.floor(k / 6) + 1).cast("int"), F.floor(k / 3) % 2, k % 3
                top = F.when(y == 1, total(1, j, v)).otherwise(total(0, j, v))
                under = F.when(y == 1, total(1)).otherwise(total(0))
                return (top + 0.5) / (under + 1.5)

            share = (total(1) + 1.0) / (total(1) + total(0) + 2.0)
            return F.struct(share.alias("pi"), F.transform(F.sequence(F.lit(0), F.lit(6 * VOTES - 1)), cell).alias("t"))

        return let(expect(st), maximise)

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, step), lambda st: F.transform(expect(st), lambda p: F.struct(p["v"].alias("v"), p["r"].alias("r"))))


def _of_kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and added (classified ones that overlap none of them), one row for
    each document; spans are struct(kind, s, e) with code points, end exclusive.

    A null or empty text has no spans. Rows that repeat doc_id and text get the same spans; null doc_ids are kept.
    An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    some = F.filter(matches(F.col("text"), CANDIDATE), lambda m: m["v"].rlike("[0-9]") | m["v"].rlike(rf"^{TITLES}\.? \p{{Lu}}") | m["v"].rlike(rf"^(?:{ADDRESS})$"))
    some = F.when(F.col("text").rlike(rf"[0-9]|\b{TITLES}\.? \p{{Lu}}"), some).otherwise(F.array().cast(SPAN))
    found = found.select("doc_id", F.xxhash64("text").alias("text_key"), *(c.alias(k) for k, c in zip(KINDS, base_spans(F.col("text")), strict=True)), some.alias("free"))
    base = F.concat(*(F.transform(k, _of_kind(k)) for k in KINDS))
    valued = F.concat(*(F.col(k) for k in KINDS))
    found = found.select("doc_id", "text_key", base.alias("base"), valued.alias("valued"), "free")
    apart = F.filter("free", lambda m: ~F.exists(F.col("base"), lambda x: (x["s"] < m["e"]) & (m["s"] < x["e"])))
    found = checkpointed(found.select("doc_id", "text_key", "base", F.transform("valued", lambda m: m.withField("base", F.lit(True))).alias("valued"), F.transform(apart, lambda m: m.withField("base", F.lit(False))).alias("free")))
    spans = found.select("doc_id", "text_key", F.explode(F.concat("valued", "free")).alias("c")).distinct()
    spans = spans.select("doc_id", "text_key", "c", votes(F.col("c")).alias("votes"), traits(F.col("c")).alias("traits"))
    patterns = spans.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    together = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("p"))  # at most 3^6 rows
    soft = together.select(F.explode(reliabilities(F.col("p"))).alias("x")).select(F.col("x.v").alias("x_votes"), F.col("x.r").alias("r"))
    labelled = spans.join(F.broadcast(soft), F.col("votes") == F.col("x_votes"))  # at most 3^6 rows
    counted = labelled.select(F.explode("traits").alias("trait"), "r").groupBy("trait").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    whole = labelled.agg(F.sum("r").alias("all_a"), F.sum(1 - F.col("r")).alias("all_b"))
    lean = F.log((F.col("a") + 0.5) / (F.col("all_a") + 1.0)) - F.log((F.col("b") + 0.5) / (F.col("all_b") + 1.0))
    model = counted.join(F.broadcast(whole), F.lit(True)).select(F.col("trait").alias("m_trait"), lean.alias("lean"), F.log((F.col("all_a") + 0.5) / (F.col("all_b") + 0.5)).alias("prior"))
    free = labelled.where(~F.col("c.base")).select("doc_id", "text_key", "c.s", "c.e", "c.v", "r", F.explode("traits").alias("trait"))
    judged = free.join(F.broadcast(model), F.col("trait") == F.col("m_trait"))  # some 1,500 traits
    judged = judged.groupBy("doc_id", "text_key", "s", "e", "v").agg((F.sum("lean") + F.max("prior")).alias("odds"), F.max("r").alias("r"))
    good = judged.where((1 / (1 + F.exp(-F.col("odds"))) >= accept) & (F.col("r") >= 0.5))
    kind = F.coalesce(shaped(F.col("v")), F.when(F.col("v").rlike("[A-Za-z]"), "secret").otherwise("number"))
    added = good.groupBy(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key")).agg(F.sort_array(F.collect_list(F.struct(kind.alias("kind"), "s", "e"))).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    return found.select("doc_id", "text_key", "base").join(added, same, "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans_op8(spark, sf_dir: str) -> DataFrame:
    """The base part of op8, which SQL can state: emails and phone numbers by position."""
    out = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    email, _, _, phone = base_spans(F.col("text"))
    spans = out.select("doc_id", F.posexplode(F.concat(F.transform(email, lambda m: F.struct(F.lit("email").alias("kind"), m["s"].alias("s"), m["v"].alias("v"))), F.transform(phone, lambda m: F.struct(F.lit("phone").alias("kind"), m["s"].alias("s"), m["v"].alias("v"))))))
    return spans.select("doc_id", "col.kind", F.col("col.v").alias("value")).groupBy("doc_id", "kind").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("found"), F.count(F.lit(1)).alias("n"))


SPANS_SQL = r"""
WITH f AS (
  SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS v FROM documents
  UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')) FROM documents
)
SELECT doc_id, kind, string_agg(v, ',' ORDER BY v) AS found, count(*) AS n
FROM f WHERE kind = 'email' OR length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 GROUP BY doc_id, kind
"""


def op8_pii_supervision(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    extra = F.transform(F.col("added"), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", extra)).alias("spans"))
