import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quotient_filter_dedup as qf

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").translate(A_TO_Z)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = 1
        for i in ids:
            kept = i == keep and stays > 0
            stays -= kept
            out[(i, keep, len(ids), kept, digest)] += 1
    return out


def run(df, **params):
    return Counter(map(tuple, qf.dedupe(df, **params).collect()))


@pytest.mark.parametrize("width", [64, 63, 50, 9, 3])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_filters_lose_nothing(width, n):
    rng = np.random.default_rng(width * 1000 + n)
    values = np.unique(rng.integers(0, 1 << width, n, dtype=np.uint64) if width < 64 else rng.integers(0, 2**64, n, dtype=np.uint64))
    counts = np.where(rng.random(len(values)) < 0.3, rng.integers(2, 1 << 40, len(values)), 1).astype(np.int64)
    got = qf.decoded(qf.encoded(values, counts, width), width)
    assert (got[0] == values).all() and (got[1] == counts).all() and len(got[0]) == len(values)


def test_filters_are_small():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 54, 1 << 18, dtype=np.uint64))
    assert len(qf.encoded(values, np.ones(len(values), np.int64), 54)) < 5.6 * len(values)  # of 8 bytes each


def test_merged_filters_count_like_one(spark):
    rng = random.Random(3)
    prints = [rng.choice([5, -7, 2**63 - 1, -(2**63)]) if rng.random() < 0.4 else rng.randrange(-(2**63), 2**63) for _ in range(4000)]
    prints += rng.sample(prints, 500)
    df = spark.createDataFrame([(p,) for p in prints], "print long").repartition(9)
    for bits in (1, 6):
        merged = qf.merge(qf.filters(df, bits, held=150), bits)
        assert {r[0]: r[1] for r in qf.counted(merged, bits, 1).collect()} == Counter(prints)
        assert {r[0]: r[1] for r in qf.counted(merged, bits).collect()} == {k: v for k, v in Counter(prints).items() if v > 1}
        assert merged.count() <= 2**bits


def test_equal_texts_by_bytes(spark):
    rng = random.Random(11)
    texts = ["Élan A", "élan A", "ÉLAN a", "éLAN A", "ÉLaN a", "straße", "STRASSE", "x  y", "x y", "X Y", "", None, " ", "İ", "i̇", "Σ", "σ", "ς"]
    docs = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, f"Single {i}") for i in range(50)]
    docs += [(2000 + i, "Hot COPY"[: 8 - i % 2].strip().swapcase() if i % 3 else "Hot COPY") for i in range(600)]
    docs += [(None, "null id"), (None, "NULL id"), (None, "x y"), (3000, "again"), (3000, "again"), (3000, "AGAIN"), (2999, "again"), (3000, "other"), (None, "alone")]
    docs += [(-5, "long " * 300_000), (-4, "LONG " * 300_000), (-3, "long " * 299_999)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], "doc_id long, text string, n int, keep int, row int, print int, digest int").repartition(6)
    want = brute(docs)
    assert run(df) == want
    # fingerprints that many unlike texts share send more texts to the comparison of bytes, no more
    assert run(df, print_of=F.length) == want
    assert run(df, print_of=lambda t: F.lit(7).cast("long")) == want


def test_hot_groups_and_empty_tables(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'HOT' when id % 3 = 1 then concat('t', id) else concat('p', cast(id / 6 as long)) end as text")
    assert run(df.repartition(7)) == brute([tuple(r) for r in df.collect()])
    assert run(df.where("doc_id < 0")) == Counter()
