import random

import pytest
from pyspark.sql import Row

from strandline.llm import pivotal_mixing as pm


def targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_taken(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "b", "c", "d", "é", None]) if i % 3 else "a", " ".join(["w"] * rng.randint(0, 60))) for i in range(1500)]
    docs += [(2000, "tiny", "x y"), (2001, "a", None), (2002, "empty", ""), (2002, "empty", "")]
    df = spark.createDataFrame([Row(doc_id=i, source=s, text=t, chunk="clash", base=1, m_size=3, m_words="clash", m_row=4, t_rows=5) for i, s, t in docs])
    rows = pm.copies(pm.sizes_of(df)).collect()
    again = pm.copies(pm.sizes_of(df.repartition(7))).collect()
    key = lambda r: (r["doc_id"], str(r["source"]), r["size"], r["base"], r["extra"], r["rows"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sum(r["rows"] for r in rows) == len(docs)
    size, taken, largest = {}, {}, {}
    for r in rows:
        assert 0 <= r["base"] + (r["extra"] > 0) <= 3 and 0 <= r["extra"] <= r["rows"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"] * r["rows"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * (r["rows"] * r["base"] + r["extra"])
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    want = targets(size)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    mixed = pm.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["rows"] * r["base"] + r["extra"] for r in rows)
    assert pm.copies(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_repeated_rows_are_rounded_apart(spark):
    text = " ".join(["w"] * 1000)
    docs = [(7, "a", text)] * 50 + [(i, "b", text) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    taken, want = {}, targets({"a": 50_000, "b": 40_000})
    for r in pm.mix(df).groupBy("source").count().collect():
        taken[r["source"]] = r["count"] * 1000
    for s in want:
        assert abs(taken[s] - want[s]) <= 1000


def test_fractions_are_kept_in_expectation(spark):
    """Every document is taken as often, over many seeds, as its source's target asks for."""
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7) for i in range(240)], "doc_id long, source string, size long")
    total = {}
    for seed in range(6):
        for r in pm.copies(sizes, chunk=32, seed=100 * seed).collect():
            total.setdefault(r["source"], []).append((r["base"] + r["extra"], r["target"] / r["source_size"]))
    for pairs in total.values():
        mean, rate = sum(x for x, _ in pairs) / len(pairs), pairs[0][1]
        assert abs(mean - rate) < 0.05
