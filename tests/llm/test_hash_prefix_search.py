import numpy as np
from pyspark.sql import functions as F

from strandline.llm import hash_prefix_search as hps


def test_recall_scores_and_edges(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1200, 16)) * rng.uniform(0.5, 2, (1200, 1))
    v[7] = v[8] = v[9]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1200)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, [1.0] * 16), (2080, [1.0] * 4), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash"))
    out = hps.search(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=400).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in range(0, 1200, 20):
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(1200), -score)) if i != q][:10]
        mine = [got[q][k][0] for k in range(1, 11)]
        hit += len(set(mine) & set(order))
        assert q not in mine and all(abs(got[q][k][1] - score[got[q][k][0]]) < 1e-9 for k in range(1, 11))
        assert mine == sorted(mine, key=lambda i: (-round(score[i], 9), i))
    assert hit / 600 >= 0.9
    assert set(got) == set(range(0, 1200, 20))
    assert hps.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_no_task_holds_more_than_a_block_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((800, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def got():
        return sorted(tuple(r) for r in hps.search(df, F.col("vec_id") % 2 == 0, k=5, shard_rows=400, recall=1.0).select("query_id", "rank", "vec_id").collect())

    whole = got()
    monkeypatch.setattr(hps, "QUERY_BLOCK", 40, raising=False)
    assert got() == whole

    def sizes(*_):
        def run(base, queries):
            return queries[["query_id"]].assign(vec_id=base["vec_id"].min(), score=float(len(queries)))

        return run

    monkeypatch.setattr(hps, "_search", sizes)
    seen = hps.search(df, F.col("vec_id") % 2 == 0, k=5, shard_rows=400).collect()
    assert len({r["query_id"] for r in seen}) == 400 and max(r["score"] for r in seen) <= 80


def test_ids_with_several_vectors(spark):
    """Every vector of a repeated id is a candidate, whatever the order of the rows; a query's best vector counts."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8))
    rows = [(i % 200, [float(x) for x in v[i]]) for i in range(300)]
    rows += [(7, [float(x) for x in 50 * v[20]]), (20, [float(x) for x in -v[20]]), *rows[:5]]
    score = {}
    for q, a in rows:
        for i, b in rows:
            if q % 20 == 0 and i != q:
                score[(q, i)] = max(score.get((q, i), -np.inf), float(np.dot(a, b)))
    want = {q: sorted(((-s, i) for (p, i), s in score.items() if p == q))[:10] for q in range(0, 200, 20)}
    assert want[20][0][1] == 7
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        got = {}
        for r in hps.search(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=120, recall=1.0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q, best in want.items():
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in best]
            assert np.allclose([s for _, _, s in sorted(got[q])], [-s for s, _ in best], atol=1e-9)
