import random

import numpy as np
from pyspark.sql import Row

from strandline.llm import toxicity_neighbours as tn


def test_index_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        term = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        w = rng.random(len(term))
        rows.append((1000 - i, int(i % 2), i // 3, term, w / np.linalg.norm(w)))
    index = tn.BlockMaxIndex(rows, 30)
    dense = np.zeros((400, 30))
    for k, (_, _, _, t, w) in enumerate(sorted(rows, key=lambda r: r[0])):
        dense[k, t] = w
    for _ in range(60):
        term = np.sort(rng.choice(30, rng.integers(1, 5), replace=False))
        w = rng.random(len(term))
        w /= np.linalg.norm(w)
        at, s = index.nearest(term, w, 15)
        full = dense[:, term] @ w
        want = np.lexsort((np.arange(400), -full.round(12)))[:15]
        assert np.allclose(s, full[want][full[want] > 0]) and (at == want[full[want] > 0]).all()


def test_held_out_documents(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    bad = ["zorgish", "quaxly", "zorgent", "quaxors"]
    docs = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if i % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
            words.append(rng.choice(bad))
        docs.append((i, " ".join(words), int(i % 6 == 0)))
    df = spark.createDataFrame([Row(doc_id=i, text=t, term="clash", score=1) for i, t, _ in docs] + [Row(doc_id=2000, text=None, term="", score=1), Row(doc_id=2001, text="", term="", score=1)])
    train = spark.createDataFrame([Row(doc_id=i, text=t, y=y) for i, t, y in docs if i % 3] + [Row(doc_id=1, text=docs[1][1], y=None)], "doc_id long, text string, y int")
    train = spark.createDataFrame([(i, t, y) for i, t, y in docs if (i // 6) % 3], "doc_id long, text string, y int")
    out = {r["doc_id"]: r for r in tn.score(df, train, least_g=2.7).collect()}
    assert len(out) == 902 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [(out[i]["predicted"], y) for i, _, y in docs if not (i // 6) % 3]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert out[2000]["predicted"] == 0 and out[2001]["score"] == out[2000]["score"]
    assert all(r["evidence"] for r in out.values() if r["predicted"])
    assert sum(not r["evidence"] for r in out.values()) < 0.2 * len(out)
    assert all(i not in r["evidence"] for i, r in out.items())  # no document has a vote on itself
    none = spark.createDataFrame([], "doc_id long, text string, y int")
    assert {r["score"] for r in tn.score(df.limit(5), none).collect()} == {0.0}


def test_scores_match_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25))) for _ in range(260)]
    y = [int("ak" in t.split() or "bk" in t.split() or rng.random() < 0.05) for t in texts]
    texts += [texts[3], texts[3], None, ""]
    train = [(i, texts[i], y[i]) for i in range(200)] + [(3, texts[3], y[3])]
    got = {r["doc_id"]: r for r in tn.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string, y int"), least_g=1.0, least_docs=4).collect()}

    terms = [tn.Terms().count(t) for t in texts]
    n1 = sum(y[:200])
    n0 = 200 - n1

    def g(t):
        a, b = (sum(t in terms[i] for i in range(200) if y[i] == k) for k in (1, 0))
        cells = [(a, (a + b) * n1 / 200), (b, (a + b) * n0 / 200), (n1 - a, (200 - a - b) * n1 / 200), (n0 - b, (200 - a - b) * n0 / 200)]
        return 2 * sum(x * np.log(x / e) for x, e in cells if x > 0), a + b

    known = sorted(t for t in set().union(*terms[:200]) if g(t)[0] >= 1.0 and g(t)[1] >= 4)
    df = np.array([sum(t in f for f in terms) for t in known])
    m = np.array([[(1 + np.log(f[t])) if t in f else 0.0 for t in known] for f in terms]) * (np.log((1 + len(texts)) / (1 + df)) + 1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    bare = [y[i] for i in range(200) if not m[i].any()]
    rate = np.array([(n0 + (y[3] == 0)) / n0, (n1 + (y[3] == 1)) / n1])
    base = (sum(bare) * rate[1] + 0.5 * rate[1]) / (sum(bare) * rate[1] + (len(bare) - sum(bare)) * rate[0] + rate.sum())
    for i, t in enumerate(texts):
        if not m[i].any():
            assert abs(got[i]["score"] - base) < 1e-9
            continue
        cosine = {j: m[j] @ m[i] for j in range(200) if texts[j] != t and m[j] @ m[i] > 1e-12}
        near = sorted(cosine, key=lambda j: (-round(cosine[j], 12), j))[:25]
        vote = np.array([rate[y[j]] / (1.05 - min(cosine[j], 1.0)) for j in near])
        want = (vote @ np.array([y[j] for j in near]) + 0.5 * base * base) / (vote.sum() + 0.5 * base)
        assert got[i]["evidence"] == near and abs(got[i]["score"] - want) < 1e-9


def test_no_ids_and_repeated_rows(spark):
    rows = [(None, "good words here", 0), (None, "bad words here", 1), (1, "bad words", 1), (1, "bad words", 1), (1, "good words", 0)] * 5
    train = spark.createDataFrame(rows, "doc_id long, text string, y int")
    out = tn.score(train.drop("y"), train, max_examples=3, least_docs=1).collect()
    assert len(out) == 25 and len({r["score"] for r in out}) <= 4
    assert tn.example_rows(train, 1).count() == 2
