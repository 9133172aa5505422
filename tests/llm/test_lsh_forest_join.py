import random

from pyspark.sql import Row

from strandline.llm import lsh_forest_join as lsh


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    docs, base = [], []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        base.append(words)
        docs.append(" ".join(words))
        for _ in range(i % 4):
            near = list(words)
            for _ in range(rng.randint(1, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            docs.append(" ".join(near))
        if i % 9 == 0:
            docs.append(" \n" + "  ".join(words) + "\t")
    return [*docs, None, "", " \n", "one two", "one two", "one two three"]


def brute(docs):
    sets = [shingle_set(t) for t in docs]
    n = len(docs)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if inter >= 0.8 * (len(sets[i]) + len(sets[j]) - inter) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in range(n)}


def test_join_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([Row(doc_id=i, text=t, rep=1, same="clash") for i, t in enumerate(docs)])
    want = brute(docs)
    for block in (1500, 3):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh.join(df, block=block).collect()}
        assert got == want, [(i, got.get(i), want[i]) for i in want if got.get(i) != want[i]][:5]


def test_prefixes_shorten_until_the_recall_is_reached(spark):
    assert lsh.estimated_recall({0.99: 1000}, 0.8, 32, 8) > 0.9999  # whole signatures do for copies with small edits
    assert lsh.estimated_recall({0.8: 1000}, 0.8, 32, 8) < 0.9999 < lsh.estimated_recall({0.8: 1000}, 0.8, 32, 6)
    assert lsh.next_prefix({0.99: 10**6}, 0.8, 32, 8, 6, 0.9999) == 7
    assert lsh.next_prefix({0.8: 1000}, 0.8, 32, 8, 6, 0.9999) == 6
    assert lsh.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_stars_and_none(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (103, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in lsh.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 104)}
    stars = spark.createDataFrame([(2, 1), (3, 1), (9, 8)], "a long, b long")
    assert sorted(map(tuple, lsh.components(stars).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert lsh.components(stars.limit(0)).count() == 0


def test_tries_span_all_prefix_groups():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    trees, depth, floor, n = 3, 4, 2, 200
    sig = rng.integers(0, 3, (n, trees, depth)).astype(np.uint16)
    texts = pa.RecordBatch.from_pydict({"rep": pa.array(range(n), pa.int64()), "sig": [x.tobytes() for x in sig]})
    rows = pa.Table.from_batches(list(lsh._nodes(trees, depth, floor)([texts.slice(0, 90), texts.slice(90)]))).sort_by("node").combine_chunks()
    edges = pa.Table.from_batches(list(lsh._tries(depth, floor)(rows.to_batches(max_chunksize=37)))).to_pylist()
    for d in (floor, 3, 4):
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for e in edges:
            if e["shared"] >= d:
                parent[root(e["a"])] = root(e["b"])
                assert (sig[e["a"], :, :d] == sig[e["b"], :, :d]).all(axis=1).any()
        groups = {}
        for i in range(n):
            for t in range(trees):
                groups.setdefault((t, sig[i, t, :d].tobytes()), set()).add(root(i))
        assert all(len(g) == 1 for g in groups.values())


def test_short_prefixes_find_what_long_ones_miss(spark):
    docs = corpus()
    df = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(docs)])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh.join(df, trees=4, depth=8).collect()}
    assert got == brute(docs)


def test_rows_that_repeat_a_doc_id(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b = a.replace("w50 ", "x ")
    other = " ".join(f"o{i}" for i in range(50))
    rows = spark.createDataFrame([(1, a), (1, a), (2, b)], "doc_id long, text string")
    assert sorted(map(tuple, lsh.join(rows).collect())) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    rows = spark.createDataFrame([(1, a), (1, other), (2, b), (None, a), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, lsh.join(rows).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 0), (2, 1, 1), (None, None, 0), (3, 3, 0)], key=str)


def test_verified_classes_are_stars_within_a_tile():
    import numpy as np

    chain = [np.arange(i, 20 + i, dtype=np.uint64) for i in range(0, 6, 2)]  # each is near the next one only
    links, edges, _ = lsh.links_of(chain, np.zeros(3, np.int64), np.ones(3, np.int64), 0.8, False)
    assert links.tolist() == [1, 2, 1]
    assert edges == [(0, 1), (0, 2)]


def test_tasks_of_components_on_small_tables(spark):
    """On small tables dealt over many partitions, tasks cost more than rows: shuffle files, checkpoints and logs."""
    links = spark.createDataFrame([(i, i % 7) for i in range(8, 60)] + [(i + 1, i) for i in range(70, 90, 3)] + [(20, 71)], "a long, b long").repartition(1)
    sc, key = spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    sc.setJobGroup("components", "counted")
    try:
        roots = lsh.components(links).count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(key)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))
    assert roots == len({x for r in links.collect() for x in r})
    assert tasks <= 55, tasks  # 70 when each end of an edge was read by itself
