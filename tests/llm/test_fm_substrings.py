import hashlib
import random

import numpy as np
from pyspark.sql import Row

from strandline.llm import fm_substrings as fm


def brute(docs, window=13):
    words = {i: (t.encode().split() if t else []) for i, t in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "ß"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))
        if i % 3 == 0:
            text += " \n\t" + passage + " " + text[:50]
        if i % 7 == 0 and docs:
            text = docs[-1][1]
        docs.append((i, text))
    docs += [(60, None), (61, ""), (62, "a " * 400), (63, "a " * 30), (64, "x y " * 20), (65, "x y " * 14)]
    rng.shuffle(docs)
    return docs


def test_index_matches_brute_force_windows():
    rng = np.random.default_rng(0)
    seqs = [b" ".join(b"ab"[i : i + 1] for i in rng.integers(0, 2, rng.integers(3, 12))) for _ in range(80)]
    owner = np.arange(80)[::-1].copy()
    got = fm.first_seen(seqs, owner, 3)
    least = {}
    for s, o in zip(seqs, owner):
        ws = s.split()
        for i in range(len(ws) - 2):
            k = tuple(ws[i : i + 3])
            least[k] = min(o, least.get(k, 10**9))
    for s, g in zip(seqs, got):
        ws = s.split()
        assert g == [least[tuple(ws[i : i + 3])] for i in range(len(ws) - 2)]


def test_removal_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([Row(doc_id=i, text=t, first=1, spans="x") for i, t in docs])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    for shard_words in (fm.SHARD_WORDS, 60):  # the small shards part most anchors into windows
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fm.remove_repeats(df, shard_words=shard_words).collect()}
        assert got == brute(docs)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows_and_no_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fm.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(None, "a " * 20), (1, "a " * 20), (1, "a " * 20)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in fm.remove_repeats(df).collect()) == [0, 0, 0]
