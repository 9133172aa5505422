import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from strandline.llm import merkle_manifest as mm

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(hashes before, hashes after) on each level."""
    out = []
    for nodes in tree[:-1]:
        lo = i // 8 * 8
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        i //= 8
    return out


def brute(docs):
    trees = defaultdict(list)
    for row in docs:
        other = row
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
            other = (*row[:4], row[4].translate(A_TO_Z))
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), leaf(other), row[0]))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels([x[2] for x in sorted(trees[t])]) for t in names}
    top = levels([built[t][-1][0] for t in names])
    out = Counter()
    for k, t in enumerate(names):
        for i, (_, _, h, other, doc_id) in enumerate(sorted(trees[t])):
            steps = path(built[t], i) + path(top, k)
            node = other
            for before, after in steps:
                node = sha(before + node + after)
            out[(doc_id, h, built[t][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0])] += 1
    return out


def corpus(seed, n, langs):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = rng.choice([None, "", "lower only", "Mixed Case", "Élan É", "straße ẞ A", f"text {i}"])
        docs.append((i * 7 % (2 * n), rng.choice(["a", "", None, "é"]), rng.choice(langs), rng.choice([None, i]), text))
    return docs


@pytest.mark.parametrize(("n", "langs", "rows", "block"), [(1, ["en"], 1, 5), (8, ["en"], 3, 5), (9, [None], 2, 1), (64, ["en"], 64, 5), (65, ["en"], 5, 1), (700, ["en", "en", "en", "de", None, "", "zz"], 37, 2), (900, [f"l{i}" for i in range(75)], 50, 1)])
def test_equals_trees_built_at_once(spark, monkeypatch, n, langs, rows, block):
    monkeypatch.setattr(mm, "RANGE_ROWS", rows)
    monkeypatch.setattr(mm, "BLOCK", block)
    monkeypatch.setattr(mm, "partitions", lambda df: 23)
    docs = corpus(n, n, langs)
    if n == 700:
        docs += [(None, "a", "en", 1, "no id"), (None, "a", "en", 1, "No Id"), *[(3, "a", "en", 5, "Again")] * 60, (4, "s", "de", 1, "Long " * 300_000)]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], SCHEMA + ", tree int, idx int, height int, digest int").repartition(4)
    assert Counter(map(tuple, mm.proofs(df).collect())) == brute(docs)
    if n == 65:  # without broadcasting the ranges
        monkeypatch.setattr(mm, "SMALL", 0)
        assert Counter(map(tuple, mm.proofs(df).collect())) == brute(docs)


def test_manifest_has_every_inner_node_once(spark, monkeypatch):
    monkeypatch.setattr(mm, "RANGE_ROWS", 30)
    monkeypatch.setattr(mm, "partitions", lambda df: 11)
    docs = [(i, "s", "en" if i % 5 else "de", i, f"t{i}") for i in range(600)]
    want = {}
    for lang in ("en", "de"):
        tree = levels([leaf(d) for d in docs if d[2] == lang])
        want |= {(lang, k, r): h for k, nodes in enumerate(tree[1:]) for r, h in enumerate(nodes)}
    got = mm.manifest(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(want) and {(r["tree"], r["level"], r["run"]): r["digest"].hex() for r in got} == want
    assert all(hashlib.sha256(r["digests"].hex().encode()).digest() == r["digest"] for r in got)


def test_empty_table(spark):
    assert mm.proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mm.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
