import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from strandline.llm import mcd_quality as mcd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    out = [None, "", " \n\t", "a b c d e", "of " * 60, "x\x1cy z w", "a b c d e f " * 3 + "\n" + "a b c d e f", "😀 #$ <x>\n<x>\n<x>\n\n\n"]
    for i in range(300):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        if i % 9 == 0:
            lines.append(lines[0])
        text = "\n".join(lines)
        out.append(text.replace(" ", "%%% ") if i % 20 == 7 else text)
    return out


def test_counts_and_verdicts(spark):
    texts = corpus()
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang="en" if i % 3 else None, source=f"s{i % 2}", d2="clash", n=3) for i, t in enumerate(texts)])
    out = {r["doc_id"]: r for r in mcd.judge(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert not (r["kept"] and r["base_failed"])
    junk = [r["kept"] for i, r in out.items() if texts[i] and "%%% " in texts[i] and not r["base_failed"]]
    clean = [r["kept"] for i, r in out.items() if i > 8 and "%%% " not in texts[i] and not r["base_failed"]]
    assert junk and not any(junk)
    assert sum(clean) >= 0.98 * len(clean)


def test_quantiles_and_no_rows(spark):
    assert mcd.chi2_quantile(0.975, 4) == pytest.approx(11.1433, abs=1e-3)
    assert mcd.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_symbol_densities_near_the_cut(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(n, symbols):
        words = [rng.choice(vocabulary) for _ in range(n)]
        for i in rng.sample(range(n), round(symbols * n)):
            words[i] += "#"
        return " ".join(words)

    docs = [(i, text(300, 0.0), "plain") for i in range(200)]
    docs += [(1000 + i, text(2236, 1093 / 2236), "dense") for i in range(10)]
    docs += [(2000 + i, text(1000, 0.486), "dense") for i in range(10)]
    docs += [(3000 + i, text(1000, 0.05), "light") for i in range(10)]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s") for i, t, _ in docs])
    kept = {r["doc_id"]: r["kept"] for r in mcd.judge(df).collect()}
    for kind, want in (("plain", True), ("dense", False), ("light", True)):
        assert all(kept[i] == want for i, _, k in docs if k == kind), kind


def test_verdicts_match_brute_force(spark):
    """The whole estimate in numpy: start, concentration, reweighting, with large, small and single groups."""
    import math

    import numpy as np

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs = []
    for i in range(420):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(8, 200))]
        words = [w + "#" if rng.random() < (0.4 if i % 11 == 0 else 0.02) else w for w in words]
        docs.append((i, "\n".join([" ".join(words)] + ["again"] * (i % 4)), ["en", "de", None][i % 3 if i < 400 else 1], "large" if i < 400 else f"small{i // 3}"))
    out = {r["doc_id"]: r for r in mcd.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    group, x, fit = [(d[2], d[3]) for d in docs], [], []
    for _, text, _, _ in docs:
        n, chars, symbols, dup, repeat, failed = brute(text)
        lines = len([t for t in text.split("\n") if t.strip()])
        x.append([math.log((chars + 100) / (n + 20)), math.log(symbols / (chars + 100) + 0.02), math.log(dup / (lines + 5) + 0.1), math.log(repeat / (n + 20) + 0.1)])
        fit.append(not failed)
    x, fit = np.array(x), np.array(fit)
    groups = sorted(set(group), key=str)
    of = {g: np.array([h == g for h in group]) & fit for g in groups}
    groups = [g for g in groups if of[g].any()]

    def estimates(moments, factor):
        out, floor = {}, np.diag(np.array(mcd.FLOOR) ** 2)
        add = lambda ms: tuple(sum(m[k] for m in ms) for k in range(3))
        like = lambda m: tuple(mcd.PRIOR * m[k] / m[0] for k in range(3))
        for g in groups:
            lang = add([add([moments[h] for h in groups if h[0] == g[0]]), like(add(list(moments.values())))])
            n, s, q = add([moments[g], like(lang)])
            cov = factor * (q / n - np.outer(s / n, s / n))
            out[g] = s / n, cov - np.diag(np.diag(cov)) + np.diag(np.maximum(np.diag(cov), 0)) + floor
        return out

    def moments(rows):
        return float(len(rows)), rows.sum(axis=0), rows.T @ rows

    def d2(g, e):
        z = x[of[g]] - e[g][0]
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(e[g][1]), z)

    start = {}
    for g in groups:
        rows = np.sort(x[of[g]], axis=0)
        low, mid, high = (rows[max(math.ceil(p * len(rows)) - 1, 0)] for p in (0.25, 0.5, 0.75))
        start[g] = len(rows), len(rows) * mid, len(rows) * (np.outer(mid, mid) + np.diag(((high - low) / 1.349) ** 2))
    e = estimates(start, 1.0)
    for _ in range(5):
        near = {}
        for g in groups:
            bins = np.floor(np.log2(d2(g, e) + 1e-6) * mcd.BINS)
            before = np.array([(bins < b).sum() for b in bins])
            near[g] = moments(x[of[g]][before < math.ceil(0.75 * len(bins))])
        e = estimates(near, 0.75 / mcd.chi2_cdf(mcd.chi2_quantile(0.75, 4), 6))
    cut = mcd.chi2_quantile(0.975, 4)
    e = estimates({g: moments(x[of[g]][d2(g, e) <= cut]) for g in groups}, 0.975 / mcd.chi2_cdf(cut, 6))
    for g in groups:
        for i, want in zip(np.flatnonzero(of[g]), d2(g, e), strict=True):
            assert out[int(i)]["distance2"] == pytest.approx(want, rel=1e-6)
            assert out[int(i)]["kept"] == (want <= mcd.chi2_quantile(0.99, 4))
    assert not any(r["kept"] for i, r in out.items() if not fit[i])
    assert sum(r["kept"] for r in out.values()) > 0.7 * fit.sum()
