import hashlib
import re

from pyspark.sql import Row

from strandline.llm import pii_supervision as pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    check = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": luhn,
        "phone": lambda v: 8 <= sum(c.isdigit() for c in v) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.A) if check[k](m[0])]


TEXTS = [
    None, "", "plain words only", "é😀 mail a.b+c@mail-1.example.com. next@x.y,z@", "10.0.0.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 0000012.1.1.255",
    "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796", "+1 (988) 555-2485, +49 30 1234567 and +1", "4041894974608795 42.144.35.254 +1 (456) 555-2186",
    "password=b7db7aa4a5fcc78305 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "1" * 20000, "a@" * 500 + "b.c", ("x1@y.zz " * 300), "9 9-9 " * 2000,
    "a@b.com_z@w.org.x@y.net", "....a@b.c-@.d@e.f", "." * 40000 + "@" + "." * 40000, "1.1.1." * 300 + "2", "m@n.io," * 3000,
]


def test_base_spans_match_brute_force(spark):
    more = [f"word number {i} login password=ab{i:06d}cdef0123 tel +1 (4{i:02d}) 555-21{i:02d} done 42.144.35.{i} x{i}@mail.example.com" for i in range(60)]
    texts = TEXTS + more
    df = spark.createDataFrame([Row(doc_id=i, text=t, base="clash", v=1) for i, t in enumerate(texts)])
    out = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert [f"{s['kind']}:{s['s']}:{s['e']}" for s in out[i]["base"]] == brute(t), t and t[:80]
        for s in out[i]["added"]:
            assert not any(b["s"] < s["e"] and s["s"] < b["e"] for b in out[i]["base"])
    caught = sum(any(s["kind"] == "secret" and texts[i][s["s"] : s["e"]].endswith("cdef0123") for s in out[i]["added"]) for i in range(len(TEXTS), len(texts)))
    assert caught >= 55
    assert not out[2]["added"]


def test_no_rows(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_kinds_without_a_fixed_pattern_are_found(spark):
    """Recall of each kind, and harmless text that is left alone; no labels are given."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    first, last = ["Anna", "Jürgen", "Marie", "Tom", "Élise", "José"], ["Miller", "Schäfer", "Dupont", "García", "Stone"]

    def check(country, body):
        moved = body + country + "00"
        rest = int("".join(str(int(c, 36)) for c in moved)) % 97
        return f"{country}{98 - rest:02d}{body}"

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    make = {
        "name": lambda: f"{rng.choice(['Mr.', 'Mrs.', 'Dr.', 'Frau', 'Herr', 'Mme'])} {rng.choice(first)} {rng.choice(last)}",
        "address": lambda: rng.choice([f"{rng.randint(1, 999)} {rng.choice(last)} Street", f"{rng.choice(last)}straße {rng.randint(1, 99)}", f"calle de {rng.choice(last)} {rng.randint(1, 99)}"]),
        "iban": lambda: check("DE", digits(18)),
        "identity": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"',
    }
    harmless = [lambda: f"page {rng.randint(1, 999)}", lambda: f"2019-2021 {rng.randint(1, 99)}", lambda: f"version {digits(1)}.{digits(1)}", lambda: f"total 12 345 678", lambda: "Street Road of Dr"]
    docs, want = [], {}
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(30)]
        kind = [*make, None, "base"][i % 7]
        planted = rng.choice(harmless)() if kind is None else f"x{i}@mail.example.com" if kind == "base" else make[kind]()
        at = rng.randrange(30)
        text = " ".join([*words[:at], planted, *words[at:]])
        docs.append((i, text))
        want[i] = (kind, planted)
    out = {r["doc_id"]: r["added"] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {k: [0, 0] for k in make}
    for i, (kind, planted) in want.items():
        if kind in make:
            found[kind][1] += 1
            found[kind][0] += any(s["kind"] == kind and docs[i][1][s["s"] : s["e"]] in planted for s in out[i])
        else:
            assert not out[i], (planted, out[i])
    assert all(a >= 0.9 * n for a, n in found.values()), found


def test_em_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    v = np.array([np.where(y, rng.choice(3, 4000, p=p), rng.choice(3, 4000, p=q)) for p, q in [((0.1, 0.2, 0.7), (0.6, 0.3, 0.1)), ((0, 0.5, 0.5), (0.2, 0.7, 0.1))] * 3]).T
    keys, n = np.unique(v, axis=0, return_counts=True)
    rows = spark.createDataFrame([([([int(x) for x in k], float(c)) for k, c in zip(keys, n)],)], "p array<struct<v:array<int>,n:double>>")
    got = np.array([x["r"] for x in rows.select(pii.reliabilities(rows["p"]).alias("x")).first()["x"]])
    pi, t = 0.5, np.array([[0.3, 0.65, 0.05], [0.05, 0.65, 0.3]])[None].repeat(6, 0)
    for step in range(pii.ROUNDS + 1):
        like = np.array([[np.log(t[j, c, k[j]]) for j in range(6)] for c in (0, 1) for k in keys]).sum(1).reshape(2, -1)
        r = 1 / (1 + np.exp(-(np.log(pi / (1 - pi)) + like[1] - like[0])))
        if step == pii.ROUNDS:
            break
        w = np.array([n * (1 - r), n * r])
        t = np.array([[[(w[c][keys[:, j] == x].sum() + 0.5) / (w[c].sum() + 1.5) for x in range(3)] for c in (0, 1)] for j in range(6)])
        pi = (w[1].sum() + 1) / (w.sum() + 2)
    assert np.allclose(got, r, atol=1e-9)
