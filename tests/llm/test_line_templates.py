import random

import pandas as pd
from pyspark.sql import Row

from strandline.llm import line_templates as lt
from strandline.operators import iterate


def test_templates_of_a_leaf():
    lines = [f"order {w} shipped to {c} today ok".encode().split() for w, c in zip("abcdef", "uvwxyz")] + [b"all other words are here now yes".split()]
    got = lt.templates_of(lines, 0.6)
    assert len(set(got[:6])) == 1 and got[6] != got[0]


def test_recurring_templates_go_and_copies_stay(spark):
    docs, rng = [], random.Random(4)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    for i in range(12):
        a, b = (" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 9))) for _ in range(2))
        docs.append((i, f"{a}\nPrinted on 2024-01-{i:02d} by user u{i}\n{b}\nshort"))
    copy = "this passage of a document is copied\nwith all its lines in several copies\nand nothing else differs at all here"
    docs += [(100 + i, copy if i % 2 else copy + f"\nend number {chr(97 + i)} of it all") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "\n\n")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", n_lines=7, leaf="clash", g_doc=77, g_text="x", g_row=1, g_forms=2) for i, t in docs])
    out = {r["doc_id"]: r for r in lt.drop_templates(df).collect()}
    assert len(out) == len(docs) and {(r["g_doc"], r["g_text"], r["g_row"], r["g_forms"]) for r in out.values()} == {(77, "x", 1, 2)}
    text = dict(docs)
    for i in range(12):
        lines = text[i].split("\n")
        assert out[i]["text"] == (text[i] if i == 0 else "\n".join(lines[:1] + lines[2:3])), out[i]["text"]
        assert out[i]["n_dropped"] == (0 if i == 0 else 2) and out[i]["n_lines"] == 4
    for i in list(range(100, 130)) + [200, 201, 202]:
        assert out[i]["text"] == text[i]
    assert lt.drop_templates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_of_shared_blocks_go_and_near_copies_add_nothing(spark):
    rng = random.Random(8)
    vocabulary = [a + b + c + d for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in "aeiou"]

    def lines(n):
        return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 12))) for _ in range(n)]

    def edited(line):
        words = line.split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    blocks = {n: lines(n) for n in (6, 10, 20)}
    docs, at = [], 0
    for n, own in ((6, 3), (10, 3), (20, 10)):
        for _ in range(60):
            docs.append((at, lines(own) + blocks[n]))
            at += 1
    hot, passage = lines(1)[0], lines(8)
    for _ in range(20):
        docs.append((at, lines(4) + [hot]))
        at += 1
    first_copy = at
    for i in range(300):  # near copies: one line in eight has another word
        k = i % 8
        docs.append((at, [edited(x) if j == k else x for j, x in enumerate(passage)] + [hot]))
        at += 1
    out = {r["doc_id"]: r for r in lt.drop_templates(spark.createDataFrame([Row(doc_id=i, text="\n".join(x)) for i, x in docs])).collect()}
    for g, (n, own) in enumerate(((6, 3), (10, 3), (20, 10))):
        assert [out[i]["n_dropped"] for i in range(60 * g, 60 * g + 60)] == [0] + [n] * 59
        assert all(out[i]["text"] == "\n".join(docs[i][1][:own]) for i in range(60 * g + 1, 60 * g + 60))
    assert [out[i]["n_dropped"] for i in range(180, 200)] == [0] + [1] * 19
    for i in range(first_copy, at):  # the near copies lose the line that recurs elsewhere and nothing else
        assert out[i]["text"] == "\n".join(docs[i][1][:-1])


def brute(docs):
    """Kept texts where all documents are unrelated: templates are sets of lines that agree in most positions."""
    where = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            tokens = tuple("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
            if any(t != "<*>" for t in tokens):
                where.setdefault(tokens, set()).add(i)
    lines = sorted(where)
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def lead(x):
        return len(x), tuple(t for t in x if t != "<*>")[:3]

    for a in lines:
        for b in lines:
            if a < b and lead(a) == lead(b) and sum(x == y != "<*>" for x, y in zip(a, b)) + 0.5 * sum(x == y == "<*>" for x, y in zip(a, b)) >= 0.6 * len(a):
                parent[root(a)] = root(b)
    seen = {}
    for x in lines:
        seen.setdefault(root(x), set()).update(where[x])
    out = {}
    for i, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            tokens = tuple("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
            found = seen[root(tokens)] if tokens in parent else set()
            if len(found) < 4 or min(found) == i:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_unrelated_documents_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [a + b + c + d for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in "aeiou"]
    names = [x + "son" for x in vocabulary]
    docs = []
    for i in range(80):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 14))) for _ in range(rng.randint(4, 7))]
        if i % 2:
            lines.append(f"welcome back dear {rng.choice(names)} you have {rng.randint(1, 99)} new messages in the box")
        if i % 3 == 0:
            lines.append(f"12 {i} 2024-05-{i % 28} total of {rng.randint(1, 9)} items")
        if i % 25 == 0:
            lines.append("only in four documents")
        if i % 30 == 0:
            lines.append("only in three documents")
        lines += [["Read more"], ["***", "1 2 3"], [f"{i} {i + 1}"], ["", " \t"]][i % 4]
        if i == 7:
            lines.append("verylong " * 30_000 + "line")
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs.append((90, None))
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for lines in (lt.LEAF_LINES, 5):  # the second parts the leaf of the greeting
        monkeypatch.setattr(lt, "LEAF_LINES", lines)
        got = {r["doc_id"]: r["text"] for r in lt.drop_templates(df).collect()}
        assert got == want, [(i, got[i], want[i]) for i in want if got[i] != want[i]][:2]
    assert any("only in three" in t for t in want.values() if t) and sum("only in four" in t for t in want.values() if t) == 1


def test_long_documents_are_compared_by_all_lines(spark):
    rng = random.Random(21)
    vocabulary = [a + b + c + d for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in "aeiou"]

    def lines(n):
        return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 12))) for _ in range(n)]

    docs, want = [], []
    for group in range(12):  # a little more or less than the share of own text that makes documents unrelated
        own = 54 if group % 2 else 36
        block = lines(300 - own)
        for k in range(4):
            docs.append((len(docs), "\n".join(lines(own) + block)))
            want.append(300 - own if group % 2 and k else 0)
    out = {r["doc_id"]: r["n_dropped"] for r in lt.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(docs))] == want


def test_tasks_hand_lines_on_before_a_batch_ends():
    class Docs:  # gives the function that its tasks would run
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    texts = ["\n".join(f"w{chr(97 + i % 26)} {''.join(chr(97 + int(d)) for d in str(i * 50 + j))}" for j in range(50)) for i in range(2_000)]
    batch = pd.DataFrame({"doc_id": range(2_000), "text_key": range(2_000), "text": texts})
    for make, columns in ((lt.parsed_lines, ["doc_id", "text_key", "leaf", "form"]), (lt.masked_lines, ["leaf", "form", "line"])):
        frames = list(make(Docs(), 3, 1)(iter([batch])))
        assert max(map(len, frames)) < 25_000
        whole = pd.concat(frames)
        assert list(whole.columns) == columns and len(whole) == 100_000 == whole["form"].nunique()
    assert set(whole["line"]) == {x.encode() for t in texts for x in t.split("\n")}


def python_functions(node):
    """Of a plan: Python functions in a task of its last stage, and the most in a task of any stage."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return python_functions(node.executedPlan())
    below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    found = [python_functions(x) for x in below]
    here = 0 if kind.endswith(("QueryStageExec", "ExchangeExec")) else sum(n for n, _ in found) + kind.startswith("MapIn")
    return here, max([here, *(most for _, most in found)])


def test_no_task_runs_two_python_functions(spark, monkeypatch):
    """Each would take a worker of its own, which the executor keeps. Small tables, of which the planner knows the size,
    may be broadcast."""
    plans = []

    def checkpointed(df):
        plans.append(df)
        return iterate.checkpointed(df)

    monkeypatch.setattr(lt, "checkpointed", checkpointed)
    docs = [(i, " ".join(chr(97 + i) + w for w in "own words of one text alone".split()) + "\nthis line stands everywhere") for i in range(20)]
    out = lt.drop_templates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(r["n_dropped"] for r in out.collect()) == 19
    most = [python_functions(df._jdf.queryExecution().executedPlan())[1] for df in [*plans, out]]
    assert len(most) > 5 and max(most) == 1, most


def test_cut_texts_in_pieces(spark, monkeypatch):
    docs = [(i, " ".join(chr(97 + i % 26) + w + chr(97 + i // 26) for w in "own words of one text alone".split()) + "\nthis line stands everywhere") for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for texts in (lt.HELD_TEXTS, 7):
        monkeypatch.setattr(lt, "HELD_TEXTS", texts)
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lt.drop_templates(df).collect()}
        assert got == {i: (t if not t or i == 0 else t.split("\n")[0], 2 if t else 0, int(bool(t) and i > 0)) for i, t in docs}
