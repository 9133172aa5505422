import hashlib
import itertools
import random
import re
import zlib

from strandline.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 4:
            role = "user"
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [] if d == 0 else [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def flagged(turns):
    seen, out = set(), []
    for _, role, text in turns:
        end = text.rstrip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """Tries every sequence of edits with at most two insertions in a row."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    own = [["D"] if f in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for f in faults]
    for edits in itertools.product(*own):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(turns) + 1):
                for role in inserts[i]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append((role, ""))
                if i < len(turns):
                    e, (_, role, text) = edits[i], turns[i]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and faults[i] == "truncated")
                    if e != "D":
                        lines.append((role if e == "K" else e, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [r[1:] for r in damage([r for r in rows if r[0] == conv])]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = flagged(turns)
        numbers = {t[0] for t in turns if t[0] is not None}
        cost, audit, lines = cheapest(turns, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as seen", "2 as alive", "3 as copy", "4 as Fault").write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = cr.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = got.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_every_sequence_of_edits(spark, tmp_path):
    rng, rows = random.Random(13), []
    for conv in range(60):
        for turn in range(rng.choice((1, 2, 2, 3))):
            role = rng.choice(["system", "user", "assistant", "tool", None, "", "User"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["One.", "Two!", "Three?\n", "cut", "  ", "", None, "Ünd.\t", "a. b"])
            rows.append((conv, rng.choice([turn, turn * 3, None]) if rng.random() < 0.3 else turn, role, text))
    want = {k: v for k, v in brute(rows).items() if v is not None}
    assert run(spark, tmp_path, rows) == want


def test_nulls_repeats_long_texts_and_empty_tables(spark, tmp_path):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    plain = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in range(3)))
    long = "word " * 200_000 + "end."
    rows = [(None, None, None, None), (None, 0, "user", "x."), (dropped, 0, "user", "gone."), (plain, 0, "system", "s."), (plain, 1, "user", long), (plain, 1, "user", long), (plain, 2, "assistant", "y.")]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[plain][:7] == (0, 0, 1, 0, 1, 3, "KKDK")
    assert run(spark, tmp_path, rows[:0]) == {}


def test_long_conversations(spark):
    """A thousand turns, of which every tenth is missing its answer: one insertion each."""
    rows, want = [], ""
    for i in range(500):
        rows.append((7, 2 * i, "user", f"q{i}?", True))
        if i % 10:
            rows.append((7, 2 * i + 1, "assistant", f"a{i}.", True))
        want += "KK" if i % 10 else "KI"
    r = cr.repair(spark.createDataFrame(rows, SCHEMA + ", alive boolean").repartition(5)).first()
    assert (r["cost"], r["audit"], r["gaps"], r["illegal"], len(r["repaired"])) == (100, want, 50, 50, 1000)
