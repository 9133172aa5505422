import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from strandline.llm import harmonic_packing as hp

TEXTS = [None, "", "plain words", "<|endoftext|> hi", "x<|endoftext|>y <|startoftext|><|endoftext|>, <|EndOfText|>", "it's <|endoftext|> İ ΑΣ é\xa0x 12ab 中文", "word another " * 3000, "a " * 4095, "b " * 4096] + [f"text {i} " * i for i in range(1, 60)]


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(hp.vocabulary_path())
    docs = spark.createDataFrame([Row(doc_id=i, text=t, idx="clash", part=1) for i, t in enumerate(TEXTS)])
    rows = hp.pack(docs).collect()
    whole = {i: np.asarray(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in enumerate(TEXTS)}
    seen, used = {}, {}
    for r in rows:
        data = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(data) // 4
        assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, data in whole.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(data) // 4
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= hp.CAPACITY
    tokens = sum(len(d) // 4 for d in whole.values())
    assert len(used) <= tokens / hp.CAPACITY * 1.03 + 1
    assert sorted(used) == list(range(len(used)))
    assert hp.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classes_fit():
    for n in range(1, 9000, 7):
        cuts = hp.cuts(n, hp.CAPACITY)
        assert sum(c[1] for c in cuts) == n and all(c[1] * c[2] <= hp.CAPACITY for c in cuts)


def test_chunks_match_the_tokenizer_and_words_of_letters_are_not_split():
    rng = random.Random(3)
    letters = [chr(c) for c in range(33, 0x250) if not chr(c).isspace()]
    chunks = [*letters, "It's", "we'LL'", "x²y½", "straße.", "Ünï_9", "\x1c", "a\x1f1", "<|endoftext|>", "a<|startoftext|>b", "中a"]
    chunks += ["".join(rng.choices(letters[:94] if rng.random() < 0.5 else letters, k=rng.randint(2, 7))) for _ in range(20_000)]
    ids = hp.TokenBytes(hp.vocabulary_path())
    texts = [*chunks, None, "", " \n", " ".join(chunks), "\t a\x0bb\x0c\r c "]
    for x, got in zip(texts, ids.of(pa.array(texts)), strict=True):
        assert got.tolist() == ids.tokenizer.encode(x or "", add_special_tokens=False).ids, x
    plain = pa.array(["Words of letters", "ÀÉÎõü straße ªº"])
    want = [x.tolist() for x in ids.of(plain)]
    ids.clear()
    ids.split = None
    assert [x.tolist() for x in ids.of(plain)] == want
    assert list(hp.blocks(pa.array(["aa", None, "é", "long text", "", "b"]), 4)) == [(0, 3), (3, 1), (4, 2)]
