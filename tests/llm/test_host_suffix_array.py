import numpy as np
from pyspark.sql import Row

from strandline.llm import host_suffix_array as hsa

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First  line\n one<br><p>Second &lt;x&gt; line<div class='ad'>buy</div><ul><li>a<li>b</ul><section class=comments><p>nice</section></article>"


def test_structure():
    page = f"<html><head><title>t</title><script>var a='</p><article>'</script></head><body><nav><ul><li>menu</ul></nav><!-- <p>x --><div class=\"ad\">ad</div>{ARTICLE}<footer>foot &copy;"
    assert [t for z, t in hsa.blocks_of(page) if z == 0] == ["Title & more", "First line one", "Second <x> line", "a", "b"]
    assert hsa.blocks_of("") == [] and hsa.blocks_of("a < b &am") == [(1, "a < b &am")]
    assert hsa.blocks_of("<p>cut <scr") == [(1, "cut")]
    assert [t for _, t in hsa.blocks_of("<article><div class=entry-header><h1>Head</h1></div><p>x<math>y</math></article>")] == ["Head", "xy"]


def test_repeats_match_brute_force():
    rng = np.random.default_rng(2)
    pages = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 30))] for _ in range(25)]
    content = np.arange(25) // 2
    got = hsa.repeated_tokens(pages, content, 4, 3)
    where = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - 3):
            where.setdefault(tuple(p[k : k + 4]), set()).add(content[i])
    for p, g in zip(pages, got):
        want = np.zeros(len(p), bool)
        for k in range(len(p) - 3):
            if len(where[tuple(p[k : k + 4])]) >= 3:
                want[k : k + 4] = True
        assert (want == g).all()


def test_pages(spark):
    boiler = "<div>Welcome to this fine host page here</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{boiler}<div>the unique words of page {'x' * i} are these {'y' * i} and so on</div></body>") for i in range(1, 9)]
    rows += [(20, "http://h.example/z", ARTICLE + boiler), (21, None, None), (22, "http://o.example/", ""), (23, None, boiler), (23, None, boiler)]
    df = spark.createDataFrame([Row(page_id=i, url=u, html=h, host="clash", zones=1) for i, u, h in rows])
    out = hsa.extract(df).collect()
    assert len(out) == len(rows)
    text = {r["page_id"]: r["text"] for r in out}
    for i in range(1, 9):
        assert "Welcome" not in text[i] and f"{'x' * i} are" in text[i]
    assert text[20] == "Title & more\nFirst line one\nSecond <x> line\na\nb"
    assert text[21] == "" and text[22] == "" and text[23] == "Welcome to this fine host page here"
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert hsa.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_hosts_and_articles_get_the_same_answer(spark):
    """Boilerplate on four pages goes, whatever the number of other pages; also beside an article, whose text stays."""
    common = "<p>this block stands on four pages of the host</p>"
    teaser = "<article><p>a teaser of few words, on every page of them</p></article>"
    for others in (5, 2500):
        rows = [(i, "http://big.example/a", f"<div>{' '.join(f'w{i}x{k}' for k in range(12))}</div>") for i in range(others)]
        rows += [(10_000 + i, "http://big.example/b", f"{teaser}{common}<div>{'b' * i} body {'z' * i} of the page {'y' * i} is here {'v' * i} in a plain part</div>") for i in range(1, 5)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        for shard_tokens in (hsa.SHARD_TOKENS, 50):
            text = {r["page_id"]: r["text"] for r in hsa.extract(df, shard_tokens=shard_tokens).collect()}
            for i in range(1, 5):
                assert text[10_000 + i] == f"a teaser of few words, on every page of them\n{'b' * i} body {'z' * i} of the page {'y' * i} is here {'v' * i} in a plain part"
            assert all(text[i].split() == [f"w{i}x{k}" for k in range(12)] for i in range(others))


def test_covered_tokens_match_brute_force(spark):
    rng = np.random.default_rng(7)
    pages = [(i, f"http://{'ab'[i % 2]}.example/", " ".join(f"t{x}" for x in rng.integers(0, 4, rng.integers(0, 40)))) for i in range(60)]
    where = {}
    for i, url, text in pages:
        t = text.split()
        for k in range(len(t) - 4):
            where.setdefault((url, *t[k : k + 5]), set()).add(text)
    got = {r["page_id"]: r["n_covered"] for r in hsa.extract(spark.createDataFrame([(i, u, f"<div>{t}</div>") for i, u, t in pages], "page_id long, url string, html string"), shard_tokens=60).collect()}
    for i, url, text in pages:
        t = text.split()
        flags = np.zeros(len(t), bool)
        for k in range(len(t) - 4):
            if len(where[(url, *t[k : k + 5])]) >= 3:
                flags[k : k + 5] = True
        assert got[i] == flags.sum()
