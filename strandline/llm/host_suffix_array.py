"""Main text of web pages: page structure, and suffix arrays over each host's pages for what structure leaves open.

A page is read into blocks. Blocks of a main content element (article, main) are text; those of menus, headers,
footers, asides, forms, notices, adverts and comments (by tag, role or class) are not. All other blocks, whether or not
the page has an article, are decided by their host: runs of at least RUN tokens that stand on PAGES or more pages of
different content are boilerplate. Covered runs are removed and unique runs kept, in page order. The host's token streams are
dealt by content: neighbouring runs that share their least token pair form a passage, and passages of one host and pair
meet in a shard, however many pages the host has. A shard concatenates its distinct passages and sorts their suffixes.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WordHashes, partitions, stored, table
from strandline.llm.fm_substrings import super_windows

RUN, PAGES, SHARD_TOKENS = 5, 3, 500_000
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^<>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "canvas", "xmp", "noembed")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CLASSES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus footer header masthead pagination pager popup modal overlay login toolbar".split())
PARTS = frozenset("comment comments reply replies ad ads advert advertisement sponsored related recommended promo".split())
CLOSES_P = BLOCK - {"br", "option", "select", "caption"}
BARRIER = frozenset("article aside body blockquote dd details dialog div fieldset figure footer form header html li main nav section table td th".split())


def _outside(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is not content by its tag, role or class."""
    if name in OUTSIDE or (name == "header" and not in_main):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes), re.I) or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    marks = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    if in_main:
        marks -= {"header", "masthead"}  # of the article itself
    return bool(marks & (PARTS if name in ("article", "main", "body", "html") else CLASSES))


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order; zones: 0 main content, 1 undecided, 2 outside by structure."""
    out: list[tuple[int, str]] = []
    now: list[list[str]] = [[], [], []]
    stack: list[tuple[str, bool, bool]] = []
    skipped = main = 0

    def flush() -> None:
        for zone, parts in enumerate(now):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((zone, text))
                parts.clear()

    def pop(to: int) -> None:
        nonlocal skipped, main
        while len(stack) > to:
            _, s, m = stack.pop()
            skipped -= s
            main -= m

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            part = page[lo:hi]
            now[2 if skipped else 0 if main else 1].append(entities.unescape(part) if "&" in part else part)

    at = 0
    while (tag := TAG.search(page, at)) is not None:
        text(at, tag.start())
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] if tag[2] else tag[6]
        if name in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "body", "html") and name not in ("article", "main", "body", "html"):
                    break
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        closes = "p" if name in CLOSES_P else name if name in ("option", "dt", "dd", "tr", "td", "th") else None
        for want in {closes, "li" if name == "li" else None} - {None}:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == want:
                    pop(i)
                    break
                if stack[i][0] in BARRIER or stack[i][0] in ("ul", "ol"):
                    break
        is_out = _outside(name, attributes or "", main > 0)
        is_main = not is_out and not skipped and (name in ("article", "main") or re.search(r"""\brole\s*=\s*["']?main\b""", attributes or "", re.I) is not None)
        stack.append((name, is_out, is_main))
        skipped += is_out
        main += is_main
    text(at, len(page))
    flush()
    return out


def repeated_tokens(pages: list[list[str]], content: np.ndarray, run: int, least_pages: int) -> list[np.ndarray]:
    """For each page a flag for each token: covered by a run that stands on pages of ``least_pages`` different contents."""
    known: dict[str, int] = {}
    lengths = np.array([len(p) for p in pages], np.int64)
    count, ends = len(pages), np.cumsum(lengths + 1) - 1
    text = np.empty(int((lengths + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.fromiter((known.setdefault(t, len(known)) for p in pages for t in p), np.int64, int(lengths.sum())) + count
    text[ends] = np.arange(count)  # each end differs: no run crosses pages
    order = suffix_array(text)
    usable = order[order + run <= len(text)]
    same = np.ones(max(len(usable) - 1, 0), bool)
    for k in range(run):
        same &= text[usable[:-1] + k] == text[usable[1:] + k]
    group = np.append(0, np.cumsum(~same)) if len(usable) else np.empty(0, np.int64)
    owner = content[np.searchsorted(ends, usable)]
    pairs = np.unique(np.stack([group, owner], axis=1), axis=0) if len(usable) else np.empty((0, 2), np.int64)
    often = np.bincount(pairs[:, 0], minlength=1) >= least_pages
    starts = usable[often[group]] if len(usable) else usable
    edge = np.zeros(len(text) + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    covered = np.cumsum(edge)[: len(text)] > 0
    return [covered[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by doubling the compared length."""
    rank, n, step = np.unique(text, return_inverse=True)[1].astype(np.int64), len(text), 1
    while True:
        then = np.zeros(n, np.int64)
        then[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 2) + then
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        rank, step = fresh, 2 * step
        if n == 0 or rank[order[-1]] == n - 1 or step > n:
            return order


def _key(data: str) -> int:
    """A signed 64-bit key of a text."""
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks that may be text (zones 0 and 1), a key of them, and the number of tokens that structure leaves open."""
    for batch in batches:
        rows = [[(z, t) for z, t in blocks_of(h) if z < 2] if h else [] for h in batch["html"]]
        batch["zones"] = [[z for z, _ in r] for r in rows]
        batch["blocks"] = [[t for _, t in r] for r in rows]
        batch["content"] = [_key("\n".join(f"{z}{t}" for z, t in r)) for r in rows]
        batch["n_open"] = [sum(t.count(" ") + 1 for z, t in r if z) for r in rows]
        yield batch.drop(columns="html")


def open_tokens(zones, blocks) -> list[str]:
    return [t for z, b in zip(zones, blocks, strict=True) if z for t in b.split(" ")]


def _passages(run: int, least_pages: int):
    """host, anchor, seq, content, first, passage of every passage; a task sends a passage for ``least_pages`` pages, which
    is enough to know that it recurs."""

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sent = WordHashes(), {}
        for batch in batches:
            rows = []
            for host, content, zones, blocks in zip(batch["host"], batch["content"], batch["zones"], batch["blocks"], strict=True):
                tokens = open_tokens(zones, blocks)
                for anchor, first, n in zip(*(x.tolist() for x in super_windows(hashes.of([t.encode("utf-8", "replace") for t in tokens]), run, 2)), strict=True):
                    passage = " ".join(tokens[first : first + n + run - 1])
                    seq = _key(f"{host} {passage}")
                    if len(sent) > 200_000:
                        sent.clear()
                    pages = sent.setdefault(seq, set())
                    fresh = len(pages) < least_pages and content not in pages
                    if fresh:
                        pages.add(content)
                    rows.append((host, anchor, seq, content, first, passage if fresh else None))
            yield pd.DataFrame(rows, columns=["host", "anchor", "seq", "content", "first", "passage"])

    return passages


def _search(run: int, least_pages: int, shard_tokens: int):
    """s_seq, covered: positions of each passage's tokens that lie in recurring runs, where there are any. Rows come sorted
    by host, anchor and seq; whole anchors go to shards."""

    def shard(rows: list[tuple[int, int, str]]) -> pd.DataFrame:
        content = np.unique(np.array([c for _, c, _ in rows], np.int64), return_inverse=True)[1]
        flags = repeated_tokens([p.split(" ") for _, _, p in rows], content, run, least_pages)
        found = {seq: np.flatnonzero(f).tolist() for (seq, _, _), f in zip(rows, flags, strict=True) if f.any()}
        return pd.DataFrame({"s_seq": np.array(list(found), np.int64), "covered": pd.Series(list(found.values()), dtype=object)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, str]] = []
        size, last, seq, pages = 0, None, None, set()
        for batch in batches:
            for host, anchor, now, content, passage in zip(batch["host"], batch["anchor"], batch["seq"], batch["content"], batch["passage"], strict=True):
                if (host, anchor) != last:
                    if size >= shard_tokens:
                        yield shard(held)
                        held, size = [], 0
                    last = host, anchor
                if now != seq:
                    seq, pages = now, set()
                if len(pages) < least_pages and content not in pages:
                    pages.add(content)
                    held.append((now, content, passage))
                    size += passage.count(" ") + 2
        if held:
            yield shard(held)

    return search


def covered_tokens(opened: DataFrame, run: int, least_pages: int, shard_tokens: int) -> DataFrame:
    """c_host, c_content, covered: positions in the open tokens of a page that lie in runs which recur on its host."""
    pages = opened.select("host", "content", "zones", "blocks").dropDuplicates(["host", "content"])
    found = stored(pages.mapInPandas(_passages(run, least_pages), "host string, anchor long, seq long, content long, first int, passage string"), "page passages")
    sent = found.where(F.col("passage").isNotNull()).select("host", "anchor", "seq", "content", "passage")
    dealt = sent.repartition(partitions(opened), "host", "anchor").sortWithinPartitions("host", "anchor", "seq", "content")
    hits = found.select("host", "content", "first", "seq").join(dealt.mapInPandas(_search(run, least_pages, shard_tokens), "s_seq long, covered array<int>"), F.col("seq") == F.col("s_seq"))
    hits = hits.select(F.col("host").alias("c_host"), F.col("content").alias("c_content"), F.transform("covered", lambda x: x + F.col("first")).alias("covered"))
    return hits.groupBy("c_host", "c_content").agg(F.flatten(F.collect_list("covered")).alias("covered"))  # of one page


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, gone = [], []
        for zones, blocks, covered in zip(batch["zones"], batch["blocks"], batch["covered"], strict=True):
            flags = np.zeros(len(open_tokens(zones, blocks)), bool)
            if covered is not None:
                flags[np.asarray(covered, np.int64)] = True
            copied = 0 not in zones and flags.sum() >= 0.9 * len(flags)  # the page as a whole recurs: a copy, not boilerplate around a text
            at, kept = 0, []
            for zone, text in zip(zones, blocks, strict=True):
                if zone:
                    tokens = text.split(" ")
                    mine = flags[at : at + len(tokens)].tolist()
                    at += len(tokens)
                    text = text if copied else " ".join(t for t, f in zip(tokens, mine, strict=True) if not f)
                if text:
                    kept.append(text)
            texts.append("\n".join(kept))
            gone.append(int(flags.sum()))
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_covered": gone})


def extract(pages: DataFrame, run: int = RUN, least_pages: int = PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text (main text, blocks joined by line feeds), n_chars, n_covered (tokens outside main content
    that the suffix arrays found repeated), one row for each page.

    A null or empty html gives an empty text; null urls are a host of their own. Repeated rows are returned as often,
    but count as one page for repeats. Unclosed tags, comments and cut pages are read as far as they go. An empty
    table gives no rows; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    read = pages.select("page_id", "url", host.alias("host"), "html").mapInPandas(_read, "page_id long, url string, host string, zones array<int>, blocks array<string>, content long, n_open long")
    read = stored(read, "pages")
    opened = read.where("n_open > 0")
    covered = covered_tokens(opened, run, least_pages, shard_tokens)
    opened = opened.join(covered, (F.col("host") == F.col("c_host")) & (F.col("content") == F.col("c_content")), "left").select("page_id", "url", "zones", "blocks", "covered")
    settled = read.where("n_open = 0").select("page_id", "url", "zones", "blocks", F.lit(None).cast("array<int>").alias("covered"))
    return settled.unionByName(opened).mapInPandas(_decide, "page_id long, url string, text string, n_chars long, n_covered long")


def op4_host_suffix_array(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
