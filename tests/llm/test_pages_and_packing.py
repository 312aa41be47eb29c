"""Packing, URL filters, page extraction."""

import html
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pricelens.llm import packing, pages, urls
from pricelens.llm.common import tokenizer_path
from pricelens.llm.queries import URL_RULES

from .conftest import HARD, prose

WORDS = "word_bpe_49k.json"


def check_packing(rows, texts, limit=4096):
    """Pieces hold the document's ids, and sequences are gapless and within the limit."""
    tokenizer = Tokenizer.from_file(tokenizer_path(WORDS))
    expected = []
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), limit)):
            part = ids[start:start + limit]
            expected.append((key, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(held)


def test_packing_documents(spark, hard, none, small):
    path = tokenizer_path(WORDS)
    check_packing(packing.pack_documents(hard, path).collect(), [(i, t) for i, t, _ in HARD])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs, path).collect()
    bins = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=4097), 4096)
    assert bound <= bins <= bound + 1
    assert packing.pack_documents(none, path).collect() == []


def items_of(spark, sizes):
    rows = [(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@pytest.mark.parametrize("sizes", [
    np.random.default_rng(1).integers(1, 60, 3000), np.random.default_rng(2).integers(20, 100, 2000), np.full(500, 51), np.full(700, 100),
    np.array([7]), np.r_[np.full(400, 34), np.full(800, 33)],
])
def test_exchange_between_partitions(spark, sizes):
    """With partitions of 100 pieces, exchange comes close to one packing of all."""
    rows = packing.pack(items_of(spark, sizes), 100, partition_pieces=100).collect()
    assert sorted(r.length for r in rows) == sorted(sizes.tolist())
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        assert sum(n for _, n in parts) <= 100
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)][:-1]).tolist()
    whole = packing.best_fit(np.asarray(sizes), 100)[0].max() + 1
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert bound <= len(fill) <= whole * 1.02 + 2


def test_lower_bound_is_one():
    """Never over the least number of bins, which small cases let us search."""
    r = random.Random(3)

    def least(sizes, bins):
        if not sizes:
            return True
        seen = set()
        for i, b in enumerate(bins):
            if b >= sizes[0] and b not in seen:
                seen.add(b)
                if least(sizes[1:], [*bins[:i], b - sizes[0], *bins[i + 1:]]):
                    return True
        return False

    for _ in range(150):
        capacity = r.randint(5, 24)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 8))), reverse=True)
        optimum = next(n for n in range(1, 9) if least(sizes, [capacity] * n))
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= optimum
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


def test_token_bytes_equal_the_tokenizer():
    path, r = tokenizer_path(WORDS), random.Random(8)
    tokenizer = Tokenizer.from_file(path)
    letters = "ab'sT É Σς\x1c\x85　\xa0 é\n <|endoftext|> 1९½漢!?- 'll're"
    for _ in range(3000):
        t = "".join(r.choice(letters) if r.random() < 0.9 else "<|endoftext|>" for _ in range(r.randint(0, 14)))
        assert np.frombuffer(packing.token_bytes(path, [t], 1)[0], "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_token_cache_ages(monkeypatch):
    path = tokenizer_path(WORDS)
    halves = packing.Halves(5), packing.Halves(5)
    monkeypatch.setattr(packing, "_caches", lambda p: halves)
    tokenizer = Tokenizer.from_file(path)
    for i in range(30):
        text = prose(i, "fr")
        assert np.frombuffer(packing.token_bytes(path, [text], 1)[0], "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/de/", "https://example.net", "https://anexample.net/en/",
    "http://x.org/fr/1", "http://x.org/FR/1", "http://example.com/de/#x", "http://www.example.com/de", "http://net/", "ftp://u@b.net:80/", "//a.net/", "a://b://c.net/",
    "http://x.net?q=/", "http://É.net/é", "http://" + "a." * 3000 + "net/" + "p" * 5000,
]


def url_truth(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.encode().lower().decode()
    fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("most", [urls.BROADCAST_BYTES, 0])
def test_urls(spark, most):
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[4:6])], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(frame, rules, broadcast_bytes=most).collect()}
    assert got == {i: url_truth(u) for i, u in enumerate(URLS + URLS[4:6])}
    assert urls.judge(frame.where("false"), rules, broadcast_bytes=most).collect() == []
    bare = urls.judge(frame, rules.where("false"), broadcast_bytes=most).collect()
    assert len(bare) == len(got) and {(r.rule, r.verdict) for r in bare} == {(None, "allow")}


def test_url_key_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(urls, "key_of", lambda host, path: len(path) % 2)
    found = urls.DigestArray(URL_RULES).longest([("a.example.net", "/en/1"), ("b.org", "/de/")])
    assert found == [("example.net", "/en/", "allow"), None]


def test_contradicting_rules_block(spark):
    found = urls.DigestArray([("a", "/", "allow"), ("a", "/", "block"), ("a", "/", "allow")]).longest([("a", "/")])
    assert found == [("a", "/", "block")]


PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body class="post"><nav><a href=x>Home</a></nav><header><h1>Site</h1></header>'
    '<article><header><h1>Head&amp;line</h1></header><p>First  sentence\n here.<div class="ad">Buy!</div><p>Second &lt;one&gt;, it <b>goes<br>on</b>.'
    '<ul><li>item<li>item</ul><script>var x = "</p>";</script><section class="reader-comments"><p>I comment, too.</p></section></article>'
    '<aside>More</aside><footer>&copy; x</footer>'
)


def test_page():
    weights = pages.train([PAGE])
    assert pages.main_text(PAGE, weights) == "Head&line\nFirst sentence here.\nSecond <one>, it goes on.\nitem\nitem"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- x", "<script>", "&", "</p></div>", "<b><i></b>", "<a href='\"x>y", "<p title=\"" * 50, "<div>" * 3000, "<![CDATA[x]]>", "\x00<p>"])
def test_broken_pages(page):
    assert isinstance(pages.main_text(page, pages.train([])), str)


def test_pages_of_the_tables(spark, small):
    """Held against the article elements of the given pages."""
    frame = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in pages.extract(frame).collect()}
    for r in frame.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


STORY = "".join(f"<p>The {w} of the town met on Monday, and it was decided that the bridge would be built. Many people came to hear it.</p>" for w in ("mayor", "council", "people"))
READ = "\n".join(["Story", *(f"The {w} of the town met on Monday, and it was decided that the bridge would be built. Many people came to hear it." for w in ("mayor", "council", "people"))])
AROUND = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>{}<footer><p>Copyright 2024 The Paper. All rights reserved.</p></footer></body></html>"


@pytest.mark.parametrize("body", [
    f'<article class="post category-legal tag-privacy"><h1>Story</h1>{STORY}</article>',
    f'<article class="post comments-open"><h1>Story</h1>{STORY}</article>',
    f'<div class="layout with-sidebar"><h1>Story</h1>{STORY}</div>',
    f'<div class="search-page"><h1>Story</h1>{STORY}</div>',
    f'<main class="related-topic"><h1>Story</h1>{STORY}</main>',
    f'<article><h1><a href="s">Story</a></h1>{STORY}<ul><li><a href="x">Other story one</a></li><li><a href="y">Another story here</a></li></ul><p><a href="b">Buy now</a></p></article>',
    f'<article><h1>Story</h1>{STORY}<div class="related-posts"><p>You may also like this. It is a good one.</p></div></article>',
    f'<article><h1>Story</h1>{STORY}</article><div id="comments"><div class="comment"><p>I think that this is great news for all of us. Well done.</p></div><div class="comment-list"><p>Nonsense, it is a waste of money.</p></div></div>',
    f'<div class="cookie-notice"><p>We use cookies to improve your experience. By using this site you agree to it.</p><button>Accept</button></div><div id="main-content"><h1>Story</h1>{STORY}</div><div class="left-sidebar"><p>Sign up to our newsletter and get the news each week.</p></div>',
])
def test_stories_under_misleading_names(spark, small, body):
    """With the weights that the given pages teach, and without a sample."""
    taught = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").limit(60).collect()]
    for weights in (pages.train(taught), pages.train([])):
        assert pages.main_text(AROUND.format(body), weights) == READ


@pytest.mark.parametrize("token, says", [
    ("site-footer", -1), ("with-sidebar", 0), ("category-legal", 0), ("comments-open", 0), ("search-page", 0), ("related-post", -1), ("reader-comments", -1),
    ("entry-header", 0), ("page-header", -1), ("mainContent", 1), ("entry-content", 1), ("sidebar-content", -1), ("ad-slot-2", -1), ("ad", -1), ("reading", 0),
    ("post", 1), ("wp-block-search", -1), ("content-with-sidebar", 0), ("12", 0), ("", 0),
])
def test_what_class_tokens_say(token, says):
    assert pages._says(token) == says


def test_labels_are_the_minimum_and_neighbours_count():
    """Random pages against all labellings; in some, neighbours outvote what a block is worth by itself."""
    r = random.Random(8)
    weights, outvoted, flows = pages.train([]), 0, [0]
    real = pages._source_side

    def counted(*args):
        flows[0] += 1
        return real(*args)

    pages._source_side = counted
    try:
        for _ in range(150):
            parts = [r.choice(['<p>{}</p>', '<div>{}</div>', '<div class="widget">{}</div>', '<li>{}</li>', '<div class="text"><p>{}</p></div>', '<h2>{}</h2>']).format(
                r.choice(["Yes", "No more of it", "Read this", prose(r.randint(0, 99), sentences=1), prose(r.randint(0, 99), sentences=3), '<a href="x">one more link</a>'])) for _ in range(r.randint(2, 9))]
            found = pages.blocks("<body><div>" + "".join(parts) + "</div></body>")
            cost, edges, side = pages.costs(found, weights), list(pages._edges(found)), pages.label(found, weights)

            def price(side):
                return sum(abs(c) for c, s in zip(cost, side) if (c > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

            best = min(price([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found)))
            assert abs(price(side) - best) < 1e-6
            outvoted += sum((c > 0) != s for c, s in zip(cost, side))
    finally:
        pages._source_side = real
    assert outvoted > 20 and flows[0] > 5


def test_page_edges(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (None, "u", PAGE, "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = pages.extract(frame).collect()
    assert len(got) == 5 and [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0]
    assert [r.text.count("\n") for r in got if r.page_id == 3] == [19_999] * 2
    assert pages.extract(frame.where("false")).collect() == []


def test_cut_is_minimal():
    """Against all labellings of small graphs."""
    r = random.Random(5)
    for _ in range(120):
        n = r.randint(1, 8)
        cost = [r.uniform(-1, 1) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def price(side):
            return sum(abs(c) for c, s in zip(cost, side) if (c > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(price(pages.cut(cost, edges)) - best) < 1e-6


def test_smoothing_carries_a_short_block():
    """A short block without a name of its own goes with those around it."""
    page = "<div>" + "".join(f"<p>{prose(i, sentences=3)}</p>" for i in range(2)) + "<div>Yes</div>" + f"<p>{prose(9, sentences=3)}</p></div>"
    assert "Yes" in pages.main_text(page, pages.train([])).split("\n")
