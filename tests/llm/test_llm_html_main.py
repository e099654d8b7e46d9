from __future__ import annotations

import html
import re
import time
from collections import Counter

import numpy as np

from tillroll.llm import html_main as hm


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, text string")


def texts(spark, rows, **kw):
    return {r.page_id: (r.text, r.n_chars) for r in hm.main_text(pages(spark, rows), **kw).collect()}


def test_article_without_its_surroundings(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<header>Site</header><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Caf&eacute; &amp; co</h1><p>One\n <b>two</b>three<br>four&nbsp;x</p><div class=\"ad\">Buy</div>"
        "<script>var t='</p>';</script><form><p>Name</p></form><!-- no --><ul><li>a</li><li>b</li></ul>"
        "<section id='comments'><p>First!</p></section><aside>More</aside></article>"
        "<footer>&copy; Us</footer></body></html>"
    )
    text = "Café & co\n\nOne twothree four\xa0x\n\na\n\nb"
    assert texts(spark, [(1, "http://a.b/", page)]) == {1: (text, len(text))}


def blocks(page):
    return [t for t, _ in hm.page_blocks(page)]


def test_figures_and_named_sections_of_an_article_stay():
    page = (
        "<article><figure><pre>code</pre><figcaption>caption</figcaption></figure>"
        "<h2 id='related-work'>Related work</h2><section id='social-history'><p>history</p></section>"
        "<section id='notice-period'><p>period</p></section><div class='share-prices'><p>prices</p></div>"
        "<h2 class='header'>head</h2><div id='related'><p>anchor</p></div>"
        "<div class='share-buttons x'><p>Share!</p></div></article>"
    )
    assert blocks(page) == ["code", "caption", "Related work", "history", "period", "prices", "head", "anchor"]


def test_names_of_the_body_and_of_wrappers_leave_the_page():
    assert blocks("<body class='right-sidebar'><div>text</div></body>") == ["text"]
    assert blocks("<body class='has-banner'><div class='has-banner'><div role='main'>text</div></div></body>") == ["text"]
    assert blocks("<body id='header'><div class='right-sidebar'>side</div><p>text</p></body>") == ["text"]
    assert blocks("<header>Site<div role='main'>text</div>") == ["text"]


def test_articles_within_dropped_parts_stay_out():
    inner = "<article><p>not this</p></article>"
    parts = ["<section id='comments'>{}</section>", "<aside>{}</aside>", "<nav>{}</nav>", "<footer>{}</footer>", "<div class='related-posts'>{}</div>"]
    for part in parts:
        assert blocks("<main><p>this</p></main>" + part.format(inner)) == ["this"], part
        assert blocks(part.format(inner) + "<article><p>this</p></article>") == ["this"], part
    assert blocks("<form><article><p>this</p></article></form>") == ["this"]


def test_given_pages_give_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = texts(spark, [(r.page_id, r.url, r.html) for r in rows])
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"[ \t-\r]+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id][0] == "\n\n".join(b for b in blocks if b)


def loose_page(unique):
    return f"<body><div>Skip to the content</div><p>{unique}</p><div>Read all our terms before you go on</div></body>"


def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark):
    rows = [(i, "http://a.net/x", loose_page(f"page{i} tells{i} its{i} own{i} story{i}")) for i in range(9)]
    rows += [(100, "http://b.net/", loose_page("another host")), (101, None, None), (102, "http://a.net/", "")]
    alone = "Skip to the content\n\nanother host\n\nRead all our terms before you go on"
    for chunk in (10, 1_000_000):
        got = texts(spark, rows, chunk_tokens=chunk)
        assert got[3][0] == "page3 tells3 its3 own3 story3"
        assert got[100][0] == alone and got[101] == ("", 0) and got[102] == ("", 0)


def test_one_page_twice_is_one_page(spark):
    row = (1, "http://a.net/", "<p>the very same words of one page</p>")
    got = [r.text for r in hm.main_text(pages(spark, [row, row])).collect()]
    assert got == ["the very same words of one page"] * 2


def test_phrases_that_prose_shares_and_copies_of_a_page_stay(spark):
    prose = [f"<p>number {i} jumps where the quick brown fox was and number {i} rests</p>" for i in range(6)]
    rows = [(i, "http://a.net/x", p) for i, p in enumerate(prose)]
    rows += [(10 + i, f"http://b.net/{i}", "<div>the very same page under many urls</div><p>and its second block</p>") for i in range(9)]
    rows += [(30 + i, url, "<p>one of these pages without a host</p><p>words</p>" + str(i)) for i, url in enumerate([None, "x", "/y", None])]
    # a paragraph on two pages of a host is no boilerplate; on three it is
    rows += [(50 + i, "http://c.net/", f"<p>twice said on this host only</p><p>own {i}</p>") for i in range(2)]
    rows += [(60 + i, "http://d.net/", f"<p>thrice said on this host only</p><p>own {i}</p>") for i in range(3)]
    got = {k: t for k, (t, _) in texts(spark, rows).items()}
    assert [got[i] for i in range(6)] == [f"number {i} jumps where the quick brown fox was and number {i} rests" for i in range(6)]
    assert {got[10 + i] for i in range(9)} == {"the very same page under many urls\n\nand its second block"}
    assert got[30] == "one of these pages without a host\n\nwords\n\n0"
    assert got[50] == "twice said on this host only\n\nown 0" and got[61] == "own 1"


def test_a_share_of_the_hosts_pages_is_needed(spark):
    rows = [(i, "http://a.net/", f"<p>page {i} of a host</p>" + ("<p>a word of thanks to all</p>" if i < 4 else "")) for i in range(40)]
    assert texts(spark, rows)[0][0] == "page 0 of a host"
    assert texts(spark, rows, least_share=0.2)[0][0] == "page 0 of a host\n\na word of thanks to all"


def brute_text(rows, least, least_pages):
    """Loose pages by definition: a block goes if windows on enough differing pages cover it."""
    paragraphs = {i: re.findall("<p>(.*?)</p>", page) for i, _, page in rows}
    streams = {tuple(p): [t for b in p for t in ["\n", *b.split()]] + ["\n"] for p in paragraphs.values()}
    on = Counter(w for s in streams.values() for w in {tuple(s[i : i + least]) for i in range(len(s) - least + 1)})
    out = {}
    for i, own in paragraphs.items():
        s, gone, kept, at = streams[tuple(own)], set(), [], 1
        for j in range(len(s) - least + 1):
            if on[tuple(s[j : j + least])] >= least_pages:
                gone.update(range(j, j + least))
        for b in own:
            n = len(b.split())
            if not set(range(at, at + n)) <= gone:
                kept.append(b)
            at += n + 1
        out[i] = "\n\n".join(kept)
    return out


def test_loose_pages_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        blocks = [" ".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(rng.integers(1, 6))]
        rows.append((i, "http://a.net/", "".join(f"<p>{b}</p>" for b in blocks)))
    expected = brute_text(rows, 5, 3)
    for chunk in (40, 1_000_000):
        assert {k: t for k, (t, _) in texts(spark, rows, chunk_tokens=chunk).items()} == expected
    assert 0 < sum(t != "\n\n".join(re.findall("<p>(.*?)</p>", r[2])) for t, r in zip(expected.values(), rows)) < 60


def test_broken_markup_takes_linear_time():
    began = time.perf_counter()
    assert hm.page_blocks("<div>" * 100_000 + "</p>" * 100_000 + "text") == [("text", True)]
    assert hm.page_blocks("<p>" * 100_000 + "</b></i>" * 100_000 + "text" + "</p>" * 200_000)[0][0] == "text"
    assert time.perf_counter() - began < 20


def test_wide_page_ids_beside_a_null(spark):
    rows = [(2**60 + 1, "u", "<p>a</p>"), (2**60 + 2, "u", "<p>b</p>"), (None, "u", "<p>c</p>")]
    assert texts(spark, rows) == {2**60 + 1: ("a", 1), 2**60 + 2: ("b", 1), None: ("c", 1)}


def brute_covered(streams, least):
    covered = {}
    for page, tokens in streams:
        for i in range(len(tokens) - least + 1):
            window = tokens[i : i + least]
            if any(p != page and window == t[j : j + least] for p, t in streams for j in range(len(t) - least + 1)):
                covered.setdefault(page, set()).update(range(i, i + least))
    return covered


def test_prefix_intervals_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        streams = [(p, [str(x) for x in rng.integers(0, 3, rng.integers(0, 25))]) for p in range(6)]
        covered = {}
        found = hm.prefix_intervals(streams, 4)
        on_pages = Counter(prefix for prefix, _, _ in found)
        for prefix, page, places in found:
            if on_pages[prefix] > 1:
                covered.setdefault(page, set()).update(i for at in places for i in range(at, at + 4))
        assert covered == brute_covered(streams, 4)


def test_broken_markup(spark):
    got = texts(spark, [(1, "http://a.b/", "<article><p>open <b>bold<p>next &am</article><p"), (2, "x", "plain &lt;words&gt;"), (3, "x", "</div></p><br/>")])
    assert got[1][0] == "open bold\n\nnext &am" and got[2][0] == "plain <words>" and got[3] == ("", 0)


def test_empty_table(spark):
    assert hm.main_text(pages(spark, [(1, "u", "h")]).limit(0)).count() == 0
