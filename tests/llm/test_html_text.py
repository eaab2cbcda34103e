"""Main text of pages: the reader of markup, and repeats against brute force on random hosts."""

import random
import time

import pytest

from densityflow.llm import html_text
from densityflow.llm.html_text import INSIDE, LONG, MARKED, PLAIN, RUN, blocks

PAGES = "page_id long, url string, html string, text string, host string, n_chars int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], PAGES)


def texts(spark, rows, **more):
    return {r.page_id: r.text for r in html_text.main_texts(pages(spark, rows), **more).collect()}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p class="ad">Buy now<p>Real text here<p>More</article>', [("Buy now", MARKED), ("Real text here", INSIDE), ("More", INSIDE)]),
        ('<article><div class="header">H</div><p class="notice">N</p><div class="related-work">R</div></article>', [("H", INSIDE), ("N", INSIDE), ("R", INSIDE)]),
        ("<article>a<article>a comment</article>b</article>", [("a", INSIDE), ("a comment", MARKED), ("b", INSIDE)]),
        ('<p>a <a href="x>broken <b>c</b> d', [("a broken c d", PLAIN)]),
        ("<p>a <a href='it's' x=\"1>2\">b</a>", [("a b", PLAIN)]),
        ("a < b &lt; c &amp;amp; d<!-- x <p> --><!-->e", [("a < b < c &amp; d" + "e", PLAIN)]),
        ("<ul><li>a<li class=ad>b<li>c</ul><main>m<p>k</main>", [("a", PLAIN), ("b", MARKED), ("c", PLAIN), ("m", INSIDE), ("k", INSIDE)]),
        ("<main>teaser<article>text</article></main>", [("teaser", PLAIN), ("text", INSIDE)]),
        ("<article><table><tr><td>a<td class=ad>b<tr><td>c</table><script>var a='</p>'</script>2<style>x", [("a", INSIDE), ("b", MARKED), ("c", INSIDE), ("2", INSIDE)]),
        ("<p>x<span class=ad>ad<span>y</span>z</span>w", [("x", PLAIN), ("adyz", MARKED), ("w", PLAIN)]),
        ("<article><p class=comments>c<br>d<p>e<form>f</article>g", [("c", MARKED), ("d", MARKED), ("e", INSIDE), ("f", MARKED), ("g", PLAIN)]),
        ("<div class=ad>left open<article>text</article>", [("left open", MARKED), ("text", INSIDE)]),
        ("<aside>menu<article>teaser</article></aside>", [("menu", MARKED), ("teaser", MARKED)]),
        ("<noscript>n</noscript><title>t</title><textarea><p>x</textarea><svg><text>s</svg>k</nothing>", [("n", MARKED), ("s", MARKED), ("k", PLAIN)]),
        ("", []),
        ("<", [("<", PLAIN)]),
        ("<a", []),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


@pytest.mark.parametrize("piece", ['<a "', '<a b="', "<div>", "<ul><li>", "<!-", "<!--", "<b>", "<script>", "&amp", "</p>", "<a x ", "word ", "<li></ul>", "<td>"])
def test_reading_takes_linear_time(piece):
    began = time.process_time()
    blocks(piece * (1_000_000 // len(piece)) + "'\">")
    assert time.process_time() - began < 5  # hours, if it were quadratic


def brute(rows, min_pages):
    """Page texts where no markup but paragraphs is used: what substrings of RUN tokens or more that
    stand on min_pages pages of a host cover goes."""
    streams = {i: h.replace("<p>", " ").split() for i, _, h in rows}
    host = {i: html_text.host_of(u) for i, u, _ in rows}
    out = {}
    for i, s in streams.items():
        gone = [False] * len(s)
        others = [" " + " ".join(streams[j]) + " " for j in streams if host[j] == host[i] and j != i]
        for a in range(len(s)):
            b = a + RUN
            while b <= len(s) and sum(f" {' '.join(s[a:b])} " in o for o in others) >= min_pages - 1:
                gone[a:b] = [True] * (b - a)
                b += 1
        out[i] = " ".join(t for t, g in zip(s, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_long_repeats_go_and_unique_runs_stay(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(f"b{seed}{k}w{r.randrange(50)}" for _ in range(r.randrange(LONG, 40))) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.5 else " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 7))]
        rows.append((i, f"https://H{i % 4}.example/x{i}", "<p>".join(parts)))
    got, want = texts(spark, rows), brute(rows, html_text.MIN_PAGES)
    assert got == want
    assert sum(len(w.split()) for w in want.values()) < sum(len(h.split()) for _, _, h in rows)
    assert texts(spark, rows, min_pages=10**9) == {i: h.replace("<p>", " ") for i, _, h in rows}


def test_site_wide_lines_go_but_copies_and_quotes_stay(spark):
    r = random.Random(5)
    line = "please sign up for our letter and you will get all news of the week by mail"
    quote = " ".join(f"q{k}" for k in range(20))

    def article(i):
        return " ".join(f"a{i}x{r.randrange(10**6)}" for _ in range(40))

    copy = article(99)
    rows = [(i, "http://one.example/", f"<nav>n</nav><article><h1>T{i}</h1><p>{article(i)}</p><p>{line}</p>" + (f"<p>{quote}</p>" if i < 3 else "") + "</article>") for i in range(8)]
    rows += [(20 + i, "http://two.example/", f"<article><p>{copy}</p></article>") for i in range(6)]
    got = texts(spark, rows)
    for i, _, h in rows[:8]:
        assert line not in got[i]
        assert f"T{i}" in got[i]
        assert (quote in got[i]) == (i < 3)
    assert all(got[20 + i] == copy for i in range(6))
    assert all(line in t for i, t in texts(spark, rows, min_pages=10**9).items() if i < 8)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://[bad", "<p>x"), (None, "http://h/", "<article>n</article>"), (4, "http://h/", "<p>same <p>page"), (4, "http://h/", "<p>same <p>page"), (5, "http://h/", "<p>" + "long text " * 500_000), (6, "http://h/", "<footer>f")]
    out = html_text.main_texts(pages(spark, rows)).collect()
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("", 0, None)
    assert got[2] == ("", 0, "")
    assert got[3][0] == "x"
    assert got[None][0] == "n"
    assert got[4] == ("same page", 9, "http://h/")
    assert got[5][1] == 10 * 500_000 - 1
    assert got[6][0] == ""
    assert html_text.main_texts(pages(spark, rows).where("page_id = 99")).collect() == []


def test_repeated_rows_count_as_one_page(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "http://h/", f"<p>{text}")] * 4
    assert texts(spark, rows) == {1: text}
    rows += [(k, "http://h/", f"<p>{text} u{k}") for k in (2, 3)]
    assert texts(spark, rows) == {1: "", 2: "u2", 3: "u3"}
