"""The HTML operator against a slow reference, and cases of its own."""

import time
from html.parser import HTMLParser

import duckdb
import pytest

from textloom.llm import html_text

BODY = [f"Paragraph number {k} holds a good many words of running text in it, and then some more of them to make a real page." for k in range(5)]
P, TEXT = "".join(f"<p>{p}</p>" for p in BODY), " ".join(BODY)


class Reference(HTMLParser):
    """Lines of a page by the library's parser; for pages that close what they open, or open a paragraph in an open one."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.text = [], [], ""
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if self.text.split():
            tags = [t for t, _ in self.open]
            never = any(t in html_text._NEVER | {"title", "script", "style"} or (t == "header" and "article" not in tags) for t in tags) or any(c in ("ad", "comments", "cookie-notice") for _, c in self.open)
            self.lines.append((" ".join(self.text.split()), never, "article" in tags))
        self.text = ""

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.open):
            self.text += data

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in html_text._INLINE | html_text._VOID:
            self.cut()
            if tag in ("p", "li") and self.open[-1][0] == tag:
                self.open.pop()
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in html_text._INLINE | html_text._VOID:
            self.cut()
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass


def slow_text(page):
    """By definition: a line stays if a window surges at or before it and none dives from there to it, counted from the first line of weight."""
    lines = Reference(page).lines
    weights = [0 if never or not article else len(text) + html_text.SURGE for text, never, article in lines]
    sums = [sum(weights[k : k + html_text.LINES]) for k in range(len(weights))]
    out = []
    for k, (text, never, article) in enumerate(lines):
        begins = [j for j in range(k + 1) if sums[j] >= html_text.SURGE and all(sums[j : k + 1]) and any(weights[j : k + 1])]
        if begins and not never and article:
            out.append(text)
    return " ".join(out)


def test_against_a_slow_reference():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    got = [html_text.main_text(h) for (h,) in pages]
    assert len(got) > 20 and sum(map(bool, got)) > 20
    assert got == [slow_text(h) for (h,) in pages]


def slow_surges(weights, window, least):
    n, kept = len(weights), set()
    sums = [sum(weights[k : k + window]) for k in range(n)]
    for j in range(n):
        for k in range(j, n):
            if sums[j] >= least and all(sums[j : k + 1]) and any(weights[j : k + 1]):
                kept.add(k)
    return kept


def test_surges_against_their_definition():
    import random

    rng = random.Random(6)
    for _ in range(500):
        weights = [rng.choice((0, 0, 0, 5, 30, 90)) for _ in range(rng.randint(0, 25))]
        got = {k for a, b in html_text.surges(weights, 3, 60) for k in range(a, b)}
        assert got == slow_surges(weights, 3, 60), weights


@pytest.mark.parametrize("page", [
    f'<div class="content has-sidebar">{P}</div>',
    f'<div id="page" class="layout with-sidebar"><nav><a href=/>Home</a></nav><article>{P}</article></div>',
    f'<body><nav><ul><li><a href=x>Home</a></ul></nav><form action=x><div>{P}</div><input></form><footer>x</footer></body>',
    f'<article data-title="the hidden gems">{P}</article>',
    f'<section class="social history">{P}</section>',
    f'<article class="post tags">{P}</article>',
    f'<div class="site-header">Name of the site</div>{P}<div class="comment-list"><p>{TEXT}</p></div><div class="sidebar">{P}</div>',
    f'<main>{P}<div hidden>{TEXT}</div><ul class="related-posts"><li>{TEXT}</ul></main>',
])
def test_pages_that_keep_their_text(page):
    assert html_text.main_text(page) == TEXT


def test_line_blocks_decide(monkeypatch):
    links = "".join(f"<li><a href=/{k}>Another page of this site, number {k}</a></li>" for k in range(4))
    page = f"<article>{P}<ul>{links}</ul>{P}<ul>{links}</ul></article>"
    assert html_text.main_text(page) == f"{TEXT} {TEXT}"  # lists of links are dives, inside a marked element too
    assert html_text.main_text(f"<article><p>A <label>word</label> here <a href=x>there</a></p><p><a href=y>One link</a></p>{P}</article>") == f"A word here there One link {TEXT}"
    monkeypatch.setattr(html_text, "surges", lambda weights: [(0, len(weights))])
    assert html_text.main_text(page) != f"{TEXT} {TEXT}"


def test_empty_and_odd_pages():
    for page in (None, "", " \n", "<p></p>", "<article></article>", "<nav>Menu of things</nav>", '<div class="ad">Buy now, buy much, buy here and today and tomorrow and on.</div>', "<"):
        assert html_text.main_text(page) in ("", "<")
    assert html_text.main_text(f"<article>{P}") == TEXT
    long = "word " * 200_000
    assert html_text.main_text(f"<p>{long}</p>") == long.strip()


@pytest.mark.parametrize("page", ["<article>" * 100_000 + "x", "<div>x</b></i></span>" * 100_000, "<div class=ad><h1>x" * 100_000, "<article class=c>y" * 100_000 + "</div></article>" * 100_000])
def test_time_is_linear_in_depth(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 8
