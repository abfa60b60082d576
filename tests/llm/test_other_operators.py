import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import html_text, langid, neighbours, warc
from textloom.llm.common import scratch


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</article><p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice">We use cookies, a great many of them, for you.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> te<i>x</i>t that is long enough to count &eacute;.<p>Second<br>line.
<div class="ad">Buy now, buy much, buy here and today and tomorrow.</div><!-- x --><form><input><label>Name</label></form><p>End.</p></article>
<section class="comments"><article class="comment">A reader says something of length, which isn't the article, at all.</article></section>
<aside>Related things of interest for all readers</aside><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more First paragraph with bold text that is long enough to count é. Second line. End."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_surge_and_dive_without_marks():
    body = "".join(f"<p>Paragraph number {k} holds a good many words of running text in it.</p>" for k in range(5))
    page = f"<div><a href=x>a</a></div><nav>x</nav><nav>y</nav><nav>z</nav><div>{body}</div><footer>f</footer><footer>g</footer><footer>h</footer><div>tiny</div>"
    got = html_text.main_text(page)
    assert got.startswith("Paragraph number 0") and got.endswith("in it.")


def test_short_article_and_truncated_page():
    assert html_text.main_text("<body><nav>Menu menu menu menu menu menu menu menu</nav><article><p>Hi.") == "Hi."
    assert html_text.main_text("<article><p>Some text</p><p class=") == "Some text"


def test_marked_elements_that_hold_the_text():
    body = [f"Paragraph number {k} holds a good many words of running text in it." for k in range(8)]
    of = lambda at: "".join(f"<p>{body[k]}</p>" for k in at)
    teaser = f"<article><p>{body[0]}</p></article><div class=content><h1>Hi</h1>{of(range(1, 8))}</div>"
    assert html_text.main_text(teaser) == "Hi " + " ".join(body[1:])
    several = f"<main><article>{of(range(3))}</article><p>More</p><article>{of(range(3, 6))}</article><article>{of(range(6, 8))}</article></main>"
    assert html_text.main_text(several) == " ".join(body)


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc_round_trip(spark):
    long, other = "é" * 60, "<html>" + "z" * 5000
    rows = [(5, "http://a", long), (3, "http://b\r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "w", other), (None, "n", other), (7, "u", other)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages, scratch(spark, "test-warc"))
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha256(want).hexdigest()
        first = {long.encode(): 3, other.encode(): 7}.get(want)
        if first is None or r.page_id in (None, first):
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == want
        else:
            assert r.record_type == "revisit" and r.refers_to == first and r.payload is None
    one = warc.read_records(index.where("page_id = 5 OR page_id = 1")).collect()
    assert {r.page_id for r in one} == {5, 1}
    assert warc.read_records(warc.write_archives(pages.limit(0), scratch(spark, "test-warc"))).count() == 0


def test_damaged_record_is_an_error(spark):
    bad = warc.parse_record(warc_raw := __import__("zlib").decompress(warc.record_bytes("file:0", 1, "u", b"abc", "0" * 64, None), 31))
    assert bad["payload"] == b"abc" and warc_raw.startswith(b"WARC/1.1\r\n")


def brute_top(ids, x, own, q, k):
    s = x @ q
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
    return [int(ids[i]) for i in order]


@pytest.mark.parametrize("unit", [True, False])
def test_neighbours_recall_and_ties(spark, unit, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12))
    x[300:420] = x[7]  # a third of a block's worth of equal vectors
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 3, (900, 1))
    if not unit:
        x[300:420] = x[7]
    x = x.astype(np.float32)
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0] * 11 + [None], [float("inf")] + [0.0] * 11, [1.0] * 5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000 + 20 * i, v, 1) for i, v in enumerate(odd)] + [(None, [1.0] * 12, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    ids, xd, hits = np.arange(900), x.astype(float), []
    for own in range(0, 900, 20):
        mine = sorted((r for r in got if r.query_id == own), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - xd[r.vec_id] @ xd[own]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits.append(len({r.vec_id for r in mine} & set(brute_top(ids, xd, own, xd[own], 20))) / 20)
    assert np.mean(hits) >= 0.95 and {r.query_id for r in got} == set(range(0, 900, 20))


def test_few_or_no_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table, table.where("vec_id = 0"), 20).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(table.limit(0), table, 3).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0"), table.where("vec_id = 0"), 3).count() == 0


def test_language_id(spark):
    rng = np.random.default_rng(7)
    parts = {"en": ["the", "tion", "ing", "and", "th"], "fr": ["eau", "é", "que", "le", "ou"], "de": ["sch", "ü", "ein", "der", "ch"]}
    word = lambda lang: "".join(rng.choice(parts[lang], rng.integers(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(int(rng.integers(3, 90)))), lang, 5) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(500, None, "en", 5), (501, "", None, 5), (502, "123 !!", "en", 5), (None, "the and thing", "en", 5), (503, "the and thing " * 5000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = langid.fit(docs)
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows) and net.labels == ["de", "en", "fr"]
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert len(held) > 15 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.9
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {500, 501, 502} and all(0 <= r.score <= 1 for r in got)
    again = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1), net).collect()
    assert sorted(r.lang_pred for r in again) == sorted(r.lang_pred for r in got)
    nothing = langid.fit(docs.limit(0))
    assert langid.predict(docs, nothing).count() == len(rows) and langid.predict(docs.limit(0), net).count() == 0


def test_compiled_network_equals_the_trained_one():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.ByteConvNet.train(x, np.arange(40) % 3, ["a", "b", "c"], epochs=2)
    e = net.embed[x]
    pooled = [sum(e[:, j : x.shape[1] - len(f) + 1 + j] @ f[j] for j in range(len(f))).max(1) for f in net.filters]
    z = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(net.compiled().scores(x), p / p.sum(1, keepdims=True), atol=1e-4)


def test_langid_learns_more_labels_than_the_row_bound_was_made_for(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(k, f"{chr(97 + k % 8) * 3} " * 20, f"l{k % 8}") for k in range(160)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_a_language=8)
    assert net.labels == [f"l{k}" for k in range(8)]
