"""The classifier of blocks: what it learns from the pages, and what no longer hangs on the words of a class."""

import re

import duckdb
import numpy as np
from pyspark.sql import functions as F
from revlens.llm import html_extract

SF = "/root/testdata/sf0.001"


def test_pages_keep_their_text_without_classes(spark):
    """With class, id and role taken away, or renamed, every page gives what it gave; so no advert hangs on its class."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    plain = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert len(plain) > 20 and all(plain.values())
    for pattern, by in ((r'\s(?:class|id|role)="[^"]*"', ""), (r'(class|id|role)="', '$1="x')):
        other = pages.withColumn("html", F.regexp_replace("html", pattern, by))
        assert {r.page_id: r.text for r in html_extract.extract(other).collect()} == plain


def test_articles_come_out_whole():
    """The text of the article element, block by block, by a plain reading of it."""
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    blank = html_extract.Model([])
    for (page,) in rows:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li|div|table|tr|td|blockquote|pre|h2)\b[^>]*>", re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner, flags=re.S))
        want = [" ".join(__import__("html").unescape(re.sub(r"<br\s*/?>", " ", b) and re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        got = html_extract.main_text(page, blank)
        assert [w for w in want if w] == got.split("\n")


def test_short_and_linked_paragraphs_stay(spark):
    model = html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))
    text = lambda page: html_extract.main_text(page, model)
    assert text('<p>Short.</p><p>A paragraph of several words that tells something, and ends.</p><p><a href="x">all a link</a></p>') == "Short.\nA paragraph of several words that tells something, and ends.\nall a link"
    assert text("<article><p>One.</p><p><a href=x>two</a></p></article><div>Buy this now.</div>") == "One.\ntwo"


def test_readers_comments_go():
    body = "<div><h1>Title here</h1><p>A paragraph of several words that tells a story to its end.</p></div>"
    said = "<p>I like it very much, says a reader at some length, and goes on.</p>"
    for frame in ('<div class="user-comment">', '<section class="reader-responses">', '<div id="commentList">', '<article class="comment">', '<div role="comment">'):
        close = f"</{frame[1:].split()[0]}>"
        assert html_extract.main_text(body + frame + said + close) == "Title here\nA paragraph of several words that tells a story to its end."
    assert "says a reader" in html_extract.main_text(body + '<div class="commentary-free">' + said + "</div>")


def test_model_fits_the_counts():
    """The fitted odds against a slow gradient descent on the same counts, and the default without both labels."""
    rng = np.random.default_rng(1)
    counts = sorted({(tuple(int(rng.integers(0, k)) for k in html_extract._LOOKS), bool(rng.integers(0, 2))): int(rng.integers(1, 50)) for _ in range(60)}.items())
    counts = [(look, label, n) for (look, label), n in counts]
    model = html_extract.Model(counts)
    total = [sum(n for _, label, n in counts if label is bool(v)) for v in (0, 1)]

    def loss(w):
        out = sum(x * x for x in w) / 2
        for look, label, n in counts:
            odds = w[-1] + sum(w[a + v] for a, v in zip(model.starts, look, strict=True))
            out += 500 * n / total[label] * np.logaddexp(0, -odds if label else odds)
        return out

    best = loss(model.w)
    for i in range(len(model.w)):
        for step in (-1e-3, 1e-3):
            moved = list(model.w)
            moved[i] += step
            assert loss(moved) >= best - 1e-7
    assert html_extract.Model([]).odds((0, 5, 0, 1, 1)) > 0 > html_extract.Model([]).odds((4, 1, 2, 1, 0))
