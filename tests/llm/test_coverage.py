"""Every row counts, whatever the size of a batch; odd rows, empty tables and clashing names in every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from revlens.llm import decontaminate, html_extract, language, line_dedup, mixing, near_dedup, order_minhash, quality, suffix_dedup, toxicity

LONG = "word " * 30_000
#: doc_id, text, lang, source, n_chars: nulls in each column, blanks, repeated rows, one id with two texts, a long text.
ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \t\n ", "en", "a", 4), (None, "one two", "en", "b", 7), (None, None, None, None, None)]
ODD += [(4, "one two", "en", "b", 7)] * 2 + [(5, "one\ntwo", "de", "b", 7), (5, "three é\U0001f600", "de", None, 8), (6, LONG, "en", "a", len(LONG))]
#: Names that operators use for columns of their own, here of other types.
CLASH = ["score", "label", "items", "size", "taken", "copies", "n_lines", "n_dropped", "kept_text", "kept", "cls", "bands", "band", "id", "text_hash", "part", "uid", "n", "batch", "n_shingles", "held", "u", "target", "_k"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark):
    docs = spark.createDataFrame(ODD, DOC)
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, 0), (5, None), (None, 1), (6, 1)], "doc_id long, label int")
    items = spark.createDataFrame([(1, "one two"), (2, None), (None, "one"), (3, "")], "item_id long, text string")
    return docs, labels, items


OPERATORS = {
    "toxicity": lambda d, labels, items: toxicity.score_toxicity(d, labels),
    "quality": lambda d, labels, items: quality.score_quality(d, labels),
    "mixing": lambda d, labels, items: mixing.mix(d),
    "decontaminate": lambda d, labels, items: decontaminate.find(d, items),
    "suffix_dedup": lambda d, labels, items: suffix_dedup.remove_repeats(d, width=200),
    "line_dedup": lambda d, labels, items: line_dedup.dedup_lines(d, min_docs=2),
    "order_minhash": lambda d, labels, items: order_minhash.fingerprints(d),
    "near_dedup": lambda d, labels, items: near_dedup.near_duplicates(d, width=4),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    """A row out for each row in, ids as they were; none for an empty table; clashing names change nothing."""
    docs, labels, items = tables(spark)
    op = OPERATORS[name]
    out = op(docs, labels, items)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.select("doc_id").collect())
    assert ids == sorted(-1 if r[0] is None else r[0] for r in ODD)
    assert op(docs.limit(0), labels.limit(0), items.limit(0)).count() == 0
    crowded = docs.select("*", *[F.array(F.lit("x")).alias(c) for c in CLASH])
    again = op(crowded, labels, items).select(*out.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


PAGES = [(1, None, None), (2, "http://a.de/x", ""), (None, "not a url", "<p>one"), (3, "http://a.de/y", "<p>" + LONG), (4, None, "<<<&#xffffffff;&bogus;"), (4, None, "<<<&#xffffffff;&bogus;")]


@pytest.mark.parametrize("name", ["html_extract", "language"])
def test_odd_pages(spark, name):
    docs, _, _ = tables(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    op = {"html_extract": html_extract.extract, "language": lambda p: language.identify(p, docs)}[name]
    out = op(pages)
    assert sorted(-1 if r.page_id is None else r.page_id for r in out.collect()) == [-1, 1, 2, 3, 4, 4]
    assert op(pages.limit(0)).count() == 0
    crowded = pages.select("*", *[F.array(F.lit("x")).alias(c) for c in ("text", "n_chars", "lang", "host", "uid", "probability", "n", "logp")])
    assert sorted(map(str, op(crowded).select(*out.columns).collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("step", [64, 1 << 20])
def test_word_vectors_count_every_text(spark, monkeypatch, step):
    """Against a plain loop, where one batch holds more rows than a slice."""
    monkeypatch.setattr(quality, "SLICE", step)
    texts = [f"a{i} b{i % 7} c{i}" for i in range(3000)] + ["", None, "alone"]
    at, sign = quality._index()
    want = np.zeros((quality.BUCKETS, quality.WIDTH))
    for t in texts:
        x = quality.token_ids(t, quality._Ids())
        for a, b in zip(x[:-1], x[1:], strict=True):
            for me, other in ((a, b), (b, a)):
                for k in range(quality.NONZERO):
                    want[me, at[other, k]] += sign[other, k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-5)
