"""Work that goes in batches or passes gives what one pass over everything gives."""

import random

import numpy as np
from pyspark.sql import functions as F
from revlens.llm import decontaminate, suffix_dedup


def test_blocks_of_items_are_passes_of_their_own(spark):
    """Small blocks find what one block finds, and no job holds the index of more than one."""
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 20)))) for i in range(40)] + [(None, "x y"), (90, None), (91, "")]
    docs = [(i, " ".join([*(word() for _ in range(20)), rng.choice(items)[1] or "", *(word() for _ in range(5))])) for i in range(60)] + [(3, None), (None, items[0][1]), (4, items[1][1]), (4, items[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("x")).withColumn("extra", F.col("doc_id"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = decontaminate.find(frame, bench), decontaminate.find(frame, bench, block=8)
    assert sorted(many.columns) == sorted(one.columns)
    rows = lambda df: sorted(str((r.doc_id, r.text, r.extra, list(r["items"]))) for r in df.collect())
    assert rows(one) == rows(many)
    assert sum(len(r["items"]) > 0 for r in many.collect()) > 30
    assert "MapInArrow" not in many._jdf.queryExecution().toString()
    assert decontaminate.find(frame.limit(0), bench, block=8).count() == 0


def test_batches_of_any_length_choose_one_gram():
    """A window's smallest gram, told by its place in the window, is the same in a batch of a kilobyte and in one of a megabyte."""
    rng, width = np.random.default_rng(1), 200
    hasher = suffix_dedup._Hasher(suffix_dedup.SEGMENT + width)
    large = rng.integers(97, 105, suffix_dedup.SEGMENT // 2).astype(np.uint8)
    found = {}
    for at in (0, 5000, 300_000):
        small = large[at : at + 1000]
        for name, x in (("small", small), ("large", large)):
            g, ph, first, last, gram = suffix_dedup.pieces(x, np.array([len(x)]), width, hasher)
            off = 0 if name == "small" else at
            for window in range(off + 250, off + 500):
                k = np.searchsorted(first, window, "right") - 1
                assert first[k] <= window <= last[k]
                found[name, at, window - off] = (int(g[k]), int(gram[k]) - window)
    assert all(found["small", at, w] == found["large", at, w] for _, at, w in found)
