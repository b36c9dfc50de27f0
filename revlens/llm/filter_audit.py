"""Audit of filters that are applied one after the other: what each order keeps, and what each filter alone is to blame for."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Stored

#: Code points before which each block of a text ends; the last block is the rest of the text.
BLOCKS = (64, 1024, 16384)
#: Up to so many classes of copies go to every task (16 bytes each); beyond it, rows meet them in a shuffle join.
BROADCAST_CLASSES = 200_000
SPACE = r"\x20\x09-\x0D"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at one document alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def class_keys(text: Column, bits: int = 64) -> list[Column]:
    """The class of a text by its length, then by length and first block, and so on to all blocks.

    Keys of fewer `bits` put more different texts in a class: for tests, results don't depend on it.
    """
    text = F.coalesce(text, F.lit(""))
    ends = (0, *BLOCKS, 2**31 - 1)
    blocks = [F.xxhash64(F.substring(text, a + 1, b - a)) for a, b in zip(ends, ends[1:], strict=False)]
    n = F.char_length(text).cast("long")
    keys = [n, *[F.xxhash64(n, *blocks[: i + 1]) for i in range(len(blocks))]]
    return [k if bits == 64 else F.pmod(k, F.lit(2**bits)) for k in keys]


def _meet(rows: DataFrame, few: DataFrame, n: int, on: str | list[str], how: str, most: int) -> DataFrame:
    """A join with `few` (n rows): sent to every task if there are up to `most`, else shuffled, where AQE splits hot keys."""
    return rows.join(F.broadcast(few) if n <= most else few.hint("merge"), on, how)


def mark(docs: DataFrame, part: str = "source", bits: int = 64, broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """(doc_id, part, mask): one row for each row of `docs` (doc_id, text, `part`); bit i of mask is set if filter i of ABCDE fails.

    E fails if a row of a smaller doc_id has the same text, wherever it is. Partition refinement finds
    these: classes of equal length are split by the hash of one block of text after the other, and what
    is alone in its class drops out. Hashing is part of the one scan that computes the other filters;
    the rounds refine keys of eight bytes. The texts of the classes that are left are compared whole, so
    hashes that collide do no harm. Copies are gathered before each shuffle.

    Null text counts as empty, null part as "". A row without doc_id is never marked by E, nor is
    a row because of it. Rows that repeat a doc_id are all judged by their own text; equal texts of one
    doc_id don't mark each other. An empty table gives none. Other columns are ignored.
    """
    store = Stored(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keys = [f"k{i}" for i in range(len(BLOCKS) + 2)]
    last = keys[-1]
    fails = failures(F.col("text"))
    own = F.lit(0)
    for i, column in enumerate(fails.values()):
        own = own + F.when(column, F.lit(1 << i)).otherwise(F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own.alias("own"), *[k.alias(name) for k, name in zip(class_keys(F.col("text"), bits), keys, strict=True)])
    rows = store.put(rows)
    live = rows.select(*keys)
    for key in keys:
        # Written, so that the join below deals both sides anew and AQE can split a hot class.
        shared = store.put(live.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
        refined = store.put(live.join(shared, key, "left_semi"))
        store.drop(shared, live if live is not rows else None)
        live = refined
    classes = store.put(live.select(last).distinct())
    store.drop(live)
    n = classes.count()
    texts = docs.select("doc_id", text.alias("text"), class_keys(F.col("text"), bits)[-1].alias(last))
    groups = _meet(texts, classes, n, last, "left_semi", broadcast_classes).groupBy(last, "text").agg(F.min("doc_id").alias("first_id"))
    # A class holds one text, unless hashes collide.
    firsts = store.put(groups.groupBy(last).agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id")))
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    mask = (F.col("own") + F.when(copied, F.lit(1 << len(fails))).otherwise(F.lit(0))).cast("int").alias("mask")
    met = _meet(rows, firsts, n, last, "left", broadcast_classes)
    collided = firsts.where("n_texts > 1").select(last)
    bad = collided.count()
    if not bad:
        return met.select("doc_id", "part", mask)
    whole = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), own.alias("own"), class_keys(F.col("text"), bits)[-1].alias(last))
    apart = _meet(whole, collided, bad, last, "left_semi", broadcast_classes).join(groups.hint("merge"), [last, "text"], "left")
    return met.where("coalesce(n_texts, 1) = 1").select("doc_id", "part", mask).unionByName(apart.select("doc_id", "part", mask))


def interaction(marks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from (part, mask, good, toxic).

    Documents are counted by part and mask before anything is unfolded, so the rest takes a few
    thousand rows a part, whatever the documents. What a step does follows from its filter and the
    set of those before it; the orders share these. A part without documents has no rows.
    """
    spark = marks.sparkSession
    counts = marks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))
    bit = {x: 1 << i for i, x in enumerate(letters)}
    n_orders = factorial(len(letters))
    cells = [
        (m, before, x, int(not m & (before | b)), int(bool(m & b) and not m & before), int(bool(m & b) and bool(m & before)), int(m == b), n_orders // m.bit_count() if m & b else 0)
        for m in range(2 ** len(letters)) for before in range(2 ** len(letters)) for x, b in bit.items() if not before & b
    ]
    orders = [("".join(o), i + 1, sum(bit[x] for x in o[:i]), o[i]) for o in permutations(letters) for i in range(len(letters))]
    effect = spark.createDataFrame(cells, "mask int, before int, letter string, is_kept int, is_removed int, is_redundant int, is_unique int, share int")
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, letter string")
    total = lambda n, flag, name: F.sum(F.col(n) * F.col(flag)).alias(name)
    by_set = counts.join(F.broadcast(effect), "mask").groupBy("part", "before", "letter").agg(
        total("n", "is_kept", "kept"), total("n", "is_removed", "removed"), total("n", "is_redundant", "redundant"), total("n", "is_unique", "unique_fails"),
        total("n_good", "is_removed", "good_lost"), total("n_toxic", "is_removed", "toxic_lost"), total("n", "share", "shapley"))
    return by_set.join(F.broadcast(steps), ["before", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", bits: int = 64, broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """interaction() of all of `docs`, with the losses among those that `labels` (doc_id, quality, toxic) calls good or toxic.

    A document is good if any label of its id has quality 1, toxic if any has toxic 1; without a label,
    or with null ones, neither. For odd rows see mark().
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = mark(docs, part, bits, broadcast_classes).join(known, "doc_id", "left")
    return interaction(marks.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
