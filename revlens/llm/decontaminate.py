"""Benchmark decontamination by spaced seeds.

Fixed masks leave out some token positions, so a substituted word breaks few seeds. Test hashes meet
training hashes; from each hit, item and text are read on both ways, over words that differ, are put in
or left out. Masks follow an item's length: at least one has a clean hit, wherever the words that the
rule lets differ may stand. Seeds of different masks may meet, which finds words put in or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import Stored, map_texts

#: The most words that a mask counts, and the shortest part that counts of a longer item.
WEIGHT, PART = 6, 13
#: So many words of texts, or one text, are hashed at once.
CHUNK = 200_000
#: Items that one pass over the training texts takes; further items take further passes.
BLOCK = 20_000


class Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words, lower-cased, without marks at their ends."""
        return np.array([self[w] for w in (x.strip("&%$#*!|.,;:?\"'()[]") for x in (text or "").lower().split()) if w], np.uint64)


#: Factors of a seed's words, and a hash that no item holds, between texts.
_MIX = np.random.default_rng(13).integers(1, 1 << 63, WEIGHT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EDGE = np.uint64(0x5DEECE66D1234567)


def weight(n: int, identity: float = 0.8) -> int:
    """How many words the masks of an item of n words count, WEIGHT at most.

    e edits leave n - e words or more in e + 1 runs. If no two neighbouring runs had w words together, all would
    have (w - 1) * ceil((e + 1) / 2) at most; w is the largest for which that is too few. A longer item
    holds a part of PART to 2 * PART - 1 words that differs no more than the whole does.
    """
    out = WEIGHT
    for k in [n] if n < PART else range(PART, 2 * PART):
        e = int((1 - identity) * k + 1e-9)
        out = min(out, max(k - e - 1, 0) // ((e + 2) // 2) + 1)
    return out


def seeds(x: np.ndarray, w: int) -> list[np.ndarray]:
    """Hashes by position of every mask of w words: without a gap, and with one word left out after each."""
    y = [x * _MIX[i] for i in range(w)]
    out = []
    for a in range(w, 0, -1):
        n = max(len(x) - w - (a < w) + 1, 0)
        h = np.full(n, w, np.uint64)
        for i in range(w):
            h += y[i][i + (i >= a) : i + (i >= a) + n]
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _index(items: list[tuple[int, str | None]], identity: float):
    """The items' words, and for each weight the sorted seeds with their item and place, and a sieve of them."""
    words = Words()
    texts = [(i, words.of(t)) for i, t in items]
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for n, (_, x) in enumerate(texts):
        if len(x):
            w = weight(len(x), identity)
            found.setdefault(w, []).extend((h, n) for h in seeds(x, w))
    index = []
    for w, got in sorted(found.items()):
        h = np.concatenate([g[0] for g in got])
        item = np.repeat(np.array([g[1] for g in got], np.int32), [len(g[0]) for g in got])
        at = np.concatenate([np.arange(len(g[0]), dtype=np.int32) for g in got])
        order = np.argsort(h, kind="stable")
        shift = np.uint64(64 - min(max(int(16 * len(h)).bit_length(), 16), 26))
        sieve = np.zeros(1 << int(64 - shift), bool)
        sieve[h >> shift] = True
        index.append((w, h[order], item[order], at[order], shift, sieve))
    return texts, index


def hits(texts: list[np.ndarray], index) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, place in the text, place in the item) of equal seeds, by text."""
    start = np.cumsum([2] + [len(x) + 2 for x in texts])
    # Two edges between texts: no mask leaves out both.
    x = np.concatenate([np.full(2, _EDGE), *(p for t in texts for p in (t, np.full(2, _EDGE)))])
    out = []
    for w, h, item, at, shift, sieve in index:
        for s in seeds(x, w):
            p = np.flatnonzero(sieve[s >> shift])
            lo = np.searchsorted(h, s[p], "left")
            ok = lo < len(h)
            ok[ok] = h[lo[ok]] == s[p[ok]]
            p, lo = p[ok], lo[ok]
            n = np.searchsorted(h, s[p], "right") - lo
            q = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(p, n)
            t = np.searchsorted(start, p, "right") - 1
            out.append(np.stack([t, item[q], p - start[t], at[q]], 1))
    got = np.concatenate(out) if out else np.empty((0, 4), np.int64)
    return iter(got[np.argsort(got[:, 0], kind="stable")].tolist())


def _reach(a: list[int], b: list[int], edits: int) -> list[int]:
    """How many words from the start of a the start of b holds with 0, 1, ... `edits` edits, at most."""
    out, far = [], {0: 0}  # by diagonal (place in b less place in a), the furthest place in a
    for e in range(edits + 1):
        if e:
            old, far = far, {}
            for d in range(-e, e + 1):
                # A word of b put in, a word of a left out, or one for the other.
                i = max(old.get(d - 1, -1), old.get(d + 1, -2) + 1, old.get(d, -2) + 1)
                i = min(i, len(a))
                if i >= 0 and 0 <= i + d <= len(b):
                    far[d] = i
                elif 0 <= len(b) - d < i:
                    far[d] = len(b) - d
        for d, i in far.items():
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            far[d] = i
        out.append(max([*far.values(), *out[-1:]]))
    return out


def _held(y: np.ndarray, x: np.ndarray, q: int, p: int, identity: float) -> bool:
    """Whether x holds y by an alignment in which word p of x is word q of y."""
    most, least = 2 * PART - 2, min(len(y), PART)
    edits = int((1 - identity) * (most + 1) + 1e-9)
    ahead = _reach(y[q + 1 : q + 1 + most].tolist(), x[p + 1 : p + 1 + most + edits].tolist(), edits)
    back = _reach(y[max(q - most, 0) : q][::-1].tolist(), x[max(p - most - edits, 0) : p][::-1].tolist(), edits)
    return any((n := 1 + ahead[e] + back[k]) >= least and e + k <= (1 - identity) * n + 1e-9 for e in range(edits + 1) for k in range(edits + 1 - e))


def leaks(got: list[np.ndarray], texts: list[tuple[int, np.ndarray]], index, identity: float) -> list[set[int]]:
    """The items that each text holds, by its words."""
    found, seen = [set() for _ in got], set()
    for t, n, p, q in hits(got, index):
        key = (t, n, p, q)
        if texts[n][0] not in found[t] and key not in seen:
            seen.add(key)
            if _held(texts[n][1], got[t], q, p, identity):
                found[t].add(texts[n][0])
    return found


def _pass(rows: DataFrame, held, identity: float) -> DataFrame:
    """`rows` with items: what each text holds of the items of one broadcast block."""

    def make():
        texts, index = _index(held.value, identity)
        words = Words()

        def f(got: list[str | None], part: pa.RecordBatch) -> dict[str, pa.Array]:
            found, wait, size = [], [], 0
            for text in got:
                wait.append(words.of(text))
                size += len(wait[-1])
                if size >= CHUNK:
                    found += leaks(wait, texts, index, identity)
                    wait, size = [], 0
            found += leaks(wait, texts, index, identity)
            return {"items": pa.array([sorted(x) for x in found], pa.list_(pa.int64()))}

        return f

    return map_texts(rows, make, [("items", T.ArrayType(T.LongType()))])


def find(docs: DataFrame, benchmark: DataFrame, identity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """`docs` with items: the sorted item_ids of `benchmark` that a text holds.

    A text holds an item if it holds all the item's words, or PART or more in a row of a longer item, with
    at most 1 - `identity` edits a word of these; a word that differs, is put in or left out is one edit. Null, empty and wordless texts and items hold and match nothing; equal items
    are found each; a null item_id is left out. Texts of any length go
    through whole; repeated rows are found alike; a column named items gives way, others stay; without items no text
    holds any, and an empty table gives an empty table.

    Up to about `block` items are one pass over `docs`. More go in blocks by hash, one job each, whose index is dropped before the next: what a
    block finds is written as (text's digest, items), and the texts meet what was found of them by digest at the end. So memory
    follows a block, whatever the number of items.
    """
    spark, mark = docs.sparkSession, "_revlens_uid"
    known = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    rounds = max(1, -(-known.count() // block))

    def held_in(r: int):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect()
        return spark.sparkContext.broadcast([(x[0], x[1]) for x in rows])

    if rounds == 1:
        return _pass(docs, held_in(0), identity)
    store = Stored(spark)
    digest = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.select("text", digest.alias(mark))
    found = None
    for r in range(rounds):
        held = held_in(r)
        some = store.put(_pass(texts, held, identity).where(F.size("items") > 0).select(mark, F.explode("items").alias("item")).distinct())
        held.destroy()
        found = some if found is None else found.unionByName(some)
    by_text = found.groupBy(mark).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rest = docs.select(*[c for c in docs.columns if c.lower() != "items"], digest.alias(mark))
    met = rest.join(by_text, mark, "left").drop(mark)
    return met.withColumn("items", F.coalesce("items", F.array().cast("array<long>")))
