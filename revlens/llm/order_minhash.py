"""Order MinHash fingerprints.

K-mers of words are numbered by occurrence; each of `hashes` functions takes the `length` smallest,
puts them in text order and hashes the tuple. The likeness of two fingerprints is the share of
components that agree, which falls with edit distance and not only with the sets' difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.decontaminate import Words

HASHES, LENGTH, CHUNK = 64, 2, 512
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def fingerprint(text: str | None, words: Words, k: int = 1, hashes: int = HASHES, length: int = LENGTH) -> str:
    """Four hexadecimal digits for each hash function. An empty or wordless text has a fixed fingerprint."""
    w = (text or "").split()
    x = np.array([words[a] for a in w], np.uint64)
    n = max(len(x) - k + 1, min(len(x), 1))
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(x))):
        h = _mixed(h ^ x[i : i + n]) + np.uint64(i)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if n else np.empty(0, np.int64)
    nth = np.empty(n, np.uint64)
    nth[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    h = _mixed(h + nth * _MIX[1])
    a = np.random.default_rng(23).integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(hashes, np.uint64)
    # The smallest values of every function and their places, CHUNK k-mers at a time.
    low, where = np.empty((hashes, 0), np.uint64), np.empty((hashes, 0), np.int64)
    for i in range(0, n, CHUNK):
        v = h[None, i : i + CHUNK] * a[:, None]
        v ^= v >> np.uint64(32)
        for _ in range(min(length, v.shape[1])):
            at = v.argmin(1)[:, None]
            low = np.concatenate([low, np.take_along_axis(v, at, 1)], axis=1)
            where = np.concatenate([where, at + i], axis=1)
            np.put_along_axis(v, at, ~np.uint64(0), 1)
        if low.shape[1] > length:
            at = np.argpartition(low, length - 1, axis=1)[:, :length]
            low, where = np.take_along_axis(low, at, 1), np.take_along_axis(where, at, 1)
    in_order = np.take_along_axis(low, np.argsort(where, axis=1), 1)
    for j in range(in_order.shape[1]):
        out = _mixed(out ^ in_order[:, j])
    return "".join(f"{int(v) >> 48:04x}" for v in out)


def _longs(values: list[int | None]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


def likeness(a: str, b: str) -> float:
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def fingerprints(docs: DataFrame, k: int = 1, hashes: int = HASHES, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of `docs` (doc_id, text); other columns are left out.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the
    next document's, in descending doc_id, null ids last by a hash of their text; rows of one id by their text. The
    last document's next is the first, a single document's next is itself. Null texts count as empty; texts of any
    length count whole; an empty table gives an empty table. Documents are dealt by ranges of doc_id, those without
    one by ranges of the hash; each range also gets the first documents of the range after it, so no task sees more
    than its range. Rows of one id, or of one text without an id, stay in one range.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / n for i in range(1, n)]
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", at, 0.2 / n)}, reverse=True) if at else []
    bounds, steps = _longs(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    # Binary search for the number of bounds above the id: 0 holds the largest ids; null ids come last.
    search = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) > F.col("doc_id"), at + step).otherwise(at)) if cuts else F.lit(0)
    key = F.coalesce("doc_id", F.xxhash64("text"))
    # The largest hashes come first, as the largest ids do.
    last = F.lit(len(cuts) + n) - F.shiftright((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(n), 32).cast("int")
    dealt = rows.withColumn("key", key).withColumn("part", F.when(F.col("doc_id").isNull(), last).otherwise(search).cast("int"))
    heads = {r.part: r.top for r in dealt.groupBy("part").agg(F.max("key").alias("top")).collect()}  # a row for each range
    used = sorted(heads) or [0]
    # The same by range number: whom a range's first document also goes to, and that document's key.
    to, top = [None] * (len(cuts) + n + 1), [None] * (len(cuts) + n + 1)
    for i, p in enumerate(used):
        to[p], top[p] = used[i - 1], heads.get(p)
    halo = dealt.where(F.col("key") == F.get(_longs(top), F.col("part"))).select("doc_id", "text", "key", F.get(_longs(to), F.col("part")).cast("int").alias("part"), F.lit(1).alias("halo"))
    ready = dealt.withColumn("halo", F.lit(0)).select("doc_id", "text", "key", "part", "halo").unionByName(halo)
    ready = ready.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part", "halo", F.col("key").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, out = Words(), None, []

        def done(a, b):
            text, n_chars = a[1], len(a[1])
            half = n_chars // 2
            edited = text[: n_chars - half] + b[1][:half]
            fe = fingerprint(edited, words, k, hashes, length)
            return (a[0], n_chars, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a[3], fe, likeness(a[3], fe), likeness(a[3], b[3]))

        def flush():
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        skip = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for doc, text, p, is_halo in zip(*(batch.column(c)[i : i + 256].to_pylist() for c in range(4)), strict=True):
                    if is_halo and skip == p:
                        continue
                    now = (doc, text, p, fingerprint(text, words, k, hashes, length))
                    if before and before[2] == p:
                        out.append(done(before, now))
                    if is_halo:
                        skip, before = p, None
                    else:
                        before = now
                if out:
                    yield flush()
                    out = []

    return ready.select("doc_id", "text", "part", "halo").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
