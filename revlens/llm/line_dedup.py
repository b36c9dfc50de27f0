"""Line dedup: drop lines whose key stands in many documents.

Keys (lines stripped of ASCII white space, A-Z lower-cased) are hashed to 128 bits and kept in levelled
sorted runs: each new batch is merge-anti-joined with the keys that the runs already hold as frequent,
and what is left becomes a run of its own; `fanout` runs of one level are compacted into one of the next.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import SPACE_BYTES, Stored, map_texts

#: So many frequent keys (16 bytes each) at most go to each Python worker; with more, a shuffle join marks the lines.
BROADCAST_KEYS = 200_000


def digests(text: str | None) -> list[bytes | None]:
    """A 16-byte hash for each line's key; None for lines without a key."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z alone
        out.append(xxhash.xxh3_128_digest(key) if key else None)
    return out


def _key_chars(text: str | None, min_chars: int) -> list[bytes | None]:
    if min_chars <= 1:
        return digests(text)
    lines = (text or "").split("\n")
    return [d if d and len(line.strip("\t\n\x0b\x0c\r ")) >= min_chars else None for d, line in zip(digests(text), lines, strict=True)]


def _longs(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2).astype("i8")
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def line_keys(docs: DataFrame, batches: int, min_chars: int = 1) -> DataFrame:
    """(batch, hi, lo, n): in how many documents each key stands, counted ahead within each slice."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts: list[Counter[bytes]] = [Counter() for _ in range(batches)]
            for text in part.column(0).to_pylist():
                counts[xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass")) % batches].update({k for k in _key_chars(text, min_chars) if k})
            for b, c in enumerate(counts):
                if c:
                    hi, lo = _longs(list(c))
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(c), pa.int32()), hi, lo, pa.array(list(c.values()), pa.int64())], ["batch", "hi", "lo", "n"])

    return docs.select("text").mapInArrow(run, "batch int, hi long, lo long, n long")


class LineRuns:
    """Levelled sorted runs of (hi, lo, n), each a table in the shared folder."""

    def __init__(self, store: Stored, min_docs: int, fanout: int = 4):
        self.store, self.min_docs, self.fanout = store, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _sorted(self, df: DataFrame) -> DataFrame:
        summed = df.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        return self.store.put(summed.sortWithinPartitions("hi", "lo"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def counts(self) -> DataFrame:
        first, *rest = self.runs()
        for r in rest:
            first = first.unionByName(r)
        return first.groupBy("hi", "lo").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch's (hi, lo, n); keys that the runs hold as frequent need no further count."""
        fresh = batch.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        if self.runs():
            full = self.counts().where(F.col("n") >= self.min_docs).select("hi", "lo")
            fresh = fresh.join(full.hint("merge"), ["hi", "lo"], "left_anti")
        self.levels[0].append(self.store.put(fresh.sortWithinPartitions("hi", "lo")))
        self.compact()

    def compact(self) -> None:
        for i in range(64):
            if i >= len(self.levels) or len(self.levels[i]) < self.fanout:
                return
            old = self.levels[i]
            merged = old[0]
            for r in old[1:]:
                merged = merged.unionByName(r)
            new = self._sorted(merged)
            self.store.drop(*old)
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(new)

    def frequent(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.min_docs).select("hi", "lo")

    def clear(self) -> None:
        self.store.drop(*self.runs())


def _cut(lines: list[str], drop: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(lines) if i not in drop)


_FIELDS = [("kept_text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]


def _arrays(cut: list[tuple[str, int, int]]) -> dict[str, pa.Array]:
    return {"kept_text": pa.array([c[0] for c in cut], pa.string()), "n_lines": pa.array([c[1] for c in cut], pa.int64()), "n_dropped": pa.array([c[2] for c in cut], pa.int64())}


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """`docs` (text and any other columns) with kept_text, n_lines, n_dropped.

    A null or empty text has one empty line, which is kept. A repeated row counts as a document of its
    own; a line repeated within a document counts once. New columns take the place of columns of their
    names. Texts of any length go through whole. An empty table gives an empty table. Lines that lose their text leave no trace but the count.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    keys = store.put(line_keys(docs, batches, min_chars), by="batch")
    runs = LineRuns(store, min_docs, fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("hi", "lo", "n"))
    frequent = store.put(runs.frequent())
    runs.clear()
    store.drop(keys)
    if frequent.count() <= broadcast_keys:
        rows = frequent.toArrow()
        both = np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()], axis=1).astype(">i8").tobytes() if rows.num_rows else b""
        held = spark.sparkContext.broadcast(both)

        def make():
            known = {held.value[i : i + 16] for i in range(0, len(held.value), 16)}

            def f(texts, _):
                cut = []
                for text in texts:
                    lines = (text or "").split("\n")
                    drop = {i for i, k in enumerate(_key_chars(text, min_chars)) if k in known}
                    cut.append((_cut(lines, drop) if drop else text or "", len(lines), len(drop)))
                return _arrays(cut)

            return f

        return map_texts(docs, make, _FIELDS)
    return _dedup_by_join(docs, frequent, min_chars)


def _dedup_by_join(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """For any number of frequent keys: lines meet them in a sort-merge join, whose hot keys AQE splits."""
    mark = "_revlens_text_key"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column(0).to_pylist():
                found = [(i, k) for i, k in enumerate(_key_chars(text, min_chars)) if k]
                if found:
                    hi, lo = _longs([k for _, k in found])
                    key = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.binary()), pa.array([i for i, _ in found], pa.int32()), hi, lo], [mark, "line", "hi", "lo"])

    # Equal texts lose equal lines, so lines are marked once for each distinct text.
    lines = docs.select("text").distinct().mapInArrow(run, f"{mark} binary, line int, hi long, lo long")
    marked = lines.join(frequent.hint("merge"), ["hi", "lo"], "left_semi").groupBy(mark).agg(F.collect_list("line").alias("_revlens_lines"))
    keyed = map_texts(docs, lambda: lambda texts, _: {mark: pa.array([xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())}, [(mark, T.BinaryType())])
    joined = keyed.join(marked.hint("merge"), mark, "left").drop(mark)

    def make():
        def f(texts, part):
            cut = []
            for text, drop in zip(texts, part.column("_revlens_lines").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                cut.append((_cut(lines, set(drop or ())), len(lines), len(drop or ())))
            return _arrays(cut)

        return f

    return map_texts(joined, make, _FIELDS).drop("_revlens_lines")
