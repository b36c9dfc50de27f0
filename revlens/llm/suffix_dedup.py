"""Repeated 200-byte strings by merging Burrows-Wheeler transforms.

Every document splits into pieces by the smallest GRAM-byte gram of each window (winnowing), so equal windows
meet in one gram's group. A piece that stands twice is repeated whole. Distinct pieces of one group go to
a bucket: each shard of a bucket has its own suffix order and BWT, and shards are merged by refining their
interleave one symbol a round, which also yields the intervals that share `width` symbols. A gram that stands
in very many distinct contexts has its pieces split by context first, so no task's work follows a group's size.
Copies of a piece are counted and settled where they are read; copies of a text are settled by their digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import Stored, map_texts

#: Groups of over CROWD distinct pieces split by context, in blocks of BLOCKS windows in turn; in blocks of one, equal pieces are equal windows.
CROWD, BLOCKS = 2048, (36, 12, 4, 1)
#: A shard's bytes; a task merges shards of about MERGE_BYTES at once, which stay in the processor's cache.
GRAM, SHARD_BYTES, MERGE_BYTES = 64, 1 << 15, 1 << 17
#: Texts go through in segments of so many bytes, which overlap by all but one byte of a window.
SEGMENT = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def _powers(b: int, n: int) -> np.ndarray:
    out = np.full(n, b, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Rolling hashes of ranges of a buffer of at most SEGMENT bytes and a window, by two bases."""

    def __init__(self, room: int):
        self.up = [_powers(b, room) for b in _BASES]
        self.down = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), room + 1) for b in _BASES]

    def sums(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[k][: len(x)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the ranges from a to b."""
        h = (sums[b] - sums[a]) * self.down[k][a]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))


def pieces(x: np.ndarray, ends: np.ndarray, width: int, hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """(gram hash, piece hash, first start, last start, gram's start) of the runs of windows that share their smallest gram.

    `x` holds texts one after the other, `ends` where each ends; no window crosses an end.
    """
    if len(x) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    c = hasher.sums(x, 0)
    at = np.arange(len(x) - GRAM + 1)
    h = hasher.of(c, at, at + GRAM, 0)
    # The same bits of a hash decide in every batch, whatever its length, so equal windows choose one gram.
    bits = np.uint64((SEGMENT + width).bit_length())
    m, span, need = (h >> bits << bits) | at.astype(np.uint64), 1, width - GRAM + 1
    while span < need:
        step = min(span, need - span)
        m = np.minimum(m[:-step], m[step:])
        span += step
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(x)), side="right")
    inside = text[: len(at)] == text[width - 1 :]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1 : len(at)] != text[: len(at) - 1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    # Windows that cross an end are the last of their text: runs end before them.
    whole = np.concatenate([[0], np.cumsum(inside)])
    n = whole[last + 1] - whole[first]
    first, n = first[n > 0], n[n > 0]
    last = first + n - 1
    ph = hasher.of(hasher.sums(x, 1), first, last + width, 1)
    return h[at[first]].view(np.int64), ph.view(np.int64), first, last, at[first]


def split(p: bytes, off: int, block: int, width: int) -> list[tuple[int, int, int, int]]:
    """A piece's windows in blocks of how far the gram, at `off` of the piece, stands from their start: (key, first, last, off).

    Windows of one block share all but `block - 1` of their bytes; the key is of those, so equal windows keep meeting.
    """
    out, last = [], len(p) - width
    for low in range((off - last) // block * block, off + 1, block):
        high = min(low + block - 1, width - GRAM)
        key = xxhash.xxh3_64_intdigest(p[off - low : off - high + width], seed=block * 1000 + low)
        out.append((key - (1 << 63), max(0, off - high), min(last, off - low), off))
    return out


def shard_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of one shard: ranks of seven symbols at once, then prefix doubling of the rows still tied."""
    n = len(s)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key << 9 | padded[i : n + i]
    order, k = np.argsort(key), 7
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows, in order, whose rank isn't theirs alone
    while len(tied):
        pos = order[tied]
        nxt = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + nxt
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[tied] = pos
        new = np.concatenate([[True], np.diff(key) != 0])
        at = np.flatnonzero(new)
        rank[pos] = np.repeat(tied[at], np.diff(np.append(at, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    return order


def merge(bwt: np.ndarray, last_first: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Rows whose first `depth` symbols also begin another row, from the rows that stand `depth` symbols after them.

    `bwt` and `last_first` hold the shards one after the other; `rows` interleaves them by no symbol yet.
    A round takes the rows in order, deals them stably by their BWT symbol and moves each to the row that
    this symbol begins: the interleave by one symbol more. Neighbours of equal symbol and equal class share
    their prefix, so no suffixes are compared. A row alone in its class can't come to share one: it is left out.
    """
    group = np.zeros(len(rows), np.int32)
    for h in range(1, depth + 1):
        symbol = bwt[rows]
        order = np.argsort(symbol, kind="stable")
        symbol, group, rows = symbol[order], group[order], last_first[rows[order]]
        new = np.empty(len(rows) + 1, bool)
        new[:1] = new[-1:] = True
        np.logical_or(symbol[1:] != symbol[:-1], group[1:] != group[:-1], out=new[1:-1])
        group = np.cumsum(new[:-1], dtype=np.int32)
        if h % 4 == 0 or h == depth:
            keep = ~(new[:-1] & new[1:])
            rows, group = rows[keep], group[keep]
            if not len(rows):
                break
    return rows


def repeated_starts(texts: list[bytes], counts: list[int], width: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each distinct piece, which of its windows also start elsewhere (a piece that stands twice: all).

    Pieces end in a symbol below all bytes. Only the rows of whole windows are merged, and those never reach an end.
    """
    members, size = [[]], 0
    for k, t in enumerate(texts):
        if size > shard_bytes:
            members.append([])
            size = 0
        members[-1].append(k)
        size += len(t) + 1
    bwts, lasts, orders, starts, base = [], [], [], [], 0
    for mem in members:
        lens = np.array([len(texts[k]) + 1 for k in mem])
        s = np.frombuffer(b"\0".join(texts[k] for k in mem) + b"\0", np.uint8).astype(np.int16) + 1
        s[np.cumsum(lens) - 1] = 0
        order = shard_order(s)
        rank = np.empty(len(s), np.int32)
        rank[order] = np.arange(len(s), dtype=np.int32)
        bwts.append((s[order - 1] - 1).astype(np.uint8))
        lasts.append(rank[order - 1] + np.int32(base))
        orders.append(order + base)
        first = np.cumsum(lens) - lens + base
        starts += list(zip(mem, first.tolist(), strict=True))
        # The row `width` symbols after each window's start.
        ends = np.zeros(len(s), bool)
        for f, n in zip((first - base).tolist(), lens.tolist(), strict=True):
            ends[f + width : f + n] = True
        base += len(s)
        orders[-1] = (orders[-1], ends[order])
    sa = np.concatenate([o for o, _ in orders])
    found = merge(np.concatenate(bwts), np.concatenate(lasts), np.flatnonzero(np.concatenate([e for _, e in orders])).astype(np.int32), width)
    hit = np.zeros(base, bool)
    hit[sa[found]] = True
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
    for k, f in starts:
        w = max(len(texts[k]) - width + 1, 0)
        out[k] = np.full(w, True) if counts[k] > 1 else hit[f : f + w].copy()
    return out


_ROW = [("g", "long"), ("ph", "long"), ("rid", "long"), ("a", "long"), ("w", "int"), ("off", "int"), ("n", "long"), ("done", "boolean"), ("uid", "binary")]


def _cut(width: int):
    """Rows of all pieces of (uid, rid, text). A piece that stands twice in one batch is settled there, and only its first row counts it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(SEGMENT + width)
        for part in parts:
            found, wait, size = [], [], 0

            def done():
                nonlocal wait, size
                if wait:
                    ends = np.cumsum([len(raw) for raw, _, _ in wait])
                    g, ph, first, last, at = pieces(np.frombuffer(b"".join(raw for raw, _, _ in wait), np.uint8), ends, width, hasher)
                    k = np.searchsorted(ends, first, side="right")
                    start = np.array([s for _, _, s in wait])[k] - (ends - np.array([len(raw) for raw, _, _ in wait]))[k]
                    found.append((g, ph, first + start, last - first + 1, at - first, np.array([r for _, r, _ in wait])[k]))
                wait, size = [], 0

            for row, text in enumerate(part.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for a in range(0, max(len(raw) - width + 1, 0), SEGMENT):
                    seg = raw[a : a + SEGMENT + width - 1]
                    if size + len(seg) > SEGMENT + width - 1:
                        done()
                    wait.append((seg, row, a))
                    size += len(seg)
            done()
            if not found:
                continue
            g, ph, a, w, off, row = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ph, g))
            new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (ph[order][1:] != ph[order][:-1])])
            head = np.flatnonzero(new)
            many = np.diff(np.append(head, len(order)))
            n, twice = np.zeros(len(g), np.int64), np.zeros(len(g), bool)
            n[order[head]] = many
            twice[order] = np.repeat(many > 1, many)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(ph), part.column("rid").take(at), pa.array(a), pa.array(w.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(n), pa.array(twice), part.column("uid").take(at)],
                [c for c, _ in _ROW],
            )

    return run


def _merged(width: int):
    """(rid, a, w, bits) of pieces some of whose windows stand elsewhere, from rows (g, n, rid, a, w, p) sorted by g."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, size, last = [], 0, None

        def done():
            found = repeated_starts([t[1] for t in todo], [1] * len(todo), width)
            # A piece of several holders was settled before: it is here as evidence.
            keep = [(*t[2], np.packbits(f).tobytes()) for t, f in zip(todo, found, strict=True) if t[0] == 1 and f.any()]
            cols = list(zip(*keep, strict=True)) if keep else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["rid", "a", "w", "bits"])

        for part in parts:
            for g, n, rid, a, w, p in zip(*(part.column(c).to_pylist() for c in range(6)), strict=True):
                if g != last and size > MERGE_BYTES:  # groups, of CROWD pieces at most, are never cut
                    yield done()
                    todo, size = [], 0
                last = g
                todo.append((n, p, (rid, a, w)))
                size += len(p)
        if todo:
            yield done()

    return run


def _split(width: int, block: int):
    """Rows of a crowded group's pieces, a row for each block of windows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 2048):
                rows = []
                for n, rid, a, off, p in zip(*(part.column(c)[i : i + 2048].to_pylist() for c in ("n", "rid", "a", "off", "p")), strict=True):
                    for key, low, high, at in split(p, off, block, width):
                        q = p[low : high + width]
                        rows.append((key, xxhash.xxh3_64_intdigest(q, seed=at - low) - (1 << 63), rid, a + low, high - low + 1, at - low, n, q))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["g", "ph", "rid", "a", "w", "off", "n", "p"])

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    """`rows` (g, ph, rid, a, n, ...) of groups that stand twice, with all (holders of the piece), kinds (distinct pieces of the group) and lead (one row of each piece).

    Rows are dealt by gram once: both windows read that partitioning. A piece of one batch is one row, so a gram of very many holders has few rows.
    """
    piece, group = Window.partitionBy("g", "ph"), Window.partitionBy("g")
    out = rows.repartition("g").withColumn("lead", F.row_number().over(piece.orderBy("rid", "a")) == 1).withColumn("all", F.sum("n").over(piece))
    out = out.withColumn("kinds", F.sum(F.col("lead").cast("int")).over(group)).withColumn("in_group", F.sum("n").over(group))
    return out.where("in_group > 1").drop("in_group")


def remove_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of `docs` (doc_id, text).

    Bytes covered by a `width`-byte string that also starts anywhere else go; `width` must exceed GRAM. Null and empty
    texts have no bytes; repeated rows are documents of their own and lose all they have, if that is `width` bytes
    or more; null ids are ids like others; other columns are left out. Texts of any length go through in segments,
    and each text's bytes must fit a worker. An empty table gives an empty table.
    """
    store = Stored(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("uid", F.unhex(F.md5("text")))
    schema = ", ".join(f"{c} {t}" for c, t in _ROW)
    rows = store.put(keyed.select("uid", "text", F.monotonically_increasing_id().alias("rid")).mapInArrow(_cut(width), schema))
    # Texts that stand twice are settled by their digest, and their marks are dropped: a row each here.
    copies = store.put(keyed.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid"))
    texts = rows.groupBy("rid").agg(F.first("uid").alias("uid")).join(copies, "uid", "left_anti").select("rid", "uid")
    marks = [rows.where("done").select("rid", "a", "w", F.lit(None).cast("binary").alias("bits"))]
    live = store.put(_grouped(rows.where("n > 0").select("g", "ph", "rid", "a", "w", "off", "n", "done")))
    # Every holder of a piece that stands twice; those that were settled in their batch are marked already.
    marks.append(live.where("all > 1 AND NOT done").select("rid", "a", "w", F.lit(None).cast("binary").alias("bits")))
    need = live.where("lead AND kinds > 1").select("g", "kinds", F.col("all").alias("n"), "rid", "a", "w", "off")
    # One holder of each distinct piece brings its bytes: texts go to their digest's place once, copies one for each task.
    owner = rows.select("rid", "uid").distinct().join(need.select("rid").distinct(), "rid", "left_semi")
    held = keyed.groupBy("uid").agg(F.first("text").alias("text")).select("uid", F.encode("text", "UTF-8").alias("raw"))
    body = need.join(owner, "rid").join(held, "uid").select("g", "kinds", "n", "rid", "a", "w", "off", F.expr(f"substring(raw, int(a + 1), w + {width - 1})").alias("p"))
    body = store.put(body)
    for block in (*BLOCKS, 0):
        small = body if not block else body.where(F.col("kinds") <= CROWD)
        small = small.where("kinds > 1").select("g", "n", "rid", "a", "w", "p").repartition("g").sortWithinPartitions("g", "rid", "a")
        marks.append(store.put(small.mapInArrow(_merged(width), "rid long, a long, w int, bits binary")))
        crowded = body.where(F.col("kinds") > CROWD)
        if not block or crowded.isEmpty():
            break
        parts = crowded.mapInArrow(_split(width, block), "g long, ph long, rid long, a long, w int, off int, n long, p binary")
        again = store.put(_grouped(parts))
        store.drop(body)
        # A holder of several was settled before it was split.
        marks.append(again.where("all > 1 AND n = 1").select("rid", "a", "w", F.lit(None).cast("binary").alias("bits")))
        body = again.where("lead AND kinds > 1").select("g", "kinds", F.col("all").alias("n"), "rid", "a", "w", "off", "p")
    spans = reduce(DataFrame.unionByName, marks).groupBy("rid").agg(F.collect_list(F.struct("a", "w", "bits")).alias("marks"))
    info = texts.join(spans, "rid").select("uid", "marks", F.lit(False).alias("whole"))
    info = store.put(info.unionByName(copies.select("uid", F.lit(None).cast(info.schema["marks"].dataType).alias("marks"), F.lit(True).alias("whole"))))
    full = keyed.join(info, "uid", "left")

    def finish():
        def f(texts, part):
            cols = [[], [], [], []]
            whole = part.column("whole").to_pylist()
            for k, t in enumerate(texts):
                raw = t.encode("utf-8", "surrogatepass")
                if whole[k]:
                    gone = len(raw) >= width
                    row = (len(raw), len(raw) * gone, int(gone), b"" if gone else raw)
                elif not (marks := part.column("marks")[k]).is_valid:
                    row = (len(raw), 0, 0, raw)
                else:
                    a, w, bits = (marks.values.field(c) for c in ("a", "w", "bits"))
                    a, w = a.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
                    some = bits.is_valid().to_numpy(zero_copy_only=False)
                    first, last = [a[~some]], [a[~some] + w[~some] + width - 1]
                    for i in np.flatnonzero(some):
                        on = np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_buffer(), np.uint8), count=w[i])) + a[i]
                        first.append(on)
                        last.append(on + width)
                    edge = np.bincount(np.concatenate(first), minlength=len(raw) + 1) - np.bincount(np.concatenate(last), minlength=len(raw) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    row = (len(raw), len(raw) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return {"n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.binary())}

        return f

    return map_texts(full, finish, [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())], rows=256).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
