"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each of `hashes` permutations gives two signature values, the minimum and the maximum. Bands of `rows`
values meet in buckets; documents of equal sets count as one there. Within a bucket, each member meets the
smallest id, then members that stay in different components are compared: pair by pair in small buckets,
in large ones in blocks, whose common shingles are counted together and which return a spanning forest of
their links. So no task holds a bucket and no more pairs than members leave a block. Links are exact:
100 * intersection >= percent * union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import SPACE_BYTES, Stored, connected, map_texts

_SPLIT = bytes.maketrans(SPACE_BYTES, b" " * len(SPACE_BYTES))
#: Buckets up to FEW members are compared pair by pair; larger ones in blocks of about so many members and bytes of sets.
FEW, BLOCK, BLOCK_BYTES = 16, 1024, 16 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_set(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, one of the whole sequence."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).lower().split(b" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > 400_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    x = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = min(width, len(x))
    h = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ x[i : len(x) - n + 1 + i]) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return np.unique(h ^ (h >> np.uint64(32)))


def min_max(s: np.ndarray, hashes: int) -> np.ndarray:
    """2 * hashes values of a set that isn't empty: the minima, then the maxima."""
    a = np.random.default_rng(11).integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)
    low, high = np.full(hashes, ~np.uint64(0)), np.zeros(hashes, np.uint64)
    for i in range(0, len(s), 1024):
        h = s[None, i : i + 1024] * a[:, None]
        h ^= h >> np.uint64(31)
        h *= _MIX[1]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, exact.

    Shingles of many sets are counted by a matrix product, the rest by walking along equal shingles, so
    the work follows what the sets share.
    """
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    of = np.diff(np.append(first, len(flat)))
    out = np.zeros((n, n), np.float32)
    often = of > max(8, n // 16)
    rows, cols = who[np.repeat(often, of)], np.repeat(np.arange(int(often.sum())), of[often])
    step = max(1, (1 << 22) // n)
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(cols, (lo, lo + step))
        m = np.zeros((n, step), np.float32)
        m[rows[a:b], cols[a:b] - lo] = 1
        out += m @ m.T
    rare = np.repeat(~often & (of > 1), of)
    v, w = flat[rare], who[rare]
    at = np.arange(len(v))
    for t in range(1, max(8, n // 16) + 1):
        at = at[at + t < len(v)]
        at = at[v[at] == v[at + t]]
        if not len(at):
            break
        np.add.at(out, (w[at], w[at + t]), 1)
        np.add.at(out, (w[at + t], w[at]), 1)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links that join the components of one group, a spanning forest of all its links."""
    ids, c = t.column("id").to_numpy(), t.column("c").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
    common = common_counts(sets).astype(np.int64)
    size = np.diag(common)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    label = np.unique(c, return_inverse=True)[1]
    found = []
    while True:
        best = np.where(linked, label[None, :], len(ids)).argmin(1)
        moved = np.flatnonzero(label[best] < label)
        if not len(moved):
            break
        up = np.arange(label.max() + 1)

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in moved:
            x, y = top(label[i]), top(label[best[i]])
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((int(ids[i]), int(ids[best[i]])))
        label = np.array([top(x) for x in range(len(up))])[label]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array([min(x) for x in zip(a, b, strict=True)], pa.int64()), "b": pa.array([max(x) for x in zip(a, b, strict=True)], pa.int64())})


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, hashes: int = 64, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, stays) for each row of `docs` (doc_id, text); other columns are left out.

    `kept` marks rows whose id is their component's; `stays` marks, of each component, rows of one id and one text
    (text_hash is xxhash64 of the text), and all rows that are linked with nothing.

    Null, empty and blank texts have no shingles and are linked with nothing; so are null ids, whose
    component is null and which are kept. Texts of equal sets are one node, whatever their ids; rows of one id with
    different texts are nodes of their own, and each is kept unless its component holds a smaller id. Bands miss a
    link at the threshold itself once in about 2e7. A set takes 8 bytes a word of a text and must fit a worker.
    An empty table gives an empty table.
    """
    store = Stored(docs.sparkSession)
    n_bands = 2 * hashes // rows

    def scan():
        known: dict[bytes, int] = {}

        def f(texts, _):
            found = [shingle_set(t, width, known) for t in texts]
            bands = [[xxhash.xxh3_64_intdigest(x.tobytes(), seed=k) for k, x in enumerate(min_max(s, hashes).reshape(n_bands, rows))] if len(s) else [] for s in found]
            return {
                "n_shingles": pa.array([len(s) for s in found], pa.int64()),
                "cls": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                "bands": pa.array([np.array(b, np.uint64).view(np.int64) for b in bands], pa.list_(pa.int64())),
            }

        return f

    fields = [("n_shingles", T.LongType()), ("cls", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]
    sized = store.put(map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), scan, fields, rows=512).drop("text"))
    # Texts of equal sets are one node: a number, the smallest id, the size.
    nodes = sized.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    nodes = store.put(nodes.withColumn("id", F.monotonically_increasing_id()))
    bands = store.put(sized.join(nodes.select("cls", "doc_id", "id"), ["cls", "doc_id"]).select("id", F.explode("bands").alias("band")))
    many = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("band", "n", "lead")
    shared = store.put(bands.join(many, "band"))
    store.drop(bands)
    # Only nodes that share a bucket need their sets again: texts of their ids, and of these the rows of their class.
    need = shared.select("id").distinct().join(nodes, "id")

    def whole():
        known: dict[bytes, int] = {}

        def f(texts, _):
            found = [shingle_set(t, width, known).tobytes() for t in texts]
            return {"s": pa.array(found, pa.binary()), "cls": pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary())}

        return f

    again = docs.select("doc_id", "text").join(need.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    full = map_texts(again, whole, [("s", T.BinaryType()), ("cls", T.BinaryType())], rows=256)
    full = store.put(full.join(need.select("cls", "doc_id", "id"), ["cls", "doc_id"]).select("id", "s"))
    sizes = nodes.select("id", "size")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links (a, b) among pairs (a, b). Members of one a, at most about 256 of them a group, meet its set in one stream."""
        groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
        member = pairs.join(groups, "a").join(full.withColumnRenamed("id", "b"), "b").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", "s")
        lead = groups.join(full.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "s")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None
            for part in parts:
                ok = []
                for a, b, x in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("s"), strict=True):
                    q = np.frombuffer(x.as_buffer(), np.uint64)
                    if b is None:
                        now, held = a, q.copy()
                        ok.append(False)
                        continue
                    assert a == now
                    common = len(np.intersect1d(held, q, assume_unique=True))
                    ok.append(100 * common >= percent * (len(held) + len(q) - common))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

        met = lead.unionByName(member).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return met.mapInArrow(run, "a long, b long")

    # Each member could link with the smallest of its buckets, where the sizes allow it.
    pairs = shared.where("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("times"))
    pairs = pairs.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b")
    pairs = store.put(pairs.where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")).select("a", "b", "times"))
    # First with the one that it shares most buckets with, then with those that are still in another component.
    best = pairs.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = store.put(confirm(best))
    labels = connected(store, links)
    of = lambda df, col, out: df.join(labels.select(F.col("id").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))
    apart = of(of(pairs.join(best, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    links = store.put(links.unionByName(confirm(store.put(apart))))
    labels = connected(store, links)
    # Then what these links leave apart: members of one bucket in different components.
    held = of(shared, "id", "c").join(full.select("id", F.octet_length("s").alias("bytes")), "id").select("band", "n", "id", "c", "bytes")
    split = held.groupBy("band").agg((F.min("c") != F.max("c")).alias("split"), F.sum("bytes").alias("all")).where("split").select("band", "all")
    open_ = store.put(held.join(split, "band"))
    # Small buckets give at most FEW - 1 pairs a row.
    few = open_.where(F.col("n") <= FEW).join(sizes, "id")
    other = few.select("band", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("size").alias("nb"))
    close = few.select("band", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("size").alias("na")).join(other, "band").where("a < b AND ca <> cb")
    close = close.where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    # Larger ones go through counts of common shingles, in groups of two blocks; every two blocks meet.
    k = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_BYTES), F.lit(2)).cast("int")
    mine = F.pmod(F.xxhash64("id"), k).cast("int")
    dealt = open_.where(F.col("n") > FEW).select("band", "id", "c", mine.alias("i"), F.explode(F.sequence(F.lit(0), k - 1)).alias("j")).where("i <> j")
    groups = dealt.select("band", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "id", "c").join(full, "id")
    dense = groups.groupBy("band", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "a long, b long")
    more = store.put(confirm(store.put(close)).unionByName(dense))
    store.drop(open_, shared)
    found = connected(store, links.unionByName(more))
    member = store.put(nodes.join(found, "id", "left").select("cls", "doc_id", F.coalesce("component", "id").alias("c")))
    first = member.groupBy("c").agg(F.min("doc_id").alias("component"))
    named = store.put(member.join(first, "c").select("cls", "c", "component"))
    # The smallest id of a component may stand in several rows, with texts that differ: the smallest hash stays.
    here = sized.select("doc_id", "cls", "text_hash").join(named.withColumnRenamed("component", "doc_id"), ["cls", "doc_id"])
    one = here.groupBy("c").agg(F.min("text_hash").alias("one"))
    named = named.join(one, "c").drop("c")
    out = sized.join(named, "cls", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    alone = F.col("cls").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", "component_id", "kept", "text_hash", (alone | (F.col("kept") & (F.col("text_hash") == F.col("one")))).alias("stays"))
