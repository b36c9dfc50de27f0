"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Each token has a fixed sparse ternary index vector; its word vector is the sum of the index vectors of
its neighbours over all documents, gathered as one fixed-size matrix for each task. A document's pool
(mean, spread and step between neighbours of its word vectors) feeds the network, whose probabilities
a temperature calibrates on rows kept out of training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import map_texts, one_text

#: Buckets that words are hashed to, width of a vector, nonzero entries of an index vector.
BUCKETS, WIDTH, NONZERO = 1 << 16, 32, 4
#: At most so many labelled rows of each label fit the network.
TRAIN_ROWS = 3000
#: Tokens that are counted at once.
SLICE = 1 << 20
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Ids(dict):
    """Bucket of a token, by the token itself."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return out


def token_ids(text: str | None, ids: _Ids) -> np.ndarray:
    return np.array([ids[w] for w in _TOKEN.findall(text or "")], np.int64)


def _index() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (BUCKETS x WIDTH) over every text; the driver sums one matrix row for each bucket."""

    end = np.array([-1])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = _index()
        ids, total = _Ids(), np.zeros(BUCKETS * WIDTH)

        def add(runs: list[np.ndarray]) -> None:
            nonlocal total
            x = np.concatenate(runs)
            a, b = x[:-1], x[1:]
            ok = (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            for me, other in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total += np.bincount(me * WIDTH + at[other, k], weights=sign[other, k], minlength=len(total))

        # Counting costs a pass over the matrix, so texts wait until they have SLICE tokens, across batches.
        runs, n = [end], 0
        for part in parts:
            for text in part.column(0):
                x = token_ids(text.as_py(), ids)
                runs += (x, end)
                n += len(x) + 1
                if n >= SLICE:
                    add(runs)
                    runs, n = [end], 0
        add(runs)
        m = total.reshape(BUCKETS, WIDTH)
        rows = np.flatnonzero(m.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(m[rows].astype(np.float32)), pa.list_(pa.float32()))], ["bucket", "v"])

    parts = docs.select("text").mapInArrow(run, "bucket int, v array<float>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(WIDTH)]).alias("v")).toArrow()
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    if sums.num_rows:
        out[sums.column(0).to_numpy()] = np.array(sums.column(1).to_pylist())
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pool(text: str | None, vectors: np.ndarray, ids: _Ids) -> np.ndarray:
    x = token_ids(text, ids)
    if not len(x):
        return np.zeros(3 * WIDTH + 1, np.float32)
    v = vectors[x]
    step = np.abs(np.diff(v, axis=0)).mean(0) if len(x) > 1 else np.zeros(WIDTH, np.float32)
    return np.concatenate([v.mean(0), v.std(0), step, [np.log1p(len(x)) / 10]]).astype(np.float32)


class Net:
    """Two layers and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 32, steps: int = 1500):
        rng = np.random.default_rng(3)
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        z, t = (x[~held] - self.mean) / self.scale, y[~held]
        p = [rng.normal(0, 0.1, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
        m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for k in range(1, steps + 1):
            i = rng.integers(0, len(t), 256)
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t[i]) / len(i)
            dh = d[:, None] * p[2] * (1 - h * h)
            for j, g in enumerate((z[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d, d.sum(keepdims=True))):
                m[j] = 0.9 * m[j] + 0.1 * g
                s[j] = 0.999 * s[j] + 0.001 * g * g
                p[j] = p[j] - 0.01 * (m[j] / (1 - 0.9**k)) / (np.sqrt(s[j] / (1 - 0.999**k)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            logit, t = self.logits(x[held]), y[held]
            loss = lambda c: np.mean(np.logaddexp(0, np.where(t > 0, -logit, logit) / c))
            self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` with score: the probability that quality is 1, from the text alone.

    `labels` (doc_id, label) may hold any rows that may be learned from; those of null label or id are
    left out. At most `train_rows` of each label, the first by hash of doc_id, fit the network, each with one text, the first by
    hash if the id has several rows; a tenth of them calibrates it. Without both labels every score is the share of label 1 (0.5 without any).
    Null and empty texts are scored as documents without words, long ones whole. An id with several labels counts
    once for each; repeated rows score alike, a row each; other columns stay, but one named score gives way. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    ok = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    few = [ok.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for v in (0, 1)]
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def pooled():
        ids = _Ids()
        return lambda texts, _: {"pool": pa.array([pool(t, vectors.value, ids) for t in texts], pa.list_(pa.float32()))}

    rows = one_text(docs, few[0].unionByName(few[1]))
    train = map_texts(rows, pooled, [("pool", T.ArrayType(T.FloatType()))]).drop("text").toPandas()
    net, share = None, float(train.label.mean()) if len(train) else 0.5
    if train.label.nunique() > 1:
        train = train.sort_values("doc_id", kind="stable")
        held = np.array([xxhash.xxh32_intdigest(str(i)) % 10 == 0 for i in train.doc_id])
        x, y = np.stack(train.pool.to_numpy()), train.label.to_numpy(float)
        net = Net(x, y, held if 0 < held.sum() < len(y) / 2 else np.zeros(len(y), bool))
    model = spark.sparkContext.broadcast(cloudpickle.dumps(net))

    def score():
        ids, net = _Ids(), cloudpickle.loads(model.value)

        def f(texts, _):
            s = net.score(np.stack([pool(t, vectors.value, ids) for t in texts])) if net else np.full(len(texts), share)
            return {"score": pa.array(np.asarray(s, np.float64))}

        return f

    return map_texts(docs, score, [("score", T.DoubleType())], rows=256)
