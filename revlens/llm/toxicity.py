"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its learned word vector, the mean of the learned vectors of its character n-grams and its
length. Both tables of vectors are trained with the network; a word's vector starts at its log odds. All overlapping windows of WINDOW words are
scored (one every STRIDE words); a text scores as its highest window does, and training follows each text's
highest window in turn.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import map_texts, one_text

#: Words of a window, words between the starts of neighbours, and units of the network in each direction.
WINDOW, STRIDE, HIDDEN = 16, 1, 8
#: Entries of a word's vector and of its n-grams' mean, the n-grams' lengths, and the inputs of the network.
WORD, CHAR, GRAMS = 4, 4, (3, 4, 5)
INPUTS = WORD + CHAR + 1
#: Character n-grams are hashed to so many bits.
GRAM_BITS = 17
#: At most so many labelled rows of each label fit the network; words and n-grams of fewer rows have no vector of their own.
TRAIN_ROWS, MIN_ROWS = 1500, 3
#: Words that one pass scores at once, and words whose gate inputs a worker keeps.
CHUNK, KEPT_WORDS = 1 << 12, 250_000
_EDGE = "&%$#*!|.,;:?\"'()[]{}<>-_"


def _word(raw: str) -> str:
    return raw.lower().strip(_EDGE)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(which word, bucket) of the character n-grams of words, edges marked: all words at once."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    x = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x))  # code points from here to the word's end
    whose, bucket = [], []
    for n in GRAMS:
        h = np.full(max(len(x) - n + 1, 0), n, np.uint64)
        for i in range(n):
            h = (h ^ x[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = left[: len(h)] >= n
        whose.append(of[: len(h)][inside])
        bucket.append((h[inside] >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
    return np.concatenate(whose), np.concatenate(bucket)


class Vocabulary:
    """Rows of the two tables for the words and (hashed) character n-grams that stand in MIN_ROWS training texts or more; row 0 is for all others."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        words, known = [Counter(), Counter()], {}
        held = np.zeros(1 << GRAM_BITS, np.int64)
        for t, label in zip(texts, labels, strict=True):
            own = {_word(r) for r in t.split()} - {""}
            words[int(label)].update(own)
            if fresh := sorted(own - known.keys()):
                whose, bucket = grams(fresh)
                known |= dict(zip(fresh, np.split(bucket[np.argsort(whose, kind="stable")], np.cumsum(np.bincount(whose, minlength=len(fresh)))[:-1]), strict=True))
            if own:
                held[np.unique(np.concatenate([known[w] for w in own]))] += 1
        names = sorted(w for w, n in (words[0] + words[1]).items() if n >= MIN_ROWS)
        self.words = {w: i for i, w in enumerate(names, 1)}
        # Log odds of the label by the words' texts, small for rare words: where a word's vector starts.
        one, zero = (np.array([0, *(words[v][w] for w in names)], np.float64) for v in (1, 0))
        ones = np.sum(np.asarray(labels) == 1)
        self.odds = ((np.log((one + 1) / (ones + 2)) - np.log((zero + 1) / (len(texts) - ones + 2))) * (one + zero) / (one + zero + 4)).astype(np.float32)
        self.odds[0] = 0
        often = held >= MIN_ROWS
        self.buckets = np.where(often, np.cumsum(often), 0).astype(np.int32)
        self.n_grams = int(often.sum())

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the words, which word each known n-gram is of, rows of the n-grams, lengths as an input)."""
        whose, bucket = grams(words)
        row = self.buckets[bucket]
        return np.array([self.words.get(w, 0) for w in words], np.int64), whose[row > 0], row[row > 0], np.minimum(np.array([len(w) for w in words], np.float32), 20) / 20


class Tokens(dict):
    """Numbers of the words met so far; number 0 pads."""

    def __init__(self):
        super().__init__()
        self.fresh, self.count = [], 1

    def __missing__(self, raw: str) -> int:
        self.fresh.append(_word(raw))
        self[raw] = n = self.count
        self.count += 1
        return n

    def take(self) -> list[str]:
        """The words that are new since the last call, in the order of their numbers."""
        out, self.fresh = self.fresh, []
        return out


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    def __init__(self, odds: np.ndarray, grams: int):
        rng, h = np.random.default_rng(7), HIDDEN
        r = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", r(INPUTS, 3 * h)), ("U", r(h, 2 * h)), ("V", r(h, h)), ("c", np.zeros(3 * h, np.float32)))} | {"a": r(2 * h), "o": r(2 * h), "z": np.zeros(1, np.float32)}
        self.words, self.grams = r(len(odds), WORD), r(grams, CHAR)
        self.words[:, 0] = odds
        self.words[0] = self.grams[0] = 0

    def inputs(self, word: np.ndarray, whose: np.ndarray, grams: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Input vectors of words from Vocabulary.rows()."""
        n, out = len(word), np.empty((len(word), INPUTS), np.float32)
        out[:, :WORD], out[:, -1] = self.words[word], length
        many = np.maximum(np.bincount(whose, minlength=n), 1)
        for j in range(CHAR):
            out[:, WORD + j] = np.bincount(whose, weights=self.grams[grams, j], minlength=n) / many
        return out

    def forward(self, x: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows (n, WINDOW, INPUTS), of whose words those marked `real` (n, WINDOW) count; with keep, also what backward() needs."""
        p, h, n = self.p, HIDDEN, len(x)
        states, tape = np.empty((n, WINDOW, 2 * h), x.dtype), {}
        for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            s, g, tape[d] = np.zeros((n, h), x.dtype), x @ p[f"W{d}"] + p[f"c{d}"], []
            for t in steps:
                zr = _sig(g[:, t, : 2 * h] + s @ p[f"U{d}"])
                z, r = zr[:, :h] * real[:, t, None], zr[:, h:]
                c = np.tanh(g[:, t, 2 * h :] + (r * s) @ p[f"V{d}"])
                new = s + z * (c - s)
                if keep:
                    tape[d].append((t, s, z, r, c))
                s = new
                states[:, t, h * (d == "b") : h * (d == "b") + h] = s
        w = np.exp(np.clip(states @ p["a"], -30, 30)) * real
        w /= np.maximum(w.sum(1, keepdims=True), 1e-20)
        ctx = (w[:, :, None] * states).sum(1)
        out = ctx @ p["o"] + p["z"]
        return (out, (states, tape, w, ctx)) if keep else out

    def backward(self, x: np.ndarray, real: np.ndarray, kept, d_out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs."""
        (states, tape, w, ctx), p, h = kept, self.p, HIDDEN
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["z"][0] = ctx.T @ d_out, d_out.sum()
        d_ctx = d_out[:, None] * p["o"]
        d_w = (states * d_ctx[:, None]).sum(2)
        d_e = w * (d_w - (w * d_w).sum(1, keepdims=True))
        g["a"] = np.einsum("nt,nth->h", d_e, states)
        d_states = w[:, :, None] * d_ctx[:, None] + d_e[:, :, None] * p["a"]
        dx = np.zeros_like(x)
        for d in "fb":
            ds = np.zeros((len(x), h), x.dtype)
            for t, s, z, r, c in reversed(tape[d]):
                ds = ds + d_states[:, t, h * (d == "b") : h * (d == "b") + h]
                dq = ds * z * (1 - c * c)
                drs = dq @ p[f"V{d}"].T
                # A word that doesn't count has z = 0, and its gates get no gradient.
                dzr = np.concatenate([ds * (c - s) * z * (1 - z), drs * s * r * (1 - r)], 1) * real[:, t, None]
                dg = np.concatenate([dzr, dq], 1)
                g[f"W{d}"] += x[:, t].T @ dg
                g[f"c{d}"] += dg.sum(0)
                g[f"U{d}"] += s.T @ dzr
                g[f"V{d}"] += (r * s).T @ dq
                dx[:, t] += dg @ p[f"W{d}"].T
                ds = ds * (1 - z) + drs * r + dzr @ p[f"U{d}"].T
        return g, dx

    def fit(self, rows: tuple[np.ndarray, ...], ids: np.ndarray, place: np.ndarray, of: np.ndarray, y: np.ndarray, rounds: int = 8, steps: int = 60, size: int = 128):
        """Train on the windows of texts `of` with labels y that start at `place` of `ids`; `rows` are Vocabulary.rows() of the words from number 0."""
        word, whose, flat, length = rows
        flat = flat[np.argsort(whose, kind="stable")]
        sizes = np.bincount(whose, minlength=len(word))
        begin = np.cumsum(sizes) - sizes
        rng, k = np.random.default_rng(9), 0
        m = {a: np.zeros_like(v) for a, v in self.p.items()}
        v = {a: b.copy() for a, b in m.items()}
        seen = [np.full(len(self.words), 1e-6, np.float32), np.full(len(self.grams), 1e-6, np.float32)]
        start = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
        for turn in range(rounds):
            if turn == 0:  # at first the window with the word that speaks loudest stands for its text, then the network's highest
                loud = np.append(self.words[word, 0][ids], np.zeros(WINDOW, np.float32))
                loud = np.lib.stride_tricks.sliding_window_view(loud, WINDOW)[place].max(1)
                top = np.lexsort((-loud, of))[start]
            elif turn % 2 == 0:
                gates = self.gates(self.inputs(word, np.repeat(np.arange(len(word)), sizes), flat, length))
                got = np.concatenate([self.sweep(gates, ids[i : i + CHUNK + WINDOW])[: CHUNK // STRIDE] for i in range(0, len(ids), CHUNK)])
                top = np.lexsort((-got[place // STRIDE], of))[start]
            for _ in range(steps):
                i = rng.integers(0, len(y), size)
                got = ids[place[top[i]][:, None] + np.arange(WINDOW)]
                mine, to = np.unique(got, return_inverse=True)
                to = to.reshape(got.shape)
                own = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[mine], sizes[mine], strict=True)]).astype(np.int64)
                grams = flat[own]
                x = self.inputs(word[mine], np.repeat(np.arange(len(mine)), sizes[mine]), grams, length[mine])[to]
                # Some words show only their letters, so that the n-grams learn too.
                hide = rng.random(got.shape) < 0.2
                x[hide, :WORD] = 0
                real = (got > 0).astype(np.float32)
                out, kept = self.forward(x, real, True)
                rate, k = 1 - k / (rounds * steps), k + 1
                g, dx = self.backward(x, real, kept, ((_sig(out) - y[i]) / size).astype(np.float32))
                for a, b in g.items():
                    m[a] = 0.9 * m[a] + 0.1 * b
                    v[a] = 0.999 * v[a] + 0.001 * b * b
                    self.p[a] = (self.p[a] - 0.02 * rate * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
                # The tables: only rows of words in the batch move, by their summed gradient (Adagrad).
                dx[hide, :WORD] = 0
                each = np.zeros((len(mine), INPUTS), np.float32)
                np.add.at(each, to.ravel(), dx.reshape(-1, INPUTS))
                for table, total, at_, grad in ((self.words, seen[0], word[mine], each[:, :WORD]), (self.grams, seen[1], grams, np.repeat(each[:, WORD : WORD + CHAR] / np.maximum(sizes[mine], 1)[:, None], sizes[mine], axis=0))):
                    row, back = np.unique(at_, return_inverse=True)
                    d = np.zeros((len(row), table.shape[1]), np.float32)
                    np.add.at(d, back, grad)
                    total[row] += (d * d).mean(1)
                    table[row] -= rate * (0.2 * d / np.sqrt(total[row])[:, None] + 1e-3 * table[row]) * (row > 0)[:, None]

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to all gates of both directions, one column for each gate, then the states after them as a window's first word: computed once a word. Signs and factors are those of sweep()."""
        h = HIDDEN
        sign = np.repeat([-1.0, -1.0, -2.0], h)
        out = np.concatenate([(x @ self.p[f"W{d}"] + self.p[f"c{d}"]) * sign for d in "fb"], axis=1).astype(np.float32)
        with np.errstate(over="ignore"):
            e = 1 + np.exp(out)
        return np.concatenate([out, *((2 / e[:, i + 2 * h : i + 3 * h] - 1) / e[:, i : i + h] for i in (0, 3 * h))], axis=1)

    def sweep(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of the windows that start at every STRIDE-th of `ids`, the same as forward() of these windows.

        All windows take a step together: step t of window k meets word k * STRIDE + t, so a step's words are one
        slice of each residue's words. The pooled sum is kept as two numbers a window, so no states are stored.
        Number 0 pads: its row of `gates` is set so that a state stays as it is.
        """
        h, n = HIDDEN, len(ids) // STRIDE
        gates[0] = 0
        gates[0, :h] = gates[0, 3 * h : 4 * h] = 1e30
        ids = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
        words = [gates[ids[r::STRIDE]].T.copy() for r in range(STRIDE)]  # (gates, windows and more)
        real = [(ids[r::STRIDE] > 0).astype(np.float32) for r in range(STRIDE)]
        there = lambda t: slice(t // STRIDE, t // STRIDE + n)
        pool = np.empty((2, WINDOW, 2, n), np.float32)
        pre, q, rs = (np.empty((k, n), np.float32) for k in (2 * h + 2, h, h))
        zr, z, r = pre[: 2 * h], pre[:h], pre[h : 2 * h]
        # Beyond what exp() holds a gate is shut: one over infinity.
        with np.errstate(over="ignore"):
            for d in (0, 1):
                name = "fb"[d]
                look = np.stack([self.p["a"][d * h : d * h + h], self.p["o"][d * h : d * h + h]]).astype(np.float32)
                u, v = np.concatenate([-self.p[f"U{name}"].T, look]).astype(np.float32), (-2 * self.p[f"V{name}"].T).astype(np.float32).copy()
                first, *steps = range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1)
                last, s = first, words[first % STRIDE][6 * h + h * d : 7 * h + h * d, there(first)].copy()
                for t in steps:
                    g = words[t % STRIDE][3 * h * d : 3 * h * d + 3 * h, there(t)]
                    np.matmul(u, s, out=pre)
                    pool[d, last], last = pre[2 * h :], t
                    zr += g[: 2 * h]
                    np.exp(zr, out=zr)
                    zr += 1
                    np.divide(s, r, out=rs)
                    np.matmul(v, rs, out=q)
                    q += g[2 * h :]
                    np.exp(q, out=q)
                    q += 1
                    np.divide(2, q, out=q)
                    q -= 1
                    q -= s
                    q /= z
                    s += q
                np.matmul(look, s, out=pool[d, last])
        e = np.clip(pool[0, :, 0] + pool[1, :, 0], -30, 30)
        np.exp(e, out=e)
        for t in range(WINDOW):
            e[t] *= real[t % STRIDE][there(t)]
        return (e * (pool[0, :, 1] + pool[1, :, 1])).sum(0) / np.maximum(e.sum(0), 1e-20) + self.p["z"][0]


def _starts(n: int) -> int:
    """How many windows cover n words: the last one holds the last word."""
    return 1 + max(0, -(-(n - WINDOW) // STRIDE))


def _room(n: int) -> int:
    """Places that n windows take: the next text begins at a multiple of STRIDE that none of them reaches."""
    return -(-((n - 1) * STRIDE + WINDOW) // STRIDE) * STRIDE


def windows(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' words (padded with 0), where in them the windows start, and which text each is of."""
    ids, place, of, size = [], [], [], 0
    for k, t in enumerate(texts):
        x = np.array([tokens[w] for w in t.split()], np.int32)
        n = _starts(len(x))
        x = np.pad(x, (0, _room(n) - len(x)))
        ids.append(x)
        place.append(size + STRIDE * np.arange(n))
        of += [k] * n
        size += len(x)
    return np.concatenate(ids), np.concatenate(place), np.array(of)


class Scorer:
    """Scores texts; the gate inputs of words stay from one call to the next."""

    def __init__(self, vocabulary: Vocabulary, net: Net):
        self.vocabulary, self.net = vocabulary, net
        self.clear()

    def clear(self) -> None:
        self.tokens = Tokens()
        self.gates = np.zeros((1 << 14, 8 * HIDDEN), np.float32)

    def learn(self) -> None:
        first = self.tokens.count - len(self.tokens.fresh)
        if first == self.tokens.count:
            return
        while self.tokens.count > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        self.gates[first : self.tokens.count] = self.net.gates(self.net.inputs(*self.vocabulary.rows(self.tokens.take())))

    def top(self, texts: list[str]) -> np.ndarray:
        """The highest logit of each text's windows. A long text goes through in parts of CHUNK words, which overlap by a window."""
        out = np.full(len(texts), -np.inf)
        ids, of, size = [], [], 0

        def done():
            nonlocal ids, of, size
            if ids:
                self.learn()
                got = self.net.sweep(self.gates, np.concatenate(ids))
                for k, at, n in of:
                    out[k] = max(out[k], got[at : at + n].max())
            ids, of, size = [], [], 0

        for k, t in enumerate(texts):
            if self.tokens.count > KEPT_WORDS:
                done()
                self.clear()
            words = t.split()
            total = _starts(len(words))
            step = CHUNK // STRIDE
            for a in range(0, total, step):
                n = min(step, total - a)
                part = words[a * STRIDE : (a + n - 1) * STRIDE + WINDOW]
                room = _room(n)
                of.append((k, size // STRIDE, n))
                own = np.zeros(room, np.int64)
                own[: len(part)] = list(map(self.tokens.__getitem__, part))
                ids.append(own)
                size += room
                if size >= CHUNK:
                    done()
        done()
        return out


def train(texts: list[str], y: np.ndarray) -> tuple[Vocabulary, Net]:
    vocabulary = Vocabulary(texts, y)
    net, tokens = Net(vocabulary.odds, vocabulary.n_grams + 1), Tokens()
    ids, place, of = windows(texts, tokens)
    net.fit(vocabulary.rows(["", *tokens.take()]), ids, place, of, y.astype(np.float32))
    return vocabulary, net


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` with score: the probability that the text is toxic, from the text alone.

    `labels` (doc_id, label) may hold any rows that may be learned from; null labels and ids are left out, an id
    with several labels counts once for each. At most `train_rows` of each label, the first by hash of doc_id, fit
    the network, each with one text, the first by hash if the id has several rows. Without both labels every score is the share of label 1 (0.5 without any). Null and empty texts
    score as one empty window; the highest window decides, so a clean rest of a text hides nothing. Very long texts
    go through in parts. Repeated rows score alike, a row each; other columns stay, but one named score gives way.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ok = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    few = [ok.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for v in (0, 1)]
    rows = one_text(docs, few[0].unionByName(few[1])).orderBy("doc_id", "label").toPandas()
    held, share = None, float(rows.label.mean()) if len(rows) else 0.5
    if rows.label.nunique() > 1:
        held = train([t or "" for t in rows.text], rows.label.to_numpy())
    model = spark.sparkContext.broadcast(cloudpickle.dumps(held))

    def make():
        got = cloudpickle.loads(model.value)
        scorer = Scorer(*got) if got else None

        def f(texts, _):
            s = np.full(len(texts), share)
            if scorer and len(texts):
                s = 1 / (1 + np.exp(-np.clip(scorer.top([t or "" for t in texts]), -50, 50)))
            return {"score": pa.array(s.astype(np.float64))}

        return f

    return map_texts(docs, make, [("score", T.DoubleType())], rows=512)
