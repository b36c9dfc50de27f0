"""The network against the log odds that its word vectors start from."""

import random

import numpy as np
from revlens.llm import toxicity


def test_the_network_learns_what_words_alone_do_not_tell():
    """The label is the order of two words that stand in every text: sums of words' log odds are at chance, the network is not."""
    rng = random.Random(3)
    fill = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()

    def text(label):
        words = [rng.choice(fill) for _ in range(rng.randint(4, 10))]
        at = rng.randrange(len(words) + 1)
        return " ".join(words[:at] + (["not", "nice"] if label else ["nice", "not"]) + words[at:])

    y, held = np.arange(600) % 2, np.arange(300) % 2
    vocabulary, net = toxicity.train([text(v) for v in y], y)
    unseen = [text(v) for v in held]
    alone = np.array([sum(vocabulary.odds[vocabulary.words.get(w, 0)] for w in t.split()) for t in unseen])
    assert abs(((alone > np.median(alone)) == held).mean() - 0.5) < 0.1
    scores = toxicity.Scorer(vocabulary, net).top(unseen)
    assert ((scores > 0) == held).mean() > 0.95


def test_a_first_state_is_computed_once_a_word():
    """The table holds each word's state as a window's first word, so that no window computes it; padding changes no state, whatever its row held."""
    net, h = toxicity.Net(np.zeros(5, np.float32), 3), toxicity.HIDDEN
    x = np.random.default_rng(1).normal(0, 2, (40, toxicity.INPUTS)).astype(np.float32)
    x[3] *= 1e4  # gates beyond what exp() holds
    gates = net.gates(x)
    one = np.zeros((40, toxicity.WINDOW, toxicity.INPUTS), np.float32)
    one[:, 0] = x
    states = net.forward(one, np.eye(1, toxicity.WINDOW, dtype=np.float32).repeat(40, 0), True)[1][0]
    assert np.allclose(gates[:, 6 * h : 7 * h], states[:, 0, :h], atol=1e-5)
    ids = np.append(np.random.default_rng(2).integers(1, 40, 100), np.zeros(toxicity.WINDOW, np.int64))
    at = ids[np.arange(100)[:, None] + np.arange(toxicity.WINDOW)]
    assert np.allclose(net.sweep(gates, ids)[:100], net.forward(x[at], (at > 0).astype(np.float32)), atol=1e-4)
