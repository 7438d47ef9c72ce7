"""The classifier's parts against plain loops."""

import re
import zlib

import numpy as np
import pytest

from chainloom.llm import quality_model as Q


def plain_tokens(text):
    return re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text)


def plain_bin(token):
    return zlib.crc32((("^" if len(token) > 1 and token.isupper() else "") + token.lower()).encode()) % Q.BINS


def plain_vectors(texts):
    """Sums of the index vectors of all tokens within the window, token by token, then of norm 1."""
    index, sums = Q.index_vectors().astype(int), {}
    for t in texts:
        bins = [plain_bin(w) for w in plain_tokens(t or "")]
        for i, b in enumerate(bins):
            total = sums.setdefault(b, np.zeros(Q.DIMS, int))
            for j in range(max(0, i - Q.WINDOW), min(len(bins), i + Q.WINDOW + 1)):
                if j != i:
                    total += index[bins[j]]
    return {b: v / max(np.linalg.norm(v), 1e-9) for b, v in sums.items()}


def plain_pooled(text, vectors):
    x = [vectors.get(plain_bin(w), np.zeros(Q.DIMS)) for w in plain_tokens(text or "")]
    if not x:
        return np.zeros(3 * Q.DIMS + 1)
    n = len(x)
    mean = sum(x) / n
    square = sum(v * v for v in x) / n
    pairs = sum((a * b for a, b in zip(x, x[1:])), np.zeros(Q.DIMS)) / n
    return np.r_[mean, square, pairs, np.log1p(n) / 10]


TEXTS = ["The cat sat. THE CAT", "", None, "one", "a b a b a b, 12 34_5!", "the dog (and cat) sat on 3 mats", "the dog (and cat) sat on 3 mats", "é世界 ok\n\nnew line"]


def test_vectors_and_pooling_equal_plain_loops(docs_of):
    docs = docs_of(list(enumerate(TEXTS))).repartition(3)
    from chainloom.llm.common import text_or_empty

    want = plain_vectors(TEXTS)
    got = Q.word_vectors(docs.select(text_or_empty("text")))
    assert set(np.flatnonzero(got.any(axis=1))) == {b for b, v in want.items() if v.any()}
    for b, v in want.items():
        assert got[b] == pytest.approx(v, abs=1e-6)
    for r in Q.features(docs, "doc_id", "text").collect():
        assert np.frombuffer(bytes(r.x), np.float32) == pytest.approx(plain_pooled(TEXTS[r.doc_id], want), abs=1e-5)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 7)), (rng.random(40) > 0.5).astype(float)
    net = Q.Network(x, y)
    z = (x - net.mean) / net.scale

    def loss():
        total = 0.0
        for row, label in zip(z, y):
            h = [np.tanh(sum(row[i] * net.p[0][i, k] for i in range(7)) + net.p[1][k]) for k in range(Q.HIDDEN)]
            logit = sum(a * b for a, b in zip(h, net.p[2])) + net.p[3][0]
            total += np.log1p(np.exp(-logit)) if label else np.log1p(np.exp(logit))
        return total / len(z) + 0.5e-4 * ((net.p[0] ** 2).sum() + (net.p[2] ** 2).sum())

    gradient = net._gradient(z, y)
    for q, g in zip(net.p, gradient):
        for _ in range(4):
            at, step = tuple(int(rng.integers(0, n)) for n in q.shape), 1e-5
            q[at] += step
            up = loss()
            q[at] -= 2 * step
            down = loss()
            q[at] += step
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_temperature_is_the_best_of_its_grid_on_rows_set_aside():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    net = Q.Network(x, y)
    aside = np.random.default_rng(3)
    aside.normal(0, 1, (5, Q.HIDDEN)), aside.normal(0, 1, Q.HIDDEN)  # the draws of the weights come first
    rows = aside.permutation(300)[:60]
    logits = net._logits((x - net.mean) / net.scale)[rows]
    losses = {t: np.mean([np.logaddexp(0, -v / t if label else v / t) for v, label in zip(logits, y[rows])]) for t in np.geomspace(0.25, 8, 61)}
    assert net.temperature == pytest.approx(min(losses, key=losses.get))
    assert net.scores(x) == pytest.approx(1 / (1 + np.exp(-net._logits((x - net.mean) / net.scale) / net.temperature)))
