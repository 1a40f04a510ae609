"""The convolution against a naive one, and what training adds to the start."""

import numpy as np
import pyarrow as pa

from catalograph.llm import toxicity as T


def _naive(model, ids):
    """The greatest response of each filter over all places of one text, zeros behind its end."""
    out = []
    for w, b in zip(model.filters, model.bias):
        best = np.zeros(w.shape[2])
        for i in range(len(ids)):
            z = b.astype(float).copy()
            for j in range(len(w)):
                row = model.embed[ids[i + j]] if i + j < len(ids) else model.embed[0]
                z += row @ w[j]
            best = np.maximum(best, z)
        out.append(best)
    return np.concatenate(out)


def test_convolution():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(words[k] for k in rng.integers(0, 50, n)) for n in (1, 2, 3, 40, 0, 7)] + ["unknown words only", None, "W1, w2.w3"]
    hashes, first = T.word_hashes(pa.array(texts))
    model = T.ToxicityModel.start(T.Lexicon(np.unique(hashes[: first[4]])), rng.normal(size=len(np.unique(hashes[: first[4]])) + 1), rng)
    for b in model.bias:
        b += rng.normal(0, 0.3, b.shape).astype(np.float32)
    ids = model.lexicon.rows(hashes)
    got = model.pooled(ids, first, model.tables())
    want = np.array([_naive(model, ids[a:b]) if b > a else np.zeros(got.shape[1]) for a, b in zip(first, first[1:])])
    assert np.allclose(got, want, atol=1e-5)
    naive = 1 / (1 + np.exp(-(want @ model.out + model.out_bias - model.thresholds[0])))
    assert np.allclose(model.scores(ids, first), naive, atol=1e-5)


def _loss(model, texts, labels):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = 1 / (1 + np.exp(-model.logits(model.lexicon.rows(np.concatenate(texts)), first)))
    return -np.mean(np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))), p


def test_training_adds_to_the_start(monkeypatch):
    """Toxic is `not` before `kind`, each of which is common alone: the log-odds of words that the filters start with can't tell."""
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(30)]

    def text(toxic):
        w = [plain[k] for k in rng.integers(0, 30, 20)]
        a, b = sorted(rng.choice(18, 2, replace=False))
        if toxic:
            w[a : a + 2] = ["not", "kind"]
        else:
            w[a], w[max(b, a + 2)] = "kind", "not"
        return " ".join(w)

    def sample(n):
        labels = (rng.random(n) < 0.4).astype(int)
        h, first = T.word_hashes(pa.array([text(x) for x in labels]))
        return [h[a:b] for a, b in zip(first, first[1:])], labels

    (texts, labels), (held, true) = sample(3000), sample(600)
    trained = T.fit(texts, labels, [None] * len(texts))
    monkeypatch.setattr(T, "EPOCHS", 0)
    start = T.fit(texts, labels, [None] * len(texts))
    (after, p), (before, q) = _loss(trained, held, true), _loss(start, held, true)
    auc = lambda s: np.mean([(s[true == 1][:, None] > s[true == 0][None, :]).mean()])
    assert after < 0.7 * before and auc(p) > 0.95 and auc(p) > auc(q) + 0.1
