"""Words, gradients and probabilities of a batch of texts equal those taken token by token."""

import random

import numpy as np
import pyarrow as pa

from wattloom.llm import maxent


def model_of(texts, rounds=1):
    counts = {}
    for w in (w for t in texts for w in [*(t or b"").lower().split(), maxent.END]):
        counts[w] = counts.get(w, 0) + 1
    words = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    rest = [w for w in counts if w not in words]
    masses, sizes = np.zeros(4), np.zeros(4)
    for w, b in zip(rest, maxent._buckets(rest, 4), strict=True):
        masses[b] += counts[w]
        sizes[b] += 1
    model = maxent.Model(words, words, [counts[w] for w in words], sum(counts.values()), len(counts), masses, sizes)
    model.weights += np.random.default_rng(1).normal(0, 0.3, model.weights.shape).astype(np.float32)
    return model


def test_words_are_those_of_bytes():
    texts = [None, b"", b"   ", b" a  B\ta\x0bc\x0cd\r\ne ", b"x", "É é y Z \x1c \x85".encode(), b"b a", b"\n"]
    distinct, codes, lengths = maxent.words_of(pa.array(texts, pa.binary()))
    want = [[*(t or b"").lower().split(), maxent.END] for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert [distinct[c].as_py() for c in codes.tolist()] == [w for own in want for w in own]
    assert len(maxent.words_of(pa.array([], pa.string()))[1]) == 0


def test_gradients_and_probabilities_are_those_of_single_tokens(monkeypatch):
    """A plain softmax down the tree, one step after another; chunks that cut texts change nothing."""
    rnd = random.Random(2)
    texts = [" ".join(f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randrange(40))).encode() for _ in range(60)]
    model = model_of(texts)
    _, lengths, ids, _, hashes = maxent._batch_ids(model, texts)
    u, mask = int, (1 << 64) - 1
    want, logs = np.zeros(model.weights.shape), []
    ends = np.cumsum(lengths)
    for i in range(len(ids)):
        start = ends[np.searchsorted(ends, i, side="right")] - lengths[np.searchsorted(ends, i, side="right")]
        b1, b2, b3 = (u(hashes[i - k]) if i - k >= start else 1 for k in (1, 2, 3))
        raw = [b1, b1 * u(maxent._Q) + b2 & mask, b2, b1 * u(maxent._Q) + b3 & mask]
        mixed = [(h ^ h >> 32) * u(maxent._P) + (k << 60) & mask for k, h in enumerate(raw, 1)]
        log = 0.0
        for s in range(model.first[ids[i]], model.first[ids[i] + 1]):
            node, child = int(model.node[s]), int(model.child[s])
            rows = [(((h ^ h >> 32) ^ ((node + 1) * u(maxent._Q) & mask)) * u(maxent._P) & mask) >> 32 for h in mixed]
            rows = [r * model.rows >> 32 for r in rows]
            z = model.bias[node].astype(float) + sum(model.weights[r].astype(float) for r in rows)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            log += np.log10(p[child])
            for r in rows:
                want[r] += (np.arange(maxent.CLASS) == child) - p
        logs.append(log)
    for chunk in (7, 100, 1 << 20):
        monkeypatch.setattr(maxent, "CHUNK", chunk)
        g = np.zeros_like(model.weights)
        model.add_gradient(g, ids, lengths, hashes)
        assert np.allclose(g, want, atol=1e-3)
        assert np.allclose(model.log10(ids, lengths, hashes), logs, atol=1e-4)


def test_looking_words_up_leaves_nothing_in_the_model():
    """Leaf, place and hash of words, frequent or not, each by itself; a worker's model does not grow with the words it meets."""
    model = model_of([b"a b c a b a", b"e f g h i j k l m n o p q r s t u v w x y z", b""])
    before = {k: len(v) for k, v in vars(model).items() if hasattr(v, "__len__")}
    words = [w for i in range(3000) for w in (b"a", maxent.END, b"new%d" % i)]
    leaf, place, h = model.look_up(words)
    assert {k: len(v) for k, v in vars(model).items() if hasattr(v, "__len__")} == before
    frequent = {int(k): i for i, k in enumerate(model.keys)}
    for w, own, at, key in zip(words, leaf.tolist(), place.tolist(), h.tolist(), strict=True):
        assert key == int(maxent._hash64([w])[0]) and at == frequent.get(key, len(model.keys))
        assert own == (model.vocabulary[w] if w in model.vocabulary else model.rare + int(maxent._buckets([w], model.buckets)[0]))


def test_gradient_of_blank_weights_reads_none():
    """The first round takes its probabilities from the tree; rows that hundreds of steps share add up as one by one."""
    model = model_of([b"a b c a b a " * 300, b"c b a"])
    texts = [b"a b " * 400, b"b", None]
    _, lengths, ids, _, hashes = maxent._batch_ids(model, texts)
    model.weights[:] = 0
    want, got = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for own, h in model.histories(hashes, lengths):
        _, child, rows, logits = model.steps(ids[own], h)
        p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        for r in rows:
            np.add.at(want, r, np.eye(maxent.CLASS, dtype=np.float32)[child] - p)
    model.weights[:] = np.nan
    model.add_gradient(got, ids, lengths, hashes, blank=True)
    assert np.allclose(got, want, atol=1e-2) and np.abs(want).max() > 100
