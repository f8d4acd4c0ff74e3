import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import lm_scoring as lm


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens) -> base scores."""
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b" end"] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for (doc_id, _), t, h in zip(rows, tokens, held, strict=True):
        out.append(((doc_id, h, len(t), sum(counts[w] > 0 for w in t), total), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)))
    return out


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score(docs).collect()


def test_base_scores(scored, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"]) for r in scored if r["doc_id"] is not None)
    expected = sorted(x for x in brute(rows) if x[0][0] is not None)
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], rel=1e-9)


def test_small_dictionary_gives_the_same_base(docs, rows, monkeypatch):
    """With most words in the tail."""
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (30,))
    got = Counter((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs.select("doc_id", "text")).collect())
    assert got == Counter((k[0], k[3], round(s, 6)) for k, s in brute(rows))


def test_model_beats_the_base_on_held_out_text(scored):
    held = [r for r in scored if r["held_out"] and r["n_tokens"] > 20]
    assert len(held) > 10 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in scored)


def network():
    r = np.random.default_rng(0)
    classes = r.integers(0, lm.CLASSES, 20)
    n = lm.Network(np.arange(20), classes, np.full(lm.CLASSES, 1 / lm.CLASSES))
    n.params[2] = r.normal(size=n.params[2].shape).astype(np.float32) * 0.5
    return n


def test_state_is_carried_across_windows(monkeypatch):
    """A document's log-likelihood is the same whatever the window and whatever lies beside it."""
    net, r = network(), np.random.default_rng(1)
    docs = [r.integers(0, 20, n).astype(np.uint16) for n in (5, 90, 1, 40, 40, 3)]

    def scores(width, many):
        s = lm.lay_out(docs, many)
        logs, h = np.zeros(s.ids.shape), np.zeros((lm.HIDDEN, s.ids.shape[1]), np.float32)
        for at, stop, n, given, keep, targets in lm._windows(s, net, width):
            states, h = net.window(given, keep, h[:, :n])
            logs[at:stop, :n] = net.log_classes(states, targets)[0]
        return [logs[at : at + n, k].sum() for k, at, n in s.places]

    one = scores(7, 1)
    assert scores(32, 3) == pytest.approx(one, rel=1e-4) and scores(1000, 6) == pytest.approx(one, rel=1e-4)


def test_gradient():
    """A step of learning changes the loss as finite differences say."""
    net, r = network(), np.random.default_rng(2)
    docs = [r.integers(0, 20, lm.TRAIN_WINDOW // 2).astype(np.uint16) for _ in range(6)]
    s = lm.lay_out(docs, 3)

    def loss(n):
        (_, _, k, given, keep, targets), *more = lm._windows(s, n, lm.TRAIN_WINDOW)
        assert not more
        return -n.log_classes(n.window(given, keep, np.zeros((lm.HIDDEN, k), np.float32))[0], targets)[0].mean()

    start = net.flat()
    slopes = [np.full(shape, 1e12, np.float32) for shape in net.shapes]  # so large that a step is the gradient scaled
    lm.learn(net, s, slopes, rate=1e3)
    step = net.flat() - start  # = -1e-3 * gradient * clipping
    net.load(start + 3 * step)
    up = loss(net)
    net.load(start - 3 * step)
    down = loss(net)
    slope = (up - down) / 6
    assert slope == pytest.approx(-float((step * step).sum()) * 1e3, rel=0.15)


def test_total_probability():
    net = network()
    states, _ = net.window(np.array([[3, 4]]), [None], np.zeros((lm.HIDDEN, 2), np.float32))
    _, probs, total = net.log_classes(states, np.zeros((1, 2), np.int64))
    assert (probs.sum(1) / total) == pytest.approx(1.0, rel=1e-5)


def test_empty_and_only_held_out(docs, empty, spark):
    assert lm.score(empty).count() == 0
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    got = lm.score(spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 5


def worded():
    """A network in which the words of a class have probabilities of their own."""
    r = np.random.default_rng(5)
    classes = np.concatenate([[0], r.integers(1, 4, 19)])
    n = lm.Network(np.arange(20), classes, np.full(lm.CLASSES, 1 / lm.CLASSES), np.arange(20) * 3)
    n.params[2] = r.normal(size=n.params[2].shape).astype(np.float32) * 0.5
    n.params[4] = r.normal(size=n.params[4].shape).astype(np.float32)
    return n


def test_words_of_a_class_sum_to_one_and_see_the_state():
    net = worded()
    states, _ = net.window(np.array([[3, 4]]), [None], np.zeros((lm.HIDDEN, 2), np.float32))
    each = np.array([net.log_words(states, np.full((1, 2), w))[0] for w in range(20)])
    for c in range(1, 4):
        assert np.exp(each[net.classes == c]).sum(0) == pytest.approx(1.0, rel=1e-5)
    assert (each[0] == 0).all() and not np.allclose(each[:, 0], each[:, 1])


def test_gradient_with_words(monkeypatch):
    monkeypatch.setattr(lm, "WORD_RATE", 1)
    net, r = worded(), np.random.default_rng(6)
    s = lm.lay_out([r.integers(0, 20, lm.TRAIN_WINDOW // 2).astype(np.uint16) for _ in range(6)], 3)

    def loss(n):
        ((at, stop, k, given, keep, targets),) = lm._windows(s, n, lm.TRAIN_WINDOW)
        states = n.window(given, keep, np.zeros((lm.HIDDEN, k), np.float32))[0]
        return -(n.log_classes(states, targets)[0] + n.log_words(states, s.ids[at:stop, :k])).mean()

    start = net.flat()
    lm.learn(net, s, [np.full(shape, 1e12, np.float32) for shape in net.shapes], rate=1e3)
    step = net.flat() - start
    net.load(start + 3 * step)
    up = loss(net)
    net.load(start - 3 * step)
    assert (up - loss(net)) / 6 == pytest.approx(-float((step * step).sum()) * 1e3, rel=0.15)


def test_counting_in_parts(docs, rows, monkeypatch):
    """Counts that a task hands on early add up to the same dictionary."""
    counts = lm.word_counts(docs)
    whole = lm.frequent_words(counts)
    monkeypatch.setattr(lm, "FLUSH", 5)
    assert lm.frequent_words(lm.word_counts(docs.repartition(7))) == whole
    expected = Counter(w for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()))
    assert whole == sorted(expected.items(), key=lambda x: (-x[1], x[0]))
