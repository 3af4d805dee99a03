"""Operator 5: exact base, a proper distribution, gradients by differences, and better held-out scores than the base."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from siltworks.llm import lm
from siltworks.llm.common import table
from tests.llm.fixtures import docs, key, remainder, rows


def brute_tokens(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


@pytest.mark.parametrize("lexicon", [20, 100_000])
def test_base(spark, lexicon):
    data = rows()
    c = Counter(t for r in data if remainder(r[0], 5) != 1 for t in brute_tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in data:
        t = brute_tokens(r[1])
        want.append((r[0], remainder(r[0], 5) == 1, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    got = sorted((tuple(r) for r in lm.score(docs(spark, data), lexicon=lexicon, warm_tokens=3000).collect()), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 for g in got)


def small(distinct=340):
    words = [lm.END, *[f"w{i}".encode() for i in range(299)]]
    counts = np.array([1000 // (i + 1) + 1 for i in range(300)], np.float64)
    return lm.Lexicon(words, counts, int(counts.sum()) + 50, distinct)


def test_distribution_sums_to_one():
    lex = small()
    net = lm.Network(lex)
    context = [5, 17, 290, 300, 3]
    docs_ = [np.array([*context, k], np.int32) for k in range(301)]
    prefix = lm.score_texts(net, [np.array(context, np.int32)])[0]
    p = np.exp(lm.score_texts(net, docs_) - prefix)
    assert abs(p.sum() - 1) < 1e-4  # number 300 stands for all words outside the lexicon together


def by_hand(net, tokens):
    """The log-probability of one text, token by token, in plain loops."""
    w, lex, n = {k: v.astype(np.float64) for k, v in net.w.items()}, net.lex, lm.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    h, total = [0.0] * n, 0.0
    for t in tokens:
        logits = [sum(h[i] * w["wc"][i, c] for i in range(n)) + w["bc"][c] for c in range(lex.n_class)]
        cls = int(lex.cls[t])
        total += logits[cls] - math.log(sum(math.exp(x) for x in logits))
        if t < lex.head:
            inside = [sum(h[i] * w["wm"][cls, i, m] for i in range(n)) + w["bm"][cls, m] for m in range(lex.members)]
            total += inside[t % lex.members] - math.log(sum(math.exp(x) for x in inside))
        else:
            total += float(lex.share[t])
        x = w["inp"][lex.input[t]] + w["bias"]
        g = [sum(h[i] * w["rec"][i, j] for i in range(n)) for j in range(3 * n)]
        z, r = [sig(x[j] + g[j]) for j in range(n)], [sig(x[n + j] + g[n + j]) for j in range(n)]
        cand = [math.tanh(x[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * cand[j] for j in range(n)]
    return total


def test_head_grows_with_the_vocabulary():
    assert [small(n).most for n in (340, 100_000, 4_000_000)] == [256, 324, 2025]


@pytest.mark.parametrize("distinct", [340, 100_000, 200_000])
def test_scores_against_plain_loops(distinct):
    net = lm.Network(small(distinct), seed=9)
    rng = np.random.default_rng(3)
    lm.train_texts(lm.Trainer(net, 0.05), [rng.integers(0, 301, 40).astype(np.int32) for _ in range(30)])
    texts = [rng.integers(0, 301, n).astype(np.int32) for n in (1, 2, 17, 33, 90)]
    for got, t in zip(lm.score_texts(net, texts), texts):
        assert abs(got - by_hand(net, t.tolist())) < 1e-3 * len(t)


def test_gradients():
    lex = small()
    net = lm.Network(lex)
    rng = np.random.default_rng(0)
    tok = rng.integers(0, 301, (6, 4)).astype(np.int32)
    keep = np.ones((6, 4), np.float32)
    keep[0] = 0
    keep[3, 1] = 0
    h = np.zeros((4, lm.HIDDEN), np.float32)
    g, _ = net.gradients(tok, keep, h)
    loss = lambda: -float(net.score(tok, keep, h)[0].sum()) / tok.size
    for k in lm.Network.NAMES:
        i = tuple(int(x) for x in np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        old, e = net.w[k][i], 1e-2
        net.w[k][i] = old + e
        up = loss()
        net.w[k][i] = old - e
        down = loss()
        net.w[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-3, k


@pytest.mark.parametrize("lengths", [[40], [3], [2, *[50] * 99], [5 + i % 90 for i in range(300)], [1 + i % 40 for i in range(1000)], [*[30] * 20, 60_000]])
def test_every_training_token_is_learnt_from(lengths):
    rng = np.random.default_rng(2)
    net = lm.Network(small())
    texts = [rng.integers(0, 301, n).astype(np.int32) for n in lengths]
    assert lm.train_texts(lm.Trainer(net, 1e-4), texts) == sum(lengths)


def test_padding_gives_no_gradient():
    net = lm.Network(small())
    rng = np.random.default_rng(4)
    tok = rng.integers(0, 301, (6, 2)).astype(np.int32)
    keep = np.ones((6, 2), np.float32)
    keep[0] = 0
    on = np.ones((6, 2), bool)
    on[2:, 1] = False
    h = np.zeros((2, lm.HIDDEN), np.float32)
    g, _ = net.gradients(tok, keep, h, on)
    long, _ = net.gradients(tok[:, :1], keep[:, :1], h[:1])
    short, _ = net.gradients(tok[:2, 1:], keep[:2, 1:], h[:1])
    for k in lm.Network.NAMES:
        assert np.allclose(g[k] * 8, long[k] * 6 + short[k] * 2, atol=1e-5), k


def test_state_is_carried_over_windows():
    net = lm.Network(small())
    rng = np.random.default_rng(1)
    long = rng.integers(0, 301, 100).astype(np.int32)
    alone = lm.score_texts(net, [long])[0]
    among = lm.score_texts(net, [rng.integers(0, 301, 7).astype(np.int32), long, rng.integers(0, 301, 33).astype(np.int32)])[1]
    assert abs(alone - among) < 1e-2
    old, lm.WINDOW = lm.WINDOW, 100
    try:
        assert abs(lm.score_texts(net, [long])[0] - alone) < 1e-2
    finally:
        lm.WINDOW = old


def test_beats_base_on_held_out(spark):
    got = [r for r in lm.score(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty(spark):
    assert lm.score(docs(spark, [])).collect() == []


@pytest.mark.parametrize("learn", [True, False])
def test_base_where_the_end_is_rare_or_not_learnt(spark, learn):
    """A few long texts, all of whose words are more frequent than the end; and rows that are all held out."""
    ids = [i for i in range(200) if (remainder(i, 5) == 1) != learn][:4]
    data = [(i, " ".join(f"w{(j * k) % 40}" for j in range(1, 900)) + f" only{k} É", *[None] * 6) for k, i in enumerate(ids, 1)]
    data += [(next(i for i in range(200) if remainder(i, 5) == 1 and i not in ids), "w1 unseen W2", *[None] * 6)]
    c = Counter(t for r in data if remainder(r[0], 5) != 1 for t in brute_tokens(r[1]))
    n, v = sum(c.values()), len(c)
    tokens = {r[0]: brute_tokens(r[1]) for r in data}
    got = {r.doc_id: r for r in lm.score(docs(spark, data), lexicon=8, warm_tokens=500).collect()}
    for i, t in tokens.items():
        assert tuple(got[i])[1:5] == (remainder(i, 5) == 1, len(t), sum(c[x] > 0 for x in t), n)
        assert np.isclose(got[i].base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rtol=1e-9, atol=1e-9)
        assert np.isfinite(got[i].score) and got[i].score <= 0
