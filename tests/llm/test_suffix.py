"""Operator 4 against brute force, and its suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siltworks.llm import suffix
from tests.llm.fixtures import docs, key, rows


def brute(data, span=200):
    seen = Counter()
    for r in data:
        t = (r[1] or "").encode()
        seen.update(t[i : i + span] for i in range(len(t) - span + 1))
    out = []
    for r in data:
        t = (r[1] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0], len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_prefix_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(300)] + [b"abab" * 5] * 2
    groups = np.array([rng.randint(0, 2) for _ in strings])
    order, lcp = suffix.prefix_order(strings, groups, 20)
    told = [(groups[i], strings[i]) for i in order]
    assert told == sorted(told)
    assert lcp[1:].tolist() == [common(a, b) if g == h else 0 for (g, a), (h, b) in zip(told, told[1:])]


def test_maximal_repeats():
    """Each set that agrees on (left, right) bytes and, as a set, on no more on either side; all of its members."""
    rng = random.Random(5)
    n = 60
    lefts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    rights = [b"x" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    groups = np.array([rng.randint(0, 1) for _ in range(n)])
    expected = set()
    for g in (0, 1):
        own = [i for i in range(n) if groups[i] == g]
        for i in own:
            for left in range(len(lefts[i]) + 1):
                for right in range(1, len(rights[i]) + 1):
                    tail = lefts[i][len(lefts[i]) - left :]
                    members = [j for j in own if lefts[j].endswith(tail) and rights[j].startswith(rights[i][:right])]
                    if len(members) < 2 or left + right < 4:
                        continue
                    most = min(common(lefts[i][::-1], lefts[j][::-1]) for j in members), min(common(rights[i], rights[j]) for j in members)
                    if most == (left, right):
                        expected.add((left, right, tuple(members)))
    got = [(x, y, tuple(sorted(m.tolist()))) for x, y, m in suffix.maximal_repeats(lefts, rights, groups, 4)]
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("hot", [500, 1])
def test_deduplicate(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(9)
    para = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(90))
    extra = []
    for i in range(12):
        own = " ".join("".join(rng.choice("ghijkl") for _ in range(5)) for _ in range(60))
        lo = rng.randint(0, 150)
        extra.append((100 + i, own + para[lo : lo + rng.randint(190, 400)] + own[::-1], None, None, 0, "", 0, 0))
    extra.append((150, "periodic " * 80, None, None, 0, "", 0, 0))
    extra.append((151, "é" * 99 + "x" + para[:199] + "é" + para[:200], None, None, 0, "", 0, 0))
    data = rows() + extra
    got = suffix.deduplicate(docs(spark, data)).collect()
    assert sorted(map(tuple, got), key=key) == brute(data)


def test_repeated_rows_are_one_context(spark, monkeypatch):
    """Very many copies of a row and a near copy: no gram comes to an array with more places than kinds of context."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("mnopqr") for _ in range(5)) for _ in range(60))
    tables = {}
    plain = suffix.written
    monkeypatch.setattr(suffix, "written", lambda df, label: tables.setdefault(label, plain(df, label)))
    monkeypatch.setattr(suffix, "discard", lambda *tables: None)
    row = lambda i, t: (i, t, None, None, 0, "", 0, 0)
    data = [row(1, text)] * 5000 + [row(2, text[:250] + "Z" + text[251:])]
    got = sorted(map(tuple, suffix.deduplicate(docs(spark, data)).collect()), key=key)
    few = brute([row(1, text)] * 2 + [row(2, text[:250] + "Z" + text[251:])])
    assert got == sorted([few[0]] * 4999 + few[1:], key=key) and len(got) == 5001
    assert 0 < tables["contexts"].groupBy("gram").count().agg({"count": "max"}).first()[0] <= 3


def test_empty(spark):
    assert suffix.deduplicate(docs(spark, [])).collect() == []


def test_frequent_grams_alone_make_no_windows(spark, monkeypatch):
    """A phrase in many texts that have nothing else in common costs no windows; a longer repeat around it is still found."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase = noise(150)
    passage = noise(60) + phrase + noise(60)
    texts = [noise(300) + phrase + noise(300) for _ in range(40)] + [noise(50) + passage + noise(70), passage + noise(10)]
    seen = {}
    old = suffix.written

    def written(df, label):
        seen[label] = out = old(df, label)
        seen[label + " rows"] = out.count()
        return out

    monkeypatch.setattr(suffix, "written", written)
    monkeypatch.setattr(suffix, "HOT", 2)
    got = {r.doc_id: r.n_removed for r in suffix.deduplicate(docs(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])).collect()}
    want = [0] * 40 + [len(passage)] * 2
    assert [got[i] for i in range(42)] == want
    assert seen["contexts rows"] > 40 and seen["windows rows"] <= 2 * (len(passage) - suffix.SPAN + 1) * 3
