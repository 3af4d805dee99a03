"""Operator 13 against a plain loop over every entry in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from siltworks.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def brute(rows, parts, entries, rounds):
    width = max((len(v) for _, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), default=0)
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    size = width // parts
    first = sorted(range(len(kept)), key=lambda i: ((kept[i][0] is None, kept[i][0] or 0), kept[i][1]))[:entries]
    cut = lambda x, p: x[p * size : (p + 1) * size]
    books = [[cut(ints[i], p) for i in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(p):
        return [min(range(len(books[p])), key=lambda k: (away(cut(x, p), books[p][k]), k)) for x in ints]

    for _ in range(rounds):
        for p in range(parts):
            of = assign(p)
            for k in set(of):
                mine = [cut(x, p) for x, o in zip(ints, of) if o == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [assign(p) for p in range(parts)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(away(cut(x, p), books[p][final[p][i]]) for p in range(parts)) for i, x in enumerate(ints)]
    out = []
    for i, (vec, _, lab) in enumerate(kept):
        total = sum(e for e, k in zip(errors, kept) if k[2] == lab)
        out.append((vec, "".join(f"{final[p][i]:02x}" for p in range(parts)), min(errors[i], codes.LARGEST), min(total, codes.LARGEST), sha))
    return out


def f32(x):
    return float(np.float32(x))


def table(n, width, seed, spread=0.3, huge=False):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, i - 1]), [f32(rng.gauss(0, spread)) for _ in range(width)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(1, None, 1), (2, [f32(0.5)] * (width - 1) + [None], 1), (3, [float("nan")] * width, 2), (4, [float("inf")] + [0.0] * (width - 1), 2), (5, [], None), (6, [1.0], 1)]
    rows += [rows[7], rows[7], (None, [f32(-0.25)] * width, None)]
    if huge:
        rows += [(n + 9, [f32(3e38)] * width, 1), (n + 10, [f32(-2e20)] * width, 2), (n + 11, [f32(400000.3)] * width, 1)]
    return rows


@pytest.mark.parametrize(("n", "width", "entries", "spread", "huge"), [(300, 8, 32, 0.3, False), (60, 16, 256, 1.0, False), (200, 8, 16, 0.002, False), (90, 8, 8, 5000.0, False), (70, 4, 16, 0.3, True)])
def test_against_plain_loop(spark, n, width, entries, spread, huge):
    rows = table(n, width, n, spread, huge)
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = codes.compress(df, entries=entries, rounds=4)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: ((r[0] is not None, r[0]), *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 4, entries, 4), key=key)


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_annulus_keeps_ties_and_prunes(kind):
    rng = np.random.default_rng(3)
    book = np.concatenate([rng.integers(-9, 9, (60, 3)), rng.integers(-900, 900, (60, 3))])
    book[70] = book[3]
    x = np.concatenate([rng.integers(-9, 9, (500, 3)), rng.integers(-900, 900, (500, 3)), book])
    annuli = codes.Annuli(book.astype(kind))
    index, least = annuli.nearest(x.astype(kind))
    dist = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert index.tolist() == dist.argmin(axis=1).tolist()
    assert [int(v) for v in least] == dist.min(axis=1).tolist()
    assert annuli.evaluated < annuli.pairs


def test_empty_and_uneven(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA)).collect() == []
    assert [tuple(r)[:4] for r in codes.compress(spark.createDataFrame([(1, [], 1, "", 0)], SCHEMA)).collect()] == [(1, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "", 0)], SCHEMA))
