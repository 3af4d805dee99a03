"""Operator 7 against brute force: fingerprints, covering, hot anchors, components."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from siltworks.llm import simhash
from tests.llm.fixtures import docs, key, rows


def brute_fp(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in (text or "").encode().decode().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_every_word_is_covered_once():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 500)
    home, _ = simhash.golay_steps()
    assert (simhash._syndrome(x ^ home[simhash._syndrome(x)]) == 0).all()
    assert max(int(h).bit_count() for h in home) == 3


def test_near_pairs_share_an_anchor():
    rng = random.Random(3)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 2)))
        at_home, _, _ = simhash.anchors(np.array([a], np.uint64).astype(np.int64))
        _, _, found = simhash.anchors(np.array([b], np.uint64).astype(np.int64))
        assert at_home[0] in found


def test_near_duplicates(spark):
    fp = {i: brute_fp(r[1]) for i, r in enumerate(rows())}
    comp = brute_components(set(fp.values()))
    least = {}
    for i, r in enumerate(rows()):
        if r[0] is not None:
            least[comp[fp[i]]] = min(r[0], least.get(comp[fp[i]], r[0]))
    want = sorted(((r[0], f"{fp[i]:016x}", least.get(comp[fp[i]])) for i, r in enumerate(rows())), key=key)
    assert sorted(map(tuple, simhash.near_duplicates(docs(spark)).collect()), key=key) == want


@pytest.mark.parametrize("hot", [2, 64])
def test_dense_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    got = {x: got.get(x, x) for x in signed}
    want = brute_components({x & (2**64 - 1) for x in signed})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({k & (2**64 - 1): v for k, v in got.items()}) == groups(want)


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long").selectExpr("least(a,b) a", "greatest(a,b) b")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def planted():
    """Texts, and copies of them with some words changed: similarities on both sides of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    line = [word() for _ in range(12)]  # in every long text
    texts = [None, "", " \n", "one two", "One  two", "one two three four five", "one two three four five six"]
    for n in [12, 40, 60, 100, 200, 400]:
        for _ in range(4):
            base = line * (n > 40) + [word() for _ in range(n)]
            texts += [" ".join(base), " ".join(base).upper()]
            for changes in (1, 2, 3, 5, 8, 16):
                copy = list(base)
                for i in rng.sample(range(n), min(n, changes)):
                    copy[i] = word()
                texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("sets", [1, 5000])
def test_similar_against_all_pairs(spark, monkeypatch, sets):
    monkeypatch.setattr(simhash, "ORDER_SETS", sets)
    texts = planted()
    s = [brute_sets(t) for t in texts]
    root = list(range(len(s)))
    far = 0
    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8:
                far += (brute_fp(texts[i]) ^ brute_fp(texts[j])).bit_count() > 2
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    assert far > 20  # pairs that the two bits of op7 leave apart
    least = {r: min(i for i, x in enumerate(root) if x == r) for r in root}
    data = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, data), 5, 0.8).collect()}
    assert got == {i: least[r] for i, r in enumerate(root)}
    kept = {r.doc_id for r in corpus_pipeline.unique(spark, docs(spark, data), "").collect()}
    assert kept == set(least.values())


def test_similar_empty(spark):
    assert simhash.similar(docs(spark, []), 5, 0.8).collect() == []


def test_one_row_of_each_group(spark):
    """Repeated rows, null ids and columns that clash: one whole row of each group stays."""
    text = "one two three four five six seven eight nine ten"
    data = [(1, text, "x"), (1, text, "y"), (None, text, "z"), (None, "alone in its group here now", "u"), (None, "alone in its group here now", "v"), (2, None, "e"), (3, "", "f"), (4, "quite another text than those", "g")]
    df = spark.createDataFrame(data, "doc_id long, text string, th string").withColumnsRenamed({"th": "doc"})
    df = df.selectExpr("*", "doc as th", "1 as n", "2 as root", "3 as component_id", "4 as _bad", "5 as _keep")
    got = simhash.one_of_each(df, 5, 0.8)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == [(False, 1), (False, 2), (False, 4)]
    assert [r.text for r in rows if r.doc_id is None] == ["alone in its group here now"]


def test_similar_links_by_fingerprints(spark):
    """SimHash itself gives candidates: sets of one fingerprint, and those of fingerprints within two bits; no others."""
    from siltworks.llm.simhash import shingle_set

    texts = planted()
    sets = [shingle_set((t or "").encode(), 5) for t in texts]
    fps = [simhash.set_fingerprint(x) for x in sets]
    for x, fp in zip(sets[:5], fps):
        bits = [2 * sum(int(h) >> b & 1 for h in x) > len(x) for b in range(64)]
        assert fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if bits[b])
    df = spark.createDataFrame([(i, fp) for i, fp in enumerate(fps)], "node long, fp long")
    got = {(r.a, r.b) for r in simhash.fingerprint_pairs(df).collect()}
    bits = lambda a, b: ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count()
    assert got and all(bits(a, b) <= 2 for a, b in got)
    first = {fp: fps.index(fp) for fp in fps}
    assert {(min(a, b), max(a, b)) for a in first.values() for b in first.values() if a < b and bits(a, b) <= 2} <= got
