"""Operators 2, 6 and 8 by held-out accuracy and brute force, and the pipeline against its operators."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from siltworks.llm import langid, leaks, secrets
from siltworks.llm.common import table
from tests.llm.fixtures import SCHEMA, docs, key, remainder, rows


def test_language_held_out(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = langid.identify(d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and {r.doc_id for r in held} == {i for i in lang if remainder(i, 3) == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs(spark)).collect() if r.doc_id in (0, 1, 2, 13)}
    assert got == {(i, "und", 0.0) for i in (0, 1, 2, 13)}
    assert langid.identify(docs(spark, [])).collect() == []
    none = [(1, "some words", None, None, 0, "", 0, 0)]
    assert langid.identify(docs(spark, none)).first().lang_pred == "und"


def test_letters():
    """Numerals that are no letters say nothing; the same letters do."""
    rows = [("en", "the word and the other word " * 9), ("de", "das wort und das andere wort " * 9)]
    s = langid.Scorer(langid.Model.fit(rows))
    for t in ("\u00b2 \u00bd 3", "\u2167 \u2460", "12 _ !"):
        assert s([t]) == [("und", 0.0)]
    assert [x[0] for x in s(["the word \u00b2", "das\u00b2wort"])] == ["en", "de"]
    assert all(langid.words_of(c) == ([c.lower()] if c.isalpha() and c.lower().isalpha() else []) for c in map(chr, range(0x20, 0x3000)) if len(c.lower()) == 1)


def test_backoff_takes_the_longest():
    m = langid.Model.fit([("a", "abc abc abd"), ("b", "xyz xyz xyw")])
    grams = {i: g for g, i in m.grams.items()}
    found = [grams[i] for i in m.backoff("abcx")]
    assert found[0] == "^abc" and "abc" in found[1]
    s = langid.Scorer(m)
    assert [x[0] for x in s(["abc", "xyz", "abq", "xyq", "", None])] == ["a", "b", "a", "b", "und", "und"]


def brute_spans(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secret_base(spark):
    got = sorted(((r.doc_id, r.base_sha256) for r in secrets.scan(docs(spark)).collect()), key=key)
    want = sorted(((r[0], hashlib.sha256(brute_spans(r[1]).encode()).hexdigest()) for r in rows()), key=key)
    assert got == want
    assert secrets.scan(docs(spark, [])).collect() == []


def training_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    value = lambda: "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(24))
    out = []
    for i in range(80):
        body = [word() for _ in range(60)]
        if i % 2:
            body[30:30] = [rng.choice(["token", "secret", "password"]), "=", f'"{value()}"']
        out.append(" ".join(body))
    return out


def test_field_generalises():
    field = secrets.fit(training_texts())
    new = "kop lamo credential = \"Ab3dEf6hIj9kLm2nOp5qRs8t\" pam nolo"
    assert secrets.base_spans(new) == []
    found = [new[a:b] for a, b, k in secrets.spans(new, field) if k == "crf"]
    assert any("Ab3dEf6hIj9kLm2nOp5qRs8t" in f for f in found)
    assert secrets.spans("kop lamo pam nolo abc", field) == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        e, move = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        move[0, 2] = -1e9
        best = max(itertools.product(range(3), repeat=5), key=lambda p: move[0, p[0]] + e[0, p[0]] + sum(move[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))))
        assert tuple(secrets.viterbi(e, move)) == best


def test_short_decoding_is_exact():
    field = secrets.fit(training_texts())
    for t in training_texts()[:20]:
        tokens = secrets.TOKEN.findall(t)
        whole = secrets.viterbi(field.emissions(tokens, secrets.file_bits(t)), field.move)
        assert field.tags(tokens, secrets.file_bits(t)) == [(i, x) for i, x in enumerate(whole) if x]


def test_lcs():
    rng = random.Random(0)
    for _ in range(50):
        a, b = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(12)]
        d = [[0] * 13 for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert leaks.lcs(a, b) == d[-1][-1]


def test_leaks_against_containment(spark):
    sf = "/root/testdata/sf0.01"
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in leaks.find(d, b).collect()}
    texts = [(r.doc_id, r.text.lower()) for r in d.select("doc_id", "text").collect()]
    want = {(i, r.item_id) for r in b.collect() for i, t in texts if r.text.lower() in t}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.05 * len(want)


def test_paraphrase_and_edges(spark):
    rng = random.Random(2)
    item = ["".join(rng.choice("aeioklmnprst") for _ in range(6)) for _ in range(40)]
    near = [w for i, w in enumerate(item) if i % 9]  # every ninth word lost
    filler = ["".join(rng.choice("bcdfghjv") for _ in range(5)) for _ in range(200)]
    data = [(1, " ".join(filler[:80] + near + filler[80:]), *[None] * 6), (2, " ".join(filler), *[None] * 6), (3, None, *[None] * 6), (4, "", *[None] * 6)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = leaks.find(spark.createDataFrame(data, SCHEMA), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)]
    assert leaks.find(docs(spark, []), bench).collect() == []
    assert leaks.find(docs(spark), bench.limit(0)).collect() == []


def test_recall_by_length_and_edits(spark):
    """Items of 20 to 2,000 words, with 5 to 30 % of their words replaced, lost or doubled: at least 0.9 are found, by each share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioklmnprstuvd") for _ in range(7))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([20, 30, 40, 60, 64, 65, 100, 128, 200, 250, 450, 900, 2000])}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    filler = [word() for _ in range(3000)]
    data, of = [], {}
    for share in (0, 0.05, 0.1, 0.15):
        for i, x in items.items():
            body = []
            for w in x:
                roll = rng.random()
                body += [w] if roll >= share else [word()] if roll < share / 3 else [] if roll < 2 * share / 3 else [w, word()]
            doc = len(data)
            of[doc] = (share, i)
            at = rng.randrange(2000)
            data.append((doc, " ".join(filler[at : at + rng.randint(0, 300)] + body + filler[at + 400 : at + 600])))
    got = {(r.doc_id, r.item_id) for r in leaks.find(spark.createDataFrame([(*r, *[None] * 6) for r in data], SCHEMA), bench).collect()}
    assert all(of[d][1] == i for d, i in got)
    for share in (0, 0.05, 0.1, 0.15):
        want = [(d, i) for d, (s, i) in of.items() if s == share]
        assert sum(x in got for x in want) / len(want) >= 0.9, share


def test_slices_of_the_benchmark_change_nothing(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    pairs = lambda: {(r.doc_id, r.item_id) for r in leaks.find(d, b).collect()}
    whole = pairs()
    monkeypatch.setattr(leaks, "SLICE_ITEMS", 9)
    assert whole and pairs() == whole


def test_long_items(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioklmnprst") for _ in range(7))
    items = {n: [word() for _ in range(n)] for n in (65, 214, 500, 3000)}
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    filler = [word() for _ in range(700)]
    data = [(0, " ".join(filler))]
    for n, x in items.items():
        lost = [w for i, w in enumerate(x) if i % 9]
        for k, body in enumerate((x, lost, x[: n // 2])):  # whole, every ninth word lost, too little of it
            data.append((10 * n + k, " ".join(filler[: 77 + k] + body + filler[77 + k :])))
    got = leaks.find(spark.createDataFrame([(*r, *[None] * 6) for r in data], SCHEMA), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(10 * n + k, n) for n in items for k in (0, 1)]
    assert leaks.find(docs(spark), spark.createDataFrame([(1, "?!")], "item_id long, text string")).collect() == []


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    d = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, d, sf)
    assert kept.columns == d.columns and kept.count() >= 0.95 * d.count()
    one = stages["SimHash near-dedup"](spark, kept, sf)
    assert one.columns == d.columns and one.count() < kept.count()
    clean = stages["benchmark decontamination"](spark, one, sf)
    texts = {r.doc_id: r.text.lower() for r in one.collect()}
    bad = {i for i, t in texts.items() if any(r.text.lower() in t for r in table(spark, sf, "benchmark").collect())}
    assert {r.doc_id for r in clean.collect()} == set(texts) - bad
    masked = stages["secret scans"](spark, clean, sf).collect()
    assert all(brute_spans(r.text) == "" and r.n_chars == len(r.text) for r in masked if r.text is not None)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in masked}
    assert {r.doc_id: r.decoded_sha256 for r in out} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in masked}


@pytest.mark.parametrize("i", range(4))
def test_stages_take_empty_and_null_rows(spark, i):
    stage = corpus_pipeline.STAGES[i][1]
    for data in ([], rows()):
        assert stage(spark, docs(spark, data), "/root/testdata/sf0.001").columns == docs(spark, data).columns
        stage(spark, docs(spark, data), "/root/testdata/sf0.001").count()
