"""Operators 1 and 10 against brute force."""

import re
import zlib
from collections import Counter, defaultdict

from siltworks.llm import quality, shards
from tests.llm.fixtures import docs, key, rows


def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_counts(spark):
    got = quality.quality(docs(spark)).collect()
    assert len(got) == len(rows())
    want = defaultdict(list)
    for r in rows():
        want[r[0]].append(brute_counts(r[1]))
    for r in got:
        c = want[r.doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c, r.doc_id
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r.base_failed and r.kept)


def own(i):
    return " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{k // 26 * 'q'}" for k in range(40))


def test_boilerplate_depletes(spark):
    menu = "home about contact imprint\nall rights are reserved by us"
    data = [(i, menu if i < 30 else f"{menu}\n" + own(i), None, "h", 0, "", 0, 0) for i in range(60)]
    data += [(100 + i, f"{menu}\n" + own(i), None, "other", 0, "", 0, 0) for i in range(5)]
    got = {r.doc_id: r for r in quality.quality(docs(spark, data)).collect()}
    assert got[0].left_share == 0 and not got[0].kept
    assert 0 < got[40].left_share < 1 and got[40].kept
    assert got[101].left_share == 1 and got[101].kept  # five documents are below the limit


def test_empty(spark):
    assert quality.quality(docs(spark, [])).collect() == []
    assert shards.shard_by_bytes(docs(spark, [])).collect() == []


def test_shards(spark):
    got = sorted(shards.shard_by_bytes(docs(spark)).collect(), key=lambda r: key((r.shard, r.slot)))
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()), key=key)
    assert [(r.doc_id, r.size, r.text_crc32) for r in got] == want  # shards and slots follow the order of ids
    total, before = sum(x[1] for x in want), 0
    for r, x in zip(got, want):
        assert r.shard == min(7, (2 * before + x[1]) * 8 // (2 * total))
        before += x[1]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_balance_on_even_rows(spark):
    data = [(i, "x" * 99, None, None, 0, "", 0, 0) for i in range(803)]
    sizes = Counter()
    for r in shards.shard_by_bytes(docs(spark, data)).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 100
