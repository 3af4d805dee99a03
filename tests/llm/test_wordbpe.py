"""Operator 12 against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltworks.llm import wordbpe
from siltworks.llm.chunks import ChunkEncoder
from tests.llm.fixtures import docs, key, rows

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return wordbpe.Encoder(PATH)


def both(enc, texts):
    ids, cuts = ChunkEncoder(enc.encode, keep=50)(pa.array(texts, pa.string()))
    return [(ids[a:b].tolist(), enc.decode(ids[a:b]).decode()) for a, b in zip(cuts[:-1], cuts[1:])]


def library(tok, texts):
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    return [(i, tok.decode(i, skip_special_tokens=False)) for i in ids]


AWKWARD = ["", " ", "  ", "a  b\n\n c\t d   ", "\0", "a\0b \0 \0c", "don't we'll'S", "x<|endoftext|>y <|startoftext|> <|endoftext", "ΣΑΣ İstanbul ǅ ﬁ K Å", "á ẹ́ ́x", "  x\x85y\x1cz᠎ q​",
           "!" * 400, "ha" * 200, "é" * 90, "日本語 😀", "12345 ٣٤", "a" * 23, "a" * 24, "a" * 25, "\x0b\x0c"]


def test_awkward_texts(tok, enc):
    assert both(enc, AWKWARD) == library(tok, AWKWARD)
    rng = random.Random(4)
    parts = [*AWKWARD, "a", "th", "e", "'", " ", "\n", "s", "ing", "1", "ß", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(1500)]
    assert both(enc, texts) == library(tok, texts)


def test_every_character(tok, enc):
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [f"x{c}y z{c}" for c in every]
    assert both(enc, texts) == library(tok, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abceinorst'.,!1 \n\té\xa0"), max_size=60), min_size=1, max_size=5))
def test_any_text(tok, enc, texts):
    assert both(enc, texts) == library(tok, texts)


def by_merges(word, merges, suffix):
    """Each merge in order of rank, everywhere from the left: what the automaton is compiled from."""
    parts = [*word[:-1], word[-1] + suffix]
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_of_random_merges(seed):
    """Small alphabets, merges of equal halves and merges that no text ever needs included: all words up to 8 symbols."""
    rng = random.Random(seed)
    suffix = "</w>" if seed % 3 else ""
    tokens = [*"ab", *("ab"[i] + suffix for i in range(2) if suffix)]
    merges = []
    while len(merges) < 14:
        a, b = rng.choice([t for t in tokens if not suffix or not t.endswith(suffix)]), rng.choice(tokens)
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    auto = wordbpe.Automaton({t: i for i, t in enumerate(tokens)}, merges, suffix)
    words = [bin(n)[3:].replace("0", "a").replace("1", "b") for n in range(2, 512)]
    ids, size = auto.encode_many(words)
    at = 0
    for w, n in zip(words, size.tolist()):
        want = by_merges(w, merges, suffix)
        assert [tokens[i] for i in ids[at : at + n]] == want == [tokens[i] for i in auto.encode(w)]
        at += n


def test_merges_out_of_order():
    with pytest.raises(ValueError):
        wordbpe.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], "")


def test_long_text_is_cut_at_white_space(tok, enc, monkeypatch):
    monkeypatch.setattr(wordbpe, "BLOCK", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeé'  \n.") for _ in range(3000)), "x" * 300, "y" * 60 + " " * 70 + "z"]
    assert both(enc, texts) == library(tok, texts)


def test_queries(spark, tok):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {}
    for r in rows():
        i = tok.encode(r[1] or "", add_special_tokens=False).ids
        ids.setdefault(r[0], []).append((i, tok.decode(i, skip_special_tokens=False)))
    want = [(k, len(i), sha(" ".join(map(str, i)).encode()), sha(d.encode())) for k, v in ids.items() for i, d in v]
    assert sorted(map(tuple, wordbpe.digests(docs(spark)).collect()), key=key) == sorted(want, key=key)
    full = [(r.doc_id, json.dumps(r.ids), r.decoded) for r in wordbpe.encode_decode(docs(spark)).collect()]
    assert sorted(full, key=key) == sorted([(k, json.dumps(i), d) for k, v in ids.items() for i, d in v], key=key)
    assert wordbpe.digests(docs(spark, [])).collect() == []
