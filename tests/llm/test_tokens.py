"""Operators 3 and 9 against the libraries."""

import hashlib
import random
import zlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltworks.llm import bpe, idstore
from siltworks.llm.chunks import ChunkEncoder
from siltworks.llm.common import new_path
from tests.llm.fixtures import docs, key, rows

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH)[0], special_tokens={})


@pytest.fixture(scope="module")
def column():
    enc = bpe.Encoder(PATH, P.PATTERN)
    return ChunkEncoder(enc.encode, keep=50)


AWKWARD = ["", " ", "  ", "a  b\n\n c\t d   ", " x", "x ", "\n", "\nx", "a\n b", "a \nb", "é" * 300, "!" * 3000, "ab" * 500, "don't  we'll 'S 12345  x",
           "a\x1cb \x1c c", "a \xa0b", "日本語 😀", "x\x85y z", "\x01a b", "x\r\ny z", "hello world\nhello again"]


def one_by_one(column, texts):
    ids, cuts = column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]


def test_awkward_texts(tik, column):
    assert one_by_one(column, AWKWARD) == [tik.encode_ordinary(t) for t in AWKWARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ce'st.,1\n\t é\xa0\x1c"), max_size=40), min_size=1, max_size=5))
def test_any_text(tik, column, texts):
    assert one_by_one(column, texts) == [tik.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("as_text", [False, True])
def test_joined_chunks_and_special_strings(as_text):
    """The library's own ids for whole texts, the special token's string at any place included."""
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = as_text
    column = idstore.tokenizer_encoder(special_as_text=as_text)[1]
    rng = random.Random(5)
    parts = ["a", "word", " ", " ", "\n", "<|endoftext|>", "<|endoftext|", "don't", "12", ".%%%", "\t", "é", "\x1c", "  ", "日本"]
    texts = [*AWKWARD, *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500))]
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        assert one_by_one(column, some) == [tok.encode(t, add_special_tokens=False).ids for t in some]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_segment_tree(tik, piece):
    assert bpe.encode_long(piece, PATH) == tik._encode_single_piece(piece) if piece not in bpe.load_ranks(PATH)[0] else True


def test_digests(spark, tik):
    got = sorted(bpe.digests(docs(spark)).collect(), key=key)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows():
        ids = tik.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert list(map(tuple, got)) == sorted(want, key=key)


def test_id_files(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(rows(), key=lambda r: key((r[0], r[1]))):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert list(map(tuple, sorted(idstore.round_trip(docs(spark)).collect(), key=lambda r: key((r.start,))))) == want
    path = new_path(spark, "t")
    idstore.write_ids(docs(spark), path)
    full = {r.start: r for r in idstore.read_ids(spark, path).collect()}
    assert [len(full[s].ids) for _, s, _, _ in want] == [n for _, _, n, _ in want]
    assert all(full[s].ids[-1] == 0 for _, s, _, _ in want)


def test_short_access_and_wrong_dictionary(spark):
    path = new_path(spark, "t")
    idstore.write_ids(docs(spark), path)
    d = bytes(spark.read.parquet(f"{path}/dictionary").first().data)
    block = bytes(spark.read.parquet(f"{path}/blocks").first().data)
    index, _, read = idstore.open_block(block, d)
    k = len(index) // 2
    assert len(read(k)) == 4 * index["n"][k]
    with pytest.raises(ValueError):
        idstore.open_block(block, d + b"x")


def test_empty(spark):
    assert bpe.digests(docs(spark, [])).collect() == []
    assert idstore.round_trip(docs(spark, [])).collect() == []
