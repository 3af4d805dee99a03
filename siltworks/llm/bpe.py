"""Operator 9, byte-level BPE encoding and decoding with a segment tree over byte positions.

Method: the leaves of a segment tree hold, for each live byte position, the rank of the pair that starts
there (joined with the position, so that the minimum is the leftmost of equal ranks); the root names the
next merge, and a merge makes point updates, each of logarithmic cost, at the merged position, the
position that dies and the live neighbour before them.

Pieces of up to 16 bytes are merged many at once: one tree a piece, the trees side by side in numpy
arrays. Longer pieces have a tree of their own. A piece that is a token is taken whole, as the
tokenizers of this family do. What a task has encoded is kept by chunk (bounded by ``KEEP`` chunks).

Edge cases: null text is the empty text: no ids, and the digests of nothing; bytes never get lost, since
each single byte is a token; text that the pattern splits into one long run is one piece, without a limit.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.chunks import ChunkEncoder
from siltworks.llm.common import arrow_map

WIDTH = 16
NONE = np.int32(2**31 - 1)
#: Chunks kept by a task; a chunk is one space-separated stretch of text.
KEEP = 250_000
#: Chunks that are encoded at once.
PORTION = 10_000
#: Text bytes of a slice.
SLICE = 4 << 20


@cache
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return ranks, table


@cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Every pair of tokens whose concatenation is a token: sorted keys, their ranks, and both as a dict."""
    ranks, _ = load_ranks(path)
    pairs = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank
    keys = np.fromiter(pairs, np.int64, len(pairs))
    values = np.fromiter(pairs.values(), np.int32, len(pairs))
    order = np.argsort(keys)
    return keys[order], values[order], pairs


class SegmentTree:
    """Leftmost minimum over one piece of any length; leaves are ``rank * size + position``."""

    def __init__(self, keys: list[int], size: int):
        self.size, self.tree = size, [0] * size + keys
        for i in range(size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = key
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least


def encode_long(piece: bytes, path: str) -> list[int]:
    """One piece of any length, O(n log n)."""
    ranks, _ = load_ranks(path)
    pairs = pair_table(path)[2]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    tok = [ranks[piece[i : i + 1]] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(at: int) -> int:
        after = nxt[at]
        rank = pairs.get(tok[at] << 32 | tok[after]) if after < n else None
        return none if rank is None else rank * size + at

    tree = SegmentTree([key(i) for i in range(n)] + [none] * (size - n), size)
    while (least := tree.tree[1]) < none:
        rank, at = divmod(least, size)
        dead = nxt[at]
        tok[at], nxt[at] = rank, nxt[dead]
        if nxt[dead] < n:
            prv[nxt[dead]] = at
        tree.put(dead, none)
        tree.put(at, key(at))
        if prv[at] >= 0:
            tree.put(prv[at], key(prv[at]))
    out, at = [], 0
    while at < n:
        out.append(tok[at])
        at = nxt[at]
    return out


def encode_many(pieces: list[bytes], path: str) -> list[bytes]:
    """Pieces of 1 to 16 bytes, all trees side by side: row r of ``tree`` is the segment tree of piece r."""
    ranks, _ = load_ranks(path)
    keys, values, _ = pair_table(path)
    n, width, levels = len(pieces), WIDTH, WIDTH.bit_length() - 1
    byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    size = np.fromiter(map(len, pieces), np.int64, n)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    # one column more: position ``width`` is a sink for neighbours that do not exist
    tok = np.full((n, width + 1), -1, np.int64)
    tok[:, :width] = np.where(np.arange(width) < size[:, None], byte_rank[flat], -1)
    nxt = np.minimum(np.arange(1, width + 2), width) * np.ones((n, 1), np.int64)
    prv = np.arange(-1, width) * np.ones((n, 1), np.int64)

    def leaf(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        want = (a << 32) | b
        i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (keys[i] == want), values[i] * width + at, NONE).astype(np.int32)

    tree = np.full((n, 2 * width), NONE, np.int32)
    tree[:, width:] = leaf(tok[:, :width], tok[:, 1:], np.arange(width))
    for level in range(levels - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

    def put(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        i = at + width
        tree[rows, i] = key
        for _ in range(levels):
            i = i >> 1
            tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        rank, at = np.divmod(tree[live, 1].astype(np.int64), width)
        dead = nxt[live, at]
        after = nxt[live, dead]
        tok[live, at], nxt[live, at] = rank, after
        tok[live, dead] = -1
        prv[live, after] = at  # the sink takes it where nothing follows
        put(live, dead, np.full(len(live), NONE))
        put(live, at, leaf(rank, tok[live, after], at))
        before = prv[live, at]
        has = before >= 0
        put(live[has], before[has], leaf(tok[live[has], before[has]], rank[has], before[has]))
        live = live[tree[live, 1] < NONE]
    row, col = np.nonzero(tok[:, :width] >= 0)
    ids, cuts = tok[row, col].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(row, minlength=n))).tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


class Encoder:
    """Encodes chunks of text by the pattern and the ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.path, self.find = path, regex.compile(pattern).findall
        self.ranks, self.table = load_ranks(path)

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        out, short = {}, []
        for p in pieces:
            if p in self.ranks:
                out[p] = self.ranks[p].to_bytes(4, "little")
            elif len(p) <= WIDTH:
                short.append(p)
            else:
                out[p] = np.array(encode_long(p, self.path), "<u4").tobytes()
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            out.update(zip(part, encode_many(part, self.path)))
        return out

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk by the pattern's matches, each match by its own tree: all ids, and how many each chunk has."""
        ids, size = [np.zeros(0, "<u4")], []
        for at in range(0, len(chunks), PORTION):
            split = [[p.encode() for p in self.find(c)] for c in chunks[at : at + PORTION]]
            done = self._pieces(list(set(chain.from_iterable(split))))
            each = [b"".join(map(done.__getitem__, ps)) for ps in split]
            ids.append(np.frombuffer(b"".join(each), "<u4"))
            size += [len(x) // 4 for x in each]
        return np.concatenate(ids), np.array(size, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def _rank_path() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_decode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary): the operator's real output, one row a document."""

    def make():
        path, pat = _rank_path()
        enc = Encoder(ranks or path, pattern or pat)
        column = ChunkEncoder(enc.encode, keep=KEEP)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, cuts = column(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32, copy=False)))
            decoded = [enc.decode(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

        return step

    return arrow_map(_rows(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded binary", rows=4096, most=SLICE)


def digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``encode_decode`` gives, without moving it out."""

    def make():
        path, pat = _rank_path()
        enc = Encoder(ranks or path, pattern or pat)
        column = ChunkEncoder(enc.encode, keep=KEEP)
        number = [str(i) for i in range(len(enc.table))].__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, cuts = column(batch.column("text"))
            each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in each], pa.int64()),
                    pa.array([sha(" ".join(map(number, x.tolist())).encode()) for x in each], pa.string()),
                    pa.array([sha(enc.decode(x)) for x in each], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    return arrow_map(_rows(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=4096, most=SLICE)
