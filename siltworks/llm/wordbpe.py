"""Operator 12, BPE encoding and decoding with a tokenization automaton.

Method: the automaton reads tokens, and accepts a sequence of tokens exactly if the merges make it of the text that it
spells. It starts as one state with an arc for each single symbol. Each merge (u, v), in order of rank, adds a gadget:
the state that u leads to is copied without its arc v, all arcs u are led to the copy, and every state with an arc u
gets an arc uv to where v led. So all arcs of one label lead to one state, and that state is told from the one it was
copied from by the one arc it lacks; the tables hold just these differences: for a pair of tokens the merge that took
the arc away, and for a token the merge that made it and its two halves. A table of steps taken before is kept besides.

A word is encoded by running the automaton over it: a symbol's end is reached by the one arc that ends there and
leaves a state reached before, so each place of the word has one last token, and the way back from the word's end is
its encoding. Decoding emits the labels of the arcs, joined as the tokenizers library does without a decoder.

Words come from the normalizer and the pre-tokenizer that the tokenizer file names. Both treat a text cut at a space,
tab, line feed, vertical tab, form feed or return like the whole text, so each different stretch between these is
worked out once and remembered; the strings of special tokens have ids of their own, wherever they stand.

Edge cases: null text is the empty text: no ids, and the digests of nothing; text of white space alone likewise. A word of
any length is one word. A long text is worked out in blocks cut at white space.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.chunks import ChunkEncoder
from siltworks.llm.common import arrow_map

#: Characters of a text that are worked out at once, and ids that are named at once.
BLOCK = 1 << 20
#: Text bytes of a slice of rows, and texts that are normalized at once.
SLICE, PORTION = 4 << 20, 10_000
#: Stretches that a task remembers at most; beyond, the memory starts anew. Steps: slots, as a power of two.
KEEP, STEPS = 250_000, 20
#: Longest word that is worked out beside others.
WIDTH = 24
_EVER = 1 << 60
#: Stands between two texts that are worked out together.
MARK = "\0"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


class Table:
    """Whole numbers by key, looked up many at once; a key that is not there gives -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0
        slot = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]  # of several for one slot the last is in
            out = self.keys[slot] != keys
            keys, values, slot = keys[out], values[out], (slot[out] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = at
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out


class Automaton:
    """Compiled from the merges; labels are token ids, and a state is named by the token whose arcs lead to it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.longest = max(map(len, vocab), default=0)
        n = max(vocab.values(), default=-1) + 1
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        #: The merge at which the state of a token lost its arc of another.
        self.lost: dict[int, int] = {}
        #: Labels of the first state, which never loses an arc; ``named``: also those that no text ever gives.
        self.labels = {v for k, v in vocab.items() if len(k.removesuffix(suffix)) <= 1}
        named = set(self.labels)
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in named or u not in named or v not in named:
                raise ValueError(f"the merge of {a!r} and {b!r} makes a token again, or comes before its halves")
            named.add(w)
            if u in self.labels and v in self.labels and self._has(u, v, k - 1):
                self.lost[u << 32 | v] = k
                self.born[w], self.left[w], self.right[w] = k, u, v
                self.labels.add(w)
        self._spell()

    def _taken(self, q: int, t: int) -> int | None:
        """The merge at which the state of ``q`` lost the arc ``t``, by itself or before it was copied."""
        bound = None
        while True:
            k = self.lost.get(q << 32 | t)
            if k is not None:
                return k if bound is None or k < bound else None
            if self.born[q] < 0:
                return None
            bound = self.born[q] if bound is None else min(bound, self.born[q])
            q = self.right[q]

    def _has(self, q: int, t: int, time: int) -> bool:
        """Whether the state of ``q`` has the arc ``t`` after the merge ``time``."""
        while True:
            while self.born[q] > time:  # made later: where its right half led
                q = self.right[q]
            k = self._taken(q, t)
            if k is not None and k <= time:
                return False
            k = self.born[t]
            if k < 0:
                return True
            if q == t:  # what its right half led to before the merge
                q, time = self.right[t], k - 1
            else:
                time = k
            t = self.left[t]

    def _spell(self) -> None:
        """The labels' spellings as a tree of characters: a table of its branches, and of each node the label that ends there
        within a word (``inner``) and at the end of one (``final``)."""
        nodes: dict[int, int] = {}
        ends = []
        for text, i in self.vocab.items():
            if i not in self.labels:
                continue
            last = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            node = 0
            for ch in text.removesuffix(self.suffix) if last else text:
                node = nodes.setdefault(node << 21 | ord(ch), len(nodes) + 1)
            ends.append((node, i, last))
        self.inner, self.final = np.full(len(nodes) + 1, -1, np.int32), np.full(len(nodes) + 1, -1, np.int32)
        for node, i, last in ends:
            if last or not self.suffix:
                self.final[node] = i
            if not last:
                self.inner[node] = i
        self.branches = Table(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.seen, self.fine = np.full(1 << STEPS, -1, np.int64), np.zeros(1 << STEPS, bool)

    def step_many(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the states of ``q`` have the arcs ``t``: by the table of steps taken before, which keeps one for each slot."""
        key = q.astype(np.int64) << 32 | t
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - STEPS)).astype(np.int64)
        out = self.fine[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            keys, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.fromiter((self._has(k >> 32, k & 0xFFFFFFFF, _EVER) for k in keys.tolist()), bool, len(keys))
            out[new] = found[of]
            self.seen[slot[new[first]]], self.fine[slot[new[first]]] = keys, found
        return out

    def encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of up to ``WIDTH`` symbols side by side: all ids, and how many each word has. An empty word has none."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-size, kind="stable")
        sizes = size[order]
        chars = np.zeros((n, WIDTH), np.int64)
        chars[np.arange(WIDTH) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars = chars[order]
        longer = [int(np.searchsorted(-sizes, -i, side="left")) for i in range(WIDTH + 1)]  # words of more than i symbols
        last, back = np.full((n, WIDTH + 1), -1, np.int32), np.zeros((n, WIDTH + 1), np.int8)
        for at in range(WIDTH):
            row, node = np.arange(longer[at]), np.zeros(longer[at], np.int64)
            for end in range(at, WIDTH):
                many = int(np.searchsorted(row, longer[end]))
                node = self.branches(node[:many] << 21 | chars[row[:many], end])
                there = node >= 0
                row, node = row[:many][there], node[there].astype(np.int64)
                if not len(row):
                    break
                token = np.where(sizes[row] == end + 1, self.final[node], self.inner[node])
                some = token >= 0
                rows, token = row[some], token[some]
                if at:
                    fits = self.step_many(last[rows, at], token)
                    rows, token = rows[fits], token[fits]
                last[rows, end + 1], back[rows, end + 1] = token, at
        if (last[np.arange(n), sizes] < 0)[sizes > 0].any():
            raise ValueError("a word has symbols that are no tokens")
        # the way back, written from the end of each word's row on
        ids, count, at, row = np.zeros((n, WIDTH), np.uint32), np.zeros(n, np.int64), sizes.copy(), np.flatnonzero(sizes)
        while len(row):
            count[row] += 1
            ids[row, WIDTH - count[row]] = last[row, at[row]]
            at[row] = back[row, at[row]]
            row = row[at[row] > 0]
        again = np.empty(n, np.int64)
        again[order] = np.arange(n)
        ids, count = ids[again], count[again]
        return ids[np.arange(WIDTH) >= WIDTH - count[:, None]], count

    def encode(self, word: str) -> list[int]:
        """The ids of one word of any length; its last symbol carries the suffix."""
        n, get, labels, has = len(word), self.vocab.get, self.labels, self._has
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for at in range(max(0, end - self.longest), end):
                t = get(word[at:end] if end < n else word[at:] + self.suffix)
                if t is not None and t in labels and (not at or has(last[at], t, _EVER)):
                    last[end], back[end] = t, at
                    break
            else:
                raise ValueError(f"no token for {word[end - 1]!r}")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]


class Encoder:
    """Encodes and decodes texts by one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        tok = Tokenizer.from_file(path)
        self.normalize, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: np.array([i], np.uint32) for t, i in special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        label = {i: t for t, i in {**model["vocab"], **special}.items()}
        self.labels = pa.array([label.get(i, "") for i in range(max(label) + 1)], pa.large_string())
        self.decimals = pa.array(map(str, range(len(self.labels))), pa.large_string())

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        long = [i for i, w in enumerate(words) if len(w) > WIDTH]
        if not long:
            return self.automaton.encode_many(words)
        own = [np.array(self.automaton.encode(words[i]), np.uint32) for i in long]
        ids, size = self.automaton.encode_many([w if len(w) <= WIDTH else "" for w in words])
        return _inserted(ids, size, long, own)

    def _apart(self, text: str) -> np.ndarray:
        """A text with strings of special tokens, or with the mark."""
        out = [np.zeros(0, np.uint32)]
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            out.append(self.special[part] if part in self.special else self._words([w for w, _ in self.split(self.normalize(part))])[0])
        return np.concatenate(out)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All other texts, normalized with a mark between two, and split in one go."""
        parts = self.normalize(f" {MARK} ".join(texts)).split(MARK)
        pieces = self.split(" ".join(parts))
        begins = np.fromiter((at for _, (at, _) in pieces), np.int64, len(pieces))
        words = pa.array([w for w, _ in pieces], pa.large_string()).dictionary_encode()
        pool, size = self._words(words.dictionary.to_pylist())
        start, index = np.cumsum(size) - size, words.indices.to_numpy()
        each = size[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(start[index] - ends[:-1], each) + np.arange(ends[-1])
        cuts = np.searchsorted(begins, np.cumsum(np.fromiter((len(x) + 1 for x in parts), np.int64, len(parts))))
        return pool[at], np.diff(ends[np.concatenate([[0], cuts])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        owner, parts = [], []
        for i, text in enumerate(texts):
            for part in _parts(text):
                owner.append(i)
                parts.append(part)
        apart = [i for i, t in enumerate(parts) if MARK in t or (self.cut_special and self.cut_special.search(t))]
        ids = dict(zip(apart, (self._apart(parts[i]) for i in apart)))
        rest, out, size = [i for i in range(len(parts)) if i not in ids], [np.zeros(0, np.uint32)], np.zeros(len(parts), np.int64)
        for at in range(0, len(rest), PORTION):
            some = rest[at : at + PORTION]
            all_ids, size[some] = self._together([parts[i] for i in some])
            out.append(all_ids)
        out = np.concatenate(out)
        if apart:
            out, size = _inserted(out, size, apart, [ids[i] for i in apart])
        return out, np.bincount(np.array(owner, np.int64), size, len(texts)).astype(np.int64)

    def joined(self, ids: np.ndarray, names: pa.Array) -> Iterator[bytes]:
        """The names of ids with a space between two, in blocks that follow each other."""
        for at in range(0, len(ids), BLOCK):
            some = ids[at : at + BLOCK]
            yield (b" " if at else b"") + _named(some, np.array([0, len(some)]), names)[0].as_buffer().to_pybytes()

    def texts(self, ids: np.ndarray, cuts: np.ndarray, names: pa.Array) -> Iterator[Iterator[bytes]]:
        """``joined`` of each text; ``cuts`` says where the ids of each begin."""
        if len(ids) > 4 * BLOCK:
            yield from (self.joined(ids[a:b], names) for a, b in zip(cuts[:-1], cuts[1:]))
        else:
            yield from ([x.as_buffer()] for x in _named(ids, cuts, names))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.joined(ids, self.labels))


def _named(ids: np.ndarray, cuts: np.ndarray, names: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


def _inserted(ids: np.ndarray, size: np.ndarray, where: list[int], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fills the entries ``where``, so far without ids, with their own."""
    places = (np.cumsum(size) - size)[where]
    n = np.fromiter(map(len, own), np.int64, len(own))
    size[where] = n
    return np.insert(ids, np.repeat(places, n), np.concatenate(own)), size


def _parts(text: str) -> list[str]:
    """A long text cut at white space."""
    if len(text) <= BLOCK:
        return [text]
    out, at = [], 0
    while len(text) - at > BLOCK:
        space = _SPACE.search(text, at + BLOCK)
        end = space.start() if space else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string): the operator's real output, one row a document."""

    def make():
        enc = Encoder(tokenizer or _path())
        column = ChunkEncoder(enc.encode, keep=KEEP)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, cuts = column(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32, copy=False)))
            decoded = [enc.decode(ids[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return arrow_map(_rows(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string", rows=4096, most=SLICE)


def digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what ``encode_decode`` gives, without moving it out."""

    def make():
        enc = Encoder(tokenizer or _path())
        column = ChunkEncoder(enc.encode, keep=KEEP)

        def sha(blocks: Iterator[bytes]) -> str:
            held = hashlib.sha256()
            for block in blocks:
                held.update(block)
            return held.hexdigest()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, cuts = column(batch.column("text"))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array(map(sha, enc.texts(ids, cuts, enc.decimals)), pa.string()),
                    pa.array(map(sha, enc.texts(ids, cuts, enc.labels)), pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    return arrow_map(_rows(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=4096, most=SLICE)


SQL = None  # SQL has no merges: the tests compare with the tokenizers library
