"""Whole-column encoding of texts by chunks: equal chunks of a slice are encoded once.

Byte-level encoders whose pattern gives a word its leading space treat a text cut before a space, or
around a line feed, that stands alone between other characters, exactly as the whole text. A text with
longer runs of white space, or with other white space, is encoded whole instead.

A key is what lies between two cuts: a word without its space, or a line feed with the word after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What an encoder gives: all ids of its texts end to end, and how many each text has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: A key where white space meets white space: nothing after the cut, or white space besides a leading line feed.
_MEETS = r"(?s)^\n?$|^[\t\x0B\f\r\x1C-\x1F\x{85}\pZ]|^.+[\s\x0B\x1C-\x1F\x{85}\pZ]"


def _lead(mark: str, texts: pa.Array) -> pa.Array:
    """The mark before each text."""
    large = lambda x: pa.scalar(x, pa.large_string())
    return pc.binary_join_element_wise(large(""), texts, large(mark))


@dataclass
class Cut:
    """A column of texts, cut: ``index`` has the key of each chunk, those of text i at cuts[i]..cuts[i+1]."""

    texts: pa.Array
    cuts: np.ndarray
    index: np.ndarray
    keys: pa.Array
    bad: np.ndarray
    led: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Cut:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        cuts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat = parts.flatten().dictionary_encode()
        keys = flat.dictionary
        mask = lambda x: x.to_numpy(zero_copy_only=False)
        return cls(texts, cuts, mask(flat.indices).astype(np.int32, copy=False), keys, mask(pc.match_substring_regex(keys, _MEETS)), mask(pc.starts_with(keys, "\n")))

    def firsts(self) -> tuple[pa.Array, list[int]]:
        """The first chunk of each text, which has no space before it, and the texts that must not be cut; their
        first chunk is empty here."""
        at = self.index[self.cuts[:-1]]
        first = self.keys.take(pa.array(at))
        bad = self.bad[self.index]
        bad[self.cuts[:-1]] = (self.bad[at] & (pc.binary_length(first).to_numpy(zero_copy_only=False) > 0)) | self.led[at]
        whole = np.logical_or.reduceat(bad, self.cuts[:-1])
        return pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), first), np.flatnonzero(whole).tolist()

    def wholes(self, which: list[int]) -> list[str]:
        return [self.texts[i].as_py() for i in which]

    def chunks(self) -> pa.Array:
        """The chunk that each key stands for."""
        return pc.if_else(pa.array(self.led), self.keys, _lead(" ", self.keys))

    def ids(self, entry: np.ndarray, whole: list[int], start: np.ndarray, size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each text's begin. ``entry`` is the entry of each key; the entries of the first chunks, then
        of the whole texts, are the last ones of ``start`` and ``size``, which are places in the ``pool`` of ids."""
        n, cuts = len(self.texts), self.cuts
        own = len(size) - n - len(whole)
        index = entry[self.index]
        index[cuts[:-1]] = own + np.arange(n)
        if whole:  # such a text is its own only chunk
            keep = np.ones(len(index), bool)
            for k, i in enumerate(whole):
                keep[cuts[i] + 1 : cuts[i + 1]] = False
                index[cuts[i]] = own + n + k
            cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
            index = index[keep]
        # a slice has less than 2^31 ids: half the memory
        length = size.astype(np.int32)[index]
        ends = np.cumsum(length)
        first = (start[index] - (ends - length)).astype(np.int32)
        bounds = np.concatenate([[0], ends])[cuts]
        del index, ends
        at = np.repeat(first, length)
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], bounds


_NOTHING = (np.zeros(0, np.uint32), np.zeros(1, np.int64))


class ChunkEncoder:
    """Gives the ids of a column of texts. A task remembers at most about ``keep`` chunks and ``keep_chars``
    characters of them; beyond either the memory starts anew."""

    def __init__(self, encode: Encode, keep: int = 400_000, keep_chars: int = 8 << 20):
        self.encode, self.keep, self.keep_chars = encode, keep, keep_chars
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = self.n = self.used = 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _look_up(self, cut: Cut) -> np.ndarray:
        """Entry of each key."""
        if len(self.known) > self.keep or self.chars > self.keep_chars:
            self._reset()
        known, keys = self.known, cut.keys.to_pylist()
        new = np.flatnonzero(np.fromiter((k not in known for k in keys), bool, len(keys)) & ~cut.bad)
        if len(new):
            ids, size = self.encode(cut.chunks().take(pa.array(new)).to_pylist())
            n, used = self.n, self.used
            self.pool = self._room(self.pool, used + len(ids))
            self.start, self.size = self._room(self.start, n + len(new)), self._room(self.size, n + len(new))
            self.pool[used : used + len(ids)] = ids
            self.size[n : n + len(new)] = size
            self.start[n : n + len(new)] = used + np.cumsum(size) - size
            self.n, self.used = n + len(new), used + len(ids)
            fresh = [keys[i] for i in new.tolist()]
            known.update(zip(fresh, range(n, self.n)))
            self.chars += sum(map(len, fresh))
        return np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one entry more than texts). Null is the empty text."""
        if not len(texts):
            return _NOTHING
        cut = Cut.of(texts)
        entry = self._look_up(cut)
        firsts, whole = cut.firsts()
        ids, size = self.encode([*firsts.to_pylist(), *cut.wholes(whole)])
        start = np.concatenate([self.start[: self.n], self.used + np.cumsum(size) - size])
        pool = np.concatenate([self.pool[: self.used], ids.astype(np.uint32, copy=False)])
        return cut.ids(entry, whole, start, np.concatenate([self.size[: self.n], size]), pool)


class JoinedEncoder:
    """The same for an encoder that is slow on many short texts: chunks are given to it joined by line feeds.

    A line feed must be one id, ``feed``, and stand alone before a space, a word or one more line feed; no chunk has
    one inside. A chunk that contains one of the texts ``alone`` is encoded by itself. Nothing is remembered.
    """

    def __init__(self, encode: Encode, feed: int, alone: list[str], joined: int = 256):
        self.encode, self.feed, self.alone, self.joined = encode, feed, alone, joined

    def _chunks(self, chunks: pa.Array, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty chunks; ``led`` where a chunk begins with a line feed of its own."""
        n = len(chunks)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cuts = np.append(np.arange(0, n, self.joined), n)
        groups = pa.LargeListArray.from_arrays(pa.array(cuts), chunks.cast(pa.large_string()))
        texts = _lead("\n", pc.binary_join(groups, pa.scalar("\n", pa.large_string()))).to_pylist()
        ids, size = self.encode(texts)
        # the line feed before a chunk, and after it the chunk's own; each text begins with one
        feeds = np.flatnonzero(ids == self.feed)
        first = feeds[np.arange(n) + np.cumsum(led) - led]
        keep = np.ones(len(ids), bool)
        keep[first] = False
        return ids[keep], np.diff(np.append(first, len(ids))) - 1

    def _encode(self, chunks: pa.Array, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = pc.binary_length(chunks).to_numpy(zero_copy_only=False)
        apart = np.zeros(len(chunks), bool)
        for text in self.alone:
            apart |= pc.match_substring(chunks, text).to_numpy(zero_copy_only=False)
        plain = (length > 0) & ~apart
        size = np.zeros(len(chunks), np.int64)
        ids, size[plain] = self._chunks(chunks.filter(pa.array(plain)), led[plain])
        if apart.any():
            places = (np.cumsum(size) - size)[apart]
            own, own_size = self.encode(chunks.filter(pa.array(apart)).to_pylist())
            size[apart] = own_size
            ids = np.insert(ids, np.repeat(places, own_size), own)
        return ids, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``ChunkEncoder``."""
        if not len(texts):
            return _NOTHING
        cut = Cut.of(texts)
        firsts, whole = cut.firsts()
        good = np.flatnonzero(~cut.bad)
        chunks = pa.concat_arrays([cut.chunks().take(pa.array(good)), firsts])
        ids, size = self._encode(chunks, np.concatenate([cut.led[good], np.zeros(len(firsts), bool)]))
        rest, rest_size = self.encode(cut.wholes(whole))
        size = np.concatenate([size, rest_size])
        entry = np.full(len(cut.keys), -1, np.int64)
        entry[good] = np.arange(len(good))
        entry = entry.astype(np.int32)
        return cut.ids(entry, whole, np.cumsum(size) - size, size, np.concatenate([ids, rest]))
