"""Operator 6, secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Method: tokens are tagged begin, inside or outside of a secret. Features are the token's shape (kind,
length, digits, variety), what stands near it (key words, assignment signs, quotes, up to four tokens
before and two after) and the file (whether it has key words, digit-heavy tokens, a key prefix). Weights
maximise the conditional likelihood of sequences (forward-backward in numpy, regularised), learnt from the
pattern spans of at most ``TRAIN_DOCS`` documents with spans and as many without (a bounded, documented
sample, different texts with the smallest hashes; whole texts of up to ``TRAIN_CHARS``, of which the segments of
``SEGMENT`` tokens with a key word or a digit-heavy token, and the first ones, are fitted on). Viterbi decodes every whole text.

Decoding is exact but short: where "outside" beats the other tags by more than any two transitions can
give back, every best path has "outside"; Viterbi runs over the stretches between such positions.

Pattern spans stay as they are; a field span is added where it overlaps none. Positions are code points.

Edge cases: null or empty text has no spans, and the digest of nothing; texts of any length are read whole;
with no span to learn from, the field adds nothing; equal texts have equal spans.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import arrow_map, smallest, tidy

KINDS = ("assign", "access", "hex", "crf")
TRAIN_DOCS = 200
TRAIN_CHARS = 20_000
SEGMENT = 48
STEPS = 40
KEEP = 300_000
NEAR = (-4, -3, -2, -1, 1, 2)

#: Fixed patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "auth", "bearer", "pwd", "access")
TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\s\w+/.\-]|\w+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, leftmost and non-overlapping for each kind, those too short dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def secret_part(text: str, span: tuple[int, int, str]) -> tuple[int, int]:
    """The secret itself: for an assignment its value, else the whole span."""
    start, end, kind = span
    return (ASSIGN.match(text, start).start(2), end) if kind == "assign" else (start, end)


def _kind(token: str) -> str:
    if token.isalpha():
        return "lower" if token.islower() else "title" if token.istitle() else "upper" if token.isupper() else "camel"
    if len(token) == 1:
        return {"=": "assign", ":": "assign", '"': "quote", "'": "quote"}.get(token, "digits" if token.isdigit() else "sign")
    token = token.rstrip(".")
    if token.isalpha():
        return "ended"
    if token.isdigit():
        return "digits"
    if re.fullmatch(r"[0-9a-f]+", token):
        return "hex"
    if re.fullmatch(r"[0-9A-Z]+", token):
        return "upnum"
    return "alnum" if token.isalnum() else "mixed"


_KEY = re.compile("|".join(KEYWORDS), re.I).search


def token_class(token: str) -> tuple:
    """Kind, length band, share of digits, variety of characters, key word, key prefix; features follow from these."""
    n = len(token)
    kind = _kind(token)
    digits = 0 if kind in _PLAIN else min(3, 4 * sum(map(str.isdigit, token)) // n)
    return kind, bisect_left((2, 5, 8, 12, 16, 24, 40), n), digits, min(4, 5 * len(set(token)) // n), n > 2 and _KEY(token) is not None, token[:4] == "AKIA"


_PLAIN = ("lower", "upper", "title", "camel", "ended", "sign", "assign", "quote")


def features(cls: tuple) -> tuple[list[str], list[str]]:
    """Own features of a class, and those that neighbours see."""
    kind, size, digits, variety, word, prefix = cls
    own = [kind, f"len{size}", f"{kind}/{size}", f"digits{digits}", f"variety{variety}", *["keyword"] * word, *["prefix"] * prefix]
    return own, [kind if kind in ("assign", "quote", "sign") else "word", *["keyword"] * word]


class Field:
    """Weights by name, and score tables of token classes. A class is a distinct pair of feature lists."""

    def __init__(self, own: dict[str, np.ndarray], near: dict[tuple[int, str], np.ndarray], file: np.ndarray, move: np.ndarray):
        self.own, self.near, self.file, self.move = own, near, file, move
        self.class_of: dict[tuple, int] = {}
        self.tokens: dict[str, int] = {}
        self.e = np.zeros((0, 3))
        self.c = np.zeros((len(NEAR), 0, 3))
        legal = move[move > -1e8]
        self.margin = 2 * max(0.0, float(legal.max() - legal.min()), float(legal.max() - move[0, 0]))

    def _classes(self, tokens: list[str]) -> np.ndarray:
        known = self.tokens
        try:
            return np.array(list(map(known.__getitem__, tokens)), np.int64)
        except KeyError:
            pass
        if len(known) > KEEP:
            known.clear()
        zero = np.zeros(3)
        e, c = [], []
        for t in dict.fromkeys(filterfalse(known.__contains__, tokens)):
            key = token_class(t)
            if key not in self.class_of:
                own, seen = features(key)
                self.class_of[key] = len(self.class_of)
                e.append(sum((self.own.get(f, zero) for f in own), zero)[None])
                c.append(np.array([sum((self.near.get((d, f), zero) for f in seen), zero) for d in NEAR])[:, None])
            known[t] = self.class_of[key]
        if e:
            self.e, self.c = np.concatenate([self.e, *e]), np.concatenate([self.c, *c], 1)
        return np.array(list(map(known.__getitem__, tokens)), np.int64)

    def emissions(self, tokens: list[str], bits: int) -> np.ndarray:
        cls = self._classes(tokens)
        e = self.e[cls] + self.file[bits]
        for k, d in enumerate(NEAR):
            if len(cls) > abs(d):
                if d < 0:
                    e[-d:] += self.c[k][cls[:d]]
                else:
                    e[:-d] += self.c[k][cls[d:]]
        return e

    def tags(self, tokens: list[str], bits: int) -> list[tuple[int, int]]:
        """(position, tag) of the tokens that the best path does not tag outside; tags: 0 outside, 1 begin, 2 inside."""
        if not tokens:
            return []
        e = self.emissions(tokens, bits)
        hot = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.margin)
        if not len(hot):
            return []
        breaks = np.flatnonzero(np.diff(hot) > 1) + 1
        out = []
        for run in np.split(hot, breaks):
            lo, hi = int(run[0]), int(run[-1]) + 1
            out += [(lo + i, t) for i, t in enumerate(viterbi(e[lo:hi], self.move, lo == 0, hi == len(tokens))) if t]
        return out


def viterbi(e: np.ndarray, move: np.ndarray, first: bool = True, last: bool = True) -> list[int]:
    """The best tags of one stretch; beyond an end that is not the text's the tag is outside.
    A text starts as if after outside, too: inside cannot begin it."""
    score = e[0] + move[0]
    back = []
    for row in e[1:]:
        both = score[:, None] + move
        back.append(both.argmax(0))
        score = both.max(0) + row
    if not last:
        score = score + move[:, 0]
    del first  # both kinds of start follow outside
    tag = int(score.argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


def file_bits(text: str, low: str | None = None) -> int:
    low = low if low is not None else text.lower()
    return any(k in low for k in KEYWORDS) + 2 * ("AKIA" in text) + 4 * (re.search(r"[0-9]{4}", text) is not None)


def fit(texts: list[str], l2: float = 0.05) -> Field:
    """Conditional maximum likelihood on segments of the texts' token sequences, by Adam."""
    names: dict[str, int] = {}
    segments = []
    for text in texts:
        spans = sorted(secret_part(text, s) for s in base_spans(text))
        found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
        labels, k = [], 0
        inside = None
        for start, end, _ in found:
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            covered = k < len(spans) and start < spans[k][1] and end > spans[k][0]
            labels.append(0 if not covered else 2 if inside == spans[k] else 1)
            inside = spans[k] if covered else None
        classes = [token_class(t) for _, _, t in found]
        feats = [features(c) for c in classes]
        bits = file_bits(text)
        for lo in range(0, len(found), SEGMENT):
            hi = min(len(found), lo + SEGMENT)
            odd = any(c[4] or c[2] and c[1] >= 3 for c in classes[lo:hi])
            if odd or lo == 0:
                segments.append((feats, lo, hi, labels[lo:hi], bits))
    move = np.zeros((3, 3))
    move[0, 2] = -1e9  # inside needs a begin
    if not any(any(s[3]) for s in segments):
        never = np.array([0.0, -1e3, -1e3])
        return Field({}, {}, np.tile(never, (8, 1)), move)
    n, t = len(segments), SEGMENT
    y = np.zeros((n, t), np.int64)
    mask = np.zeros((n, t), bool)
    rows, cols = array("q"), array("q")
    for s, (feats, lo, hi, labels, bits) in enumerate(segments):
        y[s, : hi - lo], mask[s, : hi - lo] = labels, True
        for i in range(lo, hi):
            fs = [f"o:{f}" for f in feats[i][0]] + [f"f:{bits}"]
            fs += [f"{d}:{f}" for d in NEAR if 0 <= i + d < len(feats) for f in feats[i + d][1]]
            for f in fs:
                rows.append(s * t + i - lo)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.frombuffer(rows, np.int64), np.frombuffer(cols, np.int64)
    w = np.zeros((len(names), 3))
    legal = move > -1e8
    gold_pairs = np.zeros((3, 3))
    ok = mask[:, 1:]
    np.add.at(gold_pairs, (y[:, :-1][ok], y[:, 1:][ok]), 1)
    onehot = np.eye(3)[y] * mask[:, :, None]
    m1, m2 = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, STEPS + 1):
        e = np.stack([np.bincount(rows, w[cols, j], n * t) for j in range(3)], 1).reshape(n, t, 3)
        fwd, bwd = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        fwd[:, 0] = e[:, 0] + move[0]
        for i in range(1, t):
            nxt = lse(fwd[:, i - 1, :, None] + move, 1) + e[:, i]
            fwd[:, i] = np.where(mask[:, i, None], nxt, fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            prev = lse(move + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(mask[:, i + 1, None], prev, 0)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pairs = np.exp(fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * ok[:, :, None, None]
        diff = (onehot - p).reshape(-1, 3)
        gw = np.stack([np.bincount(cols, diff[rows, j], len(names)) for j in range(3)], 1) - l2 * w
        gm = np.where(legal, gold_pairs - pairs.sum((0, 1)), 0) - l2 * np.where(legal, move, 0)
        for i, (x, g) in enumerate(((w, gw), (move, gm))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            x += np.where(legal if i else True, 0.2 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8), 0)
    own, near, file = {}, {}, np.zeros((8, 3))
    for f, i in names.items():
        where, name = f.split(":", 1)
        if where == "o":
            own[name] = w[i]
        elif where == "f":
            file[int(name)] = w[i]
        else:
            near[int(where), name] = w[i]
    return Field(own, near, file, move)


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    tokens = TOKEN.findall(text)
    tagged = field.tags(tokens, file_bits(text))
    if not tagged:
        return []
    wanted = {i for i, _ in tagged}
    place = {i: m.span() for i, m in enumerate(TOKEN.finditer(text)) if i in wanted}
    out: list[list[int]] = []
    last = -2
    for i, tag in tagged:
        if tag == 2 and last == i - 1:
            out[-1][1] = place[i][1]
        else:
            out.append(list(place[i]))
        last = i
    return [(a, b) for a, b in out]


def spans(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """All spans by start, then kind: the patterns' own, and the field's where they overlap none of them."""
    if not text:
        return []
    base = base_spans(text)
    edges = sorted((a, b) for a, b, _ in base)
    added = []
    for a, b in field_spans(text, field):
        if not any(a < y and x < b for x, y in edges):
            added.append((a, b, "crf"))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def learn(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    """Fits on the bounded sample: documents with pattern spans, and documents without."""
    texts = docs.select(F.col(text_col).alias("text")).filter((F.length("text") > 0) & (F.length("text") <= TRAIN_CHARS))
    marked = F.col("text").rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    # hashes first, equal texts once; then the texts of the chosen hashes
    ranked = smallest(texts.select(marked.alias("m"), F.xxhash64("text").alias("h")).distinct(), ["m"], "h", train_docs)
    chosen = [r.h for r in ranked.orderBy(F.desc("m"), "h").collect()]  # at most 2 * train_docs hashes
    rows = texts.withColumn("h", F.xxhash64("text")).filter(F.col("h").isin(*chosen)).dropDuplicates(["h"]).collect()
    text_of = {r.h: r.text for r in rows}
    field = fit([text_of[h] for h in chosen])
    tidy(docs.sparkSession)
    return field


def _label(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of base spans, base_sha256 and all spans of each document."""
    field = field or learn(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast((field.own, field.near, field.file, field.move))

    def make():
        own = Field(*held.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans(t, own) for t in batch.column("text").to_pylist()]
            base = [[s for s in x if s[2] != "crf"] for x in found]
            count = lambda kind: pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(count(k) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(_label(x).encode()).hexdigest() for x in base], pa.string()),
                    pa.array([_label(x) for x in found], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def masked(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with every span, or union of overlapping spans, replaced by the mask."""
    if not found:
        return text
    joined: list[list[int]] = []
    for a, b, _ in found:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    cuts = [0, *(x for ab in joined for x in ab), len(text)]
    return MASK.join(text[a:b] for a, b in list(pairwise(cuts))[::2])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All documents with their columns; secrets are masked in ``text``, and ``n_chars`` follows the new text."""
    field = field or learn(docs)
    held = docs.sparkSession.sparkContext.broadcast((field.own, field.near, field.file, field.move))

    def make():
        own = Field(*held.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [masked(t, spans(t, own)) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                old = batch.column(at).to_pylist()
                batch = batch.set_column(at, batch.schema.field(at), pa.array([len(t) if t is not None else n for t, n in zip(texts, old)], batch.schema.field(at).type))
            return batch

        return step

    return arrow_map(docs, make, docs.schema)
