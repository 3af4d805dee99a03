"""Operator 2, language identification: word-first backoff.

Method: a word known to the model is scored by its log frequency in each language; an unseen word falls
back to the character n-grams of the word (padded with ``^`` and ``$``), the longest known ones first: at
each position the longest known n-gram counts, and where none is known the shorter ones are tried down to
single characters. The language with the highest sum wins; the score is its posterior on the mean
log-likelihood of a word, sharpened by ``SHARPNESS``.

Learning takes text and language of at most ``DOCS_PER_LANG`` documents of each language that are not held
out, the ones with the smallest hash of the text (a bounded, documented sample of labelled rows), whole
texts; the tables keep words and n-grams seen at least ``MIN_COUNT`` times, so the model that is broadcast
has a bound that does not grow with the corpus: ``DOCS_PER_LANG * TRAIN_CHARS`` characters a language.

Edge cases: null text, or a text without a letter, is ``und`` with score 0; a null language is not learnt
from; with nothing to learn from every text is ``und``; ties go to the language that sorts first; language
names are data, of any number.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import arrow_map, remainder, smallest, tidy

DOCS_PER_LANG = 300
#: Longer labelled texts are passed over in training, not cut; they are scored whole like any other.
TRAIN_CHARS = 20_000
MIN_COUNT = 2
NGRAM = 5
SHARPNESS = 4.0
UND = "und"


@cache
def _token() -> re.Pattern:
    """Letters only: digits, marks and punctuation say nothing about a language."""
    return re.compile(rf"[^\W\d_{_not_letters()}]+")


def _not_letters() -> str:
    """The characters that count as alphanumeric, but are neither letters nor decimal digits (superscripts, fractions,
    numerals), as ranges of a character class."""
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalnum() and not x.isalpha() and not x.isdecimal():
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


_ALNUM = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    low = text.lower()
    words = _ALNUM.findall(low)
    # rarely is there a numeral among them; the exact pattern is slower
    return words if "".join(words).isalpha() or not words else _token().findall(low)


def grams_of(word: str) -> Iterator[str]:
    padded = f"^{word}$"
    for n in range(1, NGRAM + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


class Model:
    """Log frequencies: ``words`` and ``grams`` map to a row of their table, which has a column a language."""

    def __init__(self, langs: list[str], words: list[str], word_rows: np.ndarray, grams: list[str], gram_rows: np.ndarray):
        self.parts = langs, words, word_rows, grams, gram_rows
        self.langs, self.word_rows, self.gram_rows = langs, word_rows, gram_rows
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: i for i, g in enumerate(grams)}

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        langs = sorted({lang for lang, _ in rows})
        words: dict[str, Counter] = {x: Counter() for x in langs}
        for lang, text in rows:
            words[lang].update(words_of(text))
        grams: dict[str, Counter] = {x: Counter() for x in langs}
        for lang in langs:
            count = grams[lang]
            for w, n in words[lang].items():
                for g in grams_of(w):
                    count[g] += n
        return cls(langs, *cls._table(langs, words, False), *cls._table(langs, grams, True))

    @staticmethod
    def _table(langs: list[str], counts: dict[str, Counter], by_length: bool) -> tuple[list[str], np.ndarray]:
        """log10 of (count + 1/2) over the language's total, of n-grams of one length where they have several."""
        every: Counter = Counter()
        for c in counts.values():
            every.update(c)
        keys = [k for k, n in every.items() if n >= MIN_COUNT]
        size = np.array([len(k) if by_length else 0 for k in keys], np.int64)
        out = np.empty((len(keys), len(langs)), np.float32)
        for j, lang in enumerate(langs):
            total: Counter = Counter()
            for k, n in counts[lang].items():
                total[len(k) if by_length else 0] += n
            whole = np.array([total[i] for i in range(int(size.max(initial=0)) + 1)])
            out[:, j] = np.log10((np.array([counts[lang][k] for k in keys]) + 0.5) / (whole[size] + 1))
        return keys, out

    def backoff(self, w: str) -> list[int]:
        """From each position of the padded word, the longest known n-gram that starts there."""
        padded, get, found = f"^{w}$", self.grams.get, []
        size = len(padded)
        for i in range(size):
            for n in range(min(i + NGRAM, size), i, -1):
                at = get(padded[i:n])
                if at is not None:
                    found.append(at)
                    break
        return found

    def unseen(self, words: list[str]) -> np.ndarray:
        """Rows of unseen words: the mean over positions of the n-grams that backoff finds."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        found = [self.backoff(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(words))
        has = np.flatnonzero(size)
        if len(has):
            flat = self.gram_rows[np.fromiter((i for x in found for i in x), np.int64, int(size.sum()))]
            out[has] = np.add.reduceat(flat, (np.cumsum(size) - size)[has]) / size[has, None]
        return out


class Scorer:
    """Scores texts; rows of unseen words are kept by the task, at most about ``KEEP`` of them."""

    KEEP = 200_000

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index, self.rows, self.used = dict(self.model.words), self.model.word_rows, len(self.model.words)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """A slice of texts at once, so that its new words are looked up together."""
        langs = self.model.langs
        if self.used - len(self.model.words) > self.KEEP:
            self._reset()
        index, words = self.index, [words_of(t or "") for t in texts]
        new: set[str] = set()
        for x in words:
            new.update(filterfalse(index.__contains__, x))
        if new and langs:
            fresh = list(new)
            if self.used + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.empty((self.used + 2 * len(fresh), len(langs)), np.float32)])
            self.rows[self.used : self.used + len(fresh)] = self.model.unseen(fresh)
            index.update(zip(fresh, range(self.used, self.used + len(fresh))))
            self.used += len(fresh)
        out = []
        for x in words:
            if not x or not langs:
                out.append((UND, 0.0))
                continue
            total = self.rows[np.fromiter(map(index.__getitem__, x), np.int64, len(x))].sum(0, dtype=np.float64)
            best = int(np.argmax(total))
            mean = (total - total[best]) / len(x) * SHARPNESS * math.log(10)
            out.append((langs[best], 1 / float(np.exp(mean).sum())))
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fits on the bounded sample of documents that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        (remainder("doc_id", 3) != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS)
    )
    # hashes first, not texts; equal texts count once
    top = smallest(rows.select("lang", F.xxhash64("text").alias("h")).distinct(), ["lang"], "h", docs_per_lang)
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(top), ["lang", "h"], "left_semi").select("lang", "text").distinct()
    model = Model.fit([(r.lang, r.text) for r in picked.collect()])
    tidy(docs.sparkSession)
    return model


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    model = model or learn(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(model.parts)

    def make():
        score = Scorer(Model(*held.value))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = score(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    return arrow_map(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


#: Documents that a filtering stage rejects: no language, or hardly more than a guess among the languages.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with an identified language, all their columns as they were; judged inside the scan, without a join."""
    model = learn(docs)
    held = docs.sparkSession.sparkContext.broadcast(model.parts)

    def make():
        score = Scorer(Model(*held.value))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = score(batch.column("text").to_pylist())
            return batch.filter(pa.array([lang != UND and p >= min_score for lang, p in got], pa.bool_()))

        return step

    return arrow_map(docs, make, docs.schema)
