"""Operator 13, vector code compression: product codes of integer vectors, nearest entries by annular norm pruning.

Method: the entries of a part's codebook are sorted by norm. By the triangle inequality an entry at a distance of
at most d from a vector has a norm within d of the vector's. A vector's current best distance comes from the entries
around its norm; binary search then gives the interval of norms which that distance allows, its ends included, and
only the entries of that annulus are evaluated exactly, each once. Vectors of like norm share one block, whose annulus is the
union of theirs. Equal distances go to the lower index.

Edge cases: a null vector, or one with a null or non-finite component, is dropped; so is a vector shorter than the
longest kept one, as its missing components are null. A longest length that is no multiple of ``parts`` raises.
Fewer kept vectors than entries give a codebook of as many entries; none give an empty result. The first codebooks
take rows in the order of (vec_id, vector), null ids last, repeated rows repeatedly; repeated rows get one result row
each. Null labels are one label. Components beyond 2^27 are worked out in integers of any size, and an error
or sum of errors beyond the range of a long is given as the largest long.

Scale: every round is one scan, in which a task adds up its vectors by entry and gives one row an entry (of
``parts * entries`` at most); these rows are summed by Spark, and as many come to the driver. A label with a third of
all rows is summed before its rows are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import arrow_map, written
from siltworks.session import spread

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of like norm that share an annulus, and the entries on each side of their norm that give the first distance.
BLOCK, SEEDS = 128, 8
#: Components up to here have squared distances that fit a long; up to ``FLOATS`` they and all sums are exact as doubles.
LONGS, FLOATS = 1 << 27, 1 << 20
LARGEST = (1 << 63) - 1


class Annuli:
    """One part's codebook, sorted by norm."""

    def __init__(self, book: np.ndarray):
        square = (book * book).sum(axis=1)
        root = np.sqrt(square.astype(np.float64))
        self.order = np.argsort(root, kind="stable")
        self.book, self.square, self.norm = book[self.order], square[self.order], root[self.order]
        self.evaluated = self.pairs = 0

    def _distances(self, x: np.ndarray, xx: np.ndarray, lo: int, hi: int) -> np.ndarray:
        self.evaluated += len(x) * (hi - lo)
        return xx[:, None] + self.square[None, lo:hi] - 2 * (x @ self.book[lo:hi].T)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of ``x``; both arrays of the codebook's kind."""
        n, m = len(x), len(self.book)
        self.pairs += n * m
        xx = (x * x).sum(axis=1)
        norm = np.sqrt(xx.astype(np.float64))
        index, least = np.zeros(n, np.int64), np.zeros(n, xx.dtype)
        by_norm = np.argsort(norm, kind="stable")
        for at in range(0, n, BLOCK):
            rows = by_norm[at : at + BLOCK]
            part, part_xx, r = x[rows], xx[rows], norm[rows]
            first = max(0, int(np.searchsorted(self.norm, r[0])) - SEEDS)
            end = min(m, int(np.searchsorted(self.norm, r[-1], side="right")) + SEEDS)
            dist = self._distances(part, part_xx, first, end)
            best = np.sqrt(dist.min(axis=1).astype(np.float64))
            # what rounding of the roots can take away is given back: an annulus too wide loses nothing
            slack = 1e-9 * (1 + r + best)
            inner, outer = (r - best - slack).min(), (r + best + slack).max()
            lo, hi = min(first, int(np.searchsorted(self.norm, inner))), max(end, int(np.searchsorted(self.norm, outer, side="right")))
            dist = np.concatenate([self._distances(part, part_xx, lo, first), dist, self._distances(part, part_xx, end, hi)], axis=1)
            least[rows] = dist.min(axis=1)
            index[rows] = np.where(dist == least[rows][:, None], self.order[None, lo:hi], m).min(axis=1)
        return index, least


def _kind(most: float) -> type:
    """What integers of this size are worked out in, exactly."""
    return np.float64 if most <= FLOATS else np.int64 if most <= LONGS else object


def _integers(col: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row a vector."""
    flat = col.flatten()
    if scale & (scale - 1):
        raise ValueError("the scale must be a power of two, or products are not exact")
    wide = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)
    top = np.abs(wide).max(initial=0)
    if top > 2.0**1000:  # the product is no double any more
        return np.array([[int(v) * scale for v in row] for row in wide], object).reshape(len(col), width)
    out = np.floor(wide * scale)
    return out if top * scale <= LONGS else np.array([[int(v) for v in row] for row in out], object).reshape(len(col), width)


class Quantizer:
    """All parts' codebooks (lists of lists of int: parts, entries, components) as tasks use them."""

    def __init__(self, books: list[list[list[int]]]):
        self.books, self.most = books, max((abs(v) for b in books for e in b for v in e), default=0)
        self.made: dict = {}

    def parts(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part: the vectors' components there, their entries, and squared distances."""
        most = object() if x.dtype == object else float(np.abs(x).max(initial=0))
        kind = object if x.dtype == object or self.most > LONGS else _kind(max(most, float(self.most)))
        size = x.shape[1] // len(self.books)
        if kind not in self.made:
            self.made[kind] = [Annuli(np.array(b, kind).reshape(len(b), size)) for b in self.books]
        x = x if x.dtype == kind else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)
        for p, annuli in enumerate(self.made[kind]):
            cut = x[:, p * size : (p + 1) * size]
            yield cut, *annuli.nearest(cut)


_SUMS = "part int, entry int, n long, sums array<string>"


def _rows(held: dict) -> pa.RecordBatch:
    """Counts and sums by (part, entry); the sums as text, since they may be over any range of numbers."""
    keys = sorted(held)
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())
    cols = [k[0] for k in keys], [k[1] for k in keys], [held[k][0] for k in keys], [[str(v) for v in held[k][1]] for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["part", "entry", "n", "sums"])


def _add(held: dict, key: tuple[int, int], n: int, sums: list[int]) -> None:
    count, old = held.get(key, (0, [0] * len(sums)))
    held[key] = count + n, [a + b for a, b in zip(old, sums)]


def _partial(books: list, width: int, scale: int):
    """A task over vectors: one row for each part and entry."""

    def make():
        quantizer, held = Quantizer(books), {}

        def step(batch: pa.RecordBatch) -> list:
            x = _integers(batch.column("v"), width, scale)
            for p, (cut, index, _) in enumerate(quantizer.parts(x)):
                for k in np.unique(index).tolist():
                    mine = cut[index == k]
                    # a slice has few rows: its sums are exact in each of the kinds
                    _add(held, (p, k), len(mine), [int(v) for v in mine.sum(axis=0)])
            return []

        step.finish = lambda: iter([_rows(held)])
        return step

    return make


def _total():
    """A task over partial sums, all those of an entry among them."""
    held: dict = {}

    def step(batch: pa.RecordBatch) -> list:
        for part, entry, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
            _add(held, (part, entry), n, [int(v) for v in sums])
        return []

    step.finish = lambda: iter([_rows(held)])
    return step


def _coded(books: list, width: int, scale: int):
    """A task: the code and the error of each vector."""

    def make():
        quantizer = Quantizer(books)
        digits = np.array([f"{i:02x}" for i in range(256)])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _integers(batch.column("v"), width, scale)
            code, error = np.full(len(x), "", object), np.zeros(len(x), object)
            for _, index, least in quantizer.parts(x):
                code = code + digits[index].astype(object)
                error = error + np.array([int(v) for v in least], object)
            return pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array([min(v, LARGEST) for v in error], pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

        return step

    return make


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v: vectors whose components are all finite numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("v").isNotNull() & fine)


def learn(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[list[list[int]]]:
    """The codebooks after ``rounds`` rounds; ``kept`` has vec_id and v. What comes to the driver: ``entries`` vectors
    once, and ``parts * entries`` sums a round."""
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = _integers(pa.array([list(map(float, r.v)) for r in first], pa.list_(pa.float64())), width, scale)
    size = width // parts
    books = [[[int(v) for v in row[p * size : (p + 1) * size]] for row in start] for p in range(parts)]
    for _ in range(rounds):
        partial = arrow_map(kept.select("v"), _partial(books, width, scale), _SUMS, rows=4096)
        for r in arrow_map(partial.repartition("part", "entry"), _total, _SUMS).collect():
            books[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return books


def digest(books: list[list[list[int]]]) -> str:
    """Lowercase hex SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row a kept vector."""
    kept = _kept(vectors, id_col, vector_col, label_col)
    width = kept.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first().n
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = spread(kept.filter(F.size("v") == width))
    books = learn(kept, width, parts, entries, rounds, scale)
    label = kept.schema["label"].dataType.simpleString()
    coded = written(arrow_map(kept, _coded(books, width, scale), f"vec_id long, label {label}, code string, error long", rows=4096), "codes")
    most = F.lit(LARGEST).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


SQL = None  # five rounds over every pair of vector and entry: the test compares with a brute-force version
