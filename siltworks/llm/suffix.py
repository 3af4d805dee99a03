"""Operator 4, exact substring deduplication over enhanced suffix arrays.

Every byte covered by a ``SPAN``-byte string that also starts elsewhere is removed.

Method: an enhanced suffix array (suffix order and common-prefix lengths) is scanned with a stack, which
walks its common-prefix interval tree; the left extensions of an interval's occurrences are tested for
diversity, and each maximal repeat is put out with all its occurrences, not just neighbouring ones. What
maximal repeats cover is what all repeated strings of the length cover.

No suffix array of the whole corpus is built. Every ``SPAN``-byte window has an anchor: its leftmost
``GRAM``-byte gram of least hash. Equal windows have equal anchors, so an anchor whose gram is nowhere else
has no repeat around it, and goes. For the others, all that can hold a window with this anchor is its
context, ``2 * SPAN - GRAM`` bytes. Equal windows lie alike around their anchors, so the arrays hold the
suffixes that begin at anchors only, with what precedes them for the left extensions. Equal contexts are repeats as a whole and are counted, not compared;
of grams with several different contexts, one of each kind is looked at further. Where a window begins to the left of its anchor
falls into one of ``CORES`` ranges, and all windows of a range hold the same bytes around the anchor, the range's core; equal
windows have equal cores. So a context none of whose cores is in another goes, however frequent its gram is; the larger the corpus, the more
grams are frequent by chance. The rest go to the suffix arrays, many grams to one
array. A gram with over ``HOT`` different contexts left is not gathered: its windows are hashed (128 bits), those of shared cores, and
counted by a distributed aggregation instead. Both ways are exact, and linear in the number of anchors.

Edge cases: null text is empty; texts shorter than ``SPAN`` bytes lose nothing; matches do not cross
documents; a repeated row is a document of its own, so both lose what they share; overlapping occurrences
count; a text may lose all its bytes. Contexts are compared by 128-bit hashes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import arrow_map, as_bytes, discard, written
from siltworks.session import ship

SPAN = 200
GRAM = 32
REACH = SPAN - GRAM
HOT = 500
CORES = 4
BATCH_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1


def anchor_positions(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all windows that lie within one document of the joined bytes."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64)
    h = data.astype(np.uint64) + np.uint64(1)
    width, factor = 1, _P
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least, width = key, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    start = np.arange(n - SPAN + 1)
    inside = start + SPAN <= ends[np.searchsorted(ends, start, side="right")]
    at = (least[: n - SPAN + 1][inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.unique(at[np.append(True, at[1:] != at[:-1])]) if len(at) else at


def _anchors(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, left, right, gram, c1, c2: each anchor, its context's reach, and its hashes."""

    def make():
        gram_of, context_of = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(size)
            data = b"".join(texts)
            at = anchor_positions(np.frombuffer(data, np.uint8), ends)
            row = np.searchsorted(ends, at, side="right")
            begin = (ends - size)[row]
            lo, hi = np.maximum(begin, at - REACH), np.minimum(ends[row], at + SPAN)
            places = list(zip(at.tolist(), lo.tolist(), hi.tolist()))
            grams = np.array([gram_of(data[p : p + GRAM]) for p, _, _ in places], np.uint64).astype(np.int64)
            contexts = np.frombuffer(b"".join([context_of(data[a:b], p - a) for p, a, b in places]), "<i8").reshape(-1, 2)
            take = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("th").take(take),
                    pa.array((at - begin).astype(np.int32)),
                    pa.array((at - lo).astype(np.int16)),
                    pa.array((hi - at).astype(np.int16)),
                    pa.array(grams),
                    pa.array(contexts[:, 0].copy()),
                    pa.array(contexts[:, 1].copy()),
                ],
                ["doc_id", "th", "pos", "left", "right", "gram", "c1", "c2"],
            )

        return step

    return arrow_map(docs, make, "doc_id long, th long, pos int, left short, right short, gram long, c1 long, c2 long", rows=512)


def prefix_order(strings: list[bytes], groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group, then bytes, a prefix first; and the common prefix of each with the one before.

    Strings have at most ``width`` bytes. Strings of different groups have nothing in common.
    """
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    keys = np.zeros((n, width + 5), np.uint8)
    keys[:, :4] = groups.astype(">u4").view(np.uint8).reshape(n, 4)
    keys[:, 4:-1] = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in strings]), np.uint8).reshape(n, width)
    keys[:, -1] = size + 1
    order = np.argsort(keys.view(f"S{width + 5}").ravel(), kind="stable")
    body, size, groups = keys[order, 4:-1], size[order], groups[order]
    differs = body[1:] != body[:-1]
    common = np.where(differs.any(1), differs.argmax(1), width)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    common[groups[1:] != groups[:-1]] = 0
    return order, np.append(0, common)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of each node of the common-prefix interval tree, bottom-up, by a stack scan.

    ``common`` are the common prefixes of one sorted element and the next; a node's elements are first..end-1.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            length, first = stack.pop()
            yield length, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, least: int = SPAN) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members) of each maximal repeat of ``least`` bytes or more around the anchors of a group.

    ``rights`` are the suffixes that begin at the anchors and ``lefts`` what precedes them. The suffixes are
    sorted and a stack scan walks the interval tree of their common prefixes. A node's occurrences are tested for
    the diversity of their left extension: the same scan over what precedes them gives the sets that agree on
    ``left`` bytes and not on one more. A set that agrees on more than ``right`` bytes belongs to a deeper node.
    """
    order, common = prefix_order(rights, groups, SPAN)
    left_order, left_common = prefix_order([x[::-1] for x in lefts], groups, REACH)
    left_rank, rank = np.empty_like(left_order), np.empty_like(order)
    left_rank[left_order] = rank[order] = np.arange(len(order))
    deep = common > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    for lo, hi in zip((edge[::2] - 1).tolist(), edge[1::2].tolist()):  # suffixes lo..hi-1 are of one group
        for right, first, end in intervals(common[lo + 1 : hi].tolist()):
            by_left = np.sort(left_rank[order[lo + first : lo + end]])
            agree = np.minimum.reduceat(left_common[: by_left[-1] + 1], by_left[:-1] + 1)
            if agree.max() + right < least:
                continue
            for left, a, b in intervals(agree.tolist()):
                if left + right < least:
                    continue
                members = left_order[by_left[a:b]]
                if b - a < end - first:
                    at = rank[members]
                    if common[at.min() + 1 : at.max() + 1].min() > right:
                        continue
                yield left, right, members


def _in_arrays(contexts: DataFrame) -> DataFrame:
    """doc_id, th, a, b: repeated ranges, from suffix arrays over contexts gathered by gram."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        cut = [r[3] for r in rows]
        groups = np.unique([r[5] for r in rows], return_inverse=True)[1]
        held, size = [np.zeros(0, np.int64)], 0
        for left, right, members in maximal_repeats([r[4][:k] for r, k in zip(rows, cut)], [r[4][k:] for r, k in zip(rows, cut)], groups):
            held.append(members << 16 | left << 8 | right)
            size += len(members)
            if size > 1 << 20:
                held = [np.unique(np.concatenate(held))]
                size = 0
        found = np.unique(np.concatenate(held))
        row = found >> 16
        take = row.tolist()
        anchor = np.fromiter((r[2] + r[3] for r in rows), np.int64, len(rows))[row]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][0] for k in take], pa.int64()),
                pa.array([rows[k][1] for k in take], pa.int64()),
                pa.array((anchor - (found >> 8 & 255)).astype(np.int32)),
                pa.array((anchor + (found & 255)).astype(np.int32)),
            ],
            ["doc_id", "th", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "at", "left", "bytes", "gram"))):
                if size >= BATCH_BYTES and r[5] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
                last = r[5]
        if held:
            yield flush(held)

    ordered = contexts.repartition("gram").sortWithinPartitions("gram")
    return ordered.select("doc_id", "th", "at", "left", "bytes", "gram").mapInArrow(run, "doc_id long, th long, a int, b int")


def core_ranges() -> list[tuple[int, int]]:
    """The ranges, both ends included, of how far before its anchor a window begins."""
    edges = [(REACH + 1) * i // CORES for i in range(CORES + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def _with_shared_cores(contexts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The contexts that share a core with another, with ``live`` (a bit for each range with a shared core) and ``k``, how many
    their gram has left; and the tables behind them."""

    def make():
        digest, ranges = xxhash.xxh3_64_intdigest, core_ranges()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, bits, raw = [], [], []
            for i, (text, left) in enumerate(zip(as_bytes(batch, "bytes"), batch.column("left").to_pylist())):
                right = len(text) - left
                for bit, (least, most) in enumerate(ranges):
                    if left >= least and right >= SPAN - most:
                        rows.append(i)
                        bits.append(1 << bit)
                        raw.append(digest(text[left - least : left + SPAN - most], bit))
            take = pa.array(rows, pa.int64())
            at = batch.column("at").take(take)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), at, pa.array(bits, pa.int32()), pa.array(np.array(raw, np.uint64).astype(np.int64))], ["doc_id", "th", "at", "bit", "core"])

        return step

    # a context is named by its row and where its anchor is
    named = contexts.select("doc_id", "th", (F.col("at") + F.col("left")).cast("int").alias("at"), "left", "bytes")
    cores = written(arrow_map(named, make, "doc_id long, th long, at int, bit int, core long", rows=1024), "cores")
    shared = cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    live = cores.join(shared, "core", "left_semi").groupBy("doc_id", "th", F.col("at").alias("anchor")).agg(F.bit_or("bit").alias("live"))
    left = written(contexts.withColumn("anchor", (F.col("at") + F.col("left")).cast("int")).join(live, ["doc_id", "th", "anchor"]).drop("anchor"), "live")
    discard(cores)
    number = left.groupBy("gram").agg(F.count("*").alias("k"))
    return left.join(number, "gram"), [left]


def _by_windows(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same ranges for grams with very many contexts, by counting window hashes; and the table of windows behind them."""

    def make():
        digest, ranges = xxhash.xxh3_128_digest, core_ranges()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, at, raw = [], [], []
            for i, (text, first, left, live) in enumerate(zip(as_bytes(batch, "bytes"), *(batch.column(c).to_pylist() for c in ("at", "left", "live")))):
                for bit, (least, most) in enumerate(ranges):
                    if live >> bit & 1:
                        for j in range(max(left - most, 0), min(left - least, len(text) - SPAN) + 1):
                            rows.append(i)
                            at.append(first + j)
                            raw.append(digest(text[j : j + SPAN]))
            w = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at, pa.int32()), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())],
                ["doc_id", "th", "a", "w1", "w2"],
            )

        return step

    windows = written(arrow_map(contexts.select("doc_id", "th", "at", "left", "live", "bytes"), make, "doc_id long, th long, a int, w1 long, w2 long", rows=256), "windows")
    # overlapping contexts of a document show a window twice; a place counts once
    place = F.struct("doc_id", "th", "a")
    twice = windows.groupBy("w1", "w2").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x != y").select("w1", "w2")
    return windows.join(twice, ["w1", "w2"], "left_semi").select("doc_id", "th", "a", (F.col("a") + SPAN).cast("int").alias("b")), windows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), a, b: byte ranges whose union is what repeated strings cover."""
    return _ranges(docs, id_col, text_col)[0]


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The ranges, and the tables that they are read from."""
    ship(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    every = written(_anchors(rows.filter(F.octet_length("text") >= SPAN)), "anchors")
    shared = every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    found = written(every.join(shared, "gram", "left_semi"), "candidates")
    discard(every)
    # kinds of context, with one place of each
    kinds = written(found.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "left", "right")).alias("one")), "kinds")
    same = found.join(kinds.filter("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi")
    same = same.select("doc_id", "th", (F.col("pos") - F.col("left")).cast("int").alias("a"), (F.col("pos") + F.col("right")).cast("int").alias("b"))
    several = kinds.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1")
    places = kinds.join(several.select("gram"), "gram").select("gram", "one.*")
    # the contexts' bytes, cut inside the row; of repeated rows in one, or an array would hold a context as often as its row
    places = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "left", (F.col("pos") - F.col("left")).alias("at"), (F.col("left") + F.col("right")).alias("n"))).alias("p"))
    cut = rows.dropDuplicates(["doc_id", "th"]).join(places, ["doc_id", "th"]).select("doc_id", "th", F.encode("text", "UTF-8").alias("raw"), F.explode("p").alias("q"))
    contexts = written(
        cut.select("doc_id", "th", F.col("q.gram").alias("gram"), F.col("q.at").alias("at"), F.col("q.left").alias("left"), F.expr("substring(raw, q.at + 1, q.n)").alias("bytes")),
        "contexts",
    )
    every = contexts
    contexts, behind = _with_shared_cores(every)
    discard(every)
    hot, windows = _by_windows(contexts.filter(F.col("k") > HOT))
    return same.union(_in_arrays(contexts.filter(F.col("k") <= HOT))).union(hot), [found, kinds, *behind, windows]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left, when asked for)."""
    ranges, behind = _ranges(docs, id_col, text_col)
    spans = written(ranges.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    del ranges
    discard(*behind)
    rows = _keyed(docs, id_col, text_col).join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans.a", "spans.b")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch)
            removed, spans, kept = [], [], []
            for t, a, b in zip(texts, batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                runs: list[list[int]] = []
                for x, y in zip(a or (), b or ()):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(y, runs[-1][1])
                    else:
                        runs.append([x, y])
                removed.append(sum(y - x for x, y in runs))
                spans.append(len(runs))
                edges = [0, *(e for r in runs for e in r), len(t)]
                kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])))
            columns = [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                *([pa.array(kept, pa.binary())] if keep_bytes else []),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes])

        return step

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return arrow_map(rows, make, schema, rows=1024).withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 62), F.col("doc_id")))
