"""Operator 7, SimHash near-duplicates by anchor-point covering.

Method: the anchors are the words of a covering code. The first 46 bits of a fingerprint are two blocks of
23, and each block is covered by the perfect binary Golay code of radius 3: a fingerprint's home is its
one nearest pair of code words. A fingerprint within ``THRESHOLD`` bits of another lies, in each block,
within the covering radius plus its share of the threshold from the other's home. So each fingerprint is
replicated to every anchor within covering radius plus threshold, and compared there with the
fingerprints that have this anchor as home. No pair is missed.

An anchor that is home to more than ``HOT`` fingerprints is not compared pair by pair: all fingerprints
that touch it are replicated to every point within one bit, and two are within two bits of each other
exactly if they share such a point; linking each to the smallest there keeps every component. That is
exact, and linear in the number of fingerprints.

Distinct fingerprints are compared, not documents; equal texts cost one row. Components come from
alternating large-star and small-star rounds over written tables, none of it on the driver.

``similar`` is the wide relation: texts whose sets of shingles have a Jaccard similarity of ``similarity`` or
more. Sets are linked by the fingerprints of their shingles first, through the same covering, and each link is
compared by whole sets. At 0.8 fingerprints differ by up to 11 bits, which no affordable radius of the covering reaches, so
what this leaves apart is completed exactly by prefixes: with all sets in one common order, two sets as similar as that share
a shingle among the first n - ceil(similarity n) + 1 of each. That misses no pair; each candidate's whole sets
are then compared. The order is by hash, with the shingles that are common in a sample last; it decides how many
candidates there are, never which pairs are found.

Edge cases: null or word-less text has fingerprint zero, linked like any other; fewer words than a shingle
give the whole sequence; a tie at exactly half the shingles gives a 0 bit; null doc_id is never the
smallest id of a component unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import arrow_map, as_bytes, fresh, tidy, written

SHINGLE = 3
SEED = 42
THRESHOLD = 2
HOT = 64
BLOCK = 23
#: ``similar`` orders shingles by how many of about this many sets have them; the commonest of those come last.
ORDER_SETS, ORDER_LIMIT = 5_000, 100_000
#: Buckets of a set's sketch, a power of two; they bound a pair's overlap from above before whole sets are compared.
SKETCH = 256
#: Rounds of ``similar`` in which each set is compared with one other of its shingle only.
STARS = 1
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
RADIUS = 3


def fingerprint(text: bytes) -> int:
    """The 64-bit majority of the shingles' hashes; a shingle is a slice of the space-joined words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    bits = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):  # long texts in slices
        ones += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; few or no words give the whole sequence, as in ``fingerprint``."""
    words = text.lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return np.frombuffer(digest(joined, SEED), ">i8").astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)]), ">i8").astype(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The same majority over a set of hashes, signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """a, b: candidate pairs of sets (node, fp), each with the one that stands for its fingerprint, and those of linked fingerprints."""
    of = written(sets.select("node", "fp").distinct(), "set_fingerprints")
    one = written(of.groupBy("fp").agg(F.min("node").alias("rep")), "distinct")
    same = of.join(one, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    x, y = (one.select(F.col("fp").alias(end), F.col("rep").alias(c)) for end, c in (("a", "x"), ("b", "y")))
    near = links(one.select("fp")).join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(near).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) of each document."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in as_bytes(batch)], np.uint64).astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, "doc_id long, fp long", rows=1024)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator; zero for code words."""
    x = x.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


@cache
def golay_steps() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each of the 2048 syndromes: the step to the nearest code word, and the steps of one and of two
    bits more than the covering radius (padded with -1) to further code words."""
    one = 1 << np.arange(BLOCK)
    by_weight = [np.zeros(1, np.int64)]
    for _ in range(RADIUS + THRESHOLD):
        last = by_weight[-1]
        grown = last[:, None] | one[None, :]
        by_weight.append(np.unique(grown[(last[:, None] & one[None, :]) == 0]))
    home = np.zeros(1 << 11, np.int64)
    for steps in by_weight[: RADIUS + 1]:
        home[_syndrome(steps)] = steps
    more = []
    for steps in by_weight[RADIUS + 1 :]:
        s = _syndrome(steps)
        order = np.argsort(s, kind="stable")
        s, steps = s[order], steps[order]
        count = np.bincount(s, minlength=1 << 11)
        table = np.full((1 << 11, count.max()), -1, np.int64)
        table[s, np.arange(len(s)) - (np.cumsum(count) - count)[s]] = steps
        more.append(table)
    return home, more


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home anchor of each fingerprint, and (row, anchor) of all it is replicated to, its home included."""
    home, (one_more, two_more) = golay_steps()
    u = fp.astype(np.uint64)
    near = []
    for shift in (64 - BLOCK, 64 - 2 * BLOCK):
        x = (u >> np.uint64(shift)).astype(np.int64) & ((1 << BLOCK) - 1)
        s = _syndrome(x)
        first = (x ^ home[s])[:, None]
        near.append([first, *(np.where(t[s] >= 0, x[:, None] ^ t[s], -1) for t in (one_more, two_more))])
    a, b = near
    at_home = a[0][:, 0] << BLOCK | b[0][:, 0]
    rows, found = [], []
    for i in range(THRESHOLD + 1):
        for j in range(THRESHOLD + 1 - i):
            left, right = a[i][:, :, None], b[j][:, None, :]
            both = np.where((left >= 0) & (right >= 0), left << BLOCK | right, -1).reshape(len(fp), -1)
            r, c = np.nonzero(both >= 0)
            rows.append(r)
            found.append(both[r, c])
    return at_home, np.concatenate(rows), np.concatenate(found)


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints at ``THRESHOLD`` or fewer bits; every such pair is linked,
    directly or through others that are linked."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            at_home, rows, found = anchors(fp)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[rows]), pa.array(found == at_home[rows])], ["anchor", "fp", "home"])

        return step

    spread = written(arrow_map(fps.select("fp"), make, "anchor long, fp long, home boolean", rows=4096), "anchors")
    homes = spread.filter("home").groupBy("anchor").agg(F.count("*").alias("n"))
    home = spread.filter("home").select("anchor", F.col("fp").alias("a"))
    away = spread.select("anchor", F.col("fp").alias("b"))
    hot = homes.filter(F.col("n") > HOT).select("anchor")
    cool = home.join(hot, "anchor", "left_anti")
    close = cool.join(away, "anchor").filter((F.col("a") != F.col("b")) & (F.expr("bit_count(a ^ b)") <= THRESHOLD)).select("a", "b")
    touched = away.join(hot, "anchor", "left_semi").select(F.col("b").alias("fp")).distinct()
    ball = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    points = touched.select("fp", F.explode(ball).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a != z").select("point", "a")
    stars = points.join(least, "point").filter("a != fp").select("a", F.col("fp").alias("b"))
    return close.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root: the smallest node reachable over ``edges`` (a, b), by alternating stars.

    Each round is written to the shared folder; only an edge count and checksum come to the driver. A node
    never passes on more edges than it has, and the largest neighbourhoods shrink each round.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    now = written(edges.select("a", "b"), "edges")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: each node's larger neighbours go to the least of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        # small star: each node's smaller neighbours, and itself, go to the least of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a != b")
        nxt = written(small.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "edges")
        now_state = state(nxt)
        now, done, seen = nxt, now_state == seen, now_state
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included)."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(fps))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = written(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _flat_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all sets of a batch, and how many each has."""
    raw = [x or b"" for x in batch.column("shingles").to_pylist()]
    return np.frombuffer(b"".join(raw), "<i8"), np.array([len(x) // 8 for x in raw], np.int64)


def _node(hashes: np.ndarray) -> int:
    """Names a set."""
    return xxhash.xxh64_intdigest(hashes.astype("<i8").tobytes(), SEED) - (1 << 63)


def _common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that several of about ``ORDER_SETS`` texts have, at most ``ORDER_LIMIT`` of them, sorted."""

    def each():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in as_bytes(batch)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["shingle"])

        return step

    some = texts.filter(F.pmod("th", F.lit(max(1, texts.count() // ORDER_SETS))) == 0).dropDuplicates(["th"])
    common = arrow_map(some.select("text"), each, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > 3)
    return np.sort(np.array([r.shingle for r in common.orderBy(F.desc("n"), "shingle").limit(ORDER_LIMIT).collect()], np.int64))


def similar(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs with a Jaccard similarity of ``similarity`` or more),
    th (xxhash64 of the text) and root, which names the component also where all its ids are null."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    last = spark.sparkContext.broadcast(_common_shingles(texts, shingle))  # at most ORDER_LIMIT hashes

    def prefixes():
        late = last.value
        done: set[int] = set()  # of a task: equal sets are spread once; beyond the bound some again, which costs rows only

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, fps, heads, sketches = [], [], [], [], []
            for t in as_bytes(batch):
                hashes = shingle_set(t, shingle)
                node, n = _node(hashes), len(hashes)
                nodes.append(node)
                sizes.append(n)
                fps.append(set_fingerprint(hashes))
                if node in done:
                    heads.append(None)
                    sketches.append(None)
                    continue
                if len(done) >= 1 << 20:
                    done.clear()
                done.add(node)
                first = n - math.ceil(similarity * n - 1e-9) + 1
                if len(late):
                    hot = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
                    ordered = np.concatenate([hashes[~hot], hashes[hot]])  # by hash inside both kinds
                else:
                    ordered = hashes
                heads.append(ordered[:first].astype("<i8").tobytes())
                sketches.append(np.bincount(hashes & (SKETCH - 1), minlength=SKETCH).astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(fps, pa.int64()),
                    pa.array(heads, pa.binary()),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "th", "node", "size", "fp", "shingles", "sketch"],
            )

        return step

    def spreading():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, n = _flat_sets(batch)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            node, size = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("node", "size"))
            return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node), pa.array(at.astype(np.int32)), pa.array(size)], ["shingle", "node", "at", "size"])

        return step

    rows = written(arrow_map(texts, prefixes, "doc_id long, th long, node long, size int, fp long, shingles binary, sketch binary", rows=512), "heads")
    heads = rows.filter(F.col("shingles").isNotNull())
    spread = arrow_map(heads.select("node", "size", "shingles"), spreading, "shingle long, node long, at int, size int", rows=512)
    # one exchange by shingle serves the removal of equal sets and the count
    spread = spread.repartition("shingle").dropDuplicates(["shingle", "node"])
    spread = written(spread.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).filter("n > 1").drop("n"), "shared")

    def bound():
        """The overlap is at most the sum of the lesser counts of each bucket."""

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SKETCH) for c in "xy")
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            ok = most >= similarity * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64) - most) - 1e-6
            return batch.select(["a", "b"]).filter(pa.array(ok))

        return step

    def sets():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            each = [shingle_set(t, shingle) for t in as_bytes(batch)]
            return pa.RecordBatch.from_arrays([pa.array([_node(x) for x in each], pa.int64()), pa.array([x.astype("<i8").tobytes() for x in each], pa.binary())], ["node", "shingles"])

        return step

    def compare():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / (len(x) + len(y) - both) >= similarity)
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return step

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def sides(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
        x, y = (what.select(F.col("node").alias(end), F.col(column).alias(c)) for end, c in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar: by their sketches first, then by their whole sets, taken from the texts anew."""
        pairs = written(pairs, "pairs")
        of = heads.select("node", "sketch").join(ends(pairs), "node", "left_semi").dropDuplicates(["node"])
        pairs = written(arrow_map(sides(pairs, of, "sketch"), bound, "a long, b long", rows=512), "bounded")
        wanted = written(rows.join(ends(pairs), "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")), "wanted")
        some = texts.join(wanted.select("th"), "th", "left_semi").dropDuplicates(["th"]).select("text")
        of = written(arrow_map(some, sets, "node long, shingles binary", rows=256).dropDuplicates(["node"]), "ends")
        out = written(arrow_map(sides(pairs, of, "shingles"), compare, "a long, b long", rows=512), "links")
        tidy(spark)
        return out

    fits = (
        (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6)
        # the first shared shingle of a pair leaves room for the overlap that the similarity asks for
        & (F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6)
    )
    # first each set with one of its shingle, by a different order each time, so that a large group of near copies
    # is linked by few pairs; then all pairs that this has left in different components
    linked, links = spread.withColumn("root", F.col("node")), None
    for turn in range(STARS):
        # the set with the fewest rare shingles before this one first: of near copies, the one the others stem from
        order = F.struct("at", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "root")
        hub = F.min(order).over(Window.partitionBy("shingle"))
        stars = linked.withColumn("h", hub).select(*(F.col(f"h.{c}").alias(f"{c}_a") for c in ("node", "at", "size", "root")), *(F.col(c).alias(f"{c}_b") for c in ("node", "at", "size", "root")))
        stars = stars.filter((F.col("root_a") != F.col("root_b")) & fits)
        found = stars.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        found = verified((found.union(fingerprint_pairs(heads)) if turn == 0 else found).distinct())
        links = found if links is None else written(links.union(found), "stars")
        linked = written(spread.join(components(links), "node", "left").select("shingle", "node", "at", "size", F.coalesce("root", "node").alias("root")), "linked")
    a, b = (linked.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "at", "size", "root"))) for x in "ab")
    apart = (a.shingle == b.shingle) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & fits
    others = verified(a.join(b, apart).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    roots = components(links.union(others))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    nodes = written(nodes, "rooted")
    tidy(spark)
    named = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = written(nodes.join(named, "root").select("node", "root", "component_id"), "classes")
    return rows.select("doc_id", "th", "node").join(by_node, "node").select("doc_id", "component_id", "th", "root")


def one_of_each(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``similar``, all its columns as they were: that of the smallest id (null last),
    then of the smallest text hash; of rows alike in both, whatever their number, one stays."""
    classes = similar(docs, shingle, similarity, id_col, text_col)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    first = written(first, "kept")
    doc, th, n = (fresh(docs, c) for c in ("doc", "th", "n"))
    rows = docs.withColumn(doc, F.col(id_col).cast("long")).withColumn(th, F.xxhash64(text_col))
    match = lambda x: rows[doc].eqNullSafe(x["doc_id"]) & (rows[th] == x["th"])
    often = written(classes.groupBy("doc_id", "th").agg(F.count("*").alias(n)).filter(F.col(n) > 1).select("doc_id", "th").join(first, ["th"], "left_semi"), "often")
    single = rows.join(first, match(first), "left_semi").join(often, match(often), "left_anti")
    several = rows.join(first, match(first), "left_semi").join(often, match(often), "left_semi").dropDuplicates([doc, th])
    return single.union(several).drop(doc, th)
