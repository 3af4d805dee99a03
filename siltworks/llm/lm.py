"""Operator 5, language-model scoring: exact unigram base, and a gated recurrent model in numpy.

Method: a gated recurrent unit reads tokens; its softmax is factored by class. The most frequent tokens, about
the square root of the vocabulary, are in classes with a softmax of their own inside each class; less frequent words of
the lexicon are in bands by frequency, and all other words, unknown ones included, in one class, with
shares (c + 1/2) / sum inside a band or that class, from the exact counts. So the model gives every text a
proper probability. The state is carried across windows of ``WINDOW`` tokens to the end of a document,
and begins anew with the next one. Training is truncated backpropagation over those windows: first on
``WARM_TOKENS`` tokens on the driver (a common starting point), then in parallel, each task going once
through all training documents of its partition, to the last token of each (positions of a window beyond a
lane's end have no loss and no gradient); the tasks' weights are averaged by their tokens.

Counts are exact over all training documents. The ``LEXICON`` most frequent words are broadcast (a fixed
bound); counts of all other words reach the documents by a shuffle join on the word, per text hash.

Edge cases: null text is empty and has one token, the end; with nothing to learn from all counts are 0;
repeated rows are scored alike; ties in frequency go by the word's bytes; texts of any length are whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import SLICE_BYTES, arrow_map, remainder, written

LEXICON = 200_000
#: The head's words are in as many classes as each has members, this many at least; the number grows with the
#: fourth root of the vocabulary, so that the head has about its square root.
LEAST_SIDE = 16
BANDS = 8
#: Weights of a row in which tasks hand over what they learnt.
BLOCK = 8192
HIDDEN = 16
WINDOW = 16
LANES = 256
STEP_TOKENS = LANES * WINDOW
WARM_TOKENS, WARM_CHARS = 200_000, 20_000
WARM_RATE, RATE = 0.02, 0.002
#: The end token's key; no word is empty.
END = b""


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column in lower case (A to Z), end to end, and where each text's begin (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = lists.flatten()
    keep = pc.greater(pc.binary_length(words), 0)
    cuts = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    return words.filter(keep), np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[cuts]


def _counting() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Counts the tokens of a slice."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pc.value_counts(split_words(batch.column("text"))[0])
        words = pa.concat_arrays([found.field("values").cast(pa.large_binary()), pa.array([END], pa.large_binary())])
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.concat_arrays([found.field("counts"), pa.array([batch.num_rows], pa.int64())])], ["word", "n"])

    return step


class Lexicon:
    """The most frequent words with their counts, and the shares inside bands and the class of the rest."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.known_counts = np.append(counts, 0.0)
        self.known = pa.array(words, pa.large_binary()).cast(pa.large_string())
        self.end = words.index(END) if END in words else len(words)
        n = len(words)
        self.members = self.classes = max(LEAST_SIDE, math.ceil(distinct**0.25))
        self.most = self.members * self.classes
        self.head = min(self.most, n)
        edges = np.unique(np.round(np.geomspace(max(self.head, 1), max(n, 2), BANDS + 1)).astype(np.int64))
        band = np.searchsorted(edges, np.arange(n), side="right") - 1
        self.n_class = self.classes + BANDS + 1
        self.rest = self.classes + BANDS
        rank = np.arange(n)
        self.cls = np.append(np.where(rank < self.head, rank // self.members, self.classes + np.clip(band, 0, BANDS - 1)), self.rest)
        self.input = np.append(np.where(rank < self.head, rank, self.most + self.cls[:n] - self.classes), self.most + BANDS)
        mass = np.bincount(self.cls[:n], counts + 0.5, self.n_class)
        outside = total - int(counts.sum()) + 0.5 * (distinct - n) + 0.5
        self.rest_mass = max(outside, 0.5)
        self.share = np.zeros(n + 1)
        tail = rank >= self.head
        self.share[:n][tail] = np.log((counts[tail] + 0.5) / mass[self.cls[:n][tail]])
        self.base = np.append(np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1))), 0.0)

    def numbers(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array, np.ndarray]:
        """The numbers of each text's words and its end; and the words that are not in the lexicon, with their texts."""
        words, cuts = split_words(texts)
        at = pc.index_in(words, value_set=self.known)
        out = np.empty(len(words) + len(texts), np.int32)
        own = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(cuts))
        out[own] = pc.fill_null(at, len(self.words)).to_numpy(zero_copy_only=False)
        ends = cuts[1:] + np.arange(len(texts))
        out[ends] = self.end
        missing = at.is_null()
        owner = np.repeat(np.arange(len(texts)), np.diff(cuts))[missing.to_numpy(zero_copy_only=False)]
        bounds = [0, *(ends + 1).tolist()]
        return [out[a:b] for a, b in zip(bounds, bounds[1:])], words.filter(missing), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights and the two passes. ``step`` works on a window: arrays of (time, lane)."""

    NAMES = ("inp", "rec", "bias", "wc", "bc", "wm", "bm")

    def __init__(self, lex: Lexicon, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, f = HIDDEN, np.float32
        self.lex = lex
        if weights is None:
            prior = np.bincount(lex.cls[:-1], lex.counts + 0.5, lex.n_class)
            prior[lex.rest] = lex.rest_mass
            inside = np.full((lex.classes, lex.members), -20.0)  # places without a word
            inside.reshape(-1)[: lex.head] = np.log(lex.counts[: lex.head] + 0.5)
            weights = {
                "inp": rng.normal(0, 0.3, (lex.most + BANDS + 1, 3 * h)).astype(f),
                "rec": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(f),
                "bias": np.zeros(3 * h, f),
                "wc": rng.normal(0, 0.1, (h, lex.n_class)).astype(f),
                "bc": np.log(np.maximum(prior, 1e-6) / max(prior.sum(), 1e-6)).astype(f),
                "wm": rng.normal(0, 0.1, (lex.classes, h, lex.members)).astype(f),
                "bm": inside.astype(f),
            }
        self.w = {k: np.array(v, f) for k, v in weights.items()}

    def _states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """States before each token, the state after the last, and what the backward pass needs."""
        rec, n = self.w["rec"], HIDDEN
        before, saved = np.empty((*keep.shape, n), np.float32), []
        for t in range(len(x)):
            h = h * keep[t, :, None]
            before[t] = h
            g = h @ rec
            zr = _sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            cand = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
            saved.append((z, r, cand, g[:, 2 * n :]))
            h = cand + z * (h - cand)
        return before, h, saved

    def _outputs(self, states: np.ndarray, tok: np.ndarray):
        """Natural log-probability of each token (without the share inside bands and the rest), and gradients' parts."""
        lex, w = self.lex, self.w
        cls = lex.cls[tok]
        logits = states @ w["wc"] + w["bc"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        total = p.sum(1, keepdims=True)
        rows = np.arange(len(tok))
        out = logits[rows, cls] - np.log(total[:, 0])
        p /= total
        order = np.flatnonzero(tok < lex.head)
        order = order[np.argsort(cls[order], kind="stable")]
        cuts = np.searchsorted(cls[order], np.arange(lex.classes + 1))
        parts = []
        for c in range(lex.classes):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                m = states[at] @ w["wm"][c] + w["bm"][c]
                m -= m.max(1, keepdims=True)
                q = np.exp(m)
                s = q.sum(1, keepdims=True)
                k = tok[at] % lex.members
                out[at] += m[np.arange(len(at)), k] - np.log(s[:, 0])
                parts.append((c, at, q / s, k))
        return out, cls, p, parts

    def score(self, tok: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, h, _ = self._states(self.w["inp"][self.lex.input[tok]] + self.w["bias"], keep, h)
        out = self._outputs(before.reshape(-1, HIDDEN), tok.reshape(-1))[0]
        return (out + self.lex.share[tok.reshape(-1)]).reshape(tok.shape), h

    def gradients(self, tok: np.ndarray, keep: np.ndarray, h: np.ndarray, on: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss of the positions ``on`` (all, if not given), and the state after the last."""
        w, n = self.w, HIDDEN
        inp = self.lex.input[tok]
        before, last, saved = self._states(w["inp"][inp] + w["bias"], keep, h)
        live = slice(None) if on is None or on.all() else np.flatnonzero(on)
        states, flat = before.reshape(-1, n)[live], tok.reshape(-1)[live]
        _, cls, p, parts = self._outputs(states, flat)
        p[np.arange(len(flat)), cls] -= 1
        g = {"wc": states.T @ p, "bc": p.sum(0), "wm": np.zeros_like(w["wm"]), "bm": np.zeros_like(w["bm"])}
        d = p @ w["wc"].T
        for c, at, q, k in parts:
            q[np.arange(len(at)), k] -= 1
            g["wm"][c] = states[at].T @ q
            g["bm"][c] = q.sum(0)
            d[at] += q @ w["wm"][c].T
        whole = np.zeros((tok.size, n), np.float32)
        whole[live] = d
        d = whole.reshape(before.shape)
        dx = np.empty((*tok.shape, 3 * n), np.float32)
        drec = np.zeros_like(w["rec"])
        after = np.zeros_like(h)
        for t in range(len(tok) - 1, -1, -1):
            z, r, cand, gn = saved[t]
            hb = before[t]
            dcand = after * (1 - z) * (1 - cand * cand)
            dz = after * (hb - cand) * z * (1 - z)
            dr = dcand * gn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dcand], 1)
            dg = np.concatenate([dz, dr, dcand * r], 1)
            drec += hb.T @ dg
            after = (after * z + dg @ w["rec"].T + d[t]) * keep[t, :, None]
        flat_x = dx.reshape(-1, 3 * n)
        g["rec"], g["bias"] = drec, flat_x.sum(0)
        order = np.argsort(inp.reshape(-1), kind="stable")
        ids = inp.reshape(-1)[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        g["inp"] = np.zeros_like(w["inp"])
        g["inp"][ids[first]] = np.add.reduceat(flat_x[order], first)
        return {k: v / max(len(flat), 1) for k, v in g.items()}, last


class Trainer:
    """Adam with gradients cut at unit norm. Windows of few live lanes are gathered to ``STEP_TOKENS`` a step,
    so that every token has the same weight; ``flush`` takes the step of what is left."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps, self.gathered = net, rate, 0, 0
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.sum = {k: np.zeros_like(v) for k, v in net.w.items()}

    def __call__(self, tok: np.ndarray, keep: np.ndarray, h: np.ndarray, on: np.ndarray) -> np.ndarray:
        g, last = self.net.gradients(tok, keep, h, on)
        n = int(on.sum())
        for k, x in g.items():
            self.sum[k] += x * n
        self.gathered += n
        if self.gathered >= STEP_TOKENS:
            self.flush()
        return last

    def flush(self) -> None:
        if not self.gathered:
            return
        g = {k: x / self.gathered for k, x in self.sum.items()}
        self.sum, self.gathered = {k: np.zeros_like(x) for k, x in g.items()}, 0
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        self.steps += 1
        rate = self.rate * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, x in g.items():
            x = x * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.99 * self.v[k] + 0.01 * x * x
            self.net.w[k] = (self.net.w[k] - rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)).astype(np.float32)


def windows(docs: list[np.ndarray], lanes: int = LANES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Documents laid end to end on lanes of like length; (tokens, keep, document) of each window, and its live lanes.

    ``keep`` is 0 where a document begins. Lanes are sorted by length, so that finished ones fall away at the end.
    """
    lanes = max(1, min(lanes, len(docs)))
    heap = [(0, i) for i in range(lanes)]
    on: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, i = heapq.heappop(heap)
        on[i].append(d)
        heapq.heappush(heap, (size + len(docs[d]), i))
    on.sort(key=lambda x: -sum(len(docs[d]) for d in x))
    size = np.array([sum(len(docs[d]) for d in x) for x in on], np.int64)
    begin = np.cumsum(size) - size
    laid = [d for x in on for d in x]
    # lanes are kept end to end and padded a window at a time, so a long document costs its own length only
    flat = np.concatenate([docs[d] for d in laid]) if laid else np.zeros(0, np.int32)
    owner = np.repeat(np.array(laid, np.int32), [len(docs[d]) for d in laid])
    going = np.ones(len(flat), np.float32)
    going[np.cumsum([0, *(len(docs[d]) for d in laid[:-1])])[: len(laid)]] = 0
    for t in range(0, int(size.max(initial=0)), WINDOW):
        live = int((size > t).sum())
        wide = min(WINDOW, int(size[0]) - t)
        at = t + np.arange(wide)[:, None]
        on_lane = at < size[:live]
        at = np.where(on_lane, begin[:live] + at, 0)
        yield np.where(on_lane, flat[at], 0), np.where(on_lane, going[at], np.float32(1)), np.where(on_lane, owner[at], -1), live


def score_texts(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document's tokens, state carried from its first token to its last."""
    out = np.zeros(len(docs))
    h = None
    for tok, keep, doc, live in windows(docs):
        h = np.zeros((live, HIDDEN), np.float32) if h is None else h[:live]
        got, h = net.score(tok, keep, h)
        on = doc >= 0
        out += np.bincount(doc[on], got[on], len(docs))
    return out


def train_texts(train: Trainer, docs: list[np.ndarray], most: int | None = None) -> int:
    """Goes once through all tokens of the documents, or through ``most`` and the rest of a window; how many."""
    h, seen = None, 0
    for tok, keep, doc, live in windows(docs):
        h = np.zeros((live, HIDDEN), np.float32) if h is None else h[:live]
        on = doc >= 0
        h = train(tok, keep, h, on)
        seen += int(on.sum())
        if most is not None and seen >= most:
            break
    return seen


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", (remainder("doc_id", 5) == 1).alias("held_out"), F.xxhash64("text").alias("th"))


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all documents given."""
    return arrow_map(train.select("text"), _counting, "word binary, n long", rows=1 << 16, most=4 * SLICE_BYTES).groupBy("word").agg(F.sum("n").alias("c"))


def _blocks(blocks: dict[int, np.ndarray], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary()), pa.array([n] * len(blocks), pa.int64())], ["i", "x", "n"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON, warm_tokens: int = WARM_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    train = rows.filter(~F.col("held_out"))
    counts = written(count_words(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count of which all words fit into the lexicon, from how many words have which count
    least, room = 1 << 62, lexicon
    for r in sorted(counts.groupBy("c").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.c):
        room -= r.k
        if room < 0:
            break
        least = r.c
    # the end is always in the lexicon, however rare it is beside long texts' words, or not learnt at all
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    top = [(bytes(r.word), r.c) for r in counts.filter((F.col("c") >= least) & (F.col("word") != F.lit(END))).collect()]
    top = sorted([*top, (END, ends.c if ends else 0)], key=lambda x: (-x[1], x[0]))
    lex = Lexicon([w for w, _ in top], np.array([c for _, c in top], np.float64), total, distinct)
    held = spark.sparkContext.broadcast((lex.words, lex.counts, lex.total, lex.distinct))

    # warm start on the driver
    net = Network(lex)
    if distinct:
        trainer, left = Trainer(net, WARM_RATE), warm_tokens
        # the documents with the smallest hashes of the id
        ids = train.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(warm_tokens // 200 + 50).collect()
        some = train.filter(F.col("doc_id").isin(*[r.doc_id for r in ids if r.doc_id is not None]) & (F.length("text") <= WARM_CHARS))
        sample = lex.numbers(pa.array([r.text for r in some.select("doc_id", "text").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()], pa.large_string()))[0]
        while sample and left > 0:
            left -= max(train_texts(trainer, sample, left), WINDOW)  # a pass over very short texts counts as a window
        trainer.flush()
    start = spark.sparkContext.broadcast(net.w)

    class Learning:
        def __init__(self):
            self.net = Network(Lexicon(*held.value), start.value)
            self.train, self.seen = Trainer(self.net, RATE), 0

        def __call__(self, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            self.seen += train_texts(self.train, self.net.lex.numbers(batch.column("text"))[0])
            return []

        def finish(self) -> Iterator[pa.RecordBatch]:
            self.train.flush()
            if self.seen:
                flat = np.concatenate([self.net.w[k].reshape(-1) for k in Network.NAMES]).astype("<f8") * self.seen
                yield _blocks({i: flat[at : at + BLOCK] for i, at in enumerate(range(0, len(flat), BLOCK))}, self.seen)

    class Adding:
        """Sums the blocks of all tasks."""

        def __init__(self):
            self.sums: dict[int, np.ndarray] = {}
            self.n: dict[int, int] = {}

        def __call__(self, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            for i, x, n in zip(*(batch.column(c).to_pylist() for c in ("i", "x", "n"))):
                self.sums[i] = self.sums.get(i, 0) + np.frombuffer(x, "<f8")
                self.n[i] = self.n.get(i, 0) + n
            return []

        def finish(self) -> Iterator[pa.RecordBatch]:
            for i, x in self.sums.items():
                yield _blocks({i: x}, self.n[i])

    if distinct:
        # the weights times the tokens they were learnt from, a row a block and task, summed by the cluster: the driver
        # gets one model whatever the number of tasks
        learnt = arrow_map(train.select("text"), Learning, "i long, x binary, n long", rows=8192)
        summed = sorted(arrow_map(learnt.repartition("i"), Adding, "i long, x binary, n long").collect(), key=lambda r: r.i)
        if summed:
            flat, at, w = np.concatenate([np.frombuffer(r.x, "<f8") / r.n for r in summed]).astype(np.float32), 0, {}
            for k in Network.NAMES:
                w[k] = flat[at : at + net.w[k].size].reshape(net.w[k].shape)
                at += net.w[k].size
            net.w = w
    final = spark.sparkContext.broadcast(net.w)

    def scoring():
        own = Network(Lexicon(*held.value), final.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            each, others, owner = own.lex.numbers(batch.column("text"))
            got = score_texts(own, each) / math.log(10)
            # the words outside the lexicon, with their counts in each text
            coded = others.dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pair, times = np.unique(owner * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            words = coded.dictionary.take(pa.array(pair % kinds)).cast(pa.large_binary()).cast(pa.binary())
            n = len(each)
            cuts = pa.array(np.searchsorted(pair // kinds, np.arange(n + 1)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out", "th")),
                    pa.array([len(x) for x in each], pa.int64()),
                    pa.array(np.bincount(owner, minlength=n), pa.int64()),
                    pa.array([int((own.lex.known_counts[x] > 0).sum()) for x in each], pa.int64()),
                    pa.array([float(own.lex.base[x].sum()) for x in each]),
                    pa.array(got),
                    pa.ListArray.from_arrays(cuts, words),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                ],
                ["doc_id", "held_out", "th", "n_tokens", "n_rest", "n_head", "head_base", "head_score", "words", "counts"],
            )

        return step

    schema = "doc_id long, held_out boolean, th long, n_tokens long, n_rest long, n_head long, head_base double, head_score double, words array<binary>, counts array<int>"
    parts = written(arrow_map(rows, scoring, schema, rows=8192), "scored")
    pairs = parts.select("th", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("th", F.col("p.words").alias("word"), F.col("p.counts").alias("n"))
    rare = counts.filter((F.col("c") < least) & (F.col("word") != F.lit(END)))
    joined = pairs.join(rare, "word", "left")
    c = F.coalesce("c", F.lit(0))
    # copies of a text give their words as often as there are copies
    copies = parts.groupBy("th").agg(F.count("*").alias("copies"))
    tails = joined.groupBy("th").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"))
    tails = tails.join(copies, "th").select("th", (F.col("tail") / F.col("copies")).alias("tail"), F.expr("tail_known div copies").alias("tail_known"))
    parts = parts.drop("words", "counts")
    tail, tail_known = F.coalesce("tail", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    log_total = math.log10(total + 0.5 * (distinct + 1))
    return parts.join(tails, "th", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + tail_known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + tail - F.col("n_rest") * F.lit(log_total)).alias("base_score"),
        (F.col("head_score") + tail - F.col("n_rest") * F.lit(math.log10(lex.rest_mass))).alias("score"),
    )
