"""Operator 11, conversation structure repair: cheapest edits by shortest paths with a dial of buckets.

Method: the places between a conversation's rows, each with a state of the pattern ``(s?(ua)+)?``, are the nodes of a
graph whose arcs are the edits, with whole costs of 0 to 6. Distances to the end come from a dial, a ring of buckets
of which one is emptied after the other, as costs are small. The audit walks from the start along tight arcs (those
whose cost is just the difference of distances), at each node along the one of the least letter.

A conversation of any length: the rows are sorted by range and cut into blocks. A block's graph gives the cost from
each of its four first states to each of its four last ones; these small tables are added up from the conversation's end,
which gives each block the distances at its end; with these, each block is walked from each first state. A conversation
of one block, as nearly all are, is done with at once. What a row needs to know from afar, whether it repeats an earlier
row, is found within a sorted partition, and by a join for the few conversations that go on over its border.

Rows: a null role or text is one space, and so is a null id or turn where it is hashed; a null ``conv_id`` is a conversation
of its own. Rows of one turn are ordered by role, then by a hash of the text; equal rows are interchangeable. Text may be
of any length. An empty role, or one of another initial, cannot be kept. A conversation all of whose rows are dropped, comes
back with zeros. An empty table gives an empty result; other columns are ignored.

Scale: one range exchange of the rows (a tie-breaking number is part of its key, so that one conversation with a third of all
rows is cut as well), and one exchange by conversation at the end. That last step is a stream of one conversation's rows
through SHA-256, which cannot be cut; it holds a block at a time, and the audit, which is one value. The tables
of a conversation's blocks meet in one task: one row for each ``BLOCK`` rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import arrow_map, as_bytes, written

#: Rows of a block.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: at the start, after the system row, after a user row, after an assistant row; the last of these and the first may end.
STATES, START, FINAL = 4, 0, (0, 3)
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that may be written at a state, the state after it, and the states before it.
_WRITE = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: Buckets of the dial: more than the greatest cost of an arc, and than distances of one block's end can differ.
_DIAL = 32
_FAR = 1 << 60


def _arcs(code: str) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the edits of one row. A code is ``-`` (must be deleted), or the initial
    (``x`` if it is none of s, u, a), in upper case if the text is truncated."""
    out = [("D", q, q, DELETE) for q in range(STATES)]
    if code != "-":
        more = TRUNCATED * code.isupper()
        out += [("K", q, _AFTER[q, code.lower()], KEEP + more) for q in range(STATES) if (q, code.lower()) in _AFTER]
        out += [("R", q, _NEXT[q], REROLE + more) for q in range(STATES)]
    return out


_ROW = {c: _arcs(c) for c in "-suaxSUAX"}
_INSERTS = [("I", q, _NEXT[q], INSERT) for q in range(STATES)]
_BACK = {c: [[(p, cost) for _, p, q, cost in arcs if q == to] for to in range(STATES)] for c, arcs in _ROW.items()}
_BACK_INSERT = [[(p, cost) for _, p, q, cost in _INSERTS if q == to] for to in range(STATES)]
_OUT = {c: [sorted(a for a in [*arcs, *_INSERTS] if a[1] == q) for q in range(STATES)] for c, arcs in _ROW.items()}
#: What is left to insert after the last row, by state, and its cost.
_REST = ("", "II", "I", "")
END = tuple(INSERT * len(x) for x in _REST)


def distances(codes: str, at_end: tuple[int, ...]) -> list[int]:
    """Distance to the end of node ``place * STATES + state``; ``at_end`` are those of the last place, which belongs to what follows."""
    n = len(codes)
    dist = [_FAR] * ((n + 1) * STATES)
    dial: list[list[int]] = [[] for _ in range(_DIAL)]
    waiting, now = 0, min(at_end)
    for q, d in enumerate(at_end):
        if d < _FAR:
            dist[n * STATES + q] = d
            dial[d % _DIAL].append(n * STATES + q)
            waiting += 1
    while waiting:
        bucket = dial[now % _DIAL]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue  # reached at less meanwhile
            place, q = divmod(node, STATES)
            steps = [(place * STATES + p, cost) for p, cost in _BACK_INSERT[q]] if place < n else []
            if place:
                steps += [((place - 1) * STATES + p, cost) for p, cost in _BACK[codes[place - 1]][q]]
            for before, cost in steps:
                if now + cost < dist[before]:
                    dist[before] = now + cost
                    dial[(now + cost) % _DIAL].append(before)
                    waiting += 1
        now += 1
    return dist


def walk(codes: str, dist: list[int], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from the first place in this state, and the state at the last place."""
    out, place, n = [], 0, len(codes)
    while place < n:
        here = dist[place * STATES + state]
        for letter, _, to, cost in _OUT[codes[place]][state]:
            at = place + (letter != "I")
            if here == cost + dist[at * STATES + to]:
                out.append(letter)
                place, state = at, to
                break
    return "".join(out), state


@lru_cache(maxsize=100_000)
def _short(codes: str) -> str:
    return walk(codes, distances(codes, END), START)[0]


def cheapest(codes: str) -> str:
    """The edits of a conversation of one block, but for what is left to insert at its end; those of short ones are remembered."""
    return (_short if len(codes) <= 32 else _short.__wrapped__)(codes)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, dropped: rows by the remainder of ``crc32(conv_id:turn)``; a dropped row stays as a mark."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), (F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20).alias("kind")
    )
    kind = F.col("kind")
    after = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), after.alias("text"), (kind == 0).alias("dropped"), F.explode(times).alias("_t")).drop("_t")


#: A row of a conversation (``kind`` 1) or a block of such rows (0), whose ``code`` has the codes of its rows, but for dropped ones.
_ROWS = "kind int, conv_id long, part int, block long, seq long, at int, turn long, role string, text string, key binary, code string, fault string, alone boolean"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
_NEW = object()


def _sorted(turns: DataFrame) -> DataFrame:
    """Rows by range of conversation and turn, with what a row is judged by: its last character that is not blank, and a
    key of role and text."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "key", "tie"]
    rows = turns.withColumn("last", last).withColumn("key", key).withColumn("tie", F.monotonically_increasing_id())
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("tie")


def _flagged(most: int):
    """A task over a sorted partition: numbers the rows, finds those that repeat one of the partition, and adds the blocks."""
    return lambda: _flags(most)


def _flags(most: int):
    conv, block, codes, seen, seq, part = _NEW, 0, [], set(), 0, 0

    def closed(alone: bool) -> dict:
        return {"kind": 0, "conv_id": conv, "part": part, "block": block, "seq": -1, "code": "".join(codes), "alone": alone and not block}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)

    def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        nonlocal conv, block, codes, seen, seq, part
        blocks, code, fault, numbers, places = [], [], [], [], []
        for c, p, role, last, key, drop in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "role", "last", "key", "dropped"))):
            if conv is _NEW or c != conv:
                if conv is not _NEW:
                    blocks.append(closed(True))
                conv, part, block, codes, seen = c, p, 0, [], set()
            elif len(codes) == most:
                blocks.append(closed(False))
                block, codes = block + 1, []
            numbers.append(block)
            places.append(len(codes))
            wrong = "" if drop else "b" if not last else "d" if key in seen else "" if last in ".!?" else "t"
            if not drop:
                seen.add(key)
                initial = role[:1] if role[:1] in {"s", "u", "a"} else "x"
                codes.append("-" if wrong in {"b", "d"} else initial.upper() if wrong else initial)
            code.append("" if drop else codes[-1])
            fault.append(wrong)
        n = batch.num_rows
        cols = {"kind": [1] * n, "block": numbers, "seq": range(seq, seq + n), "at": places, "code": code, "fault": fault, "alone": [False] * n}
        seq += n
        out = [pa.array(cols[name], t) if name in cols else batch.column(name).cast(t) for name, t in zip(_NAMES, _TYPES)]
        return [pa.RecordBatch.from_arrays(out, _NAMES), *([batch_of(blocks)] if blocks else [])]

    step.finish = lambda: iter([] if conv is _NEW else [batch_of([closed(True)])])
    return step


def _is(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _repeated_afar(rows: DataFrame, border: DataFrame) -> DataFrame:
    """conv_id, part, block, afar: the rows (by place in their block's code) that repeat one of an earlier partition. A partition has
    a text of a conversation once at most here, so a text that all rows of one have is as many rows as there are partitions."""
    some = rows.filter((F.col("kind") == 1) & ~F.col("code").isin("", "-"))
    some = some.join(F.broadcast(border), _is("conv_id", "on_border"), "left_semi").select("conv_id", "key", "part", "block", "at")
    first = some.groupBy(F.col("conv_id").alias("_c"), F.col("key").alias("_k")).agg(F.min("part").alias("_p"))
    late = some.join(first, _is("conv_id", "_c") & (F.col("key") == F.col("_k"))).filter(F.col("part") > F.col("_p"))
    return late.groupBy("conv_id", "part", "block").agg(F.collect_set("at").alias("afar"))


_BLOCKS = "conv_id long, part int, block long, code string"


def _column(batch: pa.RecordBatch, keep: list[str], name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, kind)], [*keep, name])


def _stream(blocks: DataFrame, down: bool) -> DataFrame:
    """All blocks of a conversation in one task, one after the other."""
    order = [F.col(c).desc() if down else F.col(c).asc() for c in ("conv_id", "part", "block")]
    return blocks.repartition("conv_id").sortWithinPartitions(*order)


_KEPT = ["conv_id", "part", "block", "code"]


def _marked():
    """Blocks with the rows that repeat one from afar to be deleted."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = []
        for code, afar in zip(batch.column("code").to_pylist(), batch.column("afar").to_pylist()):
            gone = set(afar or ())
            codes.append("".join("-" if i in gone else c for i, c in enumerate(code)) if gone else code)
        return _column(batch, _KEPT[:3], "code", codes, pa.string())

    return step


def _costs():
    """Of each block: the least costs from each first state to each last one."""

    def table(code: str) -> list[int]:
        to = [distances(code, tuple(0 if q == end else _FAR for q in range(STATES)))[:STATES] for end in range(STATES)]
        return [to[end][q] for q in range(STATES) for end in range(STATES)]

    return lambda batch: _column(batch, _KEPT, "costs", [table(c) for c in batch.column("code").to_pylist()], pa.list_(pa.int64()))


def _ends():
    """From a conversation's last block to its first: the distances at the end of each block."""
    conv, now = _NEW, END

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal conv, now
        out = []
        for c, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist()):
            if conv is _NEW or c != conv:
                conv, now = c, END
            out.append(list(now))
            now = tuple(min(costs[q * STATES + e] + now[e] for e in range(STATES)) for q in range(STATES))
        return _column(batch, _KEPT, "at_end", out, pa.list_(pa.int64()))

    return step


def _level(at_end: list[int]) -> tuple[int, ...]:
    """Distances less the least of them, which changes no walk; states that cannot be left for the end stay far."""
    least = min(at_end)
    return tuple(d - least if d < _FAR else _FAR for d in at_end)


def _leads():
    """Of each block: the last state for each first one."""

    def leads(code: str, at_end: list[int]) -> list[int]:
        dist = distances(code, _level(at_end))
        return [walk(code, dist, q)[1] for q in range(STATES)]

    keep = [*_KEPT, "at_end"]
    return lambda batch: _column(batch, keep, "leads", [leads(c, e) for c, e in zip(batch.column("code").to_pylist(), batch.column("at_end").to_pylist())], pa.list_(pa.int32()))


def _starts():
    """From a conversation's first block to its last: the state in which each begins."""
    conv, state = _NEW, START
    keep = [*_KEPT, "at_end", "leads"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal conv, state
        out = []
        for c, leads in zip(batch.column("conv_id").to_pylist(), batch.column("leads").to_pylist()):
            if conv is _NEW or c != conv:
                conv, state = c, START
            out.append(state)
            state = leads[state]
        return _column(batch, keep, "state", out, pa.int32())

    return step


def _walks():
    """The edits of each block."""

    def edits(code: str, at_end: list[int], state: int) -> str:
        return walk(code, distances(code, _level(at_end)), state)[0]

    cols = ("code", "at_end", "state")
    return lambda batch: _column(batch, _KEPT, "edits", [edits(*x) for x in zip(*(batch.column(c).to_pylist() for c in cols))], pa.string())


def _audits():
    """The edits of conversations of one block."""
    return lambda batch: _column(batch, _KEPT, "edits", [cheapest(c) for c in batch.column("code").to_pylist()], pa.string())


def _edits(rows: DataFrame) -> DataFrame:
    """conv_id, part, block, code (repetitions from afar marked), edits of each block."""
    border = rows.filter((F.col("kind") == 1) & (F.col("seq") == 0)).select(F.col("conv_id").alias("on_border")).distinct()  # one a partition at most
    blocks = rows.filter(F.col("kind") == 0).select("conv_id", "part", "block", "code", "alone").join(F.broadcast(border.withColumn("_b", F.lit(True))), _is("conv_id", "on_border"), "left")
    alone = F.col("alone") & F.col("_b").isNull()
    whole = arrow_map(blocks.filter(alone).select(*_KEPT), _audits, f"{_BLOCKS}, edits string", rows=4096)
    afar = _repeated_afar(rows, border).select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "part", "block")), "afar")
    same = _is("conv_id", "_conv_id") & (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))
    cut = blocks.filter(~alone).select(*_KEPT).join(afar, same, "left").select(*_KEPT, "afar")
    cut = written(arrow_map(cut, _marked, _BLOCKS), "blocks")
    costs = arrow_map(cut.repartition("part", "block"), _costs, f"{_BLOCKS}, costs array<long>")
    ends = arrow_map(_stream(costs, True), _ends, f"{_BLOCKS}, at_end array<long>")
    leads = arrow_map(ends.repartition("part", "block"), _leads, f"{_BLOCKS}, at_end array<long>, leads array<int>")
    starts = arrow_map(_stream(leads, False), _starts, f"{_BLOCKS}, at_end array<long>, leads array<int>, state int")
    return whole.unionByName(arrow_map(starts.repartition("part", "block"), _walks, f"{_BLOCKS}, edits string"))


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """A conversation as its rows come, block by block."""

    def __init__(self, conv: int | None):
        self.conv, self.sha, self.lines, self.audit, self.state = conv, hashlib.sha256(), 0, [], START
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.first_turn = self.last_turn = self.before = None
        self.turns, self.codes, self.edits, self.row, self.at = 0, "", "", 0, 0

    def _line(self, role: str, text: bytes) -> None:
        self.sha.update((b"\n" if self.lines else b"") + role.encode() + b":" + text)
        self.lines += 1

    def _insert(self) -> None:
        self._line(_WRITE[self.state], b"")
        self.cost += INSERT
        self.state = _NEXT[self.state]

    def block(self, codes: str, edits: str) -> None:
        self.codes, self.edits, self.row, self.at = codes, edits, 0, 0
        self.audit.append(edits)

    def add(self, turn: int | None, role: str, text: bytes, fault: str) -> None:
        if turn is not None:
            if self.turns == 0:
                self.first_turn = turn
            self.turns += self.turns == 0 or turn != self.last_turn
            self.last_turn = turn
        initial, code = role[:1], self.codes[self.row]
        self.illegal += self.before is not None and self.before + initial not in _LEGAL
        self.before = initial
        self.row += 1
        self.blank += fault == "b"
        self.duplicate += code == "-" and fault != "b"
        self.truncated += code.isupper()
        while self.edits[self.at] == "I":
            self._insert()
            self.at += 1
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * code.isupper()
        if edit == "K":
            self._line(role, text)
            self.state = _AFTER[self.state, initial]
        else:
            self.cost += REROLE
            self._line(_WRITE[self.state], text)
            self.state = _NEXT[self.state]

    def done(self) -> tuple:
        for letter in _REST[self.state] if self.row or len(self.audit) > 1 else "":
            self.audit.append(letter)
            self._insert()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _together():
    """A task over conversations: blocks, each before its rows."""
    now: _Conversation | None = None
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        nonlocal now
        done = []
        cols = [as_bytes(batch) if c == "text" else batch.column(c).to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "code", "fault", "edits")]
        for kind, conv, turn, role, text, code, fault, edits in zip(*cols):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.done())
                now = _Conversation(conv)
            if kind:
                now.add(turn, role, text, fault)
            else:
                now.block(code, edits)
        return [batch_of(done)] if done else []

    step.finish = lambda: iter([] if now is None else [batch_of([now.done()])])
    return step


def repair(turns: DataFrame, block: int = BLOCK, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: gaps in its turns, faults of its rows, illegal neighbours, and its cheapest repair."""
    rows = written(arrow_map(_sorted(damaged(turns, conv, turn, role, text)), _flagged(block), _ROWS, rows=4096), "turns")
    none = lambda *kinds: [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds]
    edits = _edits(rows).select(F.lit(0).alias("kind"), "conv_id", "part", "block", F.lit(-1).cast("long").alias("seq"), *none("turn long", "role string", "text string"), "code", *none("fault string"), "edits")
    live = rows.filter((F.col("kind") == 1) & (F.col("code") != "")).select("kind", "conv_id", "part", "block", "seq", "turn", "role", "text", F.lit(None).cast("string").alias("code"), "fault", *none("edits string"))
    all_rows = edits.unionByName(live).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "kind", "seq")
    return arrow_map(all_rows, _together, _RESULT, rows=4096)


SQL = None  # shortest paths with ties by text: the test compares with all edits of every conversation
