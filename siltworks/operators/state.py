"""Sequential state machines per key: circuit breaker and alerts with cooldown, on tables and on streams.

Each step depends on all earlier ones of its key, so a key's rows are worked off in order, in Arrow batches; the
state itself is small and bounded. On a table a key's history streams through one task, which holds the state and a batch;
on a stream only the state stays. A micro-batch is put in order, but the rows of one batch all come after those of the batches
before: late rows are worked off when they come, and a key's state never ends (``siltworks.streaming`` has operators with watermarks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import ship
from siltworks.streaming.stateful import over_table

_TESTS: dict[str, Callable[[float, float], bool]] = {
    "gt": lambda v, t: v > t,
    "gte": lambda v, t: v >= t,
    "lt": lambda v, t: v < t,
    "lte": lambda v, t: v <= t,
    "eq": lambda v, t: v == t,
}


class Breaker:
    """Closed; open after ``failures`` within ``window``; half-open after ``wait``; closed after ``successes``.

    A failure exactly one window old does not count any more; a success while closed clears the failures.
    """

    STATE = "state string, recent array<double>, good int, next double"

    def __init__(self, failures: int = 5, window: float = 60, wait: float = 60, successes: int = 2):
        self.limit, self.window, self.wait, self.need = failures, window, wait, successes
        self.state, self.recent, self.good, self.next = "closed", [], 0, 0.0

    def dump(self) -> tuple:
        return self.state, list(self.recent), self.good, float(self.next)

    def load(self, state: tuple) -> Breaker:
        self.state, self.recent, self.good, self.next = state[0], list(state[1]), state[2], state[3]
        return self

    def __call__(self, at: float, ok: bool) -> str:
        if self.state == "open":
            if at < self.next:
                return self.state
            self.state, self.good = "half-open", 0
        if ok and self.state == "half-open":
            self.good += 1
            if self.good >= self.need:
                self.state, self.recent = "closed", []
        elif ok:
            self.recent = []
        else:
            self.recent = [t for t in (*self.recent, at) if t > at - self.window]
            if self.state == "half-open" or len(self.recent) >= self.limit:
                self.state, self.next = "open", at + self.wait
        return self.state


class Alarm:
    """Raises an alert whenever a value is beyond a threshold, and a resolution when it no longer is; both only after
    the ``cooldown`` of the last alert. A resolution does not start a cooldown."""

    STATE = "last double, open boolean"

    def __init__(self, warn: float, critical: float, cooldown: float = 60, op: str = "gte"):
        self.warn, self.critical, self.cooldown, self.beyond = warn, critical, cooldown, _TESTS[op]
        self.last, self.open = float("-inf"), False

    def dump(self) -> tuple:
        return self.last, self.open

    def load(self, state: tuple) -> Alarm:
        self.last, self.open = state
        return self

    def __call__(self, at: float, value: float) -> str | None:
        if at - self.last < self.cooldown:
            return None
        level = "critical" if self.beyond(value, self.critical) else "warning" if self.beyond(value, self.warn) else None
        if level:
            self.last, self.open = at, True
        elif self.open:
            self.open, level = False, "resolved"
        return level


_CALLS = "endpoint long, seq long, at double, ok boolean, state string"
_ALERTS = "metric string, at double, level string, value double"


def _called(step: Breaker, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "seq"])
    return pdf.assign(state=[step(a, o) for a, o in zip(pdf["at"], pdf["ok"])])[["endpoint", "seq", "at", "ok", "state"]]


def _raised(step: Alarm, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for metric, at, value in pdf.sort_values("at")[["metric", "at", "value"]].itertuples(index=False):
        if (level := step(at, value)) is not None:
            out.append((metric, at, level, value))
    return pd.DataFrame(out, columns=["metric", "at", "level", "value"])


_NAN = float("nan")


def _number(x: float | None) -> float:
    return _NAN if x is None else x


def _run(rows: DataFrame, key: str, order: list[str], make: Callable, each: Callable[..., list[dict]], apply: Callable, schema: str) -> DataFrame:
    """A machine for each key: ``each`` of a table's rows in their order (nulls last), or ``apply`` of what a micro-batch of a
    stream has, with the state kept between batches."""
    ship(rows.sparkSession)
    if not rows.isStreaming:

        def machine() -> Callable[[dict], list[dict]]:
            step = make()
            return lambda row: each(step, row)

        return over_table(rows, key, [F.asc_nulls_last(c) for c in order], machine, schema)

    def step(_key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = make()
        if state.exists:
            machine.load(state.get)
        pdf = pd.concat(list(batches), ignore_index=True)
        out = apply(machine, pdf)
        state.update(machine.dump())
        yield out

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy(key).applyInPandasWithState(step, schema, make().STATE, "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(calls: DataFrame, **limits) -> DataFrame:
    """calls(endpoint long, seq long, at double, ok boolean) with the state after each call."""
    rows = calls.select("endpoint", "seq", "at", "ok")
    return _run(rows, "endpoint", ["at", "seq"], lambda: Breaker(**limits), lambda step, r: [{**r, "state": step(_number(r["at"]), r["ok"])}], _called, _CALLS)


def alerts(snapshots: DataFrame, warn: float, critical: float, cooldown: float = 60, op: str = "gte") -> DataFrame:
    """snapshots(metric string, at double, value double): alerts raised and resolved, in the order of time."""

    def each(step: Alarm, r: dict) -> list[dict]:
        level = step(_number(r["at"]), _number(r["value"]))
        return [] if level is None else [{"metric": r["metric"], "at": r["at"], "level": level, "value": r["value"]}]

    return _run(snapshots.select("metric", "at", "value"), "metric", ["at"], lambda: Alarm(warn, critical, cooldown, op), each, _raised, _ALERTS)


class Documents:
    """The last hash of a document: whether a version is new, changed or as before."""

    STATE = "hash string"

    def __init__(self):
        self.hash = None

    def dump(self) -> tuple:
        return (self.hash,)

    def load(self, state: tuple) -> Documents:
        (self.hash,) = state
        return self

    def __call__(self, digest: str | None) -> str:
        digest = digest or ""  # a version without content is one like any other
        kind = "new" if self.hash is None else "same" if digest == self.hash else "changed"
        self.hash = digest
        return kind


def _versioned(step: Documents, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("version")
    return pdf.assign(version=pdf["version"].astype("Int64"), change=[step(h if isinstance(h, str) else None) for h in pdf["hash"]])[["uri", "version", "hash", "change"]]


def document_changes(versions: DataFrame) -> DataFrame:
    """versions(uri string, version long, content string): uri, version, hash, change (new, changed, same)."""
    rows = versions.select(F.col("uri").cast("string"), F.col("version").cast("long"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"))
    each = lambda step, r: [{**r, "change": step(r["hash"])}]
    return _run(rows, "uri", ["version"], Documents, each, _versioned, "uri string, version long, hash string, change string")
