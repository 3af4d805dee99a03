"""Places for own code: analyzers by language, executors by task type, plugins, and decorators for time and retries."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.scoring import TRANSIENT
from siltworks.session import ship

FINDING = "rule_id string, severity string, message string, line long"
PLUGIN_TYPES = ("analyzer", "formatter", "integration", "rule", "theme")
MAX_PLUGINS = 50


@dataclass
class Registry:
    """What is registered in one session. Functions run in Arrow batches on the executors."""

    analyzers: dict[str, Callable[[str, str], list[tuple]]] = field(default_factory=dict)
    executors: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = field(default_factory=dict)
    plugins: dict[str, dict] = field(default_factory=dict)

    def analyzer(self, language: str, function: Callable[[str, str], list[tuple]]) -> None:
        """``function(text, scope name)`` gives (rule_id, severity, message, line) of each finding; the last one registered counts."""
        self.analyzers[language] = function

    def executor(self, kind: str, function: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        self.executors[kind] = function

    def plugin(self, name: str, kind: str, on: bool = True) -> bool:
        """False, and no change, for a name that is there already, an unknown type, or beyond the greatest number."""
        if name in self.plugins or kind not in PLUGIN_TYPES or len(self.plugins) >= MAX_PLUGINS:
            return False
        self.plugins[name] = {"type": kind, "enabled": on}
        return True

    def enabled(self, kind: str | None = None) -> list[str]:
        return [n for n, p in self.plugins.items() if p["enabled"] and kind in (None, p["type"])]

    def switch(self, name: str, on: bool) -> bool:
        if name not in self.plugins:
            return False
        self.plugins[name]["enabled"] = on
        return True

    def analyze(self, scopes: DataFrame) -> DataFrame:
        """scopes(uri, name, language, text): uri, name and the findings of the analyzer of the language; none without one."""
        ship(scopes.sparkSession)
        known = dict(self.analyzers)

        @F.pandas_udf("array<struct<rule_id:string,severity:string,message:string,line:long>>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for language, text, name in batches:
                yield pd.Series([[dict(zip(("rule_id", "severity", "message", "line"), f)) for f in known[g](t, n)] if g in known else [] for g, t, n in zip(language, text, name)])

        rows = scopes.filter(F.col("language").isin(*known)) if known else scopes.limit(0)
        return rows.select("uri", "name", F.explode(run("language", "text", "name")).alias("f")).select("uri", "name", "f.*")

    def execute(self, kind: str, tasks: DataFrame, schema: str) -> DataFrame:
        """Tasks worked off by the executor of their type, in batches; an unknown type is refused before anything runs."""
        if kind not in self.executors:
            raise KeyError(f"No executor for {kind}")
        function = self.executors[kind]
        ship(tasks.sparkSession)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield function(b)

        return tasks.mapInPandas(run, schema)


def timed(record: Callable[[str, float, bool], None]):
    """A decorator that gives a function's name, milliseconds and success to ``record``."""

    def wrap(function):
        @functools.wraps(function)
        def inner(*args, **kwargs):
            began, ok = time.perf_counter(), False
            try:
                out = function(*args, **kwargs)
                ok = True
                return out
            finally:
                record(function.__name__, 1000 * (time.perf_counter() - began), ok)

        return inner

    return wrap


def retried(attempts: int = 3, first_ms: float = 1000, factor: float = 2, most_ms: float = 30000, sleep: Callable[[float], None] = time.sleep):
    """A decorator that tries again after errors that may pass, waiting longer each time."""

    def wrap(function):
        @functools.wraps(function)
        def inner(*args, **kwargs):
            for n in range(1, attempts + 1):
                try:
                    return function(*args, **kwargs)
                except Exception as e:
                    if n == attempts or not any(w in str(e).lower() for w in TRANSIENT):
                        raise
                    sleep(min(first_ms * factor ** (n - 1), most_ms) / 1000)

        return inner

    return wrap
