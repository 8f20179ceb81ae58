"""What a run keeps beside its data: cache, timings and their report, logs, models.

All of it is driver-side and bounded; data itself is kept by written tables.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from logging.handlers import RotatingFileHandler

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LruCache:
    """At most ``size`` entries; the one unused for longest goes first."""

    def __init__(self, size: int = 1000):
        self.size = size
        self._entries: OrderedDict[Hashable, object] = OrderedDict()
        self._lock = threading.Lock()

    def put(self, key: Hashable, value: object) -> None:
        with self._lock:
            self._entries[key] = value
            self._entries.move_to_end(key)
            while len(self._entries) > self.size:
                self._entries.popitem(last=False)

    def get(self, key: Hashable, default: object = None) -> object:
        with self._lock:
            if key not in self._entries:
                return default
            self._entries.move_to_end(key)
            return self._entries[key]

    def invalidate(self, key: Hashable) -> None:
        with self._lock:
            self._entries.pop(key, None)

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()

    def __len__(self) -> int:
        return len(self._entries)

    def persist(self, spark: SparkSession, path: str) -> None:
        """The entries as a table of JSON texts, from the longest unused on; keys are strings."""
        with self._lock:
            rows = [(i, str(k), json.dumps(v)) for i, (k, v) in enumerate(self._entries.items())]
        spark.createDataFrame(rows, "place int, key string, value string").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        """Entries of a persisted cache, used now in the order they were."""
        for row in spark.read.parquet(path).orderBy("place").limit(self.size).collect():
            self.put(row["key"], json.loads(row["value"]))


def evicted(uses: DataFrame, size: int) -> DataFrame:
    """``uses`` (key, used_at) with ``stays``: whether a cache of that size still holds the key after all uses."""
    last = uses.groupBy("key").agg(F.max("used_at").alias("used_at"))
    newest = last.orderBy(F.desc("used_at"), "key").limit(size).select("key", F.lit(True).alias("stays"))
    return last.join(F.broadcast(newest), "key", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))  # size rows


@dataclass
class Monitor:
    """Wall-clock seconds of named stages, and what of a limit they take."""

    limit: float = 60.0
    stages: dict[str, float] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begun = time.perf_counter()
        try:
            yield
        except Exception as e:
            self.errors.append(f"{name}: {e}")
            raise
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - begun

    def total(self) -> float:
        return sum(self.stages.values())

    def report(self) -> dict:
        """Seconds and shares by stage, the total, and whether it keeps the limit without an error."""
        total = self.total()
        return {
            "stages": {k: {"seconds": v, "percent": 100 * v / total if total else 0.0} for k, v in self.stages.items()},
            "total_seconds": total,
            "status": "pass" if total <= self.limit and not self.errors else "fail",
            "errors": self.errors,
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """The report as a JSON text."""
        text = json.dumps(self.report(), indent=2)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def stage_shares(timings: DataFrame, limit: float) -> DataFrame:
    """Timings (run, stage, seconds) as (run, stage, seconds, percent, total, status), a run at a time."""
    sums = timings.groupBy("run", "stage").agg(F.sum("seconds").alias("seconds"))
    totals = sums.groupBy("run").agg(F.sum("seconds").alias("total"))
    joined = sums.join(totals, "run")
    percent = F.when(F.col("total") > 0, 100 * F.col("seconds") / F.col("total")).otherwise(0.0)
    return joined.select("run", "stage", "seconds", percent.alias("percent"), "total", run_status(F.col("total"), limit).alias("status"))


def run_status(total: Column, limit: float) -> Column:
    return F.when(total <= limit, "pass").otherwise("fail")


class JsonLines(logging.Formatter):
    """A record as a JSON object; ``extra={"fields": {...}}`` adds to it."""

    def format(self, record: logging.LogRecord) -> str:
        entry = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            entry["error"] = self.formatException(record.exc_info)
        return json.dumps(entry | getattr(record, "fields", {}), ensure_ascii=False, default=str)


def logger(name: str = "foliant", path: str | None = None, level: int = logging.INFO, most_bytes: int = 10 << 20, kept: int = 5) -> logging.Logger:
    """A logger of JSON lines, to a file that is rotated or else to the error stream; asked twice it is the same one."""
    found = logging.getLogger(name)
    found.setLevel(level)
    if not found.handlers:
        handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept, encoding="utf-8") if path else logging.StreamHandler()
        handler.setFormatter(JsonLines())
        found.addHandler(handler)
        found.propagate = False
    return found


class ModelManager:
    """Models by name: loaded at their first use, kept, reloaded or found missing."""

    def __init__(self, loaders: dict[str, Callable[[], object]]):
        self._loaders, self._loaded, self._lock = dict(loaders), {}, threading.RLock()

    def get(self, name: str) -> object:
        with self._lock:
            if name not in self._loaded:
                self._loaded[name] = self._loaders[name]()
            return self._loaded[name]

    def reload(self, name: str) -> object:
        with self._lock:
            self._loaded.pop(name, None)
            return self.get(name)

    def is_available(self, name: str) -> bool:
        """Whether the model can be loaded; a library that is absent counts as no."""
        try:
            self.get(name)
        except (KeyError, ImportError, OSError):
            return False
        return True

    def validate(self) -> dict[str, bool]:
        return {name: self.is_available(name) for name in sorted(self._loaders)}
