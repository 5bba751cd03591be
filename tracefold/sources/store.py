"""S5 for the whole pipeline: persist a Lifecycle and its paired entity tables once, reopen lazily.

Production flow: ``read_event_log`` (or the message reader) -> ``write_trace`` into a
folder on shared storage -> every analysis opens it with ``open_trace``. The write
cuts the lineage (a lost executor never re-reads the raw logs), and later reads
get column pruning and predicate pushdown from Parquet. Tables are partitioned by
application when ``partition_by_app`` is set (pruning for per-app questions).
"""

from __future__ import annotations

import threading
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from tracefold.operators import entities
from tracefold.sources.lifecycle import Lifecycle

ENTITY_TABLES = ["jobs", "stages", "tasks", "executors"]


def write_trace(lc: Lifecycle, path: str, partition_by_app: bool = False, mode: str = "overwrite") -> None:
    base = path.rstrip("/")

    def w(df: DataFrame, sub: str) -> None:
        wr = df.write.mode(mode)
        if partition_by_app:
            wr = wr.partitionBy("app_id")
        wr.parquet(f"{base}/{sub}")

    # independent tables: submit their jobs concurrently (Spark schedules jobs from several threads)
    run_parallel([(lambda n=f.name: w(getattr(lc, n), f"events/{n}")) for f in fields(Lifecycle)])
    stored = open_events(lc.job_start.sparkSession, base)
    run_parallel([
        lambda: w(entities.pair_jobs(stored), "entities/jobs"),
        lambda: w(entities.pair_stages(stored), "entities/stages"),
        lambda: w(entities.pair_tasks(stored), "entities/tasks"),
        lambda: w(entities.pair_executors(stored), "entities/executors"),
    ])


def run_parallel(actions, workers: int = 4) -> None:
    """Run independent Spark actions from a few driver threads; re-raise the first failure."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=workers) as pool:
        for fut in [pool.submit(a) for a in actions]:
            fut.result()


class LazyTables:
    """Parquet tables opened on first use (a query pays footer reads only for tables it touches)."""

    def __init__(self, spark: SparkSession, base: str, names: list[str]):
        self._spark, self._base, self._names, self._dfs = spark, base.rstrip("/"), set(names), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        if name not in self._dfs:
            self._dfs[name] = self._spark.read.parquet(f"{self._base}/{name}")
        return self._dfs[name]


class StoredTables:
    """Tables of ``source`` (its attributes): those in ``stored`` are written on first use and read back, the others
    are views of what they are built from."""

    def __init__(self, spark: SparkSession, base: str, source: object, stored: list[str]):
        self.stored = stored
        self._spark, self._base, self._source = spark, base.rstrip("/"), source
        self._dfs: dict[str, DataFrame] = {}
        self._locks = {n: threading.RLock() for n in stored}  # a table is written once, others meanwhile

    def written(self, name: str) -> bool:
        return name in self._dfs

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._locks:
            return getattr(self._source, name)
        with self._locks[name]:
            if name not in self._dfs:
                path = f"{self._base}/{name}"
                getattr(self._source, name).write.mode("overwrite").option("compression", "zstd").parquet(path)
                self._dfs[name] = self._spark.read.parquet(path)
            return self._dfs[name]


def open_events(spark: SparkSession, path: str) -> Lifecycle:
    t = LazyTables(spark, f"{path.rstrip('/')}/events", [f.name for f in fields(Lifecycle)])
    return _LazyLifecycle(t)  # type: ignore[return-value]


def open_entities(spark: SparkSession, path: str) -> LazyTables:
    return LazyTables(spark, f"{path.rstrip('/')}/entities", ENTITY_TABLES)


class _LazyLifecycle:
    def __init__(self, t: LazyTables):
        self._t = t

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._t, name)
