"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it. A folder of our own is set only when the
session has none (local tests), never a machine-local path on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app_name: str = "tracefold") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACEFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, taken from the session.

    Only when the session names none (a local test) do we create one under the
    system temp folder; cluster sessions must name a shared folder in
    ``spark.checkpoint.dir``.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not current:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; a cluster session must name a shared folder for checkpoints"
            )
        current = tempfile.mkdtemp(prefix="tracefold-ckpt-")
        try:
            spark.conf.set(CHECKPOINT_CONF, current)
        except Exception:  # core confs may be read-only at runtime; the context setting below suffices
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


_CONF_LOCK = threading.RLock()
FOLDERS_OPEN = 64  # folders that a task writes at once before it sorts its rows by folder
SORTED_SPLIT_BYTES = 16 << 20  # input of a task that sorts what it expands
FAST_GZIP = {"zlib.compress.level": "BEST_SPEED"}  # option of text sinks: somewhat larger files in less time
FOLDER_GROUP_BYTES = 16 << 20  # of a Parquet file that is written beside others: a writer holds a row group, a split ends with one


@contextmanager
def with_conf(spark: SparkSession, **settings: object) -> Iterator[None]:
    """Settings of the session (``__`` for ``.``) for one write; they are put back after it."""
    with _CONF_LOCK:
        keys = {k.replace("__", "."): str(v) for k, v in settings.items()}
        before = {k: spark.conf.get(k, None) for k in keys}
        try:
            for k, v in keys.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def unsorted_folders(spark: SparkSession):
    """Writes by folder (``partitionBy``) keep a file open per folder instead of sorting, and spilling, all rows first."""
    return with_conf(spark, spark__sql__maxConcurrentOutputFileWriters=FOLDERS_OPEN)


def folder_parquet(writer):
    """Parquet of small row groups: with the usual ones (128 MB each) the open files of a task, and then the one task that reads
    and sorts a whole group, would need memory for gigabytes of text."""
    return writer.options(**{"compression": "zstd", "parquet.block.size": FOLDER_GROUP_BYTES})


def land(spark: SparkSession, folder: str, landing: str, name: str | None = None) -> None:
    """Move what was written into ``folder`` to where a stream looks for files: whole, as ``landing/name``, or file by file.

    The files are closed, so nothing is written twice. A folder that is not there (nothing was written) is none.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, to = path(folder), path(landing)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(to)
    if not fs.exists(source):
        return
    moves = [(source, path(to, name))] if name else [
        (f.getPath(), path(to, f"{source.getName()}-{f.getPath().getName()}")) for f in fs.listStatus(source) if not f.getPath().getName().startswith(("_", "."))]
    for old, new in moves:
        if not fs.rename(old, new):
            raise OSError(f"{old} could not be moved to {new}")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)

