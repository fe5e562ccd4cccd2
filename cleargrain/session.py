"""Session settings and staged tables.

``stage`` is the one place where a pipeline cuts its lineage: the rows are
written once as Parquet in the folder that the cluster names in
``spark.checkpoint.dir`` and read back, so later passes prune columns and a
lost executor costs a re-read instead of a recomputation. The shuffle files
behind a stored table are deleted as soon as it is written, and ``scratch``
deletes stored tables that only a step of a run needs.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# A staged side is broadcast only when its measured size stays below this.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

# Spark keeps shuffle files until the driver collects its garbage; with this they go when the query that wrote them ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
_open = threading.local()  # ``scratch`` of each thread, the innermost last


def local_session(app: str = "cleargrain", cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings that the wide rule projections rely on.

    The JVM does not compile methods above 8,000 bytes of bytecode, so a fused
    stage beyond that runs interpreted. With the limit below, Spark evaluates
    such a projection in separately compiled pieces instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    return spark


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that yields fewer partitions than there are cores.

    A file with one row group is one task. Large inputs are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the session's checkpoint folder.

    A temporary folder is chosen only in local mode with the setting unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="cleargrain-")
    return _local_dir


def staged_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table."""
    spark = df.sparkSession
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # nothing reads the shuffles of ``df`` again
    path = staged_path(spark, label)
    if levels := getattr(_open, "levels", None):
        levels[-1].append(path)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all tables that this thread staged inside, but for those handed to ``keep``.

    What is needed later has to be kept or written elsewhere by then: a table that still reads a deleted one fails.
    """
    levels = _open.levels = getattr(_open, "levels", [])
    levels.append([])
    try:
        yield
    finally:
        for path in levels.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def keep(*tables: DataFrame) -> None:
    """Leave tables, as ``stage`` returned them, to the ``scratch`` around the innermost one, if there is one."""
    *outer, inner = _open.levels
    for table in tables:
        if table.staged_at in inner:
            inner.remove(table.staged_at)
            if outer:
                outer[-1].append(table.staged_at)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str = "stage") -> DataFrame:
    """Stage what ``build`` returns, and delete what it staged on the way; nothing else that it makes may be read later."""
    with scratch(spark):
        out = stage(build(), label)
        keep(out)
    return out


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a staged table is small enough to broadcast, by its rows and the measured bytes of its texts and lists."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    width, measured = 16, []
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        width += fixed.get(kind, 8)
        if kind in ("string", "binary"):
            measured.append(F.sum(F.octet_length(c).cast("bigint")).alias(f"b{i}"))
        elif "<" in kind:  # an entry is 8 bytes or more, also where its text is shorter
            measured.append(F.sum(4 * F.octet_length(F.to_json(F.struct(c))).cast("bigint")).alias(f"b{i}"))
    rows, *sizes = df.agg(F.count(F.lit(1)), *measured).first()
    return rows * width + sum(x or 0 for x in sizes) <= (BROADCAST_LIMIT_BYTES if limit is None else limit)
