"""Session helpers: the shared folder, tables that cut lineage, and local sessions."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and the master is local (tests) a local folder is made and set; on a cluster a
    missing setting is an error, as executors do not see each other's folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spindle-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
        return where
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Bytes of a batch that goes to a Python worker, so that neither side holds a partition of long texts at once.
ARROW_BYTES = 8 << 20

#: The setting under which a query's shuffle files are deleted when it ends.
CLEANS = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def small_batches(spark: SparkSession):
    """Holds the size of Arrow batches for a block."""
    return settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(ARROW_BYTES))


_here = threading.local()
_left: set[str] = set()


def _scopes() -> list[set[str]]:
    if not hasattr(_here, "scopes"):
        _here.scopes = []
    return _here.scopes


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at the end of a block, the tables that :func:`materialise` wrote in it, but for those that :func:`keep` took out."""
    held: set[str] = set()
    _scopes().append(held)
    try:
        yield
    finally:
        _scopes().pop()
        for path in held:
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Hands a table of :func:`materialise` on to the block around this one, or else to the end of the process."""
    scopes, path = _scopes(), getattr(df, "_spindle_path", None)
    if scopes and path in scopes[-1]:
        scopes[-1].discard(path)
        if len(scopes) > 1:
            scopes[-2].add(path)
    return df


def register(path: str) -> None:
    """Has a path below the shared folder deleted when the process ends, if its session still runs then."""
    if not _left:
        atexit.register(clean_up)
    _left.add(path)


def clean_up() -> None:
    """Deletes all tables that are left below the shared folder; no result that reads them may be needed any more."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in list(_left):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _left.discard(path)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table below the shared folder and returns the reread table.

    The table survives lost executors, cuts the lineage, and is written once however often it is read. It is deleted at
    the end of the :func:`scratch` block that it is in, if any, else when the process ends. Shuffle files of the query that
    writes it go as soon as it is written, so those of a job of many steps do not add up on the disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spindle-{name}-{uuid.uuid4().hex}"
    register(path)
    if _scopes():
        _scopes()[-1].add(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(spark), settings(spark, **CLEANS):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindle_path = path  # type: ignore[attr-defined]
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: ``df``, as it is dealt out and sorted, from files in the shared folder. :func:`discard` deletes these, or the end of the process.

    Shuffle files of the query that writes them go as soon as they are written if ``df`` was made under :data:`CLEANS`.
    """
    out = df.checkpoint(eager=True)
    path = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    register(path)
    out._spindle_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by :func:`materialise` or :func:`checkpoint`; nothing may read it afterwards."""
    path = getattr(df, "_spindle_path", None)
    if path:
        for held in _scopes():
            held.discard(path)
        _delete(df.sparkSession, path)


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Holds SQL settings for a block; keys are written with ``__`` for dots."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def local_session(cpus: int | None = None, app: str = "spindle") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
