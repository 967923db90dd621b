"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local = threading.local()
#: Paths of saved tables that are still there, and their sessions.
_held: dict[str, SparkSession] = {}

#: What empties the caches that operators keep in a Python worker from task to task, by operator.
_caches: dict[str, Callable[[], object]] = {}
_using = ""


def keeps(operator: str, drop: Callable[[], object]) -> None:
    """Says that ``operator`` keeps something in a worker, and how it goes."""
    _caches[operator] = drop


def only(operator: str) -> None:
    """Called where a task of ``operator`` begins: what a worker that Spark uses again kept for others goes, back to the system."""
    global _using
    if _using == operator:
        return
    _using = operator
    for other, drop in _caches.items():
        if other != operator:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole input table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs in one process (tests on one
    machine) a temporary folder is set; on a cluster that is an error, as
    executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="assetspark-shared-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    A lost executor costs no recomputation beyond the write.  The files go with
    ``release``, when a ``scratched`` function that saved them returns (not those
    with ``keep``), or at the latest when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assetspark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _held[path] = spark
    scopes = getattr(_local, "scopes", None)
    if scopes and not keep:
        scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Removes the files of saved tables, and lets Spark drop the shuffles that made them."""
    for path in [f.saved_path for f in frames]:
        _remove(path)
    if spark := SparkSession.getActiveSession():
        spark.range(1).collect()  # the last job's shuffles are held until another one has run
        _collect(spark)


def scratched(made: Callable) -> Callable:
    """A function whose saved tables go when it returns; what it returns may only read those saved with ``keep``."""

    @wraps(made)
    def run(*args, **named):
        if not hasattr(_local, "scopes"):
            _local.scopes = []
        _local.scopes.append([])
        try:
            return made(*args, **named)
        finally:
            gone = [p for p in _local.scopes.pop() if p in _held]
            spark = _held[gone[0]] if gone else None
            for path in gone:
                _remove(path)
            if spark:
                _collect(spark)

    return run


def _collect(spark: SparkSession) -> None:
    # shuffle files stay until the driver notices that no plan needs them
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _remove_all() -> None:
    for path in list(_held):
        _remove(path)


def _remove(path: str) -> None:
    spark = _held.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # gone already, or the JVM is
        pass
