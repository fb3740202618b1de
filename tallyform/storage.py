"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a folder of its own; a cluster gets an error, since each of its
    machines would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyform-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Scratch tables that nobody has removed yet; they go when the process exits.
_LEFT: set[str] = set()
#: What the innermost ``scratch`` block of this thread has made.
_WITHIN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@atexit.register
def _remove_left() -> None:
    spark = SparkSession.getActiveSession() if _LEFT else None
    if spark is not None:
        remove(spark, *_LEFT)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    made = _WITHIN.get()
    if made is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables that this thread makes within the block go at its end, but for those taken off the list that it gives."""
    made: list[str] = []
    before = _WITHIN.set(made)
    try:
        yield made
    finally:
        _WITHIN.reset(before)
        remove(spark, *made)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no pending plan reads."""
    sc = spark.sparkContext
    for path in list(paths):
        try:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
            _LEFT.discard(path)
        except Exception:  # noqa: BLE001  at exit the gateway may be gone
            return


@contextlib.contextmanager
def settings(spark: SparkSession, **changed: str) -> Iterator[None]:
    """Session settings that hold within the block (dots as double underscores), and not after it."""
    keys = {k.replace("__", "."): v for k, v in changed.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, name: str, batch_rows: int = 512) -> tuple[DataFrame, str]:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, and its path.

    The shuffle files of the write go with it, so that an operator of several passes holds one pass's at a time.
    batch_rows bounds what one Arrow batch of long texts can hold.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(batch_rows)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
