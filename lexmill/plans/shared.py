"""Intermediate tables that outlive executors, and joins that broadcast only what has been measured.

Lineage is cut by writing a Parquet table into the folder that the session names in
``spark.checkpoint.dir``, which all executors share. Unlike a local checkpoint, such a table survives the
loss of any executor; unlike an RDD checkpoint, it is columnar and compressed.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast: both are known before the hint is given.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Sizes from here on stand for tables of which the planner knows none: those that the driver has made of a setting.
_UNKNOWN = 1 << 50

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` as a full address; one of our own only where that setting is absent in local mode, as in tests.

    On a cluster a folder of one machine would take each executor's part of a table apart from the others, so that the
    setting is required there.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and app not in _OWN:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        _MADE.append(_OWN[app])
    return _full(spark, (named or _OWN[app]).rstrip("/"))


def _full(spark: SparkSession, path: str) -> str:
    """A path with the file system that it is meant in: its own, else the cluster's default one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return p.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; it is removed when the driver ends, or by :func:`release`."""
    path = f"{shared_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def still_there(spark: SparkSession, path: str) -> bool:
    """Whether a written table hasn't been removed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Removes all tables written so far. Results that still read from them must have been used."""
    while _MADE and SparkSession.getActiveSession() is not None:
        _remove(_MADE.pop())
    _OWN.clear()


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end the tables written within it, so that a long session doesn't fill the shared folder. Results must have been used by then."""
    before = set(_MADE) | set(_OWN.values())
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before and p not in _OWN.values()]:
            _MADE.remove(path)
            _remove(path)


@atexit.register
def _at_end() -> None:
    left = list(_MADE)
    try:
        release()
    except Exception:  # noqa: BLE001, S110 - the JVM may have ended before
        pass
    for path in left:  # what a stopped session has left behind, where the folder is reached without Spark
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: executed once, and safe against lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``: of a written table that of its files, which is known before anything runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and :data:`BROADCAST_BYTES`, else as it is; and which of the two.

    ``df`` should come from :func:`cut`: its bytes are those of its files, and counting its rows reads only footers.
    """
    size = planned_bytes(df)
    if BROADCAST_BYTES < size < _UNKNOWN:
        return df, False
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df), True) if small else (df, False)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`sized_broadcast` without saying which it was: beyond the bound the join is Catalyst's choice."""
    return sized_broadcast(df, rows)[0]


def reading_partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str):
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
