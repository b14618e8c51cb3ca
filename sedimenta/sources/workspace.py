"""Durable intermediate results in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@lru_cache(maxsize=1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="sedimenta-")


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # Only where driver and executors are one process is a folder of this machine enough.
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        root = _own_root()
    return f"{root.rstrip('/')}/sedimenta"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named by ``spark.checkpoint.dir``."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    return path


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark's own readers see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, store = _path(spark, path)
    store.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made inside belong to the scope and are removed at its end, after an error too.

    Results that leave the scope must be stored elsewhere; frames over removed folders fail.
    """
    token = _owned.set([])
    try:
        yield
    finally:
        paths = _owned.get()
        _owned.reset(token)
        for path in paths:
            remove(spark, path)


def remove_older(spark: SparkSession, hours: float) -> int:
    """Remove folders that nobody has added to for so long, as drivers that died leave them."""
    at, store = _path(spark, _root(spark))
    if not store.exists(at):
        return 0
    limit = time.time() * 1000 - hours * 3_600_000
    old = [s.getPath() for s in store.listStatus(at) if s.getModificationTime() < limit]
    for path in old:
        store.delete(path, True)
    return len(old)


def write_counted(df: DataFrame, path: str, which: Column | None = None) -> int:
    """Write a frame and return the number of its rows (or of some), observed by the same job."""
    seen = Observation()
    rows = F.count("*") if which is None else F.count_if(which)
    df.observe(seen, rows.alias("rows")).write.parquet(path)
    return seen.get["rows"]


def stash(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage without depending on executors staying alive. Parquet keeps column
    pruning and a true size estimate for the plans that follow.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
