"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application: the driver serves it as a zip."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "parcelyard_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package given to the workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, deleted when the driver's Python ends.

    Where the setting is absent and the master is local (tests on one machine), /tmp/checkpoints is set. On a cluster the absence
    is an error: executors do not share a machine's folder.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file:///tmp/checkpoints"
            sc.setCheckpointDir(base)
        path = f"{base.rstrip('/')}/parcelyard-{uuid.uuid4().hex}"
        _scratch[sc.applicationId] = path
        atexit.register(_end, sc, path)
    return _scratch[sc.applicationId]


def _end(sc: SparkContext, path: str) -> None:
    # where the session was stopped before, another one is not started for this
    if sc._jsc is not None:
        delete(sc, path)
    elif path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def delete(sc: SparkContext, path: str) -> None:
    """Delete a folder on any store."""
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the application's scratch folder."""
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet; what the write shuffled is of no use afterwards and goes at once."""
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.set(key, before)


_open = threading.local()


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if getattr(_open, "stack", None):
        _open.stack[-1].append((out, path))
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within are deleted at the end, but for those given to the function that this yields: the ones that are read later."""
    stack = _open.stack = getattr(_open, "stack", [])
    own: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    stack.append(own)
    try:
        yield keep
    finally:
        stack.remove(own)
    for table, path in own:
        if any(table is k for k in kept):
            if stack:
                stack[-1].append((table, path))
        else:
            delete(table.sparkSession.sparkContext, path)
