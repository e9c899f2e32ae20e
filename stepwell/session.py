"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Name of the folder that holds the scratch folders of an application, before its id.
SCRATCH = "stepwell-scratch-"
_owned: set[str] = set()


def local_session(app_name: str = "stepwell", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session in one process may fall back to a temporary folder, which is removed when it ends:
    with executors of their own a machine-local folder would be lost to the others, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="stepwell-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


_scopes: list[list[str]] = []


def new_folder(spark: SparkSession, kind: str = "stepwell") -> str:
    """A scratch folder of its own in the shared folder, not made yet.

    All scratch folders of an application lie under one, which goes when the application ends. Inside ``scratch`` a
    folder goes at the end of the block.
    """
    root = f"{shared_dir(spark).rstrip('/')}/{SCRATCH}{spark.sparkContext.applicationId}"
    if root not in _owned:
        files, path = _open(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _owned.add(root)
    folder = f"{root}/{kind}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block, also of one that fails, every scratch folder made within it.

    Tables that operators return may read scratch folders until they are written, so write them within the block. An index
    built within it is gone afterwards; a stored one stays.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            remove_folder(spark, folder)


def sweep(spark: SparkSession, older_than_hours: float = 72.0) -> int:
    """Delete what applications that were killed have left in the shared folder; the number of folders deleted.

    An application counts as gone when none of its scratch folders was made or removed for so many hours.
    """
    files, shared = _open(spark, shared_dir(spark))
    own = f"{SCRATCH}{spark.sparkContext.applicationId}"
    before = (time.time() - older_than_hours * 3600) * 1000
    gone = [
        status.getPath()
        for status in (files.listStatus(shared) if files.exists(shared) else [])
        if status.getPath().getName().startswith(SCRATCH)
        and status.getPath().getName() != own
        and status.getModificationTime() < before
    ]
    for path in gone:
        files.delete(path, True)
    return len(gone)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to a scratch folder of its own; the table as read back, and the folder.

    Nothing is shared by accident: a later call on the same plan reads its sources again.
    """
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder."""
    files, path = _open(spark, folder)
    files.delete(path, True)


def _open(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
