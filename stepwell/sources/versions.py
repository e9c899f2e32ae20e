"""Folders whose content is replaced as a whole.

A replaced folder holds one subfolder per version and a folder of marks. A version counts from the moment its
mark exists: the mark is an empty file, made in one step, whose name sorts by the number of the version. So a
reader finds the old version or the new one, never a part, and a write that fails leaves the old one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKS = "_versions"
#: Versions that stay, so that readers of the one before can finish.
KEPT = 2
#: A version without a mark belongs to a writer that is running, or to one that failed so many hours ago.
ABANDONED_HOURS = 24.0


def _open(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _under(spark: SparkSession, path: str, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))


def _marks(spark: SparkSession, path: str) -> list[str]:
    """Names of the marks, oldest first."""
    files, _ = _open(spark, path)
    marks = _under(spark, path, MARKS)
    if not files.exists(marks):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(marks))


def _version(mark: str) -> str:
    return "v-" + mark.split("-", 1)[1]


def current(spark: SparkSession, path: str) -> str:
    """The folder to read: the last version of a replaced folder, any other path as it is."""
    marks = _marks(spark, path)
    return f"{path.rstrip('/')}/{_version(marks[-1])}" if marks else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace what ``path`` holds by what ``write`` puts into the folder it is given.

    Of two writers at the same time the one that ends last wins. Versions before the last two are deleted, and so is
    what a plain table had at the path.
    """
    path = path.rstrip("/")
    version = uuid.uuid4().hex
    folder = f"{path}/v-{version}"
    files, _ = _open(spark, path)
    try:
        write(folder)
    except BaseException:
        files.delete(_under(spark, folder), True)
        raise
    marks = _marks(spark, path)
    number = int(marks[-1].split("-", 1)[0]) + 1 if marks else 1
    files.create(_under(spark, path, MARKS, f"{number:020d}-{version}"), False).close()
    _sweep(spark, path)


def _sweep(spark: SparkSession, path: str) -> None:
    files, folder = _open(spark, path)
    marks = _marks(spark, path)
    live = {_version(m) for m in marks[-KEPT:]}
    past = {_version(m) for m in marks[:-KEPT]}
    before = (time.time() - ABANDONED_HOURS * 3600) * 1000
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        pending = name.startswith("v-") and name not in past and status.getModificationTime() >= before
        if name != MARKS and name not in live and not pending:
            files.delete(status.getPath(), True)
    for mark in marks[:-KEPT]:
        files.delete(_under(spark, path, MARKS, mark), False)
