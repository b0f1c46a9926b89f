"""Files in the folder that the driver and all executors share, on any file system that Spark knows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def located(path: str | Path) -> str:
    """The path with its scheme: a bare one is a local file, whatever Spark's default file system is."""
    return str(path) if _SCHEME.match(str(path)) else "file://" + os.path.abspath(path)


def _system(spark: SparkSession, uri: str) -> tuple[object, object]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class _Stream:
    """Just enough of a file for reading in pieces."""

    def __init__(self, stream: object) -> None:
        self._stream = stream

    def read(self, n: int) -> bytes:
        return bytes(self._stream.readNBytes(n))

    def __enter__(self) -> _Stream:
        return self

    def __exit__(self, *error: object) -> None:
        self._stream.close()


def opened(path: str | Path, spark: SparkSession | None = None) -> BinaryIO | _Stream:
    """A file for reading bytes; one that isn't local needs a session."""
    uri = located(path)
    if uri.startswith("file:"):
        return open(re.sub("^file:(//(?=/))?", "", uri), "rb")
    system, at = _system(spark or SparkSession.active(), uri)
    return _Stream(system.open(at))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (or of setCheckpointDir) with its scheme, a temporary one of a local session without.

    A bare path belongs to the default file system, as it does for Spark's own checkpoints.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and (chosen := context._jsc.sc().getCheckpointDir()).isDefined():
        folder = chosen.get()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = located(tempfile.gettempdir())
    system, path = _system(spark, folder)
    return system.makeQualified(path).toString()


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/plenum-files-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str | Path, folder: str | Path | None = None) -> str:
    """Copies a file of the driver into `folder` (a new one in the shared folder), for all executors to read; gives its place."""
    target = f"{located(folder) if folder else new_folder(spark)}/{Path(path).name}"
    system, at = _system(spark, target)
    system.copyFromLocalFile(False, True, _system(spark, located(path))[1], at)
    return target
