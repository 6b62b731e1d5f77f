"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "typeflow") -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave ``master`` and the partition count unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Zone-less timestamps are turned into microseconds through the session zone: keep it at UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, named by ``spark.checkpoint.dir``.

    Where a session with a local master names none (tests), one temporary folder per process stands in for it, and is
    removed when the process ends. On a cluster executors don't see each other's folders, so there it must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if not _is_local(master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master!r} share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="typeflow-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        folder = _own_folder[0]
    return folder.rstrip("/")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/typeflow/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the cluster sees them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(place) if entry.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)
