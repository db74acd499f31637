"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"
#: Spark doesn't let a running session set its own key; a folder made here is noted under this one.
OWN_DIR_KEY = "skerry.shared.dir"


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g", app: str = "skerry") -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a single machine) a temporary folder is
    created and noted on the session, so later calls agree; on a cluster that is an error,
    because executors wouldn't share it.
    """
    root = spark.conf.get(SHARED_DIR_KEY, None) or spark.conf.get(OWN_DIR_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skerry-")
        spark.conf.set(OWN_DIR_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/skerry/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, for operators that run Python on them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skerry-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "skerry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.join("skerry", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended before the interpreter
        if path.startswith("file://"):
            shutil.rmtree(path[len("file://"):], ignore_errors=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
