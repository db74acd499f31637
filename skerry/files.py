"""Small files on a shared file system that survive crashes and second writers."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession

from .session import hadoop_path

#: Versions of a state that stay behind the newest, for readers that have listed but not yet opened them.
OLD_VERSIONS = 4


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the state since it was read."""


def local_path(path: str) -> str | None:
    """The path on a mounted file system, or None where Hadoop's client is needed."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else None


def create_exclusive(spark: SparkSession, path: str, body: bytes) -> bool:
    """Creates a file that isn't there yet and gives True, or gives False and leaves the one that is.

    The body is written whole under a hidden name first, so nobody sees half of it; then one
    link or one rename that doesn't overwrite makes it visible. That step is atomic on
    mounted and HDFS-like file systems; of two writers one is refused.
    """
    folder, name = path.rsplit("/", 1)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        hidden = local_path(part)
        try:
            with open(hidden, "wb") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            os.link(hidden, local)
            return True
        except FileExistsError:
            return False
        finally:
            if os.path.exists(hidden):
                os.unlink(hidden)
    return _create_by_rename(spark, path, part, body)


def _create_by_rename(spark: SparkSession, path: str, part: str, body: bytes) -> bool:
    fs, hidden = hadoop_path(spark, part)
    _, to = hadoop_path(spark, path)
    stream = fs.create(hidden, True)
    stream.write(bytearray(body))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    no_overwrite = gateway.new_array(kind, 1)
    no_overwrite[0] = kind.NONE
    try:
        # this form of rename refuses a name that is taken, on every file system
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(hidden, to, no_overwrite)
        return True
    except Exception:
        fs.delete(hidden, False)
        if fs.exists(to):
            return False
        raise


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The whole file; FileNotFoundError where there is none."""
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order, none where it isn't there."""
    local = local_path(path)
    if local is not None:
        return sorted(os.listdir(local)) if os.path.isdir(local) else []
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Versions:
    """A small state kept as numbered files of JSON, the highest number being the state.

    A new version is created exclusively under the next number, so there is always a whole
    one: a writer that dies leaves the state before or after its change, and one that has
    read an overtaken state is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def latest(self) -> tuple[int, Any]:
        """Number and value of the state; (0, None) where none was written."""
        while True:
            found = self.numbers()
            if not found:
                return 0, None
            try:
                return found[-1], json.loads(read_bytes(self.spark, self._path(found[-1])))
            except FileNotFoundError:  # so many newer ones came since the listing; list again
                continue

    def put(self, number: int, value: Any) -> None:
        """Makes ``value`` the state after version ``number``; ConcurrentWrite if there is another already."""
        if not create_exclusive(self.spark, self._path(number + 1), json.dumps(value).encode()):
            raise ConcurrentWrite(f"{self.folder}: version {number + 1} is another writer's")
        for old in self.numbers():
            if old < number + 1 - OLD_VERSIONS:
                fs, p = hadoop_path(self.spark, self._path(old))
                fs.delete(p, False)

    def change(self, step) -> Any:
        """Applies ``step`` (state -> state, or None for no change) to the newest state until no other writer comes between."""
        while True:
            number, value = self.latest()
            new = step(value)
            if new is None:
                return value
            try:
                self.put(number, new)
                return new
            except ConcurrentWrite:
                continue

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:010d}.json"
