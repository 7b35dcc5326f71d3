"""Folders that many read and one writes: a writer's lock, and versions that one file's creation publishes.

Both rest on a file being made only once, which HDFS and local disks hold to; not all object stores do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Busy(RuntimeError):
    """Another job is writing to the folder, or has taken it over."""


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _at(spark, path)
    fs.delete(hadoop, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    hadoop, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def stamp(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of change of a table's files: another value once the table has changed."""
    hadoop, fs = _at(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(hadoop)))


@dataclass(frozen=True)
class Lock:
    """A folder's lock as one holder has it."""

    spark: SparkSession
    folder: str
    name: str
    token: str

    def check(self) -> None:
        """Busy if the lock is no longer this holder's; to be called last before anything is published."""
        if _holder(self.spark, self.folder) != (self.name, self.token):
            raise Busy(f"{self.name} was taken over or its lock was broken")


def _holder(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    path, fs = _at(spark, f"{folder}/writer")
    if not fs.exists(path):
        return None
    held = fs.open(path)
    try:
        return held.readUTF(), held.readUTF()
    finally:
        held.close()


def _take(spark: SparkSession, folder: str, name: str, token: str, over: bool) -> None:
    path, fs = _at(spark, f"{folder}/writer")
    out = fs.create(path, over)
    out.writeUTF(name)
    out.writeUTF(token)
    out.close()


@contextmanager
def only_writer(spark: SparkSession, folder: str, name: str) -> Iterator[Lock]:
    """Hold the folder's ``writer`` file. Another name meets Busy; a retry under the same name takes the lock over, since
    a job that died leaves it behind. If the first is alive after all, it is no longer the holder: it fails at ``check``
    and leaves the lock alone."""
    token = uuid.uuid4().hex
    try:
        _take(spark, folder, name, token, False)
    except Exception as e:
        holder = _holder(spark, folder)
        if holder is None:
            raise
        if holder[0] != name:
            raise Busy(f"{holder[0]} is writing to {folder}") from e
        _take(spark, folder, name, token, True)
    try:
        yield Lock(spark, folder, name, token)
    finally:
        if _holder(spark, folder) == (name, token):
            remove(spark, f"{folder}/writer")


def break_lock(spark: SparkSession, folder: str) -> str | None:
    """Take away the lock that a job has left which will not come again; its name. If it is alive, it will fail before
    it publishes anything."""
    holder = _holder(spark, folder)
    remove(spark, f"{folder}/writer")
    return holder[0] if holder else None


def published(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Number and name of the folder's versions, oldest first."""
    return sorted((int(n), name) for n, _, name in (f.partition("@") for f in names(spark, f"{folder}/published") if "@" in f))


def publish(lock: Lock, name: str) -> int:
    """Make ``name`` the folder's newest version, for all readers at once: they go by the names of empty files."""
    lock.check()
    done = published(lock.spark, lock.folder)
    number = done[-1][0] + 1 if done else 1
    path, fs = _at(lock.spark, f"{lock.folder}/published/{number:012d}@{name}")
    fs.create(path, False).close()
    return number


def withdraw(spark: SparkSession, folder: str, number: int, name: str) -> None:
    """Forget an old version."""
    remove(spark, f"{folder}/published/{number:012d}@{name}")
