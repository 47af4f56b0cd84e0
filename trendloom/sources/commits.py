"""Versions of a set of tables below one folder, and a log of numbered pointers that says which is current.

A writer puts its tables into a folder of its own and then commits: the next pointer is made whole under another name and gets its number only if
nobody has it yet. Whoever loses the race takes the number after, or, if what it wrote depends on the state it
has read, is told to read again. Readers see the pointer with the largest number, and so always a whole version. What no
recent pointer refers to is deleted by ``clean_up``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..schemas import require

POINTER, ASIDE = "current-{:010d}.json", "_pointer."


class Conflict(RuntimeError):
    """Somebody else has committed since the state was read."""


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm, at


def exists(spark: SparkSession, path: str) -> bool:
    fs, _, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, _, at = file_system(spark, path)
    fs.delete(at, True)


def _named(spark: SparkSession, target: str, pattern: str) -> list:
    fs, jvm, at = file_system(spark, target)
    return list(fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, pattern)) or [])


def _numbers(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(x.getPath().getName()[8:-5]) for x in _named(spark, target, "current-*.json"))


def last(spark: SparkSession, target: str) -> int:
    """The largest number of a pointer below target, 0 if there is none."""
    return max(_numbers(spark, target), default=0)


def _took(spark: SparkSession, new: str, place: str) -> bool:
    """Gives the file new the name place, unless that exists. One of several that try at once succeeds.

    Local files are linked, which fails for a name that exists; elsewhere the file system's own rename without overwriting decides,
    which HDFS does in one step.
    """
    fs, jvm, at = file_system(spark, new)
    to = jvm.org.apache.hadoop.fs.Path(place)
    if fs.getUri().getScheme() == "file":
        try:
            os.link(at.toUri().getPath(), to.toUri().getPath())
        except FileExistsError:
            return False
        return True
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to, none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def commit(spark: SparkSession, target: str, state: dict, expected: int | None = None) -> int:
    """Makes state the current one; gives the number of its pointer.

    With ``expected``, the number of the pointer that the state was made from, a commit by somebody else since then raises Conflict;
    without, the next free number is taken.
    """
    fs, _, new = file_system(spark, f"{target}/{ASIDE}{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    try:
        number = (last(spark, target) if expected is None else expected) + 1
        while not _took(spark, new.toString(), f"{target}/{POINTER.format(number)}"):
            if expected is not None:
                raise Conflict(f"{target}: pointer {number} is taken")
            number += 1
        return number
    finally:
        fs.delete(new, False)


def state_of(spark: SparkSession, target: str, number: int) -> dict:
    fs, jvm, at = file_system(spark, f"{target}/{POINTER.format(number)}")
    stream = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, target: str) -> dict:
    number = last(spark, target)
    require(number > 0, f"{target} has no version")
    return state_of(spark, target, number)


def retried(attempt: Callable[[], int], tries: int = 20) -> int:
    """Runs an attempt that reads the current state and commits against it, again after each Conflict."""
    for k in range(tries):
        try:
            return attempt()
        except Conflict:
            if k == tries - 1:
                raise
            time.sleep(0.05 * (k + 1))
    raise AssertionError


def folders_of(state: dict) -> set[str]:
    """The folders that a state refers to: its version, and those that hold parts of it."""
    return {state["version"], *state.get("parts", {}).values()}


def clean_up(spark: SparkSession, target: str, keep: int = 1, older_than_s: float = 3600.0) -> list[str]:
    """Deletes pointers but the last ``keep``, and folders and files that these do not refer to; gives the names of the folders deleted.

    Whatever has changed within ``older_than_s`` stays, as a writer at work is not referred to yet. It must be longer than any write takes.
    """
    numbers = _numbers(spark, target)
    held = {f for n in numbers[-keep:] for f in folders_of(state_of(spark, target, n))}
    before, gone = time.time() * 1000 - older_than_s * 1000, []
    fs, _, _ = file_system(spark, target)

    def touched(status) -> int:
        inside = [touched(x) for x in fs.listStatus(status.getPath())] if status.isDirectory() else []
        return max([status.getModificationTime(), *inside])

    for n in numbers[:-keep]:
        delete(spark, f"{target}/{POINTER.format(n)}")
    for status in _named(spark, target, "*"):
        name = status.getPath().getName()
        loose = name.startswith(ASIDE) if not status.isDirectory() else name not in held
        if loose and touched(status) <= before:
            fs.delete(status.getPath(), True)
            gone += [name] if status.isDirectory() else []
    return gone


def read_current(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{current(spark, target)['version']}/{name}")
