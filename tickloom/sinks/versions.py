"""Versions of a table laid out by month, published one after the other as a whole.

A version is a small file that names the folder of each month. It appears under the next number by one rename, which
fails if another writer was first. Folders are never changed once written, so readers of older versions are not
disturbed until these are expired. The file system must rename files atomically.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

FOLDER = "_versions"


@dataclass(frozen=True)
class Version:
    number: int
    #: The folder of each month, named by its first day, below the table's path.
    folders: dict[str, str]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The published versions, ascending."""
    folder = f"{path}/{FOLDER}"
    system = _system(spark, path)
    if not system.exists(_path(spark, folder)):
        return []
    names = [status.getPath().getName() for status in system.listStatus(_path(spark, folder))]
    return sorted(int(name.removesuffix(".json")) for name in names if name[:1].isdigit())


def read(spark: SparkSession, path: str, number: int) -> Version:
    stream = _system(spark, path).open(_path(spark, f"{path}/{FOLDER}/{number:012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, json.loads(text))


def newest(spark: SparkSession, path: str) -> Version | None:
    """The newest version, or None for a table without versions."""
    found = numbers(spark, path)
    return read(spark, path, found[-1]) if found else None


def fresh_folder() -> str:
    """A name, below the table's path, that nothing has been written to."""
    return f"data/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, before: Version | None, folders: dict[str, str]) -> Version:
    """Makes a version the newest, unless another one came after ``before``."""
    version = Version(1 if before is None else before.number + 1, folders)
    target = f"{path}/{FOLDER}/{version.number:012d}.json"
    waiting = f"{path}/{FOLDER}/_{uuid.uuid4().hex}"
    stream = _system(spark, path).create(_path(spark, waiting))
    try:
        stream.write(bytearray(json.dumps(folders).encode()))
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(
        _path(spark, path).toUri(), spark._jsc.hadoopConfiguration()) if "://" in path else \
        fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    java = spark._jvm.java.lang
    plain = java.reflect.Array.newInstance(  # no options: without overwriting
        java.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(_path(spark, waiting), _path(spark, target), plain)
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        raise RuntimeError(f"{path} has got another version {version.number} meanwhile") from error
    return version


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the newest ``keep`` versions and the folders that only they name; returns how many folders."""
    found = numbers(spark, path)
    old, kept = found[:-keep], found[-keep:]
    named = {folder for n in kept for folder in read(spark, path, n).folders.values()}
    gone = {folder for n in old for folder in read(spark, path, n).folders.values()} - named
    system = _system(spark, path)
    for number in old:  # first, so that no reader finds a version without its folders
        system.delete(_path(spark, f"{path}/{FOLDER}/{number:012d}.json"), False)
    for folder in gone:
        system.delete(_path(spark, f"{path}/{folder}"), True)
    return len(gone)
