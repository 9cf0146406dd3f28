"""Versions of a table: folders of their own, small pointers created last, pins of readers, and what may be removed.

``<table>/data-<id>`` holds rows; ``version-<n>`` is a pointer created once, which names what the version is made of. A pointer is never replaced, so of two writers
one takes the next number, and a write that fails leaves every earlier version as it was. All goes through the file system of the path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a pin no longer counts, and after which a folder that no pointer names is taken for a writer's that died.
STALE_S = 86_400


class Folder:
    """Small files in one folder, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self, prefix: str = "") -> dict[str, float]:
        """Names that start with ``prefix``, and the seconds since each was changed."""
        if not self._fs.exists(self._path(self.path)):
            return {}
        now = self.spark._jvm.System.currentTimeMillis()
        found = self._fs.listStatus(self._path(self.path))
        return {s.getPath().getName(): (now - s.getModificationTime()) / 1000 for s in found if s.getPath().getName().startswith(prefix)}

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def create(self, name: str, text: str = "") -> bool:
        """Create the file unless it exists; whether it was created."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        """The text of a small file; read on the driver, without a job."""
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _number(name: str) -> int:
    return int(name[8:])


def versions(spark: SparkSession, table_path: str) -> list[int]:
    return sorted(map(_number, Folder(spark, table_path).names("version-")))


def latest_version(spark: SparkSession, table_path: str) -> int:
    """Number of the newest version, 0 when there is none."""
    return max([0, *versions(spark, table_path)])


def publish(spark: SparkSession, table_path: str, text: str) -> int:
    """Create the next pointer with this text; its number. Earlier pointers stay."""
    folder, n = Folder(spark, table_path), latest_version(spark, table_path)
    while True:
        n += 1
        if folder.create(f"version-{n}", text):
            return n


def pointer(spark: SparkSession, table_path: str, version: int | None = None) -> str:
    return Folder(spark, table_path).read(f"version-{version or latest_version(spark, table_path)}")


def write_version(df: DataFrame, table_path: str, dry_run: bool = False, keep: int | None = None) -> str | None:
    """Write the next version of a table and keep the earlier ones, or the last ``keep``; a dry run writes nothing."""
    if dry_run:
        return None
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{table_path}/{folder}")
    publish(spark, table_path, folder)
    if keep:
        clean_versions(spark, table_path, keep)
    return f"{table_path}/{folder}"


def read_version(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """A version of the table. Beside a writer that removes old versions, use ``pinned_version``."""
    return spark.read.parquet(f"{table_path}/{pointer(spark, table_path, version)}")


@contextmanager
def pinned_version(spark: SparkSession, table_path: str, version: int | None = None) -> Iterator[DataFrame]:
    """A version that is not removed while it is open, even if newer ones take its place.

    The pin is written first and the pointer looked up again after: ``clean_versions`` removes the pointer first and then looks for pins, so one of the
    two always sees the other. If the pointer is gone, the newest version is tried instead (a version asked for by number must exist).
    """
    folder = Folder(spark, table_path)
    while True:
        n = version or latest_version(spark, table_path)
        pin = f"pin-{n}-{uuid.uuid4().hex}"
        folder.create(pin)
        if folder.exists(f"version-{n}"):
            break
        folder.remove(pin)
        if version or not n:
            raise FileNotFoundError(f"{table_path} has no version {n}")
    try:
        yield read_version(spark, table_path, n)
    finally:
        folder.remove(pin)


def clean_versions(spark: SparkSession, table_path: str, keep: int, stale_s: float = STALE_S) -> list[str]:
    """Remove versions before the last ``keep``, and folders that no version names; what was removed.

    A version that a reader has pinned loses its pointer only, so that no new reader takes it up; its folders go once the pin is gone or older than ``stale_s``. A folder that
    never had a pointer belongs to a writer: it goes when it is older than ``stale_s``.
    """
    folder = Folder(spark, table_path)
    gone = []
    for n in versions(spark, table_path)[:-keep]:
        # what the version was made of is kept in a note until its folders are gone
        folder.create(f"retired-{n}", folder.read(f"version-{n}"))
        folder.remove(f"version-{n}")
    pinned = {int(p.split("-")[1]) for p, age in folder.names("pin-").items() if age < stale_s}
    notes = {n: folder.read(n) for n in folder.names("retired-")}
    named = set()
    for text in [folder.read(f"version-{n}") for n in versions(spark, table_path)] + [t for n, t in notes.items() if int(n[8:]) in pinned]:
        named |= set(parts_of(text))
    retired = {part for t in notes.values() for part in parts_of(t)}
    for name, age in folder.names("data-").items():
        if name not in named and (name in retired or age > stale_s):
            folder.remove(name)
            gone.append(name)
    for n in notes:
        if int(n[8:]) not in pinned:
            folder.remove(n)
    for p, age in folder.names("pin-").items():
        if age >= stale_s:
            folder.remove(p)
    return gone


def parts_of(text: str) -> list[str]:
    """The data folders that a pointer names: one, or those of a bucketed table."""
    return sorted(set(json.loads(text)["buckets"].values())) if text.startswith("{") else [text]
