"""Tables that are replaced at once.

A table's folder has one folder of data per version and, in ``_versions``, one
small file per finished version that names it. A writer first writes all data
of its version, then claims the next number, then moves the number's file into
place. Readers take the highest number. A writer that is killed leaves data that
no file names, so the version before stays the table; two writers get two
numbers and the later one is the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_VERSIONS = "_versions"
#: Readers that don't know versions skip folders with this prefix as well.
_DATA = "data-"


class Folder:
    """A folder of whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self.path = path.rstrip("/")
        self._files = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        # A pattern of paths is no folder.
        return not set("*?{[") & set(self.path) and self._files.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._files.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str) -> bool:
        """Whether the empty file wasn't there and now is."""
        return self._files.createNewFile(self._at(name))

    def move(self, name: str, to: str) -> None:
        if not self._files.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} cannot be moved to {to}")

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished versions, rising; none for a folder that isn't such a table."""
    names = Folder(spark, path).names(_VERSIONS)
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def write_version(spark: SparkSession, path: str, write: Callable[[str], StructType | None]) -> int:
    """A new version, whose data ``write`` puts below the folder that it is given; returns its number."""
    folder, data = Folder(spark, path), f"{_DATA}{uuid.uuid4().hex}"
    schema = write(f"{folder.path}/{data}")
    draft = f"{_VERSIONS}/.{data}"
    folder.write(draft, json.dumps({"data": data, "schema": schema and schema.jsonValue()}))
    number = max([0, *(int(n.split(".")[0]) for n in folder.names(_VERSIONS) if n[0].isdigit())]) + 1
    while not folder.create(f"{_VERSIONS}/{number:08}.claimed"):
        number += 1
    folder.move(draft, f"{_VERSIONS}/{number:08}.json")
    return number


def version_folder(spark: SparkSession, path: str, version: int | None = None) -> str:
    """The folder with a version's data, the last one's by default; the path itself where there are no versions."""
    return _version(spark, path, version)[0]


def _version(spark: SparkSession, path: str, version: int | None) -> tuple[str, StructType | None]:
    known = snapshot_versions(spark, path)
    if not known and version is None:
        return path, None
    number = known[-1] if version is None else version
    if number not in known:
        raise ValueError(f"{path} has no version {number}")
    folder = Folder(spark, path)
    entry = json.loads(folder.read(f"{_VERSIONS}/{number:08}.json"))
    return f"{folder.path}/{entry['data']}", StructType.fromJson(entry["schema"]) if entry["schema"] else None


def write_snapshot(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """``rows`` as the new version of the table, as Parquet; returns its number."""

    def write(target: str) -> StructType:
        rows.write.partitionBy(*partition_by).parquet(target)
        return StructType([f for f in rows.schema.fields if f.name not in partition_by] + [rows.schema[c] for c in partition_by])

    return write_version(rows.sparkSession, path, write)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one by default, with the schema it was written with."""
    folder, schema = _version(spark, path, version)
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all versions but the last ``keep``, at least one; data of unfinished ones stays. Returns their numbers.

    Readers of a deleted version fail, so keep what running jobs may read.
    """
    folder, gone = Folder(spark, path), snapshot_versions(spark, path)[: -max(1, keep)]
    for number in gone:
        data = json.loads(folder.read(f"{_VERSIONS}/{number:08}.json"))["data"]
        folder.delete(f"{_VERSIONS}/{number:08}.json")
        folder.delete(data)
    return gone
