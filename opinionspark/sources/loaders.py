"""Posts from wherever the user's code finds them, as a Spark data source.

A loader names its parts, each a piece of work for one task, and loads the posts
of one part as dictionaries. ``register_loader`` makes a data source of it, which
``spark.read.format(name)`` and ``spark.readStream.format(name)`` know from then
on. A stream takes the parts that were added to the end of the list since its
last batch, so parts keep their order and none goes away.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

from .posts import normalize_posts, shaped
from .schema import FILE_POST

#: Ids of posts without one: the part's number, then the place within it, of which a part has at most so many.
_PLACES = 1 << 33


class Loader(Protocol):
    def parts(self) -> list[Any]:
        """The parts there are now, in the order in which they came; each can be pickled."""

    def load(self, part: Any) -> Iterator[dict[str, Any]]:
        """The posts of a part, raw fields by name; called in a task."""


class _Part(InputPartition):
    def __init__(self, number: int, part: Any):
        super().__init__(number)
        self.number, self.part = number, part


def _value(value: Any, kind: Any) -> Any:
    """A raw field as files have it: text, or JSON text for lists and objects; structs as tuples."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_value(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return int(value)


def _rows(loader: Loader, part: _Part) -> Iterator[tuple]:
    for place, post in enumerate(loader.load(part.part)):
        row = [_value(post.get(f.name), f.dataType) for f in FILE_POST.fields]
        if row[0] is None:
            row[0] = part.number * _PLACES + place
        yield tuple(row)


class _Reader(DataSourceReader):
    def __init__(self, loader: Loader):
        self._loader = loader

    def partitions(self) -> list[_Part]:
        return [_Part(i, p) for i, p in enumerate(self._loader.parts())]

    def read(self, partition: _Part) -> Iterator[tuple]:
        # Without any part Spark asks for a part that is none.
        return _rows(self._loader, partition) if isinstance(partition, _Part) else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, loader: Loader):
        self._loader = loader

    def initialOffset(self) -> dict:  # noqa: N802
        return {"parts": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"parts": len(self._loader.parts())}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        parts = self._loader.parts()
        return [_Part(i, parts[i]) for i in range(start["parts"], end["parts"])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _rows(self._loader, partition) if isinstance(partition, _Part) else iter(())


def register_loader(spark: SparkSession, name: str, make: Callable[[dict[str, str]], Loader]) -> None:
    """Makes ``name`` a data source format; ``make`` gets the options of a read and gives its loader."""
    assert isinstance(FILE_POST.fields[0].dataType, LongType)

    class Posts(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return FILE_POST

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(make(dict(self.options)))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(make(dict(self.options)))

    spark.dataSource.register(Posts)


def load_posts(spark: SparkSession, name: str, stream: bool = False, **options: str) -> DataFrame:
    """Posts of a registered loader, as ``read_posts`` gives them."""
    reader = (spark.readStream if stream else spark.read).format(name).options(**options)
    return normalize_posts(shaped(reader.load()))


class JsonFiles:
    """Arrays and lines of JSON objects in files that every executor can open; a file is a part, the oldest first.

    For large files in a store of Spark's use ``read_posts``, which cuts them.
    """

    def __init__(self, options: dict[str, str]):
        self._pattern = options["path"]

    def parts(self) -> list[str]:
        return sorted(glob.glob(self._pattern), key=lambda p: (os.stat(p).st_mtime_ns, p))

    def load(self, part: str) -> Iterator[dict[str, Any]]:
        with open(part, encoding="utf-8") as file:
            text = file.read()
        posts = json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
        if not all(isinstance(p, dict) for p in posts):
            raise ValueError(f"{part} has something else than objects")
        yield from posts
