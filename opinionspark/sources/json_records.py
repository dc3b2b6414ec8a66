"""The objects of JSON array files, and of files of JSON objects, read by many tasks.

A file is read as the segments that end with a closing brace, which Spark's
text reader splits by byte ranges. Where an object of the array begins depends
on everything before: on the quotes, as braces within strings don't count, and
on the depth. So a first pass sums each range up, for both cases of whether it
begins within a string: its bytes, its quotes and what it does to the depth. A
running sum over a file's ranges, a few numbers each, then says how every range
begins. The second pass cuts the ranges into objects, and the two ends of an
object that lies on an edge are put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..plans.checkpoints import shared_dir

#: Ranges of one read at most, as each task knows where all ranges begin. With ranges of 128 MB they are 25 TB.
MOST_RANGES = 200_000
#: Bytes of segments that are worked on together.
_TOGETHER = 1 << 22
_SPLIT_SETTING = "spark.sql.files.minPartitionNum"
_QUOTE, _OPEN, _CLOSE, _COMMA = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[34]], _CLASS[[91, 123]], _CLASS[[93, 125]], _CLASS[[44]] = _QUOTE, _OPEN, _CLOSE, _COMMA
_FILLED = np.ones(256, bool)
_FILLED[[9, 10, 13, 32]] = False
#: What stands between objects, and what may follow what: array opened, object begun, comma, array closed, object ended.
_OPENED, _BEGUN, _NEXT, _CLOSED, _ENDED, _NOTHING = range(6)
_MAY = np.zeros((6, 6), bool)
for _before, _after in (
    (_NOTHING, _OPENED), (_OPENED, _BEGUN), (_OPENED, _CLOSED), (_BEGUN, _ENDED), (_ENDED, _NEXT), (_ENDED, _CLOSED), (_NEXT, _BEGUN),
):
    _MAY[_before, _after] = True
#: A file without an array has its objects one after the other.
_MAY_BARE = np.zeros((6, 6), bool)
for _before, _after in ((_NOTHING, _BEGUN), (_BEGUN, _ENDED), (_ENDED, _BEGUN)):
    _MAY_BARE[_before, _after] = True


class BrokenJson(ValueError):
    """A file isn't an array of objects, or objects one after the other."""


def _quotes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the quotes at ``at`` those that no backslash escapes."""
    slash = data == 92
    if not slash.any():
        return at
    last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
    run = at - 1 - np.where(at > 0, last_other[at - 1], -1)
    return at[run % 2 == 0]


def _structure(data: np.ndarray, in_string: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas outside strings, their classes, whether the bytes end in a string)."""
    kind = _CLASS[data]
    at = np.flatnonzero(kind)
    kind = kind[at]
    quotes = np.zeros(len(at), bool)
    real = _quotes(data, at[kind == _QUOTE])
    quotes[np.searchsorted(at, real)] = True
    inside = (np.cumsum(quotes) + in_string) & 1
    outside = (kind != _QUOTE) & (inside == 0)
    return at[outside], kind[outside], int(inside[-1]) if len(at) else in_string


@dataclass
class _Range:
    """How a range of a file begins, and how it ends."""

    file: int
    start: int
    in_string: int
    depth: int
    bare: bool
    segments: int
    unclosed: bool


class _Cutter:
    """Cuts the bytes of one range, handed over piece by piece, into objects."""

    def __init__(self, known: _Range):
        self._file, self._at, self._in_string, self._depth = known.file, known.start, known.in_string, known.depth
        self._base, self._may = (0, _MAY_BARE) if known.bare else (1, _MAY)
        # A range begins at the file's start or behind a closing brace.
        within = known.depth > self._base or known.in_string
        self._before = _NOTHING if known.start == 0 else _BEGUN if within else _ENDED
        self._held: list[bytes] = []
        self._held_at, self._held_begun = known.start, False

    def _broken(self, at: int) -> BrokenJson:
        return BrokenJson(f"neither an array of objects nor a row of them, near byte {self._at + at}")

    def cut(self, data: np.ndarray) -> Iterator[tuple[int, int, bool, bool, bytes]]:
        """(file, place, begins here, ends here, bytes) of objects that end in these bytes."""
        at, kind, self._in_string = _structure(data, self._in_string)
        change = np.where(kind == _OPEN, 1, np.where(kind == _CLOSE, -1, 0))
        after = self._depth + np.cumsum(change)
        before = after - change
        brace = data[at] >= 123
        event = np.full(len(at), _NOTHING)
        event[(kind == _OPEN) & brace & (before == self._base)] = _BEGUN
        event[(kind == _CLOSE) & brace & (after == self._base)] = _ENDED
        if self._base:
            event[(kind == _COMMA) & (before == 1)] = _NEXT
            event[(kind == _OPEN) & ~brace & (before == 0)] = _OPENED
            event[(kind == _CLOSE) & ~brace & (after == 0)] = _CLOSED
        some = event != _NOTHING
        event, place = event[some], at[some]
        # Whatever else stands outside of objects, brackets among it, is no white space.
        chain = np.concatenate(([self._before], event))
        wrong = np.flatnonzero(~self._may[chain[:-1], chain[1:]])
        if len(wrong):
            raise self._broken(int(place[wrong[0]]))
        filled = np.concatenate(([0], np.cumsum(_FILLED[data])))
        edges = np.concatenate(([-1], place, [len(data)]))
        between = filled[edges[1:]] - filled[edges[:-1] + 1]
        wrong = np.flatnonzero((chain != _BEGUN) & (between > 0))
        if len(wrong):
            raise self._broken(int(edges[wrong[0]] + 1))
        raw = data.tobytes()
        begun, ended = place[event == _BEGUN], place[event == _ENDED] + 1
        if self._before == _BEGUN and len(ended):
            self._held.append(raw[: ended[0]])
            yield self._file, self._held_at, self._held_begun, True, b"".join(self._held)
            self._held, ended = [], ended[1:]
        elif self._before == _BEGUN:
            self._held.append(raw)
        for a, b in zip(begun.tolist(), ended.tolist()):
            yield self._file, self._at + a, True, True, raw[a:b]
        if len(begun) > len(ended):
            self._held, self._held_at, self._held_begun = [raw[begun[-1] :]], self._at + int(begun[-1]), True
        self._before = int(chain[-1])
        self._depth = int(after[-1]) if len(after) else self._depth
        self._at += len(data)

    def rest(self) -> Iterator[tuple[int, int, bool, bool, bytes]]:
        """The beginning, or middle, of an object that ends in a later range."""
        if self._held:
            yield self._file, self._held_at, self._held_begun, False, b"".join(self._held)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, where its range begins by the reader, segments) of consecutive rows of a range, in bounded parts."""
    for batch in batches:
        values = batch["value"].cast(pa.binary()).to_pylist()
        held: list[bytes] = []
        size, key = 0, None
        for own, value in zip(zip(batch["file"].to_pylist(), batch["block"].to_pylist()), values):
            if held and (own != key or size > _TOGETHER):
                yield (*key, held)
                held, size = [], 0
            key = own
            held.append(value)
            size += len(value) + 1
        if held:
            yield (*key, held)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per part of a range; parts of a range follow each other within a task and are numbered."""
    names = ["file", "block", "part", "bytes", "odd", "outside", "inside", "first", "segments", "bare_end"]
    rows, part = [], 0
    for file, block, segments in _runs(batches):
        data = np.frombuffer(b"}".join([*segments, b""]), np.uint8)
        changes = []
        for in_string in (0, 1):
            _, kind, end = _structure(data, in_string)
            changes.append(int((kind == _OPEN).sum()) - int((kind == _CLOSE).sum()))
        filled = np.flatnonzero(_FILLED[data])
        first = chr(data[filled[0]]) if len(filled) else None
        rows.append((file, block, part, len(data), end ^ 1, *changes, first, len(segments), segments[-1].strip() in (b"", b"]")))
        part += 1
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, types)], names)


@contextmanager
def _same_ranges(spark: SparkSession) -> Iterator[None]:
    """Both passes cut the files alike, whatever executors come or go between them."""
    own = spark.conf.get(_SPLIT_SETTING, None)
    if own is None:
        spark.conf.set(_SPLIT_SETTING, max(1, spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_SPLIT_SETTING)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, start, bytes, odd ... ) of every range with how it begins."""
    parts = _segments(spark, path).mapInArrow(
        _summaries,
        "file string, block long, part long, bytes long, odd long, outside long, inside long, first string, segments long, bare_end boolean",
    )
    own = Window.partitionBy("file").orderBy("block", "part")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def ahead(value) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    begun = parts.withColumn("in_string", ahead("odd") % 2).withColumn(
        "change", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    )
    placed = begun.select(
        "*",
        ahead("bytes").alias("start"),
        ahead("change").alias("depth"),
        F.first("first", ignorenulls=True).over(whole).alias("opening"),
    )
    # A range's first part begins it; its last one tells how it ends.
    return placed.groupBy("file", "block").agg(
        F.min(F.struct("part", "start", "in_string", "depth", "opening")).alias("b"),
        F.sum("segments").alias("segments"),
        F.sum("bytes").alias("bytes"),
        F.max(
            F.struct("part", (F.col("in_string") + F.col("odd")) % 2, F.col("depth") + F.col("change"), "bare_end")
        ).alias("e"),
    ).select(
        "file", "block", "segments", "bytes", "b.start", "b.in_string", "b.depth", "b.opening",
        F.col("e").getField("col2").alias("ends_in_string"), F.col("e").getField("col3").alias("end_depth"), "e.bare_end",
    )


def _known(spark: SparkSession, path: str) -> tuple[dict[tuple[str, int], _Range], dict[int, int]]:
    """How each range begins, by file and block, and the number of bytes ahead of each file, files in order of names."""
    sizes = {
        r.file: r.size
        for r in spark.read.format("binaryFile").load(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("length").alias("size")
        ).collect()
    }
    rows = sorted(_ranges(spark, path).limit(MOST_RANGES + 1).collect(), key=lambda r: (r.file, r.block))
    if len(rows) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    known, ahead, total = {}, {}, 0
    for k, r in enumerate(rows):
        if k == 0 or rows[k - 1].file != r.file:
            number = len(ahead)
            ahead[number] = total
        last = k + 1 == len(rows) or rows[k + 1].file != r.file
        # Every segment counts with a brace behind it; a file's last one may have none. A compressed file's length
        # doesn't tell, nor does one with a byte order mark, which the reader leaves out.
        size, end = sizes.get(r.file), r.start + r.bytes
        unclosed = last and (end == size + 1 if size is not None and size <= end <= size + 1 else r.bare_end)
        opening = None if unclosed and r.opening == "}" else r.opening  # a file of white space
        if last and (r.ends_in_string or r.end_depth != (-1 if unclosed else 0)) and opening is not None:
            raise BrokenJson(f"{r.file} ends within an object, a string or the array")
        if opening not in (None, "[", "{"):
            raise BrokenJson(f"{r.file} doesn't begin with an array or an object")
        known[(r.file, r.block)] = _Range(number, r.start, r.in_string, r.depth, opening != "[", r.segments, unclosed)
        total += r.bytes
    return known, ahead


def read_objects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(place, object): every object of the files with its place, the bytes ahead of it, files in order of their names.

    A file is an array of objects or has them one after the other, on lines or
    not; empty files have none. The files are read twice, one task for each
    range of bytes that Spark cuts, and the objects are stored below the shared
    folder as Parquet. Anything else in a file, an object that ends too early or
    one that isn't JSON is an error.
    """
    with _same_ranges(spark):
        known, ahead = _known(spark, path)
        shared = spark.sparkContext.broadcast((known, ahead))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges, starts = shared.value
            key, cutter, left = None, None, 0

            def rows_of(found: list) -> pa.RecordBatch:
                columns = list(zip(*found)) if found else [[]] * 5
                file = np.array(columns[0], np.int64)
                place = [starts[f] + p for f, p in zip(columns[0], columns[1])]
                arrays = [pa.array(file), pa.array(place, pa.int64()), pa.array(columns[2], pa.bool_())]
                arrays += [pa.array(columns[3], pa.bool_()), pa.array([b.decode() for b in columns[4]], pa.string())]
                return pa.RecordBatch.from_arrays(arrays, names)

            for file, block, segments in _runs(batches):
                if (file, block) != key:
                    if cutter is not None:
                        yield rows_of(list(cutter.rest()))
                    key = (file, block)
                    if key not in ranges:
                        raise RuntimeError(f"{file} is no longer cut at byte {block}: read it again")
                    cutter, left = _Cutter(ranges[key]), ranges[key].segments
                left -= len(segments)
                data = b"}".join([*segments, b""])
                if left == 0 and ranges[key].unclosed:
                    data = data[:-1]
                yield rows_of(list(cutter.cut(np.frombuffer(data, np.uint8))))
            if cutter is not None:
                yield rows_of(list(cutter.rest()))

        names = ["file", "place", "begins", "ends", "text"]
        found = _segments(spark, path).mapInArrow(cut, "file long, place long, begins boolean, ends boolean, text string")
        whole = F.col("begins") & F.col("ends")
        target = f"{shared_dir(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
        found.select(
            "file", "place", "begins", whole.alias("whole"),
            F.when(whole, _parsed(F.col("text"), schema)).alias("object"), F.when(~whole, F.col("text")).alias("text"),
        ).write.parquet(target)
    stored = spark.read.parquet(target)
    own = Window.partitionBy("file").orderBy("place")
    pieces = stored.filter(~F.col("whole")).withColumn("number", F.sum(F.col("begins").cast("int")).over(own))
    joined = pieces.groupBy("file", "number").agg(
        F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    edges = joined.select("place", _parsed(text, schema).alias("object"))
    return stored.filter("whole").select("place", "object").unionByName(edges)


def _parsed(text: Column, schema: StructType) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})
