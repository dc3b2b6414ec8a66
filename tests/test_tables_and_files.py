"""Arrays that are read by many tasks, tables in versions, and stored results."""

from __future__ import annotations

import json
import os
import random
import signal
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from conftest import ROOT
from opinionspark.sources import posts as P
from opinionspark.sources.json_records import BrokenJson, read_objects
from opinionspark.sources.results import read_results, results_catalogue, save_results
from opinionspark.sources.snapshots import drop_versions, read_snapshot, snapshot_versions, write_snapshot

OBJECT = StructType([StructField("a", LongType()), StructField("s", StringType()), StructField("n", StringType())])


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of some hundred bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def objects(n):
    rng = random.Random(1)
    signs = ["{", "}", "[", "]", '"', "\\", ",", "x", "é", "漢", "\n", '\\"', "}}}", '"{', '":{']
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [{"a": i, "s": s, "n": [{"k": "}"}, [1, [2]], s[:5]]} for i, s in enumerate(made)]


def test_arrays_are_cut_anywhere(spark, tmp_path, small_ranges):
    rows = objects(150)
    long = {"a": 1, "s": "{}" * 2000, "n": [[["}"]]]}  # over many ranges
    files = {
        "line": (json.dumps(rows), rows),
        "pretty": (json.dumps(rows, indent=2, ensure_ascii=False), rows),
        "lines": ("\n".join(json.dumps(r) for r in rows), rows),
        "ended": ("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", rows),
        "long": (json.dumps([*rows[:5], long, *rows[5:9]]), [*rows[:5], long, *rows[5:9]]),
        "mark": ("﻿" + json.dumps(rows[:30]), rows[:30]),
        "none": (" [ ] ", []),
        "blank": (" \n", []),
        "one": (json.dumps(rows[0]), rows[:1]),
    }
    for name, (text, expected) in files.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        got = sorted(read_objects(spark, str(path), OBJECT).collect())
        assert [(r.object.a, r.object.s, json.loads(r.object.n)) for r in got] == [(r["a"], r["s"], r["n"]) for r in expected], name
        raw = text.removeprefix("﻿").encode()
        assert all(raw[r.place : r.place + 1] == b"{" for r in got)
    tasks = spark.read.option("lineSep", "}").text(str(tmp_path / "line.json")).rdd.getNumPartitions()
    assert tasks >= os.path.getsize(tmp_path / "line.json") // 700


def test_broken_files_are_errors(spark, tmp_path, small_ranges):
    good = json.dumps(objects(40))
    broken = {
        "cut": good[:-30], "open": good[:-1], "comma": good[:-1] + ",]", "word": good[:-1] + " x ]", "twice": good + good,
        "number": good[:-1] + ",3]", "string": good[:-1] + ',"s"]', "nested": good[:-1] + ',[{"a":1}]]',
        "no comma": good.replace('}, {"a": 20', '} {"a": 20'), "two": good.replace('}, {"a": 20', '},, {"a": 20'),
        "field": good.replace('{"a": 20,', '{"a": 20 "b",'), "quote": good[:900] + '"' + good[900:], "text": "hello",
        "line": "\n".join(json.dumps(r) for r in objects(40))[:-1],
    }
    for name, text in broken.items():
        assert name not in ("no comma", "two", "field") or text != good
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        with pytest.raises(Exception):
            read_objects(spark, str(path), OBJECT).collect()
    with pytest.raises(BrokenJson):
        read_objects(spark, str(tmp_path / "cut.json"), OBJECT)


def test_ids_follow_the_bytes(spark, tmp_path, small_ranges):
    """Ids don't depend on how files are cut, and files follow each other by name."""
    for k in range(3):
        rows = [{"content": f"post {k} {i}"} for i in range(40)]
        (tmp_path / f"f{k}.json").write_text(json.dumps(rows), encoding="utf-8")
        (tmp_path / f"g{k}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n", encoding="utf-8")
    for pattern, fmt in (("f*.json", "json"), ("g*.jsonl", "jsonl")):
        found = []
        for size in (500, 10_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            posts = P.read_posts(spark, str(tmp_path / pattern), fmt)
            found.append([(r.post_id, r.content) for r in posts.orderBy("post_id").collect()])
        assert found[0] == found[1]
        assert [c for _, c in found[0]] == [f"post {k} {i}" for k in range(3) for i in range(40)]
        assert len({i for i, _ in found[0]}) == 120


def test_written_arrays_are_arrays(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit('"é\n'), "id").alias("s"))
    P.write_json_arrays(rows.repartition(3), str(tmp_path / "a"))
    read = [json.loads(p.read_text(encoding="utf-8")) for p in (tmp_path / "a").glob("*.txt")]
    assert sorted((r["id"], r["s"]) for f in read for r in f) == [(i, f'"é\n{i}') for i in range(100)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshot_versions(spark, path) == []
    for n in (3, 0, 5):
        write_snapshot(spark.range(n).withColumn("d", F.lit("x")), path, ("d",))
    assert snapshot_versions(spark, path) == [1, 2, 3]
    assert [read_snapshot(spark, path, v).count() for v in (1, 2, None)] == [3, 0, 5]
    assert read_snapshot(spark, path, 2).columns == ["id", "d"]
    with pytest.raises(ValueError):
        read_snapshot(spark, path, 9)
    # A claimed number of a writer that died is skipped.
    (tmp_path / "t" / "_versions" / "00000004.claimed").touch()
    assert write_snapshot(spark.range(7), path) == 5
    assert read_snapshot(spark, path).count() == 7
    assert drop_versions(spark, path, 2) == [1, 2] and snapshot_versions(spark, path) == [3, 5]
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 2


def test_failed_writes_leave_the_table(spark, tmp_path, make_posts):
    posts = make_posts([{"post_id": i, "content": f"c{i}", "publish_time": "2024-01-01 00:00:00"} for i in range(4)])
    path = str(tmp_path / "enriched")
    P.write_enriched(posts, path)
    broken = posts.withColumn("content", F.when(F.col("post_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        P.write_enriched(broken, path)
    stored, rate = P.read_enriched(spark, path)
    assert stored.count() == 4 and rate.first().total_count == 4


def test_killed_writers_leave_the_table(spark, tmp_path):
    """A process is killed while its tasks write."""
    path = str(tmp_path / "t")
    write_snapshot(spark.range(10), path)
    script = textwrap.dedent(
        f"""
        import sys; sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        from opinionspark.sources.snapshots import write_snapshot
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        slow = F.udf(lambda x: __import__("time").sleep(1) or x, "long")
        write_snapshot(spark.range(0, 400, 1, 40).select(slow("id").alias("id")), {path!r})
        """
    )
    writer = subprocess.Popen([sys.executable, "-c", script], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    for _ in range(240):
        if len([n for n in os.listdir(path) if n.startswith("data-")]) > 1:
            break
        time.sleep(0.5)
    else:
        pytest.fail("the writer never began")
    time.sleep(2)
    os.killpg(writer.pid, signal.SIGKILL)
    writer.wait()
    assert snapshot_versions(spark, path) == [1]
    assert read_snapshot(spark, path).count() == 10


def test_results_by_name(spark, tmp_path):
    path = str(tmp_path / "r")
    assert results_catalogue(spark, path).count() == 0
    with pytest.raises(KeyError):
        read_results(spark, path, "a")
    save_results(spark, path, "one", {"a": {"x": spark.range(2), "y": spark.range(3)}, "b": {"z": spark.range(0)}})
    save_results(spark, path, "two", {"a": {"x": spark.range(5)}})
    assert {k: f.count() for k, f in read_results(spark, path, "a").items()} == {"x": 5}
    assert {k: f.count() for k, f in read_results(spark, path, "a", "one").items()} == {"x": 2, "y": 3}
    assert read_results(spark, path, "b")["z"].columns == ["id"]
    kept = results_catalogue(spark, path).select("run_id", "operator", "frame").collect()
    assert sorted(map(tuple, kept)) == [("one", "a", "x"), ("one", "a", "y"), ("one", "b", "z"), ("two", "a", "x")]
    with pytest.raises(KeyError):
        read_results(spark, path, "b", "two")
