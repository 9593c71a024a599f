"""Streams that end, by tables: the same as by keys, without a call of Python for each key."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import GroupedData

import __spark_entry__ as entry
from quillstone.streaming import run, stateful


def _stream(spark, folder, batches, schema):
    """A stream with a file, and so a batch, for each of some lists of rows, in their order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in glob.glob(f"{folder}/*.parquet"):
            if not f.endswith(("-told.parquet",)):
                os.rename(f, f"{folder}/{k:03d}-told.parquet")
                os.utime(f"{folder}/{k:03d}-told.parquet", (1_000_000_000 + k, 1_000_000_000 + k))
    return run.file_stream(spark, f"file://{folder}", 1)


def test_throttled_batches_as_by_keys(spark, tmp_path):
    rows = [(n, None if n % 5 == 4 else f"k{n % 3}", n % 2 or None, -(n // 100)) for n in range(1200)]
    schema = "event_id long, event_type string, user_id long, ts int"
    stream = _stream(spark, f"{tmp_path}/e", [rows[:500], rows[500:501], rows[501:]], schema)
    drained = stateful.drained_throttle(stream, ["event_type", "user_id"], ["ts", "event_id"])
    assert drained.schema.simpleString() == "struct<event_id:bigint,occurrence:int>"
    want, counts = [], Counter()
    for batch in (rows[:500], rows[500:501], rows[501:]):
        for n, kind, user, _ in sorted(batch, key=lambda r: (r[3], r[0])):
            counts[kind, user] += 1
            if stateful.told(counts[kind, user]):
                want.append((n, counts[kind, user]))
    assert sorted(map(tuple, drained.collect())) == sorted(want)


def test_assembled_batches_as_by_keys(spark, tmp_path):
    batches = [
        [("a", 1, "b", False), ("a", 0, "a", False), ("n", 0, "x", False), ("one", 0, "whole", True), ("late", 2, "3", True)],
        [("a", 2, "c", True), ("a", 1, "again", False), ("late", 0, "1", False), (None, 0, "none", True)],
        [("late", 1, "2", False), ("one", 0, "anew", True), ("n", 2, "z", True)],
    ]
    schema = "message_id string, seq long, text string, done boolean"
    got = stateful.drained_responses(_stream(spark, f"{tmp_path}/p", batches, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("one", "whole"), ("a", "abc"), (None, "none"), ("late", "123"), ("one", "anew")], key=str)


@pytest.mark.parametrize("name", ["l10_canned_answers_as_streams", "x01_assembled_responses", "x02_streamed_throttle"])
def test_streams_without_calls_by_key(spark, monkeypatch, name):
    def refused(*_args, **_kwargs):
        raise AssertionError("a call of Python for each key")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", refused)
    got = [tuple(r) for r in entry.queries()[name](spark, entry.DATA).collect()]
    db = duckdb.connect()
    for t in ("events", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{entry.DATA}/{t}.parquet'")
    assert sorted(got) == sorted(db.execute(entry.oracle_sql()[name]).fetchall())
