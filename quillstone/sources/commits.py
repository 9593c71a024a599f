"""Tables that grow by commits: data first, then one small file that names it.

Each attempt writes to a folder of its own; a commit is a JSON file that appears whole and names the attempt that
counts. What reads a table reads the commits there are, so data that was left half-way, or written by a task that was
thought lost, is never seen, and no folder has to be renamed, which object stores can't do at once. A commit whose name
is there already is not written again: that is what makes a repeated batch harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written under a hidden name and then given its own."""
    folder, name = path.rsplit("/", 1)
    fs, hidden = _store(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    target = _store(spark, path)[1]
    if not fs.rename(hidden, target):
        fs.delete(hidden, False)
        raise FileExistsError(path)


def get(spark: SparkSession, path: str) -> str:
    fs, place = _store(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, sorted, hidden ones apart; none if it isn't there."""
    fs, place = _store(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(n for n in (status.getPath().getName() for status in fs.listStatus(place)) if not n.startswith("."))


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _store(spark, path)
    fs.delete(place, True)


class Committed:
    """The commits of one table below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        """Names of the commits, in order."""
        return [n.removesuffix(".json") for n in names(self.spark, f"{self.root}/commits")]

    def get(self, name: str) -> dict[str, Any]:
        """What a commit says; one that isn't there is an error."""
        if name not in self.names():
            raise FileNotFoundError(f"{self.root}: no commit {name}")
        return json.loads(get(self.spark, f"{self.root}/commits/{name}.json"))

    def add(self, name: str, write: Callable[[str], dict[str, Any] | None]) -> bool:
        """Have ``write`` put data into a fresh folder, then commit it with what it returns; False if the name is there.

        A ``write`` that fails, or a driver that ends before the commit, leaves the table as it was.
        """
        if name in self.names():
            return False
        attempt = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        says = write(attempt) or {}
        try:
            put(self.spark, f"{self.root}/commits/{name}.json", json.dumps(says | {"place": attempt}, sort_keys=True))
        except FileExistsError:  # another driver was first
            remove(self.spark, attempt)
            return False
        return True

    def append(self, name: str, rows: DataFrame) -> bool:
        """Commit rows as Parquet."""
        return self.add(name, lambda place: rows.write.parquet(place))

    def places(self, wanted: list[str] | None = None, part: str = "") -> list[str]:
        """Folders of data, of all commits or of some."""
        return [json.loads(get(self.spark, f"{self.root}/commits/{n}.json"))["place"] + part for n in (self.names() if wanted is None else wanted)]

    def rows(self, schema: str, part: str = "") -> DataFrame:
        """All committed rows; a table without commits is empty."""
        places = self.places(part=part)
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)
