"""Stores that answer page by page, as a Spark source: ranges are read side by side, each by following its cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: A page of a range from a cursor on (None: its beginning): {"data": [...], "page_info": {"has_next_page", "end_cursor"}, "total_count"}.
Fetch = Callable[[Any, Any], dict[str, Any]]


@dataclass
class Range(InputPartition):
    """What one task reads: a part of the store that has pages and a total of its own, such as a stretch of time."""

    value: Any


def entities(fetch: Fetch, part: Any) -> Iterator[dict[str, Any]]:
    """Entities of a range, page after page; that there are as many as the store says is checked at the end."""
    cursor, seen = None, 0
    while True:
        page = fetch(part, cursor)
        for entity in page["data"]:
            seen += 1
            yield entity
        if not page["page_info"]["has_next_page"]:
            break
        if page["page_info"]["end_cursor"] == cursor:
            raise ValueError(f"{part}: the store's cursor stands still at {cursor}")
        cursor = page["page_info"]["end_cursor"]
    if seen != page["total_count"]:
        raise ValueError(f"{part}: expected {page['total_count']} entities, but got {seen}")


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, ranges: Sequence[Any], fields: list[str]):
        self.fetch, self.ranges, self.fields = fetch, list(ranges), fields

    def partitions(self) -> list[Range]:
        return [Range(r) for r in self.ranges]

    def read(self, partition: Range) -> Iterator[tuple]:
        for entity in entities(self.fetch, partition.value):
            yield tuple(entity.get(f) for f in self.fields)


def paged(spark: SparkSession, name: str, fetch: Fetch, ranges: Sequence[Any], schema: str) -> DataFrame:
    """All entities of ``ranges`` of a store, a task for each; ``fetch`` runs in tasks and answers one page.

    Ranges must not overlap; a store that has only one is read by one task. Fields that an entity lacks are null, others
    than those of ``schema`` are left out. A lost task reads its range again from the beginning. No ranges, no rows.
    """
    ranges = list(ranges)
    if not ranges:
        return spark.createDataFrame([], schema)

    class Store(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(fetch, ranges, schema.fieldNames())

    spark.dataSource.register(Store)
    return spark.read.format(name).load()


def time_ranges(start: int, end: int, parts: int) -> list[tuple[int, int]]:
    """Half-open stretches that together are [start, end), at most ``parts`` and none empty."""
    if end <= start:
        return []
    parts = min(parts, end - start)
    cuts = [start + (end - start) * k // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def paged_folder(root: str) -> Fetch:
    """The pages of a folder of JSON files: ``range=<low>-<high>/cursor=<n>/``, the first at cursor 0."""

    def fetch(part: tuple[int, int], cursor: Any) -> dict[str, Any]:
        import json

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        found = store.get_file_info(fs.FileSelector(f"{path}/range={part[0]}-{part[1]}/cursor={cursor or 0}", allow_not_found=True))
        files = [f.path for f in found if f.base_name.startswith("part-")]
        if not files:  # a range without entities has no page at all
            return {"data": [], "page_info": {"has_next_page": False, "end_cursor": None}, "total_count": 0}
        with store.open_input_stream(files[0]) as stream:
            return json.loads(stream.read())

    return fetch
