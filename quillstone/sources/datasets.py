"""Documents with their chunks: loaded, resumed and dropped as one, never one without the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.commits import Committed

DOCUMENTS = "doc_id long, dataset string, title string, url string, content string"
CHUNKS = "doc_id long, dataset string, split_index int, num_splits int, headings array<string>, text string, text_to_encode string"


class Library:
    """A table of documents and one of chunks below ``root``; a load or a drop is one commit for both.

    Commits are numbered. A load holds rows of both tables, and may name a dataset that it replaces; a drop names one.
    A dataset's rows are those of loads since it was last named, that load's own among them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Committed(spark, root)

    def _next(self) -> str:
        names = self.table.names()
        return f"{int(names[-1]) + 1 if names else 0:012d}"

    def load(self, documents: DataFrame, chunks: DataFrame, replaces: str | None = None) -> None:
        """Both or neither: chunks whose document isn't in the load are an error, and what was written is not seen.

        ``replaces``: a dataset whose earlier rows the load takes the place of, at once.
        """
        documents, chunks = documents.select(*_fields(DOCUMENTS)), chunks.select(*_fields(CHUNKS))

        def write(place: str) -> dict:
            documents.write.partitionBy("dataset").parquet(f"{place}/documents")
            chunks.write.partitionBy("dataset").parquet(f"{place}/chunks")
            read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{place}/{part}")
            orphans = read("chunks", CHUNKS).join(read("documents", DOCUMENTS), ["dataset", "doc_id"], "left_anti")
            if not orphans.isEmpty():
                raise ValueError("a chunk has no document")
            return {"kind": "load"} | ({"dataset": replaces} if replaces else {})

        if not self.table.add(self._next(), write):
            raise RuntimeError("another load came first")

    def drop(self, dataset: str) -> bool:
        """Documents of a dataset and with them their chunks; whether there were any."""
        if self.documents().where(F.col("dataset") == dataset).isEmpty():
            return False
        if not self.table.add(self._next(), lambda _place: {"kind": "drop", "dataset": dataset}):
            raise RuntimeError("another change came first")
        return True

    def resume(self, documents: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("dataset", "url")) -> None:
        """Only documents that aren't there, with their chunks."""
        new = documents.join(self.documents().select(*keys).distinct(), list(keys), "left_anti")
        self.load(new, chunks.join(new.select("dataset", "doc_id"), ["dataset", "doc_id"], "left_semi"))

    def documents(self) -> DataFrame:
        return self._rows("documents", DOCUMENTS)

    def chunks(self) -> DataFrame:
        return self._rows("chunks", CHUNKS)

    def _rows(self, part: str, schema: str) -> DataFrame:
        dropped: set[str] = set()
        rows = self.spark.createDataFrame([], schema)
        for name in reversed(self.table.names()):  # the latest first: what it drops counts for all before
            says = self.table.get(name)
            if says["kind"] == "load":
                read = self.spark.read.schema(schema).parquet(f"{says['place']}/{part}")
                rows = rows.unionByName(read.where(~F.col("dataset").isin(sorted(dropped))) if dropped else read)
            if "dataset" in says:
                dropped.add(says["dataset"])
        return rows.select(*_fields(schema))


def _fields(schema: str) -> list[str]:
    return [f.strip().split()[0] for f in schema.split(", ")]
