"""Sinks: partitioned tables, full refresh and resume, versions, JSON and CSV exports, backup and restore."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[a-zA-Z0-9_]+$")
#: The columns of a question-answer export, in order.
QA_COLUMNS = ["id", "question", "answer", "document_name", "document_source", "document_id", "chunk_id", "content_hash", "dataset", "created_at", "version_id", "version_timestamp", "version_llm_model", "expected_chunk_content"]


def save_chunks(chunks: DataFrame, path: str, refresh: bool) -> None:
    """Chunks by dataset: a refresh replaces the datasets that are there, resuming appends."""
    writer = chunks.write.partitionBy("dataset")
    if refresh:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf).exists(place)


def ingest(items: DataFrame, path: str, keys: list[str], resume: bool) -> int:
    """Load items; resumed, only those that the table lacks. How many rows were written."""
    spark = items.sparkSession
    if resume and _there(spark, path):
        items = items.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    items = items.persist()
    try:
        n = items.count()
        if n:
            save_chunks(items, path, refresh=not resume)
        return n
    finally:
        items.unpersist()


def save_json(rows: DataFrame, path: str, drop_empty: tuple[str, ...] = ("page_number",)) -> None:
    """JSON lines; columns that may be left out are, where they are null or zero."""
    shown = [F.when(F.col(c) != 0, F.col(c)).alias(c) if c in drop_empty else F.col(c) for c in rows.columns]
    rows.select(*shown).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def save_markdown(splits: DataFrame, path: str, key: str) -> None:
    """Splits of each document as one readable text."""
    part = F.struct("split_index", F.concat(F.lit("--- "), F.col("split_index").cast("string"), F.lit(" ---\n"), F.col("content")).alias("x"))
    texts = splits.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("p")).select(key, F.array_join(F.transform("p", lambda p: p["x"]), "\n\n").alias("value"))
    texts.write.mode("overwrite").partitionBy(key).text(path)


def save_splits(splits: DataFrame, root: str, key: str, title: str, folders: int = 256) -> int:
    """Splits of each document as JSON and as one readable text, ``<folder>/<key>.splits.json`` and ``.splits.md``.

    ``splits``: key, title, split_index and the fields of a split (headings, text, text_to_encode, chunk_id, data_ids).
    A document's folder follows from its key, and there are at most ``folders``. How many files were written.
    """
    fields = ["headings", "text", "text_to_encode", "chunk_id", "data_ids"]
    part = F.struct("split_index", F.struct(*fields).alias("s"))
    rows = splits.groupBy(key).agg(F.first(title).alias("title"), F.sort_array(F.collect_list(part), True).alias("p"))
    folder = F.lpad(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folders)).cast("string"), 4, "0")
    name = F.concat_ws("/", folder, F.concat(F.col(key).cast("string"), F.lit(".splits")))
    each = F.transform("p", lambda p: F.concat(F.lit("---\nlength:   "), F.length(p["s"]["text_to_encode"]).cast("string"), F.lit("\nheadings: "), F.array_join(p["s"]["headings"], " > "), F.lit("\n"), p["s"]["text"]))
    readable = F.concat(F.col("title"), F.lit(" => "), F.size("p").cast("string"), F.lit(" splits\n\n"), F.array_join(each, "\n\n"))
    as_json = F.to_json(F.transform("p", lambda p: p["s"]))
    files = rows.select(F.explode(F.array(F.struct(F.concat(name, F.lit(".json")).alias("path"), as_json.alias("content")), F.struct(F.concat(name, F.lit(".md")).alias("path"), readable.alias("content")))).alias("f"))
    return save_files(files.select("f.*"), root)


def save_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One header, quotes doubled, nulls as nothing."""
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]) if columns else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def save_version(rows: DataFrame, path: str, version: str) -> None:
    """Question-answer pairs of one version, beside the others."""
    rows.withColumn("version_id", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)


def latest_version(spark: SparkSession, path: str) -> str:
    """The greatest version by name; none is an error."""
    found = spark.read.parquet(path).agg(F.max(F.col("version_id").cast("string")).alias("v")).first()["v"] if _there(spark, path) else None
    if found is None:
        raise ValueError("there is no version")
    return found


def save_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Texts as files of the names that rows give them, below ``root``; how many. A file appears whole; a repeated name is one of its texts."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        n = 0
        for pdf in batches:
            for name, text in zip(pdf["path"], pdf["content"], strict=True):
                folder, own = f"{base}/{name}".rsplit("/", 1)
                hidden = f"{folder}/.{own}.{uuid.uuid4().hex}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(hidden) as out:
                    out.write((text or "").encode())
                store.move(hidden, f"{folder}/{own}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    named = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("content"))
    return named.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def backup(spark: SparkSession, tables: dict[str, str], to: str, schema: str = "app") -> dict[str, int]:
    """Tables copied below ``to``; their row counts."""
    if not _NAME.match(schema):
        raise ValueError("not the name of a schema")
    counts = {}
    for name, path in tables.items():
        spark.read.parquet(path).write.mode("overwrite").parquet(f"{to}/{schema}/{name}")
        counts[name] = spark.read.parquet(f"{to}/{schema}/{name}").count()
    return counts


def restore(spark: SparkSession, names: list[str], source: str, to: dict[str, str], schema: str = "app") -> dict[str, int]:
    """Tables put back, replacing what is there; a backup that isn't there is an error before anything is replaced."""
    if not _NAME.match(schema):
        raise ValueError("not the name of a schema")
    for name in names:
        if not _there(spark, f"{source}/{schema}/{name}"):
            raise FileNotFoundError(f"{source}/{schema}/{name}")
    counts = {}
    for name in names:
        spark.read.parquet(f"{source}/{schema}/{name}").write.mode("overwrite").parquet(to[name])
        counts[name] = spark.read.parquet(to[name]).count()
    return counts
