"""Files that stand in for what an item says: its own text file, one that overrides its text, and its splits.

All are found by path: the files of a folder are read once, whole, and joined to items, so no task opens a file by
itself and the number of items doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import strings as S
from quillstone.operators.relational import unused
from quillstone.sources.commits import names
from quillstone.sources.readers import required, text_files

SPLIT = "array<struct<headings:array<string>,text:string,text_to_encode:string,chunk_id:string,data_ids:string>>"


def below(path: Column, folder: str) -> Column:
    """The part of a file's path below a folder, as it was named."""
    base = urlparse(folder).path.rstrip("/") + "/"
    at = F.locate(base, path)
    rest = F.when(at > 0, F.substring(path, at + len(base), F.length(path)))
    return F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))  # paths in file metadata are encoded


def folder_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, content) of a folder's files, paths below it; none if the folder isn't there.

    Spark's readers pass over names that begin with an underscore, as the page of a folder (``_index``) does: those are
    listed apart and read by tasks.
    """
    if not names(spark, folder):
        return spark.createDataFrame([], "path string, content string")
    shown = text_files(spark, folder, glob).select(below(F.col("path"), folder).alias("path"), "content")
    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    passed = [f.path for f in found if f.base_name.startswith("_") and f.is_file and fnmatch(f.base_name, glob)]
    if not passed:
        return shown

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            texts = []
            for path in pdf["path"]:
                with store.open_input_stream(path) as stream:
                    texts.append(stream.read().decode())
            yield pd.DataFrame({"path": [p.removeprefix(base).lstrip("/") for p in pdf["path"]], "content": texts})

    listed = spark.createDataFrame([(p,) for p in passed], "path string")
    return shown.unionByName(listed.repartition(min(200, 1 + len(passed) // 100)).mapInPandas(read, "path string, content string"))


def with_content(items: DataFrame, json_folder: str, md_folder: str, common_url: str, md_file: str = "md_file", markdown: str = "markdown") -> DataFrame:
    """Items with their ``content`` and the ``file_path`` that stands for their url below ``md_folder``.

    An item that names a file beside its JSON has that file's text, and one that isn't there is an error. Any other has
    the text of ``<file_path>.md`` where there is one (made by hand), or its own markdown; neither is an error. Items
    must have ``url``; extra columns stay.
    """
    spark = items.sparkSession
    own, side = unused(items, "_own"), unused(items, "_side")
    named = folder_files(spark, json_folder, "*.md").select(F.col("path").alias(own), F.col("content").alias(own + "text"))
    overrides = folder_files(spark, md_folder, "*.md").select(F.col("path").alias(side), F.col("content").alias(side + "text"))
    rows = items.withColumn("file_path", F.substring(S.file_path(F.lit(""), common_url, F.col("url")), 2, 1 << 20))
    rows = rows.join(named, F.col(md_file) == F.col(own), "left").join(overrides, F.concat("file_path", F.lit(".md")) == F.col(side), "left")
    said = F.when(F.col(md_file).isNotNull(), required(F.col(own + "text"), "an item's file isn't there")).otherwise(required(F.coalesce(F.col(side + "text"), F.col(markdown)), "an item has no content"))
    return rows.withColumn("content", said).drop(own, own + "text", side, side + "text")


def with_splits(items: DataFrame, md_folder: str, chunk: Column) -> DataFrame:
    """Items with ``splits``: those of ``<file_path>.splits.json`` where there is one, else what ``chunk`` makes.

    ``edited`` tells which. A file that isn't a JSON array of splits is an error, not an item without splits.
    """
    path, text = unused(items, "_path"), unused(items, "_text")
    files = folder_files(items.sparkSession, md_folder, "*.splits.json").select(F.col("path").alias(path), F.col("content").alias(text))
    rows = items.join(files, F.concat("file_path", F.lit(".splits.json")) == F.col(path), "left")
    read = F.from_json(F.col(text), SPLIT, {"mode": "FAILFAST"})
    return rows.withColumns({"splits": F.when(F.col(text).isNotNull(), read).otherwise(chunk.cast(SPLIT)), "edited": F.col(text).isNotNull()}).drop(path, text)


def split(headings: Column, text: Column, context: Column) -> Column:
    """A split as chunking makes it: what is embedded is its context and its text without links."""
    encoded = F.concat(S.stripped(context), F.lit("\n\n"), S.remove_links(text))
    return F.struct(headings.alias("headings"), text.alias("text"), encoded.alias("text_to_encode"), F.lit("").alias("chunk_id"), F.lit("").alias("data_ids"))


def documents_and_chunks(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a document table and of its chunks, with split_index from 0 and num_splits, from items with splits."""
    documents = items.select("doc_id", "dataset", "title", "url", "content")
    parts = items.select("doc_id", "dataset", F.size("splits").alias("num_splits"), F.posexplode("splits").alias("split_index", "s"))
    return documents, parts.select("doc_id", "dataset", "split_index", "num_splits", "s.headings", "s.text", "s.text_to_encode")
