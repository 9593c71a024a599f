"""Sources: scraped JSON, folders of HTML, CSV questions, sidecar files, external stores by pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.relational import first_by, unused

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "main_content", "main_primary", "nonaccordion", "markdown", "h1", "h2", "md_file")] + [T.StructField("accordions", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])


def choose_input(paths: list[str], dataset: str) -> list[str]:
    """The files to read: those named, or the dataset's own scrapings."""
    return paths or [f"{dataset}_scrapings.json"]


def json_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items of JSON arrays, files merged, with ``input_pos`` as their order."""
    rows = spark.read.schema(ITEM).option("multiLine", True).json(paths)
    return rows.withColumn("input_pos", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")))


def first_of_each_url(items: DataFrame) -> DataFrame:
    return first_by(items, ["url"], ["input_pos"])


def stamped(items: DataFrame, dataset: str, program: str, region: str) -> DataFrame:
    """Items with the constants of a run."""
    return items.withColumns({"dataset": F.lit(dataset), "program": F.lit(program), "region": F.lit(region)})


def required(value: Column, message: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message)).cast("string"))


def main_text(items: DataFrame) -> DataFrame:
    """``content`` of items: the main part, or else the primary one; neither is an error."""
    return items.withColumn("content", required(F.coalesce("main_content", "main_primary", "markdown"), "an item has no content"))


def with_override(items: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Items with a sidecar's value where there is one. ``overrides``: key and column."""
    own = unused(items, "_side")
    side = overrides.select(key, F.col(column).alias(own))
    return items.join(side, key, "left").withColumn(column, F.coalesce(own, column)).drop(own)


def text_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, content) of whole files, sorted by path when collected."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def html_folder(spark: SparkSession, folder: str) -> DataFrame:
    return text_files(spark, folder, "*.html").withColumnRenamed("content", "html")


def csv_rows(spark: SparkSession, path: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header, all strings, quoted line breaks kept, a byte order mark dropped; lacking columns are an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip('"') for c in rows.columns])
    lacking = [c for c in needs if c not in rows.columns]
    if lacking:
        raise ValueError(f"columns are lacking: {', '.join(lacking)}")
    return rows


def questions(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, ("question",))


def faq_items(raw: DataFrame) -> DataFrame:
    """Rows of a content API with FAQs, as one piece of HTML for each: those without, and tests, are left out."""
    kept = raw.where(F.col("faq").isNotNull() & (F.size("faq") > 0) & ~F.endswith("route", F.lit("test")))
    part = F.transform("faq", lambda q: F.concat(F.lit("<h2>"), q["question"], F.lit("</h2>"), q["answer"]))
    return kept.select("route", F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1>"), F.array_join(part, "")).alias("html"))


def all_pages(fetch: Callable[[str | None], dict]) -> Iterator[dict]:
    """Entities of a store that answers page by page; what it says there are must have come."""
    cursor, seen, total = None, 0, None
    while True:
        page = fetch(cursor)
        total = page.get("total", total)
        for entity in page["data"]:
            seen += 1
            yield entity
        if not page.get("has_next_page"):
            break
        cursor = page["cursor"]
    if total is not None and seen != total:
        raise ValueError(f"{seen} of {total} entities came")


def refresh_stats(log: DataFrame) -> DataFrame:
    """Pages and chunks that log lines tell of."""
    found = log.select(F.regexp_extract("value", r"(\d+) pages", 1).alias("p"), F.regexp_extract("value", r"(\d+) chunks", 1).alias("c"))
    number = lambda c: F.sum(F.expr(f"try_cast({c} as bigint)"))
    return found.agg(F.coalesce(number("p"), F.lit(0)).alias("pages"), F.coalesce(number("c"), F.lit(0)).alias("chunks"))


def refresh_counts(log: DataFrame, html: DataFrame, markdown: DataFrame) -> DataFrame:
    """One row: HTML and markdown files that there are (``path``), and the pages and chunks that a log tells of."""
    files = lambda rows, name: rows.agg(F.count_distinct("path").alias(name))
    return files(html, "html_files").crossJoin(files(markdown, "markdown_files")).crossJoin(refresh_stats(log))  # single rows
