"""The corpus pipeline: STAGES applied to documents in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; a text that a stage changes has a new n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import ngram_join, quality_rules, secret_scan
from quillstone.llm.packing import pack
from quillstone.llm.queries import quality_list, secret_model, tokenizer_file
from quillstone.llm.shared import scratch, stage
from quillstone.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned list keep; the list is learned from this sf_dir's labels.

    Null and empty texts fail the base and go; repeated rows get the same verdict; ids aren't looked at but to find
    labels. Without labels the list is empty, and the base alone decides. An empty table gives no rows.
    """
    rules = quality_list(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs.select(COLUMNS), rules).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id, decided by id and text.

    An id's different texts are documents of their own, each decided by its class, and of repeated rows (same id, same
    text) one stays. Documents without an id stay, and no other goes on their account. Null and empty texts are in no
    class. An empty table gives no rows.
    """
    same = F.coalesce(F.md5("text"), F.lit(""))
    # one mark for each id and text, and for each row without an id
    mark = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id().cast("string")).otherwise(same)
    # ids order the documents of a class, and those without one come last
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", same.alias("mark"))
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        found = ngram_join.join(docs.select(key.alias("key"), "text"), id_col="key", width=5, similarity=0.8)
        gone = found.where("not key.unnamed and key != class_id").select("key.doc_id", "key.mark").distinct()
        keep.append(stage(gone, "pipeline-gone"))
    # repeated rows become one before the shuffle, which serves the join as well: an outer one, as an anti join would
    # be moved below, to rows that are many still
    single = docs.select(*COLUMNS, mark.alias("mark")).dropDuplicates(["doc_id", "mark"])
    told = keep[0].withColumn("gone", F.lit(True)).hint("merge")
    return single.join(told, ["doc_id", "mark"], "left").where("gone is null").select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; a text that loses none stays as it is.

    Repeated rows are occurrences of their own; null texts stay null; an empty table gives no rows.
    """
    done = dedup_substrings(docs.select(COLUMNS), window=35, with_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return _changed(done.withColumn("new", text))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; null texts stay null. Each row is decided alone; an empty table gives no rows."""
    done = secret_scan.scan(docs.select(COLUMNS), secret_model(spark, docs), redact=True)
    return _changed(done.withColumn("new", F.when(F.col("text").isNotNull(), F.col("redacted"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, with the ids: little-endian, two bytes each.

    Null and empty texts have their end id alone; repeated rows and null ids are packed like any others; an empty
    table gives no rows. A sequence is its pieces' ids by offset.
    """
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, capacity=2048, with_ids=True, width=2, forget=True)


def _changed(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``new`` as text; n_chars counts anew where the text isn't the same."""
    n = F.when(F.col("new").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("new")).cast("long")
    return docs.withColumn("n_chars", n).withColumn("text", F.col("new")).select(COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("secrets", secrets),
    ("packing", packing),
]

#: Learned rules, model scores and ids by a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over this sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
