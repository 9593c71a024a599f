"""Retrieval evaluation: judged results, metrics, failure analysis, exact stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.relational import unused

#: Labels of datasets by their names in commands.
DATASET_LABELS = {
    "ca_ftb": "CA FTB", "ca_public_charge": "Keep Your Benefits", "ca_wic": "WIC", "covered_ca": "Covered California", "edd": "CA EDD",
    "irs": "IRS", "la_policy": "DPSS Policy", "ssa": "SSA",
}


def dataset_label(name: Column) -> Column:
    """The label of a dataset's name, case-insensitive; other names stay."""
    pairs = [F.lit(x) for kv in DATASET_LABELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(name)), name)


def judge(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A row for each question: what it expected, the ordered list it got, whether and where the expected is in it.

    ``questions``: query_id, dataset, expected_hash, expected_document; ``retrieved``: query_id, rank, chunk_id, score,
    content_hash, document_id. Questions without a hit stay, with an empty list.
    """
    item = F.struct("rank", "chunk_id", "score", "content_hash", "document_id")
    lists = retrieved.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("retrieved_chunks"))
    kind = lists.schema["retrieved_chunks"].dataType.simpleString()
    joined = questions.join(lists, "query_id", "left").withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.array().cast(kind)))
    place = lambda field, wanted: F.nullif(F.array_position(F.transform("retrieved_chunks", lambda c: c[field]), F.col(wanted)), F.lit(0).cast("long")).cast("int")
    return (
        joined.withColumn("rank_if_found", place("content_hash", "expected_hash"))
        .withColumn("document_rank_if_found", place("document_id", "expected_document"))
        .withColumn("correct_chunk_retrieved", F.col("rank_if_found").isNotNull())
        .withColumn("correct_document_retrieved", F.col("document_rank_if_found").isNotNull())
    )


def _metrics() -> list[Column]:
    correct, doc = F.col("correct_chunk_retrieved"), F.col("correct_document_retrieved")
    top = F.when(~correct & (F.size("retrieved_chunks") > 0), F.array_max(F.transform("retrieved_chunks", lambda c: c["score"])))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("sample_size"),
        zero(F.avg(correct.cast("double"))).alias("recall_at_k"),
        zero(F.avg(doc.cast("double"))).alias("document_recall_at_k"),
        zero(F.avg(top)).alias("avg_score_incorrect"),
        F.count_if(correct).alias("successful_retrievals"),
        F.count_if(doc).alias("successful_document_retrievals"),
    ]


def metrics(results: DataFrame, by: str = "dataset", keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics for each dataset and, with a null dataset and ``overall``, over all: one pass with a rollup."""
    if keys:
        sets = [F.col(k) for k in keys]
        each = results.groupBy(*sets, by).agg(*_metrics()).withColumn("overall", F.lit(False))
        total = results.groupBy(*sets).agg(*_metrics()).withColumn(by, F.lit(None).cast("string")).withColumn("overall", F.lit(True))
        return each.unionByName(total)
    return results.rollup(by).agg(*_metrics(), (F.grouping(by) == 1).alias("overall"))


def at_each_k(judged_at_most: DataFrame, ks: list[int]) -> DataFrame:
    """Results at several k from one retrieval at the largest: each row's list and ranks cut at k."""
    cut = lambda c: F.when(F.col(c) <= F.col("k"), F.col(c))
    rows = judged_at_most.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return (
        rows.withColumn("retrieved_chunks", F.slice("retrieved_chunks", F.lit(1), F.col("k")))
        .withColumn("rank_if_found", cut("rank_if_found"))
        .withColumn("document_rank_if_found", cut("document_rank_if_found"))
        .withColumn("correct_chunk_retrieved", F.col("rank_if_found").isNotNull())
        .withColumn("correct_document_retrieved", F.col("document_rank_if_found").isNotNull())
    )


def precision_recall(results: DataFrame, k: int) -> DataFrame:
    hit = F.col("correct_chunk_retrieved").cast("double")
    return results.agg(F.avg(hit / k).alias("precision_at_k"), F.avg(hit).alias("recall_at_k"))


def failure_analysis(results: DataFrame, by: str = "dataset") -> DataFrame:
    """Datasets with failures, most first, then by name, with the count of failures."""
    return results.where("not correct_chunk_retrieved").groupBy(by).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), by)


def explode_results(results: DataFrame) -> DataFrame:
    """A row for each retrieved chunk with its rank, and whether it is the expected one; one row where there is none."""
    others = [c for c in results.columns if c != "retrieved_chunks"]
    rows = results.select(*others, F.posexplode_outer("retrieved_chunks").alias("pos", "chunk"))
    return rows.select(
        *others, (F.col("pos") + 1).cast("int").alias("retrieved_rank"), "chunk.chunk_id", "chunk.score", F.coalesce(F.col("chunk.content_hash") == F.col("expected_hash"), F.lit(False)).alias("is_correct")
    )


def stratified_sample(rows: DataFrame, key: Column, id_col: str, fraction: float | None = None, min_samples: int | None = None, seed: int = 0) -> DataFrame:
    """Of each stratum exactly min(n, max(min_samples or 1, int(n * fraction))) rows; all if neither is given.

    Members are the first by a seeded md5 of the id, so that the sample is the same anywhere.
    """
    if fraction is not None and not 0 <= fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    if not fraction and min_samples is None:
        return rows
    stratum, tie, total, place = (unused(rows, name) for name in ("_key", "_tie", "_n", "_at"))
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(tie, id_col))
    least = F.lit(1 if min_samples is None else min_samples)
    size = F.least(F.col(total), F.greatest(least, F.floor(F.col(total) * F.lit(float(fraction or 0.0)))))
    keyed = rows.withColumn(stratum, key).withColumn(tie, F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))))
    return keyed.withColumn(total, n).withColumn(place, at).where(F.col(place) <= size).drop(stratum, tie, total, place)


def check_fraction(fraction: float | None) -> None:
    if fraction is not None and not 0 < fraction <= 1:
        raise ValueError("sample fraction must be over 0 and at most 1")


def column_order(columns: list[str], first: list[str]) -> list[str]:
    """Columns of a flat export: those of ``first`` that exist, then the others by name."""
    return [c for c in first if c in columns] + sorted(c for c in columns if c not in first)
