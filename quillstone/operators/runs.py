"""An evaluation from a file of questions to logged metrics, and an ingestion from its arguments."""

from __future__ import annotations

import argparse
import inspect
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import evaluation as E
from quillstone.sources import readers, versions

QUESTION_COLUMNS = ("query_id", "dataset", "expected_hash", "expected_document")
METRICS = "k long, dataset string, overall boolean, sample_size long, recall_at_k double, document_recall_at_k double, avg_score_incorrect double, successful_retrievals long, successful_document_retrievals long"

#: (questions, k, min_score) -> query_id, rank, chunk_id, score, content_hash, document_id of the k best of each.
Retrieve = Callable[[DataFrame, int, float], DataFrame]


def run_evaluation(
    spark: SparkSession, questions_file: str, ks: list[int], retrieve: Retrieve, log_root: str, date: str, datasets: list[str] | None = None, min_score: float = -1.0,
    sample_fraction: float | None = None, min_samples: int | None = None, seed: int = 0, commit: str | None = None,
) -> dict[int, str]:
    """Evaluates a retrieval at each k on a CSV's questions and logs a batch for each: results, metrics, configuration.

    The CSV has the QUESTION_COLUMNS; ``datasets`` are names or labels to keep, none keeps all; a sample is drawn for
    each dataset. Chunks are retrieved once, at the largest k. Batch ids by k. No questions left, no k, or a fraction
    out of bounds is an error before anything is retrieved.
    """
    E.check_fraction(sample_fraction)
    if not ks:
        raise ValueError("there is no k")
    rows = readers.csv_rows(spark, questions_file, QUESTION_COLUMNS)
    asked = rows.select(F.col("query_id").cast("long").alias("query_id"), "dataset", "expected_hash", F.col("expected_document").cast("long").alias("expected_document"))
    if datasets:
        wanted = [E.DATASET_LABELS.get(d.lower(), d) for d in datasets]
        asked = asked.where(E.dataset_label(F.col("dataset")).isin(wanted))
    asked = E.stratified_sample(asked, F.col("dataset"), "query_id", sample_fraction, min_samples, seed).persist()
    try:
        n = asked.count()
        if n == 0:
            raise ValueError("no questions are left")
        judged = E.judge(asked, retrieve(asked, max(ks), min_score)).persist()
        try:
            ids = {}
            for k in ks:
                at = E.at_each_k(judged, [k])
                ids[k] = str(uuid.uuid4())
                versions.log_batch(versions.batch_config(ids[k], k, datasets, n, commit), at, E.metrics(at, keys=("k",)), log_root, date)
            return ids
        finally:
            judged.unpersist()
    finally:
        asked.unpersist()


def logged_metrics(spark: SparkSession, log_root: str, date: str, batch_ids: Sequence[str]) -> DataFrame:
    """Metrics of some batches, as they were logged."""
    out = spark.createDataFrame([], METRICS)
    for batch in batch_ids:
        out = out.unionByName(versions.logged(spark, log_root, date, batch, "metrics", METRICS))
    return out


@dataclass(frozen=True)
class Ingestion:
    """What an ingestion is asked for."""

    dataset: str
    program: str
    region: str
    path: str
    resume: bool = False
    skip_db: bool = False


def ingestion_arguments(argv: list[str]) -> Ingestion:
    """Arguments behind a command's name: dataset, program, region, path, --resume and --skip_db."""
    parser = argparse.ArgumentParser(prog=argv[0] if argv else "ingest")
    for name in ("dataset", "program", "region", "path"):
        parser.add_argument(name)
    for name in ("resume", "skip_db"):
        parser.add_argument(f"--{name}", action="store_true")
    return Ingestion(**vars(parser.parse_args(argv[1:])))


def run_ingestion(argv: list[str], ingest: Callable[..., object]) -> object:
    """Calls an ingestion with what its arguments say. One that is asked to resume or to leave the tables alone, and
    has no such parameter, is refused before it begins."""
    asked = ingestion_arguments(argv)
    can = inspect.signature(ingest).parameters
    options = {}
    for name in ("resume", "skip_db"):
        if getattr(asked, name):
            if name not in can:
                raise NotImplementedError(f"this ingestion can't {name}")
            options[name] = True
    return ingest(asked, **options)


@contextmanager
def timed(told: Callable[[str, float], None], what: str) -> Iterator[None]:
    """Tells how many seconds what is inside took, also where it fails."""
    start = time.perf_counter()
    try:
        yield
    finally:
        told(what, time.perf_counter() - start)
