"""Question-answer pairs by version, and evaluation batches, each a commit with its metadata."""

from __future__ import annotations

import os
import subprocess
from datetime import UTC, datetime
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.commits import Committed
from quillstone.sources.writers import QA_COLUMNS, save_csv

QA_SCHEMA = ", ".join(f"{c} string" for c in QA_COLUMNS)


def version_id(now: datetime) -> str:
    """The name of a version: names sort as their times do."""
    return now.strftime("%Y%m%d_%H%M%S")


def save_qa_version(pairs: DataFrame, root: str, version: str, model: str | None = None, git_commit: str | None = None, now: datetime | None = None) -> bool:
    """Pairs as a CSV of the export's 14 columns, then the version's metadata; False if the version is there already.

    Columns that ``pairs`` lacks are empty, others are left out. The metadata: version_id, timestamp, llm_model,
    total_pairs, datasets (different document sources, sorted) and git_commit; counts are of what was written.
    """
    spark, stamp = pairs.sparkSession, (now or datetime.now(UTC)).isoformat()
    filled = pairs.withColumns({"version_id": F.lit(version), "version_timestamp": F.lit(stamp), "version_llm_model": F.lit(model).cast("string")})

    def write(place: str) -> dict[str, Any]:
        save_csv(filled, f"{place}/qa_pairs", QA_COLUMNS)
        written = _read(spark, f"{place}/qa_pairs").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("document_source")).alias("sources")).first()
        return {"version_id": version, "timestamp": stamp, "llm_model": model if written["n"] else None, "total_pairs": written["n"], "datasets": written["sources"], "git_commit": git_commit}

    return Committed(spark, root).add(version, write)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def latest_qa_version(spark: SparkSession, root: str) -> str:
    """The greatest version that is whole; none is an error."""
    found = Committed(spark, root).names()
    if not found:
        raise ValueError("there is no version")
    return found[-1]


def qa_metadata(spark: SparkSession, root: str, version: str | None = None) -> dict[str, Any]:
    return Committed(spark, root).get(version or latest_qa_version(spark, root))


def qa_pairs(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The pairs of a version, all columns strings; of the latest if none is named."""
    return _read(spark, qa_metadata(spark, root, version)["place"] + "/qa_pairs")


def git_commit(folder: str | None = None) -> str:
    """The commit that the code is at; an error where there is none."""
    at = folder or os.path.dirname(os.path.abspath(__file__))
    try:
        return subprocess.run(["git", "-C", at, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError) as e:
        raise RuntimeError(f"no commit could be told: {e}") from e


def package_version() -> str:
    """The version of this package as installed, or the one it states."""
    import quillstone

    try:
        return metadata.version("quillstone")
    except metadata.PackageNotFoundError:
        return quillstone.__version__


def batch_config(batch_id: str, k: int, datasets: list[str] | None = None, samples: int = 0, commit: str | None = None, package: str | None = None, now: datetime | None = None) -> dict[str, Any]:
    """Who and what a batch of evaluation is: its id and time, what it measures, and which software does."""
    return {
        "batch_id": batch_id, "timestamp": (now or datetime.now(UTC)).isoformat(),
        "evaluation_config": {"k_value": k, "num_samples": samples, "dataset_filter": datasets or []},
        "software_info": {"package_version": package or package_version(), "git_commit": commit or git_commit()},
    }


def log_batch(config: dict[str, Any], results: DataFrame, summary: DataFrame, root: str, date: str) -> bool:
    """Results and metrics as JSON below a date, then the batch's configuration; nothing is seen of a batch that failed."""

    def write(place: str) -> dict[str, Any]:
        results.write.json(f"{place}/results")
        summary.write.json(f"{place}/metrics")
        return config | {"date": date}

    return Committed(results.sparkSession, f"{root}/{date}").add(config["batch_id"], write)


def logged(spark: SparkSession, root: str, date: str, batch_id: str, part: str, schema: str) -> DataFrame:
    """The ``results`` or ``metrics`` of a batch."""
    return spark.read.schema(schema).json(Committed(spark, f"{root}/{date}").get(batch_id)["place"] + f"/{part}")


def batches(spark: SparkSession, root: str, date: str) -> list[dict[str, Any]]:
    """Configurations of all batches of a date."""
    table = Committed(spark, f"{root}/{date}")
    return [table.get(n) for n in table.names()]

