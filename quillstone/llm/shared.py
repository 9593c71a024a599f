"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine."""
    named = spark.sparkContext.getConf().get(SETTING, None) or spark.conf.get(SETTING, None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"a cluster has to name a shared folder in {SETTING}")
        named = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new, unused place in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's own setting that removes shuffle files when the query that wrote them has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while a table is written: texts are long, and both sides of a Python worker hold a batch.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN: list[dict[str, SparkSession]] = []


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and survives lost executors.

    What was shuffled for it is removed when it is written; the session's settings stay as they were.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    before = {key: spark.conf.get(key) for key in (CLEAN, BATCH)}
    spark.conf.set(CLEAN, "true")
    spark.conf.set(BATCH, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    for made in _OPEN[-1:]:
        made[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*staged: DataFrame) -> None:
    """Remove tables that ``stage`` wrote and that nothing reads any more: what was made from them is written."""
    for df in staged:
        _delete(df.sparkSession, _PLACES.pop(df))


@contextmanager
def scratch(*, keep: list[DataFrame]) -> Iterator[None]:
    """Tables staged inside are removed at the end, but for those that are put into ``keep``."""
    made: dict[str, SparkSession] = {}
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        stay = {_PLACES.get(df) for df in keep}
        for path, spark in made.items():
            if path not in stay:
                _delete(spark, path)


def text_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, in one aggregated scan."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def groups_for(n_bytes: int, per_group: int) -> int:
    """How many groups of about ``per_group`` bytes hold ``n_bytes``."""
    return max(1, -(-n_bytes // per_group))


def open_shared(uri: str, mode: str):
    """A binary stream of a file in the shared folder, on any store that pyarrow or the local file system opens."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        return open(parts.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def rename_shared(old: str, new: str) -> None:
    """Move a finished file to its name, so that a task that was lost half-way leaves nothing that is read."""
    parts = urlparse(old)
    if parts.scheme in ("", "file"):
        os.replace(parts.path, urlparse(new).path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(old)
    store.move(path, fs.FileSystem.from_uri(new)[1])
