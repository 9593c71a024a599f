"""Streams that end: all files there are go through a query, whose output is a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillstone.sources.commits import Committed


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new place in the cluster's ``spark.checkpoint.dir``; in a temporary folder only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files. A stream takes one file only as a pattern."""
    schema = spark.read.parquet(path).schema
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors with several states need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drain(stream: DataFrame, tag: str, mode: str = "append", many_states: bool = False) -> DataFrame:
    """Run a stream over all there is now, into a table with exactly one copy of each row, and read that.

    ``many_states``: the stream's processors need the RocksDB state store.
    """
    spark = stream.sparkSession
    place = work_dir(spark, tag)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    with rocksdb(spark) if many_states else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def drain_by_steps(stream: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], kept: T.StructType, told: T.StructType, tag: str) -> DataFrame:
    """Run a stream over all there is now, each batch by ``step(rows, kept)``, and read what it told.

    ``step`` gets a batch and what the batches before left, and gives what is told and what is left for the next one,
    all as tables, so that a batch is worked on as any table is. ``kept`` and ``told`` are their schemas. A batch's rows go
    into a folder of its number, what is left into two folders in turn: one that runs again finds what it found before
    and overwrites only what it wrote itself.
    """
    place = work_dir(stream.sparkSession, tag)
    numbers: set[int] = set()

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(kept).parquet(f"{place}/kept-{(number - 1) % 2}") if number else spark.createDataFrame([], kept)
        rows, left = step(batch, before)
        rows.write.mode("overwrite").parquet(f"{place}/out/{number}")
        left.write.mode("overwrite").parquet(f"{place}/kept-{number % 2}")
        numbers.add(number)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(told).parquet(*[f"{place}/out/{n}" for n in sorted(numbers)]) if numbers else spark.createDataFrame([], told)


def append_new(stream: DataFrame, path: str, keys: list[str], tag: str) -> None:
    """Append to a table those rows of a stream whose keys it lacks; a batch that runs twice adds nothing twice."""
    spark = stream.sparkSession

    def one(batch: DataFrame, _number: int) -> None:
        rows = batch.dropDuplicates(keys)
        try:
            have = spark.read.parquet(path).select(*keys)
        except Exception as missing:  # the table may not be there yet; anything else is an error
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            have = None
        if have is not None:
            rows = rows.join(have, keys, "left_anti")
        rows.write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", work_dir(spark, tag)).trigger(availableNow=True).start()
    query.awaitTermination()


def fan_out(stream: DataFrame, primary: str, others: list[str], tag: str, state: str | None = None, primary_last: bool = False) -> list[str]:
    """Write each batch to a primary store and then to others, whose failures are told but don't stop it.

    ``primary_last``: the others come first, as where an answer counts only once all that belongs to it has been tried.

    Each store has a ledger: a batch is a commit of its own (``sources.commits``), named after ``tag`` and its number,
    so a batch that runs again, with the same ``state``, is skipped by the stores that have it and is whole in the
    others: no store holds a row twice. Read a store with ``stored``; ``catch_up`` gives another store what it missed.
    """
    spark = stream.sparkSession
    failed: list[str] = []

    def one(batch: DataFrame, number: int) -> None:
        name = f"{tag}-{number:012d}"
        batch.persist()
        try:
            for store in [*others, primary] if primary_last else [primary, *others]:
                try:
                    Committed(spark, store).append(name, batch)
                except Exception as e:
                    if store == primary:
                        raise
                    failed.append(f"{store}: {type(e).__name__}")
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", state or work_dir(spark, tag)).trigger(availableNow=True).start()
    query.awaitTermination()
    return failed


def stored(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The rows of a store that ``fan_out`` writes."""
    return Committed(spark, store).rows(schema)


def catch_up(spark: SparkSession, primary: str, other: str, schema: str) -> list[str]:
    """Batches that another store lacks, copied from the primary one; which they were."""
    have = set(Committed(spark, other).names())
    lacking = [n for n in Committed(spark, primary).names() if n not in have]
    for name in lacking:
        Committed(spark, other).append(name, spark.read.schema(schema).parquet(Committed(spark, primary).get(name)["place"]))
    return lacking
