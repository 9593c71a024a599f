"""Joins, first-wins dedup, upsert, paging and backfill over tables of documents, chunks and sessions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT_KEY = ["source", "dataset", "program", "region"]


def unused(rows: DataFrame, name: str) -> str:
    """A column name that the rows don't have, so that nothing of theirs is replaced."""
    while name in rows.columns:
        name += "_"
    return name


def first_by(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in a stated order, which ``dropDuplicates`` doesn't promise."""
    r = unused(rows, "_r")
    return rows.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) == 1).drop(r)


def resume(items: DataFrame, loaded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items that aren't loaded yet."""
    keys = keys or DOCUMENT_KEY
    return items.join(loaded.select(*keys).distinct(), keys, "left_anti")


def exists(rows: DataFrame, condition: Column) -> bool:
    return not rows.where(condition).limit(1).isEmpty()


def backfill_parents(children: DataFrame, parents: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Parents with a row, of defaults, for each key of children that has none."""
    orphans = children.select(key).where(F.col(key).isNotNull()).distinct().join(parents.select(key), key, "left_anti")
    return parents.unionByName(orphans.withColumns(defaults), allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, key: str, fixed: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with the rows of ``new``, the new values of a known key in place of the old; ``fixed`` columns stay."""
    n = new.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in new.columns if c != key]).alias("_new"))
    both = table.join(n, table[key] == F.col("_key"), "full_outer")
    out = [F.coalesce(F.col(key), F.col("_key")).alias(key)]
    for c in table.columns:
        if c == key:
            continue
        if c not in new.columns:
            out.append(F.col(c))
        elif c in fixed:
            out.append(F.when(table[key].isNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows whose key is in ``gone``."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def page(rows: DataFrame, order: list[str | Column], number: int, size: int = 25) -> tuple[DataFrame, int]:
    """One page, counted from 1, and how many there are; beyond the last it is empty."""
    if size <= 0:
        raise ValueError("a page holds at least one row")
    pages = math.ceil(rows.count() / size)
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size if number >= 1 else 0), pages


def links_between(steps: DataFrame) -> DataFrame:
    """(thread_id, question_id, answer_id): answers joined to their parents in the same thread."""
    q = steps.select("thread_id", F.col("id").alias("question_id"))
    a = steps.where("parent_id is not null").select("thread_id", F.col("parent_id").alias("question_id"), F.col("id").alias("answer_id"))
    return q.join(a, ["thread_id", "question_id"])


def dangling(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps in no pair."""
    used = pairs.select(F.explode(F.array("question_id", "answer_id")).alias("id")).distinct()
    return steps.join(used, "id", "left_anti")


def drop_dataset(table: DataFrame, dataset: str) -> DataFrame:
    return table.where(~F.col("dataset").eqNullSafe(F.lit(dataset)))


def throttled(n: Column) -> Column:
    """Which occurrences of an event are told: the first ten, each tenth to a hundred, then each hundredth."""
    return (n <= 10) | ((n <= 100) & (n % 10 == 0)) | (n % 100 == 0)


def throttle(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events with their number among equals, only those that are told."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("occurrence", n).where(throttled(F.col("occurrence")))


def islands(rows: DataFrame, keys: list[str], order: str, same: Column, name: str = "island") -> DataFrame:
    """Rows with the number of their run; a run begins where ``same`` (over ``prev_*`` columns) doesn't hold."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    begins = unused(rows, "_new")
    return rows.withColumn(begins, new).withColumn(name, F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(begins)


def flatten_schema(rows: DataFrame, sep: str = "_") -> DataFrame:
    """Structs as columns, names joined by ``sep``."""
    from pyspark.sql import types as T

    def walk(schema: T.StructType, path: str, name: str) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            at, to = f"{path}`{f.name}`", f"{name}{f.name}"
            out += walk(f.dataType, f"{at}.", f"{to}{sep}") if isinstance(f.dataType, T.StructType) else [F.col(at).alias(to)]
        return out

    return rows.select(*walk(rows.schema, "", ""))


#: Characters of an anchor, and how many neighbouring ones it is the least of.
ANCHOR, AMONG = 16, 32


def containing(texts: DataFrame, text: str, passages: DataFrame, passage: str, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Pairs in which a text holds a passage, one for each pair of rows; repeated rows are rows of their own.

    Passages of at most ``broadcast_bytes`` go to every task. Beyond that, texts and passages meet by anchors. A long
    passage is known by the least hash among its first stretches of ANCHOR characters, AMONG of them; a text that holds
    it holds them all, so this hash is the least of a window there, too, and a text offers no more than the least of
    each of its windows, about one for 16 characters. Shorter passages are known by their first ANCHOR characters or all
    they have, and a text offers each place of it for the lengths that there are. Numbers of rows travel with anchors;
    texts are moved once, for what has met, and compared whole. Null texts and passages are in no pair; empty passages
    are in every text.
    """
    if _row_bytes(passages, passage) <= broadcast_bytes:
        return texts.join(F.broadcast(passages), F.contains(F.col(text), F.col(passage)))
    t, p = (next(n for n in (f"{x}{k}" for k in range(len(texts.columns + passages.columns) + 1)) if n not in texts.columns + passages.columns) for x in ("_t", "_p"))
    texts, some = _numbered(texts.where(F.col(text).isNotNull()), t), _numbered(passages.where(F.length(passage) > 0), p)
    n = F.least(F.length(passage), F.lit(ANCHOR))
    kinds = sorted(r["k"] for r in some.select(F.when(F.length(passage) >= ANCHOR + AMONG - 1, 0).otherwise(n).alias("k")).distinct().collect())  # at most 17
    of_texts = _anchors(texts.select(F.col(t).alias("row"), F.col(text).alias("text")), lambda x: [(k, window_anchors(x) if k == 0 else stretches(x, k)) for k in kinds])
    of_passages = _anchors(some.select(F.col(p).alias("row"), F.col(passage).alias("text")), lambda x: [(0, window_anchors(x)[:1])] if len(x) >= ANCHOR + AMONG - 1 else [(min(len(x), ANCHOR), stretches(x, min(len(x), ANCHOR))[:1])])
    met = of_texts.withColumnRenamed("row", t).join(of_passages.withColumnRenamed("row", p), ["kind", "anchor"]).select(t, p).distinct()
    found = met.join(texts, t).join(some, p).where(F.contains(F.col(text), F.col(passage)))
    every = texts.drop(t).crossJoin(passages.where(F.length(passage) == 0))  # every text holds the empty one
    return found.select(*[c for c in texts.columns if c != t], *passages.columns).unionByName(every)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number each, written, so that the numbers stay."""
    from quillstone.streaming.run import work_dir

    place = work_dir(rows.sparkSession, "numbered")
    rows.withColumn(name, F.monotonically_increasing_id()).write.parquet(place)
    return rows.sparkSession.read.parquet(place)


def stretches(text: str, k: int) -> np.ndarray:
    """Hashes of all stretches of ``k`` characters, in order."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(x) < k:
        return np.zeros(0, np.int64)
    h = np.full(len(x) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ x[j : len(x) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def window_anchors(text: str) -> np.ndarray:
    """The least hash of each window of AMONG neighbouring stretches, in order; none of a shorter text."""
    least, width = stretches(text, ANCHOR), 1
    while width < AMONG and len(least) > 0:  # of 2, 4, 8 ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return least


def _anchors(rows: DataFrame, of: Callable[[str], list[tuple[int, np.ndarray]]]) -> DataFrame:
    """(row, kind, anchor): the different anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [(row, kind, np.unique(hashes)) for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for kind, hashes in of(text)]
                sizes = [len(own) for _, _, own in found]
                columns = [np.repeat(np.array([f[k] for f in found], kind), sizes) for k, kind in ((0, np.int64), (1, np.int32))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([np.zeros(0, np.int64), *(own for *_, own in found)]))], names=["row", "kind", "anchor"])

    return rows.mapInArrow(run, "row long, kind int, anchor long")


def _row_bytes(rows: DataFrame, text: str, row: int = 16) -> int:
    """UTF-8 bytes of a text column, and ``row`` for each row, so that many empty texts count as well."""
    return rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + row), F.lit(0))).first()[0]
