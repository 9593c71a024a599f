"""Filtered exact top-k retrieval by inner product, for all queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = {"datasets": "dataset", "programs": "program", "regions": "region"}


def inner_product(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision, added in order."""
    parts = F.zip_with(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def filtered(chunks: DataFrame, **filters: list[str] | None) -> DataFrame:
    """IN-list filters; an empty or missing list doesn't filter, an unknown filter is an error."""
    for name, values in filters.items():
        if name not in FILTERS:
            raise ValueError(f"unknown filter: {name}")
        if values:
            chunks = chunks.where(F.col(FILTERS[name]).isin(list(values)))
    return chunks


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as one array, taken from Arrow's own values."""
    return np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks] or [np.zeros(0)]).reshape(-1, width)


def _top(chunks: pa.Table, queries: pa.Table, width: int, k: int, min_score: float, schema: pa.Schema, cells: int = 1 << 22) -> pa.Table:
    """The ``k`` best chunks of a block for each query of a part: tiles of scores, then those near the best added in order."""
    if chunks.num_rows == 0 or queries.num_rows == 0:
        return schema.empty_table()
    ids, x, q, own = np.asarray(chunks["chunk_id"]), _matrix(chunks["embedding"], width), _matrix(queries["query_vector"], width), np.asarray(queries["query_id"])
    length, asked = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(-length, kind="stable")  # the longest first, so that a tile needs a beginning only
    ids, x, length = ids[order], x[order], length[order]
    turn = np.argsort(-asked, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tile = max(1, cells // len(x))
    for start in range(0, len(turn), tile):
        rows = turn[start : start + tile]
        bound = length * asked[rows[0]]
        most = int(np.searchsorted(-bound, -(min_score - 1e-9 * (1.0 + bound[0])), side="right"))
        if most == 0:  # neither these nor the shorter ones reach the threshold
            break
        about = q[rows] @ x[:most].T
        margin = 1e-9 * (1.0 + asked[rows] * length[0])
        least = np.full(len(rows), min_score)
        if most > k:
            least = np.maximum(least, np.partition(about, most - k, axis=1)[:, most - k])
        r, c = np.nonzero(about >= (least - margin)[:, None])
        for part in range(0, len(r), max(1, cells // max(width, 1))):  # many ties come in parts
            at = slice(part, part + max(1, cells // max(width, 1)))
            found.append((rows[r[at]], ids[c[at]], np.cumsum(x[c[at]] * q[rows[r[at]]], axis=1)[:, -1]))
    if not found:
        return schema.empty_table()
    r, i, score = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((i, -score, r))
    r, i, score = r[order], i[order], score[order]
    keep = (np.arange(len(r)) - np.searchsorted(r, r, side="left") < k) & (score >= min_score)
    return pa.Table.from_arrays([pa.array(own[r[keep]]), pa.array(i[keep]), pa.array(score[keep])], schema=schema)


def _finite(vector: str) -> Column:
    """Whether a vector is there and holds numbers only; never null."""
    fine = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int, min_score: float = -1.0, block_rows: int = 65536, query_rows: int = 16384, **filters: list[str] | None) -> DataFrame:
    """(query_id, rank, chunk_id, score): the ``k`` chunks of largest inner product of every query, at least ``min_score``.

    ``queries``: query_id long, query_vector; ``chunks``: chunk_id long, embedding and the columns to filter by. Ties
    go to the smaller chunk_id. Queries and chunks whose vector is null, empty or holds anything but finite numbers find
    and are nothing; vectors meet those of their own width. Parts of the queries meet blocks of chunks, a task for each
    pair, which keeps its own top k, so that a shuffle carries k rows for a query and block, and no task holds all
    queries; the threshold is on the ranking key and goes below the top k.
    """
    chunks = filtered(chunks, **filters).where(_finite("embedding")).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding", F.size("embedding").alias("width"))
    queries = queries.where(_finite("query_vector")).select(F.col("query_id").cast("long").alias("query_id"), "query_vector", F.size("query_vector").alias("width"))
    blocks, parts = max(1, -(-chunks.count() // block_rows)), max(1, -(-queries.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = chunks.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks))).withColumn("part", every(parts))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("block", every(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])

    def top(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _top(left, right, key[2].as_py(), k, min_score, schema)

    keys = ["block", "part", "width"]
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(top, "query_id long, chunk_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "score")


def retrieve_one(query: list[float], chunks: DataFrame, k: int, min_score: float = -1.0, **filters: list[str] | None) -> DataFrame:
    """The top k of a single query: a sort with a limit, which Spark runs as a heap in each task."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = filtered(chunks, **filters).select("chunk_id", inner_product("embedding", vector).alias("score"))
    return scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "chunk_id").limit(k)
