"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. Pivot inverted files post, for each pivot, the vectors that
have it among their nearest and at which place. A query's own nearest pivots are looked up there; vectors are ranked
by the footrule distance of the two orders, and the first of them are ranked again by exact inner products.

Largest inner products become least distances by one more component that gives all vectors the same norm, so vectors
of any norms have sensible pivots. Equal vectors are posted once. Index and queries meet block by block: a part of the
queries and a block of the index in one task, so that neither side has to fit anywhere as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.shared import groups_for, stage


#: Window ranks up to as many are cut off before a shuffle (Spark's own default).
SAMPLE = 1000


def lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with a component that fills their squared norms up to ``norm2``."""
    rest = np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector, nearest first."""
    length = min(length, len(pivots))
    far = (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    near = np.argpartition(far, length - 1, axis=1)[:, :length]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def apart(sample: np.ndarray, pivots: int, cosine: float = 0.8) -> np.ndarray:
    """The first ``pivots`` of a sample that point elsewhere than all before them, so that a dense cluster gets one."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    chosen: list[int] = []
    for k in range(len(sample)):
        if len(chosen) < pivots and (not chosen or (unit[chosen] @ unit[k]).max() < cosine):
            chosen.append(k)
    return sample[chosen]


class Postings:
    """Pivot inverted files of the vectors of one block."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.length = order.shape[1]
        self.rows = len(order)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by], np.arange(pivots + 1))
        row, place = by // self.length, (by % self.length).astype(np.int32)
        self.files = [(row[a:b], place[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def nearest(self, order: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` rows of least footrule distance to a query's order; a pivot that a row lacks counts as beyond its last."""
        files = [self.files[p] for p in order]
        sizes = [len(row) for row, _ in files]
        row, there = np.concatenate([f[0] for f in files]), np.concatenate([f[1] for f in files])
        place = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        near = np.bincount(row, self.length - np.abs(there - place), minlength=self.rows)
        if most >= self.rows:
            return np.arange(self.rows)
        cut = np.partition(near, self.rows - most)[self.rows - most]
        return np.flatnonzero(near >= max(cut, 1)) if cut else np.argpartition(-near, most - 1)[:most]


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    return np.cumsum(rows * query, axis=1)[:, -1]


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 512, length: int = 80, share: float = 0.18, least: int = 100, block_rows: int = 8192, query_rows: int = 16384
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` its ``k`` nearest others found.

    Nearness is the inner product; ties go to the smaller id; rank counts from 1. Rows with a null id, and vectors
    that are null, empty, zero or hold null or non-finite components take no part; vectors meet those of their own
    width. A query finds all candidates if there are at most ``k``. Repeated rows (same id, same vector) count once, as
    queries and as candidates. An id with several vectors asks once with each, and ranks count from 1 in each answer;
    none of a query's own id is found. Components of any finite size take part: orders of pivots are taken from scaled
    vectors, and a score that overflows is infinite, or not a number and last. Other columns are ignored, whatever
    their names. An empty table gives no rows.

    Pivots come from the first ``2 * pivots``, at most 1,000, distinct vectors of a width by a hash: the only sample. In each block of
    ``block_rows`` distinct vectors, the nearest ``share`` (and at least ``least``) by footrule are ranked exactly.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine).withColumn("dim", F.size("v")).distinct()
    # of equal vectors the k + 1 least ids are all that any query can need
    first = Window.partitionBy("dim", "v").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    hashed = F.xxhash64(F.lit(29), "v")
    distinct = stage(kept.groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", hashed), "ann-vectors")
    blocks = groups_for(distinct.count(), block_rows)
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64(F.lit(31), "h"), F.lit(blocks)))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "dim", hashed.alias("h"))
    parts = groups_for(queries.count(), query_rows)
    queries = queries.withColumn("part", F.pmod(F.xxhash64(F.lit(37), "id"), F.lit(parts)))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # every part of the queries meets every block of the index: the stated query set against all rows
    asked = queries.withColumn("block", number(blocks))
    posted = dealt.withColumn("part", number(parts)).withColumn("pivot", F.lit(False))
    # the sample of the pivots goes along with each block, so that the driver holds no vectors; ranks up to SAMPLE are
    # cut off before the shuffle, so no task sorts all vectors of a width
    sample = distinct.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy("h", "v"))).where(F.col("r") <= min(2 * pivots, SAMPLE))
    sample = sample.withColumn("block", number(blocks)).withColumn("part", number(parts)).withColumn("ids", F.array(F.col("r").cast("long"))).withColumn("pivot", F.lit(True))
    columns = ["dim", "block", "part", "v", "ids", "pivot"]
    posted = posted.select(columns).unionByName(sample.select(columns))
    result = pa.schema([("query_id", pa.int64()), ("query_h", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def dense(column, dim: int) -> np.ndarray:
        flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        return np.asarray(flat, dtype=np.float64).reshape(-1, dim)

    def answer(key: tuple, index: pa.Table, asked_: pa.Table) -> pa.Table:
        if index.num_rows == 0 or asked_.num_rows == 0:
            return result.empty_table()
        dim = key[0].as_py()
        is_pivot = np.asarray(index["pivot"])
        place = np.array([x[0] for x in index["ids"].filter(pa.array(is_pivot)).to_pylist()])
        found_pivots = dense(index["v"].filter(pa.array(is_pivot)), dim)[np.argsort(place)]
        index = index.filter(pa.array(~is_pivot))
        if index.num_rows == 0:
            return result.empty_table()
        x, q = dense(index["v"], dim), dense(asked_["v"], dim)
        # with the largest component of the block and its pivots as one, the largest squared norm is what all are lifted to
        largest = max(np.abs(x).max(), np.abs(found_pivots).max())
        unit = 1.0 / largest if largest > 1e-300 else 1e300
        xs, ps = x * unit, found_pivots * unit
        top = max((xs * xs).sum(axis=1).max(), (ps * ps).sum(axis=1).max())
        pv = apart(lift(ps, top), pivots)
        qs = q / np.abs(q).max(axis=1, keepdims=True)
        qs = qs / np.linalg.norm(qs, axis=1, keepdims=True)
        ids = index["ids"].to_pylist()
        postings = Postings(orders(lift(xs, top), pv, length), len(pv))
        q_orders = orders(np.concatenate([qs * np.sqrt(top), np.zeros((len(qs), 1))], axis=1), pv, length)
        most = max(least, int(share * len(x)))
        out_q, out_h, out_v, out_s = [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for own, h, vector, turned, order in zip(asked_["id"].to_pylist(), asked_["h"].to_pylist(), q, qs, q_orders, strict=True):
                rows_ = postings.nearest(order, most)
                # one of them may be the query alone; rounding is far below the margin, but a sum that overflows isn't
                if len(rows_) > k + 1 and largest * np.abs(vector).max() < 1e300 / dim:
                    about = xs[rows_] @ turned
                    margin = 1e-9 * np.sqrt(top)
                    rows_ = rows_[about >= np.partition(about, len(about) - k - 1)[len(about) - k - 1] - margin]
                scores = exact(vector, x[rows_])
                none = np.isnan(scores)
                found = sorted((m, 0.0 if m else -s, i, s) for r, m, s in zip(rows_.tolist(), none.tolist(), scores.tolist(), strict=True) for i in ids[r] if i != own)[:k]
                out_q += [own] * len(found)
                out_h += [h] * len(found)
                out_v += [i for *_, i, _ in found]
                out_s += [s for *_, s in found]
        return pa.Table.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_h, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], schema=result)

    met = posted.groupBy("dim", "block", "part").cogroup(asked.groupBy("dim", "block", "part")).applyInArrow(answer, "query_id long, query_h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_h").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
