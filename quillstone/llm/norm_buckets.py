"""Exact top-k by inner product: candidates in buckets of like length, pruned by local cosine thresholds.

Candidates are dealt into classes by their lengths and each class into buckets of bounded size. A first round asks
every query of one bucket of the longest vectors, which gives a score that its k-th best reaches at least. With it a
query needs candidates of a certain length, and meets only buckets that have them; queries are dealt into parts by
that need, so that a candidate goes to no part that can't use it. In a bucket the score needed becomes a cosine needed:
where it leaves few candidates on the query's largest coordinates, those are looked up in sorted coordinates
(coordinate pruning), else all candidates that are long enough are taken (length pruning). What is left is verified by
exact products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.integer_vectors import matrix, products, whole_rows
from quillstone.llm.shared import groups_for, stage

SLACK = 1e-9  # relative; bounds are doubles, scores are whole numbers
_FOUND = pa.schema([("query_id", pa.int64()), ("query_h", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
ANY = -(1 << 63)  # a score that all reach
FOUND = "query_id long, query_h long, vec_id long, score long"


class Bucket:
    """Candidates of one bucket, longest first, with their unit vectors sorted on each coordinate once that is asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.x, self.length = ids[order], x[order], length[order]
        self.shorter = -self.length  # ascending
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long_enough(self, need: np.ndarray) -> np.ndarray:
        """For each length needed how many candidates have it; they come first."""
        return np.searchsorted(self.shorter, -need * (1 - SLACK), side="right")

    def on_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.by_coordinate:
            unit = self.x[:, f] / np.maximum(self.length, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.by_coordinate[f] = (unit[order], order)
        return self.by_coordinate[f]

    def near(self, unit: np.ndarray, cosine: float, prefix: int, focus: int, share: float) -> np.ndarray | None:
        """Candidates among the first ``prefix`` that may have a cosine to ``unit``, by its largest coordinates; None if they are many."""
        found = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            values, order = self.on_coordinate(int(f))
            mid, wide = np.arccos(np.clip(unit[f], -1, 1)), np.arccos(np.clip(cosine, -1, 1))
            low, high = np.cos(min(np.pi, mid + wide)) - SLACK, np.cos(max(0.0, mid - wide)) + SLACK
            a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            if found is None:
                if b - a > share * prefix:
                    return None
                found = order[a:b]
                found = found[found < prefix]
            else:
                v = self.x[found, f] / np.maximum(self.length[found], 1e-300)
                found = found[(v >= low) & (v <= high)]
        return found


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, need: np.ndarray, k: int, tile: int = 256, focus: int = 3, share: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate id, score) of each query's ``k`` best in a bucket that reach ``need``, its own id apart."""
    bucket = Bucket(ids, x)
    q_length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    reach = q_length * bucket.length[0] * (1 + SLACK) + SLACK
    wanted = need.astype(np.float64)
    alive = np.flatnonzero(wanted <= reach)
    with np.errstate(divide="ignore", invalid="ignore"):
        length = np.where(need > 0, wanted / q_length, 0.0)
        cosine = np.where(need > 0, wanted / (q_length * bucket.length[0]), -1.0)
    prefix = bucket.long_enough(length)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(rows: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        """The ``k`` best of each row among what was scored."""
        least = need[rows].copy()
        if scores.shape[1] > k + 1:  # one of them may be the query itself
            least = np.maximum(least, np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1])
        r, c = np.nonzero((scores >= least[:, None]) & (bucket.ids[at][None, :] != query_ids[rows][:, None]))
        s, i = scores[r, c], bucket.ids[at][c]
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        first = np.searchsorted(r, r, side="left")
        top = np.arange(len(r)) - first < k
        out.append((rows[r[top]], i[top], s[top]))

    by_length = []
    for row in alive[np.argsort(prefix[alive], kind="stable")]:
        found = None
        if cosine[row] > 0.5:  # below, a coordinate leaves nearly all candidates
            found = bucket.near(q[row] / q_length[row], cosine[row], int(prefix[row]), focus, share)
        if found is None:
            by_length.append(row)
        elif len(found):
            keep(np.array([row]), found, products(q[row : row + 1], bucket.x[found]))
    for a in range(0, len(by_length), tile):
        rows = np.array(by_length[a : a + tile])
        most = int(prefix[rows].max())
        if most:
            keep(rows, np.arange(most), products(q[rows], bucket.x[:most]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Classes:
    """Rows in at most ``most`` classes by a number, and each class in groups of about ``per`` rows by a hash.

    Cuts are quantiles, so only as many numbers as there are classes come to the driver. Rows with the same number are
    in one class, but in as many groups as their count asks for.
    """

    def __init__(self, rows: DataFrame, column: str, most: int, per: int):
        want = min(most, groups_for(rows.count(), per))
        cuts = rows.agg(F.percentile_approx(column, [k / want for k in range(1, want)], 10000).alias("c")).first()["c"] if want > 1 else []
        self.cuts = sorted(set(cuts or []))
        self.column = column
        stats = {r["k"]: r for r in rows.groupBy(self.number().alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        self.size = [groups_for(stats[k]["n"], per) if k in stats else 1 for k in range(len(self.cuts) + 1)]
        self.base = [sum(self.size[:k]) for k in range(len(self.size))]
        self.low = [stats[k]["low"] if k in stats else float("inf") for k in range(len(self.size))]
        self.high = [stats[k]["high"] if k in stats else float("-inf") for k in range(len(self.size))]

    def number(self) -> Column:
        out = F.lit(0)
        for cut in self.cuts:
            out = out + (F.col(self.column) > cut).cast("int")
        return out

    def group(self, hashed: Column) -> Column:
        of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), self.number() + 1)
        return of(self.base) + F.pmod(hashed, of(self.size))

    def groups(self, wanted: Column, skip: int | None = None) -> Column:
        """All groups of the classes whose numbers ``wanted`` lists, but for one."""
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in (b, b + n - 1)]) for b, n in zip(self.base, self.size, strict=True)])
        every = F.flatten(F.transform(wanted, lambda k: F.sequence(F.element_at(table, k + 1)[0], F.element_at(table, k + 1)[1])))
        return every if skip is None else F.array_remove(every, F.lit(skip).cast("long"))

    def those(self, keep: list[Column]) -> Column:
        """Numbers of the classes for which a condition holds, one for each class."""
        return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(keep)]), lambda k: k.isNotNull())


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = 8192, query_rows: int = 16384, length_classes: int = 32, need_classes: int = 16
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` the ``k`` highest scores of others.

    Each component becomes ``floor(scale * x)``; a score is the inner product of these whole numbers, exact. Ties go to
    the smaller id; rank counts from 1; a query finds all candidates if there are at most ``k``. Rows with a null id,
    and vectors that are null or hold null or non-finite components take no part; zero vectors do, with scores of 0;
    vectors meet those of their own width, empty ones each other. Repeated rows (same id, same numbers) count once. An
    id with several vectors asks once with each, and ranks count from 1 in each answer; none of a query's own id is
    found. Components whose products could overflow a long are an error. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    rows = stage(whole_rows(vectors, scale, id_col, vector_col).withColumn("length", F.sqrt("n2")).withColumn("dim", F.size("v")).drop("n2"), "norm-rows")
    lengths = Classes(rows, "length", length_classes, bucket_rows)
    spread = F.xxhash64(F.lit(43), "id", "h")
    dealt = rows.withColumn("bucket", lengths.group(spread))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    first = lengths.base[-1]  # a bucket of the longest

    def answer(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        if index.num_rows == 0 or queries.num_rows == 0:
            return _FOUND.empty_table()
        qid = np.asarray(queries["id"])
        need = np.asarray(queries["need"])
        r, i, s = best(np.asarray(index["id"]), matrix(index["v"]), qid, matrix(queries["v"]), need, k)
        return pa.Table.from_arrays([pa.array(qid[r]), pa.array(np.asarray(queries["h"])[r]), pa.array(i), pa.array(s)], schema=_FOUND)

    keys = ["dim", "bucket", "part"]

    def meet(index: DataFrame, queries: DataFrame) -> DataFrame:
        left, right = index.select(*keys, "id", "v"), queries.select(*keys, "id", "h", "v", "need")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, FOUND)

    # one bucket of the longest, met by all parts of the queries
    parts = groups_for(asked.count(), query_rows)
    start = asked.withColumns({"need": F.lit(ANY), "bucket": F.lit(first).cast("long"), "part": F.pmod(spread, F.lit(parts))})
    opened = dealt.where(F.col("bucket") == first).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    begun = stage(meet(opened, start), "norm-begun")
    reached = begun.groupBy(F.col("query_id").alias("id"), F.col("query_h").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    needs = asked.join(reached, ["id", "h"], "left").withColumn("need", F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(ANY))).drop("n", "least")
    # the length that a candidate has to have: without a threshold, or with one below zero, any will do
    needs = stage(needs.withColumn("reach", F.when(F.col("need") > 0, F.col("need") / F.greatest("length", F.lit(1e-300)) * (1 - SLACK)).otherwise(F.lit(0.0))), "norm-needs")
    reaches = Classes(needs, "reach", need_classes, query_rows)
    queries = needs.withColumn("part", reaches.group(spread))
    queries = queries.withColumn("bucket", F.explode(lengths.groups(lengths.those([F.col("reach") <= top for top in lengths.high]), skip=first)))
    candidates = dealt.where(F.col("bucket") != first).withColumn("part", F.explode(reaches.groups(reaches.those([F.lit(low) <= F.col("length") for low in reaches.low]))))
    found = begun.unionByName(meet(candidates, queries))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_h").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
