"""Centroid clustering by plain Lloyd iterations over whole numbers.

Every vector is compared with every centroid: centroids, whose number is a parameter, go to all tasks; a task works
out integer squared differences to each centroid in NumPy and takes the first of the least. Tasks add up whole numbers
for each cluster, and these sums, one row for a cluster and task, are merged by a grouping, so that a cluster with
most of all rows is no more work for it than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.integer_vectors import finite, whole
from quillstone.llm.shared import stage


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared differences of each vector to each centroid, exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def _totals(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """For each cluster that has vectors: how many, the sum of their distances and of their components."""
    dims = centroids.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        n, far, sums = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                d = distances(x, c)
                own = d.argmin(axis=1)
                n += np.bincount(own, minlength=len(c))
                np.add.at(far, own, d[np.arange(len(x)), own])
                np.add.at(sums, own, x)
        there = np.flatnonzero(n)
        if len(there):
            yield pd.DataFrame({"cluster": there.astype(np.int32), "n": n[there], "far": far[there], "sums": list(sums[there])})

    parts = kept.select("v").mapInPandas(add, "cluster int, n long, far long, sums array<long>")
    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), total(F.col("far")).alias("far"), F.array(*[total(F.col("sums")[k]) for k in range(dims)]).alias("sums"))
    return {r["cluster"]: (r["n"], int(r["far"]), [int(s) for s in r["sums"]]) for r in merged.collect()}  # one row for each centroid


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors with exactly ``dims`` components, none null or not finite; each component becomes
    ``floor(scale * x)``. The first centroids are the ``clusters`` vectors whose ``seed`` and id have the least sha256
    (all, if there are fewer; ties of repeated ids by the vector). A round assigns every vector to the nearest centroid
    (ties: the smaller number) and moves each centroid that has vectors to the floor of their mean; then vectors are
    assigned once more. Repeated rows count each; a row whose id is null is assigned but never a first centroid, so
    that a table of such rows alone has no centroid, and an error says so. Components whose distances could overflow a
    long (beyond about 2**27 after scaling, for 64) are an error. Other columns are ignored, whatever their names. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    key = F.col(f"`{id_col}`")
    rows = vectors.select(key.alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("f")).where(finite("f") & (F.size("f") == dims))
    kept = stage(rows.select("id", whole("f", scale, F.lit(isqrt((1 << 62) // dims) // 2)).alias("v")), "lloyd")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = kept.where(F.col("id").isNotNull()).orderBy(hashed, "v").limit(clusters).collect()  # as many rows as centroids
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not first:
        if not kept.isEmpty():
            raise ValueError("no row has an id, so none can be a first centroid")
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for k, (n, _, sums) in _totals(kept, centroids).items():
            centroids[k] = [s // n for s in sums]
    far = {k: f for k, (_, f, _) in _totals(kept, centroids).items()}
    marks = [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in centroids.tolist()]
    shared, inertia = spark.sparkContext.broadcast(centroids), sum(far.values())
    each = np.array([far.get(k, 0) for k in range(len(marks))], np.int64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["v"].to_numpy()), shared.value)
                own = d.argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "cluster": own.astype(np.int32), "distance": d[np.arange(len(d)), own], "cluster_inertia": each[own], "inertia": inertia, "centroid_sha256": [marks[k] for k in own]})

    # ids travel as strings: a null among longs would make doubles of them
    out = kept.select(F.col("id").cast("string").alias("id"), "v").mapInPandas(assign, "id string, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
