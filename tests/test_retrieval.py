"""Batch retrieval against all products: several parts and blocks, ties, widths, vectors that are none."""

import math
import random

import pytest

from quillstone.operators import retrieval as V

CHUNKS = "chunk_id long, embedding array<float>, dataset string, width string, block int"


def _score(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def _fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize(("k", "least"), [(1, -1e9), (4, -1e9), (4, 0.4), (1000, 0.0), (3, 1e6)])
def test_parts_and_blocks_agree_with_all_products(spark, k, least):
    r = random.Random(7)
    vector = lambda n: [float(r.randrange(-4, 5)) / 4 for _ in range(n)]
    chunks = [(n, vector(3), "a") for n in range(200)] + [(n, [1.0, 0.0, 0.5], "a") for n in range(200, 260)] + [(n, vector(2), "b") for n in range(260, 280)]
    chunks += [(300, None, "a"), (301, [], "a"), (302, [1.0, None, 2.0], "a"), (303, [math.nan, 1.0, 1.0], "a"), (304, [math.inf, 1.0, 1.0], "b"), (305, [0.0, 0.0, 0.0], "a")]
    queries = [(n, vector(3)) for n in range(60)] + [(60, [0.5, 0.5]), (61, None), (62, []), (63, [1.0, math.nan, 0.0]), (64, [None, 1.0, 1.0]), (65, [0.0, 0.0, 0.0])]
    want = []
    for q, v in queries:
        if _fine(v):
            all_ = sorted((-_score(v, c), i) for i, c, _ in chunks if _fine(c) and len(c) == len(v))
            want += [(q, n, i, -s) for n, (s, i) in enumerate([x for x in all_ if -x[0] >= least][:k], 1)]
    rows = spark.createDataFrame([(*c, "mine", 5) for c in chunks], CHUNKS)
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    got = V.retrieve(asked, rows, k, least, block_rows=50, query_rows=16)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_tiles_of_one_task(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 8)), rng.normal(size=(90, 8)) * np.exp(rng.normal(size=(90, 1)))
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    table = lambda i, v, names: pa.table({names[0]: pa.array(i), names[1]: pa.array(v.tolist(), pa.list_(pa.float64()))})
    got = V._top(table(np.arange(400), x, ("chunk_id", "embedding")), table(np.arange(90), q, ("query_id", "query_vector")), 8, 7, 1.0, schema, cells=1200)
    found = {}
    for qid, c, _ in zip(*(got[n].to_pylist() for n in ("query_id", "chunk_id", "score")), strict=True):
        found.setdefault(qid, []).append(c)
    for n in range(90):
        s = x @ q[n]
        assert found.get(n, []) == [c for c in np.argsort(-s)[:7].tolist() if s[c] >= 1.0]
