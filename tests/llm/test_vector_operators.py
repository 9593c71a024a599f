"""Operators 11 to 13 against plain versions: ties, repeated rows, widths, nulls, empty tables, clashing columns."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import dual_tree, lloyd, norm_buckets, queries
from quillstone.llm.integer_vectors import products

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, n2 int, length string, bucket int, cluster string, h int, dim int, cell int, need int, score string"
CLASH = ("x", "y", 1, "z", 7, "w", 7, 7, 7, 7, "u")


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows(seed=3, n=700, width=6, spread=True):
    """Vectors of many lengths, with groups of equal ones, another width, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if spread:
        x *= np.exp(rng.normal(size=(n, 1)) * 1.5)
    x[n // 2 : n // 2 + 60] = x[n // 2]  # a hot vector
    x[40] = 0.0
    out = [(k, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for k, v in enumerate(x)]
    out += [(k, [0.5, float(k % 7)], k % 3) for k in range(n, n + 60)]
    out += [(None, [1.0] * width, 1), (n + 100, None, 1), (n + 200, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (n + 300, [math.nan] * width, 1), (n + 400, [math.inf] + [0.0] * (width - 1), 1), (n + 500, [], 2), (n + 600, [], 2), (n + 700, [1.0] * width, None)]
    return out


def table(spark, data):
    return spark.createDataFrame([(i, v, g, *CLASH) for i, v, g in data], SCHEMA).repartition(5)


def whole(v, scale):
    return tuple(math.floor(scale * float(x)) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


# 11


def plain_lloyd(data, clusters, rounds, dims, scale):
    kept = [(i, whole(v, scale)) for i, v, _ in data if finite(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    cents = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for k, vs in own.items():
            cents[k] = tuple(sum(c) // len(vs) for c in zip(*vs, strict=True))
    found = [(i, *near(v)[::-1]) for i, v in kept]
    each = defaultdict(int)
    for _, k, d in found:
        each[k] += d
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, k, d, each[k], sum(each.values()), mark[k]) for i, k, d in found), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("clusters", [1, 5, 40])
def test_lloyd_agrees_with_plain_rounds(spark, clusters):
    data = rows(n=150)
    data += data[:20]  # repeated rows count each
    assert told(lloyd.cluster(table(spark, data), clusters, 3, 6, 64)) == plain_lloyd(data, clusters, 3, 6, 64)


def test_lloyd_on_few_rows_and_none(spark):
    few = [(5, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (5, [-3.0, 1.0], 0), (None, [0.0, 0.0], 0), (7, [1.0], 0)]
    assert told(lloyd.cluster(table(spark, few), 16, 2, 2, 64)) == plain_lloyd(few, 16, 2, 2, 64)
    empty = lloyd.cluster(table(spark, few).where("false"), 16, 2, 2, 64)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="no row has an id"):
        lloyd.cluster(table(spark, few[3:4]), 16, 2, 2, 64)
    with pytest.raises(Exception, match="too large"):
        lloyd.cluster(table(spark, [(1, [1e30, 0.0], 0)]), 16, 2, 2, 64).collect()


# 12


def plain_top(data, every, k, scale):
    kept = {(i, whole(v, scale)) for i, v, _ in data if i is not None and finite(v)}
    out = []
    for q, v in kept:
        if q % every == 0:
            best = sorted((-dot(v, w), c) for c, w in kept if c != q and len(w) == len(v))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [True, False])
def test_norm_buckets_agree_with_all_products(spark, spread):
    data = rows(spread=spread)
    data += data[:30]
    got = norm_buckets.search(table(spark, data), every=5, k=4, bucket_rows=60, query_rows=25, length_classes=6, need_classes=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(data, 5, 4, 256)


def test_norm_buckets_on_few_rows_and_none(spark):
    few = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-1.0, 0.0], 0), (0, [0.0, 2.0], 0), (50, [3.0], 0)]
    got = sorted(tuple(r) for r in norm_buckets.search(table(spark, few)).collect())
    assert got == [(0, 1, 1, -65536), (0, 1, 1, 0), (0, 2, 2, -65536), (0, 2, 2, 0)]
    assert norm_buckets.search(table(spark, few).where("false")).collect() == []
    large = [(k, [1e6 + k, -1e6], 0) for k in range(6)]
    assert sorted(tuple(r) for r in norm_buckets.search(table(spark, large), every=1, k=3).collect()) == plain_top(large, 1, 3, 256)


def test_both_prunings_leave_the_best():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 3))
    x *= np.exp(rng.normal(size=(3000, 1)) * 0.01) / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.floor(25600 * x).astype(np.int64)
    ids = rng.permutation(3000)
    q = x[:200]
    s = products(q, x)
    used = []
    near = norm_buckets.Bucket.near
    norm_buckets.Bucket.near = lambda self, *a: used.append(near(self, *a)) or used[-1]
    try:
        need = np.sort(s, axis=1)[:, -8]
        r, i, got = norm_buckets.best(ids, x, ids[:200], q, need, 5)
    finally:
        norm_buckets.Bucket.near = near
    assert any(u is not None for u in used) and any(u is None for u in used)  # coordinates for some, lengths for others
    for k in range(200):
        want = sorted((-a, b) for a, b in zip(s[k].tolist(), ids.tolist(), strict=True) if b != ids[k] and a >= need[k])[:5]
        assert [(-a, b) for a, b in zip(got[r == k].tolist(), i[r == k].tolist(), strict=True)] == want


# 13


def plain_negatives(data, every, positives, negatives, scale=256):
    kept = {(i, g, whole(v, scale)) for i, v, g in data if i is not None and g is not None and finite(v)}
    out = []
    for a, g, v in kept:
        if a % every:
            continue
        others = [(-dot(v, w), i, h == g) for i, h, w in kept if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in others if x[2])[:positives]:
            fit = sorted(x for x in others if not x[2] and 80 * -ps <= 100 * -x[0] <= 100 * -ps)[:negatives]
            out += [(a, p, r, n, -ps, -s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [True, False])
def test_dual_trees_agree_with_all_products(spark, spread):
    data = rows(seed=5, spread=spread)
    data += data[:30]
    got = dual_tree.mine(table(spark, data), every=4, positives=3, negatives=4, block_rows=50, anchor_rows=40)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(data, 4, 3, 4)


def test_dual_trees_on_few_rows_and_none(spark):
    few = [(0, [1.0, 0.0], 0), (1, [0.9, 0.0], 0), (2, [0.8, 0.0], 1), (3, [0.8, 0.0], 1), (4, [0.95, 0.0], 2), (5, [-1.0, 0.0], 1), (100, [-2.0, 0.0], 3), (200, [0.0], 0)]
    assert sorted(tuple(r) for r in dual_tree.mine(table(spark, few)).collect()) == plain_negatives(few, 100, 5, 5) != []
    assert dual_tree.mine(table(spark, few).where("false")).collect() == []
    assert dual_tree.mine(table(spark, few).where("label = 3")).collect() == []


def test_pairs_of_nodes_are_pruned_at_once():
    rng = np.random.default_rng(2)
    centres = np.eye(8)[rng.integers(0, 8, 4000)] * 2000
    x = np.round(centres + rng.normal(size=centres.shape) * 60).astype(np.int64)
    order = rng.permutation(4000)
    x = x[order]
    anchors, candidates = dual_tree.Tree(x[:400], 16), dual_tree.Tree(x, 64)
    bests = dual_tree.Bests(np.full(400, dual_tree.NONE + 1), 5)
    ids = np.arange(4000)

    def score(at, there):
        bests.offer(at, ids[there], products(x[at], x[there]), at[:, None] != ids[there][None, :])

    scored = dual_tree.descend(anchors, candidates, lambda a, b: (float(bests.need[anchors.order[a:b]].min()), float("inf")), score)
    leaves = sum(c < 0 for c in anchors.left) * sum(c < 0 for c in candidates.left)
    assert scored < leaves / 4
    for k in range(0, 400, 7):
        s = products(x[k : k + 1], x)[0]
        assert [(-a, b) for a, b in zip(bests.score[k].tolist(), bests.id[k].tolist(), strict=True)] == sorted((-a, b) for b, a in enumerate(s.tolist()) if b != k)[:5]


def test_intervals_hold_all_products():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = (np.floor(rng.normal(size=(30, 5)) * 300 + rng.normal(size=5) * 900) for _ in range(2))
        ta, tb = dual_tree.Tree(a, 40), dual_tree.Tree(b, 40)
        low, high = dual_tree.interval(ta.centre[:1], ta.radius[:1], tb.centre[:1], tb.radius[:1])
        s = a @ b.T
        assert low[0, 0] <= s.min() and s.max() <= high[0, 0]


def test_registered_queries_agree_with_plain_versions(spark):
    """The thin queries themselves, on the given table."""
    e = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert told(queries.op11_plain_lloyd(spark, DATA)) == plain_lloyd(e, 16, 3, 64, 64)
    assert sorted(tuple(r) for r in queries.op12_norm_buckets(spark, DATA).collect()) == plain_top(e, 50, 5, 256)
    moved = [(i, v, (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in e]
    assert sorted(tuple(r) for r in queries.op13_dual_tree(spark, DATA).collect()) == plain_negatives(moved, 100, 5, 5)


def test_no_task_sorts_all_vectors_of_a_width(spark):
    """Pivots of a width are cut off before the shuffle: a limit of ranks stands below the exchange."""
    from quillstone.llm import permutation_index

    plan = permutation_index.search(table(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [dim" in plan and f", {permutation_index.SAMPLE}, Partial" in plan
