"""Hard negatives by dual-tree search: trees over anchors and over candidates, and bounds for pairs of their nodes.

The inner products of two balls lie in an interval that follows from their centres and radii. A pair of nodes whose
interval ends below what every anchor of the one still needs, or begins above what any may take, is left out at once;
pairs of leaves are scored exactly. The upper levels of both trees are cells, cut across the coordinates that vary most
in a bounded sample: Spark measures their balls over all rows and pairs them; the lower levels are built in the task where
a part of an anchor cell meets a block of a candidate cell.

There are two searches: an anchor's best of its own label, and then, for each of these, the best of other labels whose
scores lie between two shares of its score. Both begin with one block near the anchor, so that they start out with
scores to beat.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.integer_vectors import matrix, products, whole_rows
from quillstone.llm.shared import groups_for, stage

NONE = 1 - (1 << 63)  # below all scores; its negative is a long, too
SLACK = 1e-9
_SCHEMA = pa.schema([("anchor_id", pa.int64()), ("anchor_h", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND = "anchor_id long, anchor_h long, place int, vec_id long, score long"


class Tree:
    """Balls over rows, down to ``leaf`` rows; a node is a stretch of ``order``.

    A ball is cut across the line from a row far from its centre to the row farthest from that: in equal halves, or in
    a wide gap that leaves at least a tenth of its rows on each side, so that trees aren't deep and groups stay whole.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        x = x.astype(np.float64)
        self.order = np.arange(len(x))
        self.start, self.end, self.left, centres, radii = [0], [len(x)], [-1], [], []
        node = 0
        while node < len(self.start):
            a, b = self.start[node], self.end[node]
            own = x[self.order[a:b]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            radius = float(np.sqrt(away.max()))
            centres.append(centre)
            radii.append(radius)
            if b - a > leaf and radius > 0:
                one = own[away.argmax()]
                along = own @ (own[((own - one) ** 2).sum(axis=1).argmax()] - one)
                by = np.argsort(along, kind="stable")
                gaps, least = np.diff(along[by]), max(1, (b - a) // 10)
                mid = least + int(gaps[least - 1 : b - a - least].argmax())
                if gaps[mid - 1] < 0.05 * (along[by[-1]] - along[by[0]]):
                    mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][by]
                self.left[node] = len(self.start)
                self.start += [a, a + mid]
                self.end += [a + mid, b]
                self.left += [-1, -1]
            node += 1
        self.centre, self.radius = np.array(centres), np.array(radii)


def interval(centre: np.ndarray, radius: np.ndarray, other: np.ndarray, other_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that points of each ball of the one and each of the other can have."""
    mid = centre @ other.T
    length, other_length = np.sqrt((centre**2).sum(axis=1)), np.sqrt((other**2).sum(axis=1))
    wide = radius[:, None] * other_length[None, :] + length[:, None] * other_radius[None, :] + radius[:, None] * other_radius[None, :]
    slack = SLACK * (length[:, None] * other_length[None, :] + wide) + SLACK
    return mid - wide - slack, mid + wide + slack


def descend(anchors: Tree, candidates: Tree, needs: Callable[[int, int], tuple[float, float]], score: Callable[[np.ndarray, np.ndarray], None]) -> int:
    """Walk pairs of nodes, the more promising half first; how many pairs of leaves were scored.

    ``needs`` tells of a stretch of anchors the least score that any of them can use, and the greatest. Each leaf of
    anchors begins with the leaf of candidates whose centre has the greatest product with its own, so that all anchors
    have scores to beat before the walk.
    """
    low, high = interval(anchors.centre, anchors.radius, candidates.centre, candidates.radius)
    ends, other_ends = (np.flatnonzero(np.array(t.left) < 0) for t in (anchors, candidates))
    nearest = other_ends[(anchors.centre[ends] @ candidates.centre[other_ends].T).argmax(axis=1)]
    begun = set(zip(ends.tolist(), nearest.tolist(), strict=True))
    for i, j in begun:
        score(anchors.order[anchors.start[i] : anchors.end[i]], candidates.order[candidates.start[j] : candidates.end[j]])
    scored, stack = len(begun), [(0, 0)]
    while stack:
        i, j = stack.pop()
        least, most = needs(anchors.start[i], anchors.end[i])
        if high[i, j] < least or low[i, j] > most:
            continue
        a, c = anchors.left[i], candidates.left[j]
        if a < 0 and c < 0:
            if (i, j) in begun:
                continue
            scored += 1
            score(anchors.order[anchors.start[i] : anchors.end[i]], candidates.order[candidates.start[j] : candidates.end[j]])
        elif c < 0 or a >= 0 and anchors.end[i] - anchors.start[i] > candidates.end[j] - candidates.start[j]:
            stack += [(a, j), (a + 1, j)] if high[a, j] < high[a + 1, j] else [(a + 1, j), (a, j)]
        else:
            stack += [(i, c), (i, c + 1)] if high[i, c] < high[i, c + 1] else [(i, c + 1), (i, c)]
    return scored


class Bests:
    """For each row of a search the ``k`` best found so far, ties to the smaller id, and what a score has to reach."""

    def __init__(self, need: np.ndarray, k: int):
        self.need, self.k = need.copy(), k
        self.score = np.full((len(need), k), NONE, np.int64)
        self.id = np.zeros((len(need), k), np.int64)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        hit = fits & (scores >= self.need[rows][:, None])
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        rows = rows[some]
        s = np.concatenate([self.score[rows], np.where(hit[some], scores[some], NONE)], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, top, axis=1), np.take_along_axis(i, top, axis=1)
        self.need[rows] = np.maximum(self.need[rows], self.score[rows, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.score > NONE)
        return r, self.id[r, c], self.score[r, c]


class Cells:
    """The upper levels of a tree over rows: at most 64 cells, cut by a sample, and blocks of them by a hash.

    The sample, the only one, is the first ``sample`` rows by a hash; it decides which rows share a cell, and nothing
    else: balls are measured over all rows. Rows of another width than the sample's first are cell 0, whose ball is
    everything.
    """

    def __init__(self, rows: DataFrame, per: int, sample: int = 4096, levels: int = 6):
        self.per = per
        count = rows.count()
        self.levels = min(levels, (groups_for(count, per) - 1).bit_length())
        some = rows.select("v").orderBy(F.xxhash64(F.lit(47), "id", "h"), "id", "h").limit(sample).collect() if self.levels else []  # bounded
        self.width = len(some[0]["v"]) if some else -1
        x = np.array([r["v"] for r in some if len(r["v"]) == self.width], np.float64)
        self.cuts: list[tuple[int, float]] = []  # as a heap
        self.centres = np.zeros((1, max(self.width, 0)))
        if self.width > 0:
            parts = [x]
            for _ in range(self.levels):
                halves = []
                for p in parts:
                    f = int(p.var(axis=0).argmax()) if len(p) else 0
                    cut = float(p[:, f].mean()) if len(p) else 0.0
                    if len(p) and not 0.1 <= (p[:, f] <= cut).mean() <= 0.9:
                        cut = float(np.median(p[:, f]))
                    self.cuts.append((f, cut))
                    halves += [p[p[:, f] <= cut], p[p[:, f] > cut]]
                parts = halves
            self.centres = np.array([p.mean(axis=0) if len(p) else x.mean(axis=0) for p in parts])
        self.n_cells = 1 + (len(self.centres) if self.width > 0 else 0)

    def number(self, node: int = 0) -> Column:
        """The cell of ``v``, counted from 1; 0 for other widths."""
        if self.width <= 0:
            return F.lit(0)
        if node >= len(self.cuts):
            return F.lit(node - len(self.cuts) + 1)
        f, cut = self.cuts[node]
        inner = F.when(F.get("v", F.lit(f)) <= cut, self.number(2 * node + 1)).otherwise(self.number(2 * node + 2))
        return F.when(F.size("v") == self.width, inner).otherwise(F.lit(0)) if node == 0 else inner

    def measure(self, rows: DataFrame, need: Column | None = None, most: Column | None = None) -> None:
        """How many rows each cell has, its radius, the least that any of its rows needs and the most that any may take."""
        far = F.lit(0.0)
        if self.width > 0:
            centre = F.element_at(F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in self.centres]), F.greatest(F.col("cell"), F.lit(1)))
            far = F.when(F.col("cell") > 0, F.sqrt(F.aggregate(F.zip_with("v", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d))).otherwise(F.lit(0.0))
        asked = [F.min(F.lit(float("-inf")) if need is None else need.cast("double")).alias("least"), F.max(F.lit(float("inf")) if most is None else most.cast("double")).alias("most")]
        stats = {r["cell"]: r for r in rows.withColumn("cell", self.number()).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(far).alias("radius"), *asked).collect()}
        get = lambda name, none: [stats[c][name] if c in stats and stats[c][name] is not None else none for c in range(self.n_cells)]
        self.count, self.radius, self.least, self.most = get("n", 0), get("radius", 0.0), get("least", float("inf")), get("most", float("-inf"))
        self.size = [groups_for(n, self.per) if n else 0 for n in self.count]
        self.base = [sum(self.size[:c]) for c in range(self.n_cells)]

    def _of(self, values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("cell") + 1)

    def dealt(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows with their cell and their block, counted over all cells."""
        block = self._of(self.base) + F.pmod(F.xxhash64(F.lit(53), "id", "h"), F.greatest(self._of(self.size), F.lit(1)))
        return rows.withColumn("cell", self.number()).withColumn(name, block)

    def blocks(self, reach: list[list[int]]) -> Column:
        """For the cell of a row of the other tree all blocks of the cells it reaches."""
        ranges = [[(self.base[c], self.base[c] + self.size[c] - 1) for c in cells if self.size[c]] for cells in reach]
        pair = "array<array<bigint>>"
        table = F.array(*[F.array(*[F.array(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in own]).cast(pair) for own in ranges])
        return F.flatten(F.transform(F.element_at(table, F.col("cell") + 1), lambda r: F.sequence(r[0], r[1])))


def reached(anchors: Cells, candidates: Cells) -> list[list[int]]:
    """For each cell of anchors the cells of candidates whose interval holds a score that one of its anchors can use."""
    out = [[c for c in range(candidates.n_cells) if candidates.size[c]] if anchors.size[0] else []]
    for g in range(1, anchors.n_cells):
        keep = [0] if candidates.size[0] else []
        if candidates.n_cells > 1 and anchors.size[g]:
            if anchors.width != candidates.width:
                keep += [c for c in range(1, candidates.n_cells) if candidates.size[c]]
            else:
                low, high = interval(anchors.centres[g - 1 : g], np.array(anchors.radius[g : g + 1]), candidates.centres, np.array(candidates.radius[1:]))
                keep += [c + 1 for c in range(len(candidates.centres)) if candidates.size[c + 1] and high[0, c] >= anchors.least[g] and low[0, c] <= anchors.most[g]]
        out.append(keep)
    return out


def _search(rows: DataFrame, anchors: DataFrame, places: int, k: int, inside: Callable, part_rows: int, cells: Cells, tag: str) -> DataFrame:
    """(anchor_id, anchor_h, place, vec_id, score): for each anchor and place the ``k`` best that fit, found twice at most.

    ``anchors`` have arrays ``need`` and ``most`` with a number for each place; ``inside`` tells which scores fit.
    """

    def answer(key: tuple, block: pa.Table, asked: pa.Table) -> pa.Table:
        if block.num_rows == 0 or asked.num_rows == 0:
            return _SCHEMA.empty_table()
        ids, labels, x = np.asarray(block["id"]), np.asarray(block["label"]), matrix(block["v"])
        own, h, own_labels, q = np.asarray(asked["id"]), np.asarray(asked["h"]), np.asarray(asked["label"]), matrix(asked["v"])
        need, most = matrix(asked["need"]).reshape(len(own), places), matrix(asked["most"]).reshape(len(own), places)
        bests = [Bests(need[:, p], k) for p in range(places)]
        for some, others in inside(own_labels, labels):
            tree, other = Tree(q[some], 64), Tree(x[others], 256)
            tree.order, other.order = some[tree.order], others[other.order]
            ceiling = most[tree.order].max(axis=1)

            def needs(a: int, b: int, order=tree.order, ceiling=ceiling) -> tuple[float, float]:
                at = order[a:b]
                return min(float(best.need[at].min()) for best in bests), float(ceiling[a:b].max())

            def score(at: np.ndarray, there: np.ndarray) -> None:
                s = products(q[at], x[there])
                fits = (own[at][:, None] != ids[there][None, :]) & inside.fits(own_labels[at][:, None], labels[there][None, :])
                for p, best in enumerate(bests):
                    best.offer(at, ids[there], s, fits & (s <= most[at, p][:, None]))

            descend(tree, other, needs, score)
        out = []
        for p, best in enumerate(bests):
            r, i, s = best.found()
            out.append(pa.Table.from_arrays([pa.array(own[r]), pa.array(h[r]), pa.array(np.full(len(r), p, np.int32)), pa.array(i), pa.array(s)], schema=_SCHEMA))
        return pa.concat_tables(out)

    keys = ["dim", "part", "block"]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = left.select(*keys, "id", "label", "v"), right.select(*keys, "id", "h", "label", "v", "need", "most")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, FOUND)

    def top(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor_h", "place").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    tree = Cells(anchors, part_rows)
    tree.measure(anchors)
    # one block of the candidates' cell that the anchor lies in: scores to beat
    near = tree.dealt(anchors, "part").withColumn("cell", cells.number()).withColumn("block", cells._of(cells.base)).where(cells._of(cells.size) > 0)
    begin = cells.dealt(rows, "block").where(F.col("block") == cells._of(cells.base))
    begin = begin.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(sum(tree.size) - 1, 0)).cast("long"))))
    begun = stage(meet(begin, near), f"{tag}-begun")
    beaten = begun.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_h").alias("h"), "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    beaten = beaten.where(F.col("n") == k).groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("beat"))  # one for each place
    raised = F.transform("need", lambda x, p: F.greatest(x, F.coalesce(F.try_element_at("beat", p), x)))
    asked = stage(anchors.join(beaten, ["id", "h"], "left").withColumn("need", raised).drop("beat"), f"{tag}-asked")
    tree.measure(asked, F.array_min("need"), F.array_max("most"))
    reach = reached(tree, cells)
    back = [[g for g in range(tree.n_cells) if c in reach[g]] for c in range(cells.n_cells)]
    own_block = cells._of(cells.base)  # of the row's own cell among the candidates', which has been searched
    queries = tree.dealt(asked, "part").withColumn("block", F.explode(cells.blocks(reach))).withColumn("cell", cells.number()).where(F.col("block") != own_block)
    candidates = cells.dealt(rows, "block").withColumn("part", F.explode(tree.blocks(back)))
    return top(begun.unionByName(meet(candidates, queries)))


class _Same:
    """Trees for each label by itself: an anchor meets its own."""

    def __call__(self, anchors: np.ndarray, candidates: np.ndarray):
        for label in np.intersect1d(anchors, candidates):
            yield np.flatnonzero(anchors == label), np.flatnonzero(candidates == label)

    def fits(self, anchor: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        return anchor == candidate


class _Other:
    """One tree for all labels; pairs of leaves leave out the anchor's own."""

    def __call__(self, anchors: np.ndarray, candidates: np.ndarray):
        yield np.arange(len(anchors)), np.arange(len(candidates))

    def fits(self, anchor: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        return anchor != candidate


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_rows: int = 8192, anchor_rows: int = 4096
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, rows whose id is divisible by ``every``.

    Each component becomes ``floor(scale * x)``; scores are inner products of these whole numbers, exact; higher ones
    come first, ties by smaller id. An anchor's positives are its first ``positives`` others of its label (all, if
    there are fewer). For each of them, the first ``negatives`` rows of other labels whose scores s satisfy
    ``low * p <= 100 * s <= high * p`` for the positive's score p are returned, rank from 1; there may be none. Labels
    are whole numbers. Rows with a null id or label, and vectors that are null or hold null or non-finite components
    take no part; vectors meet those of their own width. Repeated rows (same id, label and numbers) count once; an id
    with several vectors or labels is an anchor with each, and none of an anchor's own id is found. Components whose
    products could overflow a long are an error. Other columns are ignored, whatever their names. An empty table gives
    no rows.
    """
    label = F.col(f"`{label_col}`").cast("long").alias("label")
    all_rows = whole_rows(vectors, scale, id_col, vector_col, label).where(F.col("label").isNotNull())
    rows = stage(all_rows.withColumn("h", F.xxhash64(F.lit(59), "h", "label")).withColumn("dim", F.size("v")).drop("n2"), "dual-rows")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    cells = Cells(rows, block_rows)
    cells.measure(rows)
    one = lambda x: F.array(F.lit(x).cast("long"))
    first = asked.withColumns({"need": one(NONE + 1), "most": one((1 << 63) - 1)})
    best = _search(rows, first, 1, positives, _Same(), anchor_rows, cells, "dual-positives")
    best = stage(best.select("anchor_id", "anchor_h", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "dual-positives")
    listed = best.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_h").alias("h")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most ``positives``
    # scores are whole, so shares of a positive's become whole ends; a place without a positive, or with no score between its ends, fits nothing
    share = lambda n, percent: F.get("p", n)["positive_score"].cast("decimal(20,0)") * F.lit(percent).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")
    ends = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda n: F.struct(F.ceil(share(n, low)).cast("long").alias("need"), F.floor(share(n, high)).cast("long").alias("most")))
    none = F.struct(F.lit((1 << 63) - 1).cast("long").alias("need"), F.lit(NONE).cast("long").alias("most"))
    ends = F.transform(ends, lambda e: F.when(e["need"] <= e["most"], e).otherwise(none))
    second = asked.join(listed, ["id", "h"]).withColumn("e", ends).withColumns({"need": F.col("e")["need"], "most": F.col("e")["most"]}).drop("p", "e")
    worst = _search(rows, stage(second, "dual-bands"), positives, negatives, _Other(), anchor_rows, cells, "dual-negatives")
    named = worst.withColumn("place", F.col("place") + 1).join(best, ["anchor_id", "anchor_h", "place"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
