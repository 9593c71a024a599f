"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole sequences and near-equal pieces of what is left over. The pieces are dealt into
groups by a hash. In a group, every piece starts as a partial partition with one window filled; the two partial
partitions of largest imbalance are merged again and again, the fullest window of one with the emptiest of the
other, until one partition of near-equal windows is left. If a window exceeds the capacity, the count of windows
rises and the group is partitioned anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import groups_for, stage
from quillstone.llm.token_ids import encoder


def cut(n: int, capacity: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole sequences, then near-equal pieces up to ``most``."""
    whole = n // capacity
    out = [(k * capacity, capacity) for k in range(whole)]
    rest, at = n - whole * capacity, whole * capacity
    if rest:
        parts = -(-rest // most)
        edges = [at + rest * k // parts for k in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by largest differencing over ``windows`` windows."""
    n = len(sizes)
    window = np.zeros(n, dtype=np.int64)
    if windows == 1 or n == 0:
        return window
    order = np.argsort(-sizes, kind="stable")
    # a partial partition: sums in falling order, and for each window a tree of sizes (-1: none)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    made = n
    sums = {}
    heap = []
    for rank, i in enumerate(order):
        heap.append((-int(sizes[i]), rank))
        sums[rank] = (np.array([sizes[i]], np.int64), np.array([i], np.int64))  # windows beyond are empty
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (x, p), (y, q) = sums.pop(a), sums.pop(b)
        if len(x) + len(y) <= windows:  # no window of one needs a filled window of the other
            total, tree = np.concatenate((x, y)), np.concatenate((p, q))
        else:
            if len(x) < len(y):
                x, p, y, q = y, q, x, p
            total, tree = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
            total[: len(x)], tree[: len(x)] = x, p
            k = len(y)
            at = np.arange(windows - 1, windows - 1 - k, -1)
            total[at] += y
            both = tree[at] >= 0
            new = np.arange(made, made + int(both.sum()))
            left[new], right[new] = tree[at[both]], q[both]
            tree[at] = q
            tree[at[both]] = new
            made += len(new)
        down = np.argsort(-total, kind="stable")
        total, tree = total[down], tree[down]
        sums[fresh] = (total, tree)
        low = total[-1] if len(total) == windows else 0
        heapq.heappush(heap, (-int(total[0] - low), fresh))
        fresh += 1
    total, tree = sums[heap[0][1]]
    for w, t in enumerate(tree):
        todo = [int(t)] if t >= 0 else []
        while todo:
            t = todo.pop()
            if t < n:
                window[t] = w
            else:
                todo += (int(left[t]), int(right[t]))
    return window


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size such that none holds more than ``capacity``. Sizes up to ``capacity``."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        over = np.bincount(window, sizes, minlength=windows)
        if over.max() <= capacity:
            return window
        windows += 1


PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, capacity: int, most: int, with_ids: bool = False, width: int = 4, forget: bool = False) -> DataFrame:
    """One row per piece of every document, with the ids themselves if asked for (little-endian unsigned, ``width`` bytes)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, rows, held = [], [], []
                for k, ids in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start, length in cut(n, capacity, most):
                        piece = ids[4 * start : 4 * (start + length)]
                        owner.append(k)
                        rows.append((start, length, zlib.crc32(piece), n))
                        if with_ids:
                            held.append(piece if width == 4 else np.frombuffer(piece, "<u4").astype("<u2").tobytes())
                columns = [part.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(held, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if forget:
            enc.forget()
            pa.default_memory_pool().release_unused()

    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, PIECES.format(kind=kind) + ", ids binary" * with_ids)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, most: int = 512, group_pieces: int = 512, with_ids: bool = False, width: int = 4, forget: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row for each piece.

    Every id of every document, its end id included, lies in one piece; a sequence holds at most ``capacity`` ids and
    its pieces stand at offsets without gaps. sequence_id runs without gaps from 0. Null and empty texts have their
    end id alone. Repeated rows and null ids are packed like any others; other columns are ignored. An empty table
    gives no rows. With ``with_ids`` each piece has its ids, ``width`` bytes each: two are enough for a vocabulary of
    up to 65,536 ids, and anything larger is refused then. ids_crc32 is of four bytes each in any case. With
    ``forget`` workers let go of their kept words at a task's end: about 100 MB less for each, for a tenth more time.
    """
    if width not in (2, 4) or (width == 2 and max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) >= 1 << 16):
        raise ValueError("ids don't fit into this width")
    if not 0 < most <= capacity:
        raise ValueError("pieces must fit into a sequence")
    named = pieces(docs, tokenizer, id_col, text_col, end_id, capacity, most, with_ids, width, forget)
    # a written row number deals pieces evenly, however many of them are alike
    made = stage(named.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    count = made.count()
    groups = groups_for(count, group_pieces)
    # whole sequences are windows already; they are dealt too, so that they get their numbers
    dealt = made.withColumn("grp", F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(groups)))

    def place(key: tuple, table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=list(zip(*(table[c].to_pylist() for c in ("ids_crc32", "start", "length")), strict=True)).__getitem__)
        table = table.take(pa.array(order, pa.int64()))
        length = np.asarray(table["length"])
        window = np.empty(len(length), dtype=np.int64)
        part = length < capacity
        window[part] = pack_sizes(length[part], capacity)
        first = int(window[part].max()) + 1 if part.any() else 0
        window[~part] = first + np.arange(int((~part).sum()))
        by = np.argsort(window, kind="stable")
        at = np.cumsum(length[by]) - length[by]
        begin = np.flatnonzero(np.diff(window[by], prepend=-1))
        offset = np.empty(len(length), dtype=np.int64)
        offset[by] = at - np.repeat(at[begin], np.diff(np.append(begin, len(by))))
        for name, values in (("window", window), ("offset", offset)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    names = list(named.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", window long, offset long"
    placed = stage(dealt.groupBy("grp").applyInArrow(place, schema), "packing-windows")
    bases = first_numbers(placed.groupBy("grp").agg((F.max("window") + 1).alias("n")))
    out = placed.join(bases, "grp")
    return out.select(*[c for c in names if c != "ids"], (F.col("base") + F.col("window")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))


def first_numbers(counts: DataFrame, block: int = 4096) -> DataFrame:
    """(grp, base) where base is the sum of ``n`` over smaller groups: sums within blocks, and of whole blocks."""
    from pyspark.sql import Window

    counts = stage(counts.withColumn("block", F.floor(F.col("grp") / block)), "first-numbers")
    within = Window.partitionBy("block").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each block of 4096 groups
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inner = counts.select("grp", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside"))
    return inner.join(blocks, "block").select("grp", (F.col("before") + F.col("inside")).alias("base"))
