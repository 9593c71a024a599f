"""Substring dedup by recompression.

Each word gets a name, a 64-bit fingerprint of its bytes. In every round, maximal runs of one name and pairs of a
left and a right name get a new name, a fingerprint of what they consist of; a seeded hash deals names to left and
right anew in each round. Names thus agree over the whole corpus without a dictionary. Whether a symbol arises at a
place depends only on the words around it (its reach), so two equal word sequences hold the same symbols wherever
the reach lies inside them. A window that holds a symbol which occurs once in the corpus, reach and all, is thereby
shown to be unique. All other windows are verified: their 128-bit fingerprints are counted over the corpus.

Three steps over groups of documents, each followed by one count of packed fingerprints: symbols, candidate windows,
removal. Only documents with candidates reach the third.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.llm import global_counts as G
from quillstone.llm import words as W
from quillstone.llm.shared import groups_for, stage, text_bytes

TELLING = 3
FAR = np.int64(1) << np.int64(40)  # a reach that leaves its document
_RUN, _LEFT, _RIGHT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def compress(names: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after ``rounds``, their lengths in words, and where the reach of each begins and ends."""
    n = whole = len(names)
    start = np.arange(n, dtype=np.int64)
    left, right = start.copy(), start + 1
    for r in range(rounds):
        if n == 0:
            break
        near = doc[1:] == doc[:-1]
        before, after = np.full(n, -FAR), np.full(n, FAR)
        before[1:][near] = left[:-1][near]
        after[:-1][near] = right[1:][near]
        head = np.ones(n, dtype=bool)
        head[1:] = ~(near & (names[1:] == names[:-1]))
        at = np.flatnonzero(head)
        tail = np.append(at[1:], n) - 1
        base = names[at]
        length = tail - at + 1
        block = np.where(length > 1, W.mix(base * _RUN + length.astype(np.uint64)), base)
        side = (W.mix(base + np.uint64(2 * r + 1)) & np.uint64(1)).astype(bool)  # True: left
        pair = np.zeros(len(at), dtype=bool)
        pair[:-1] = side[:-1] & ~side[1:] & (doc[at[1:]] == doc[at[:-1]])
        second = np.zeros(len(at), dtype=bool)
        second[1:] = pair[:-1]
        k = np.flatnonzero(~second)
        end = np.where(pair[k], k + 1, k)
        made = block[k]
        both = pair[k]
        made[both] = W.mix(block[k[both]] * _LEFT + W.mix(block[end[both]] ^ _RIGHT))
        left, right = before[at[k]], after[tail[end]]
        start, doc, names = start[at[k]], doc[at[k]], made
        n = len(names)
    return names, np.diff(np.append(start, whole)), left, right


class Batch:
    """Words and symbols of the documents of one group."""

    def __init__(self, texts: pa.ChunkedArray, window: int, rounds: int):
        self.data, offsets = W.buffers(texts)
        self.offsets = offsets
        self.s, self.e, self.first = W.word_spans(self.data, offsets)
        self.h = W.word_hashes(self.data, self.s, self.e)
        self.window, self.rounds = window, rounds

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names and reaches of the symbols that lie, reach and all, within some window.

        Symbols of one or two words are shared too often to tell anything; equal symbols have equal lengths.
        """
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        names, length, left, right = compress(self.h, doc, self.rounds)
        ok = (right - left <= self.window) & (length >= TELLING)
        return names[ok], left[ok], right[ok]

    def candidates(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """Starts of the windows that hold no symbol which is known to occur once."""
        at = W.window_starts(self.first, self.window)
        names, left, right = self.symbols()
        known = G.Distinct(names, None, buckets).shared(answers)
        left, right = left[~known], right[~known]
        change = np.zeros(len(self.h) + 2, dtype=np.int32)
        np.add.at(change, np.maximum(right - self.window, 0), 1)
        np.add.at(change, left + 1, -1)
        return at[np.cumsum(change)[at] == 0]

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window, from two word hashes of different keys."""
        lo = W.window_hashes(self.h, at, self.window)
        if len(at) == 0:
            return lo, lo
        use = np.zeros(len(self.h) + 1, dtype=np.int32)
        np.add.at(use, at, 1)
        np.add.at(use, at + self.window, -1)
        use = np.cumsum(use[:-1]) > 0
        other = np.zeros(len(self.h), dtype=np.uint64)
        other[use] = W.word_hashes(self.data, self.s[use], self.e[use], W.SEEDS[1])
        return lo, W.window_hashes(other, at, self.window)

    def removed(self, at: np.ndarray) -> np.ndarray:
        """For each word whether one of the windows at ``at`` covers it."""
        cover = np.zeros(len(self.h) + 1, dtype=np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.window, -1)
        return np.cumsum(cover[:-1]) > 0

    def kept(self, k: int, gone: np.ndarray | None) -> tuple[int, int, bytes]:
        """Words, removed words, and the kept words of document ``k`` joined by one space."""
        words = self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().split()
        if gone is None or not (mask := gone[self.first[k] : self.first[k + 1]]).any():
            return len(words), 0, b" ".join(words)
        return len(words), int(mask.sum()), b" ".join(itertools.compress(words, ~mask))


def _with(schema: T.StructType, more: list) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in more)])


RESULT = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string"}


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, rounds: int = 4, group_bytes: int = 4 << 20, with_text: bool = False
) -> DataFrame:
    """The columns of ``docs`` with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if a window of ``window`` words that covers it starts anywhere else as well, judged on the input.
    Null and empty texts have no words and keep the empty string. Texts shorter than a window lose nothing. Repeated
    rows count as occurrences of their own, so each loses all its windows. Columns of ``docs`` with the names of
    result columns are replaced. An empty table gives an empty table. Ids may be null or repeated.
    """
    if window < 2 or rounds < 1:
        raise ValueError("window must be at least 2 and rounds at least 1")
    clash = [c for c in docs.columns if c in RESULT and c not in (id_col, text_col)]
    docs = docs.drop(*clash)
    carried = list(docs.columns)
    _, n_bytes = text_bytes(docs, text_col)
    groups, buckets = groups_for(n_bytes, group_bytes), groups_for(n_bytes, 6 * group_bytes)
    # neutral names inside: whatever the columns are called, nothing clashes
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    text = f"c{carried.index(text_col)}"
    named = named.withColumn("grp", F.pmod(F.xxhash64(F.lit(7), F.col(f"c{carried.index(id_col)}"), F.col(text)), F.lit(groups)))

    inner = list(named.columns)

    def symbols(key: tuple, table: pa.Table) -> pa.Table:
        names, _, _ = Batch(table[text], window, rounds).symbols()
        return G.sent_table(G.Distinct(names, None, buckets).rows(key[0].as_py()))

    # the same columns as below, so that both steps read one shuffle of the documents
    shared = G.shared(named.groupBy("grp").applyInArrow(symbols, G.SENT))

    # one table for the three kinds of row of the second step: done, pending, sent
    sent = T.StructType([T.StructField("bucket", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("lo", "hi", "multi")])
    done = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.BinaryType())]
    kinds = _with(named.schema, [("kind", T.IntegerType()), ("sent", sent), *done, ("at", T.BinaryType())])
    arrow = to_arrow_schema(kinds)

    def windows(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table[text], window, rounds)
        at = batch.candidates(answers, buckets)
        lo, hi = batch.fingerprints(at)
        owner = np.searchsorted(batch.first, at, side="right") - 1
        pending = np.zeros(len(table), dtype=bool)
        pending[owner] = True
        n_words, kept, starts = [], [], []
        cuts = np.searchsorted(owner, np.arange(len(table) + 1))
        for k in range(len(table)):
            if pending[k]:
                n_words.append(None)
                kept.append(None)
                starts.append(_runs(at[cuts[k] : cuts[k + 1]] - batch.first[k]))
            else:
                n, _, joined = batch.kept(k, None)
                n_words.append(n)
                kept.append(joined if with_text else hashlib.sha256(joined).hexdigest().encode())
                starts.append(None)
        rows = len(table)
        columns = {c: table[c] for c in inner}
        if not with_text:  # a text that is done is not needed again
            columns[text] = pa.array([t if p else None for t, p in zip(table[text].to_pylist(), pending, strict=True)], pa.string())
        columns |= {"kind": pa.array(pending.astype(np.int32)), "sent": pa.nulls(rows, arrow.field("sent").type), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(np.where(pending, None, 0).tolist(), pa.int64()), "kept": pa.array(kept, pa.binary()), "at": pa.array(starts, pa.binary())}
        out = pa.Table.from_arrays([_as(columns[f.name], f.type) for f in arrow], schema=arrow)
        rows = G.Distinct(lo, hi, buckets).rows(key[0].as_py())
        if rows:
            grp = [r.pop("grp") for r in rows]
            more = {"grp": pa.array(grp, pa.int64()), "kind": pa.array([2] * len(rows), pa.int32()), "sent": pa.array(rows, arrow.field("sent").type)}
            out = pa.concat_tables([out, pa.Table.from_arrays([_as(more.get(f.name, pa.nulls(len(rows), f.type)), f.type) for f in arrow], schema=arrow)])
        return out

    second = stage(named.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_whole(windows, arrow), kinds), "substring-windows")
    repeated = G.shared(second.filter("kind = 2").select("grp", "sent.*"))
    result = _with(named.schema, done)
    arrow_result = to_arrow_schema(result)

    def remove(_key, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table[text], window, 1)
        starts = [_unrun(x) for x in table["at"].to_pylist()]
        at = np.concatenate([x + batch.first[k] for k, x in enumerate(starts)]) if starts else np.zeros(0, np.int64)
        lo, hi = batch.fingerprints(at)
        hit = G.Distinct(lo, hi, buckets).shared(answers)
        gone = batch.removed(at[hit])
        out = [batch.kept(k, gone) for k in range(len(table))]
        columns = {c: table[c] for c in inner}
        columns |= {"n_words": pa.array([n for n, _, _ in out], pa.int64()), "n_removed": pa.array([m for _, m, _ in out], pa.int64())}
        columns["kept"] = pa.array([t if with_text else hashlib.sha256(t).hexdigest().encode() for _, _, t in out], pa.binary())
        return pa.Table.from_arrays([_as(columns[f.name], f.type) for f in arrow_result], schema=arrow_result)

    fields = [*inner, "n_words", "n_removed", "kept"]
    pending = second.filter("kind = 1").select(*inner, "at")
    third = pending.groupBy("grp").cogroup(repeated.groupBy("grp")).applyInArrow(_whole(remove, arrow_result), result)
    both = second.filter("kind = 0").select(*fields).unionByName(third.select(*fields))
    kept = F.col("kept")
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(carried) if with_text or c != text_col]
    out += [F.col("n_words"), F.col("n_removed"), (F.sha2(kept, 256) if with_text else kept.cast("string")).alias("kept_sha256")]
    if with_text:
        out.append(kept.cast("string").alias("kept_text"))
    return both.select(*out)


def _runs(at: np.ndarray) -> bytes:
    """Rising numbers as (first, count) of the runs in which they follow each other."""
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    return np.stack([at[first], np.diff(np.append(first, len(at)))], axis=1).astype(np.int64).tobytes()


def _unrun(data: bytes) -> np.ndarray:
    runs = np.frombuffer(data, np.int64).reshape(-1, 2)
    skip = runs[:, 0] - np.concatenate(([0], np.cumsum(runs[:, 1])[:-1]))
    return np.arange(int(runs[:, 1].sum())) + np.repeat(skip, runs[:, 1])


def _as(column, kind: pa.DataType):
    column = column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column])
    return column if column.type == kind else column.cast(kind)


def _whole(step, schema: pa.Schema):
    """Answers without a group of documents (there are none, in practice) give nothing."""

    def run(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        made = step(key, table, answers)
        pa.default_memory_pool().release_unused()  # of the groups before
        return made

    return run
