"""N-gram Jaccard join by MinHash banding.

1. Each text becomes a sketch of ``bands * rows`` MinHash values over its word n-grams. Texts with equal n-grams are
   copies; one of them stands for all.
2. Sketches are shuffled by the hash of each band, those alone in a band left out. A band's bucket of many sketches is
   cut into tiles, so that no task takes it whole. In a tile, pairs are kept whose sketches agree well enough that a
   similar pair is lost once in millions, each pair only in its first common band. Kept pairs travel packed, by the
   pair of blocks that their texts belong to; no row is made for a pair.
3. The n-gram sets of texts with a partner meet at their pairs of blocks, once each, and every pair is verified on
   the full sets. What leaves is linear in the texts: links counted for each, and a forest of their components.

Band and row counts follow from the similarity and the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import global_counts as G
from quillstone.llm import words as W
from quillstone.llm.shared import drop, groups_for, stage

#: Texts of one block that meet in a task, at most about so many.
BLOCK_TEXTS = 600
#: Standard deviations that a sketch may lie below the similarity.
SLACK = 5.5
#: Sketches of one bucket that a tile's side holds, and how many buckets at most count as hot: 16 bytes each are broadcast.
TILE, HOT_BUCKETS = 4096, 1 << 18
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def bands_for(similarity: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): as many rows as the target recall at ``similarity`` allows with at most ``most`` values."""
    if not 0 < similarity < 1 or not 0 < recall < 1:
        raise ValueError("similarity and recall lie between 0 and 1")
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngrams(texts: pa.Array, width: int, seeds: tuple[int, ...] = W.SEEDS[:1]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the word n-grams of all texts, one array for each seed, and where those of each text begin.

    They stand with repeats, in order. A text of fewer words than ``width`` has one n-gram, all its words; one without
    words has none.
    """
    data, offsets = W.buffers(texts)
    s, e, first = W.word_spans(data, offsets)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    at = W.window_starts(first, width)
    owner = np.searchsorted(first, at, side="right") - 1
    place = begin[owner] + at - first[owner]
    few = np.flatnonzero((n > 0) & (n < width))
    made = []
    for seed in seeds:
        words = W.word_hashes(data, s, e, seed)
        out = np.empty(int(begin[-1]), dtype=np.uint64)
        out[place] = W.window_hashes(words, at, width)
        for size in range(1, width):
            rows = few[n[few] == size]
            out[begin[rows]] = W.window_hashes(words, first[rows], size)
        made.append(out)
    return made, begin


def text_keys(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams, where those of each text begin, and a 128-bit key of each text's n-grams, repeats counted.

    The halves of a key are sums over hashes of different seeds, so equal keys mean equal n-grams.
    """
    (grams, others), begin = ngrams(texts, width, W.SEEDS)
    keys = np.zeros(len(begin) - 1, dtype=_KEY)
    has = np.flatnonzero(np.diff(begin))
    if len(has):
        keys["a"][has] = np.add.reduceat(W.mix(grams), begin[has])
        keys["b"][has] = np.add.reduceat(W.mix(others), begin[has])
    return grams, begin, keys


def _seeds(values: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(101)
    return r.integers(0, 1 << 32, values, dtype=np.uint32), r.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1)


def sketches(grams: np.ndarray, begin: np.ndarray, values: int) -> np.ndarray:
    """The low 16 bits of ``values`` MinHash values of each text; texts must have n-grams."""
    out = np.empty((len(begin) - 1, values), dtype=np.uint16)
    xor, times = _seeds(values)
    at = 0
    while at < len(begin) - 1:  # about 64k n-grams at a time stay in the cache
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + (1 << 16), side="right")) - 1)
        h = (grams[begin[at] : begin[to]] >> np.uint64(32)).astype(np.uint32)
        cuts = begin[at:to] - begin[at]
        work = np.empty_like(h)
        for k in range(values):
            np.bitwise_xor(h, xor[k], out=work)
            np.multiply(work, times[k], out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            out[at:to, k] = np.minimum.reduceat(work, cuts) & np.uint32(0xFFFF)
        at = to
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), (len(sketch), bands)).copy()
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = W.mix(key ^ parts[:, :, r]) + np.uint64(r)
    return key


def _keys(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_KEY)


def _block(sketch0: np.ndarray, keys: np.ndarray, blocks: int, parts: int) -> np.ndarray:
    """Texts that share a MinHash value share one of ``blocks``, cut into ``parts`` so that none grows beyond memory.

    A text meets at most as many blocks as there are, and as its partners have such values.
    """
    return W.mix(W.mix(sketch0.astype(np.uint64)) % np.uint64(blocks) * np.uint64(1 << 20) + keys["a"] % np.uint64(parts))


def _meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    low, high = np.minimum(x, y), np.maximum(x, y)
    return W.mix(low ^ W.mix(high)).astype(np.int64)


def _bucket_pairs(table: pa.Table, bands: int, rows: int, least: float, blocks: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(meeting, key, key) of the pairs that stay, some ten thousand looked at a time."""
    keys = _keys(table["key"])
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(len(keys), -1)
    band, bucket, tile_i, tile_j, side = (np.asarray(table[c]) for c in ("band", "bandkey", "tile_i", "tile_j", "side"))
    order = np.lexsort((keys["b"], keys["a"], side, tile_j, tile_i, bucket))
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for column in (bucket, tile_i, tile_j):
        new[1:] |= np.diff(column[order]) != 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    block = _block(sketch[:, 0], keys, blocks, parts)
    # in a tile of one side, a row meets all after it; else those of the first side meet those of the second
    at_ = np.arange(len(order))
    last = np.repeat(start + size, size)
    edge = np.repeat(start + np.add.reduceat(side[order] == tile_i[order], start, dtype=np.int64), size)
    whole = (tile_i == tile_j)[order]
    begin = np.where(whole, at_ + 1, edge)
    partners = np.where(whole | (at_ < edge), last - begin, 0)
    ends = np.cumsum(partners)
    at = 0
    while at < len(order):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + 40_000, side="right")))
        for lo in range(0, int(ends[to - 1] - done), 80_000):  # one row may have more partners than that
            n = partners[at:to]
            total = int(n.sum())
            i = np.repeat(np.arange(at, to), n)[lo : lo + 80_000]
            j = begin[i] + (np.arange(total) - np.repeat(np.cumsum(n) - n, n))[lo : lo + 80_000]
            x, y = order[i], order[j]
            same = sketch[x] == sketch[y]
            ok = same.mean(axis=1) >= least
            x, y, same = x[ok], y[ok], same[ok]
            if len(x) == 0:
                continue
            shared = same[:, : bands * rows].reshape(len(x), bands, rows).all(axis=2)
            first = (shared.argmax(axis=1) == band[x]) & (shared.any(axis=1)) & (keys[x] != keys[y])
            x, y = x[first], y[first]
            if len(x):
                yield _meeting(block[x], block[y]), keys[x], keys[y]
        at = to


def _verify(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets reach the Jaccard similarity; texts are marked one after another, partners summed at once."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    order = np.argsort(x, kind="stable")
    good = np.zeros(len(x), dtype=bool)
    cuts = np.flatnonzero(np.diff(x[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        k = x[order[a]]
        own = ids[begin[k] : begin[k + 1]]
        mark[own] = True
        for c in range(a, b, 512):
            rows = order[c : min(c + 512, b)]
            n = size[y[rows]]
            skip = np.repeat(begin[y[rows]] - (np.cumsum(n) - n), n)
            hit = mark[ids[np.arange(int(n.sum())) + skip]]
            common = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            good[rows] = common >= similarity * (size[k] + n - common) - 1e-9
        mark[own] = False
    return good


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` its root, the least of its component."""
    parent = np.arange(n)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(n)], dtype=np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(key, root) of every key in ``edges`` (columns u, v), root the least key of its component.

    Alternating large and small stars; each round is written to the shared folder.
    """
    e = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        done, e = e, stage(small.select("x.u", "x.v").where("u != v").distinct(), "stars")
        drop(done)
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("key"), F.col("v").alias("root"))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.99999, group_texts: int = 4096
) -> DataFrame:
    """(id, class_id, copy_id, n_links) for every row of ``docs``.

    copy_id: the least id of the texts with the same word n-grams. n_links: how many other such texts have a Jaccard
    similarity of at least ``similarity``; copies aren't counted. class_id: the least id of all texts that such links
    connect. Texts without words (null, empty, spaces) are alone. Rows with a null id take part like any other, but
    give no id to a class: a class of null ids alone has a null class_id. Repeated rows are copies. Other columns are
    ignored. An empty table gives no rows.
    """
    bands, rows = bands_for(similarity, recall)
    values = bands * rows
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / values)
    text = F.col(f"`{text_col}`").cast("string")
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams, begin, keys = text_keys(part.column(2), width)
                has = np.flatnonzero(np.diff(begin))
                key, sketch = [None] * part.num_rows, [None] * part.num_rows
                if len(has):
                    s = sketches(grams, np.append(begin[has], begin[-1]), values)
                    for i, k in enumerate(has):
                        key[k] = keys[k].tobytes()
                        sketch[k] = s[i].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], names=["id", "h", "key", "sketch"])
        pa.default_memory_pool().release_unused()

    sketch = stage(plain.mapInArrow(sketched, f"id {id_type}, h long, key binary, sketch binary"), "ngram-sketches")
    # equal keys have equal sketches, so that any will do; any row of a copy has its text
    copies = stage(sketch.where("key is not null").groupBy("key").agg(F.min("id").alias("copy_id"), F.min(F.struct("id", "h")).alias("row"), F.min("sketch").alias("sketch")), "ngram-copies")
    count = copies.count()
    hottest = copies.groupBy(F.substring("sketch", 1, 2).alias("s")).count().agg(F.max("count")).first()[0] or 1
    blocks, parts = groups_for(count, BLOCK_TEXTS), groups_for(hottest, BLOCK_TEXTS)
    groups, buckets = groups_for(count, group_texts), groups_for(count * bands * 8, 16 << 20)
    dealt = copies.select("key", "sketch", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("grp"))

    def all_bands(key: tuple, table: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(table.num_rows, values)
        return G.sent_table(G.Distinct(band_keys(s, bands, rows).ravel(), None, buckets).rows(key[0].as_py()))

    shared = G.shared(dealt.groupBy("grp").applyInArrow(all_bands, G.SENT))
    entry_schema = pa.schema([("band", pa.int64()), ("bandkey", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])
    pair_buckets = groups_for(count * bands, 1 << 18)

    def entries(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return entry_schema.empty_table()
        s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(table.num_rows, values)
        keys = band_keys(s, bands, rows).ravel()
        at = np.flatnonzero(G.Distinct(keys, None, buckets).shared(answers))
        owner = pa.array(at // bands, pa.int64())
        columns = [pa.chunked_array([pa.array(at % bands)]), pa.chunked_array([pa.array(keys[at].view(np.int64))]), table["key"].take(owner), table["sketch"].take(owner)]
        return pa.Table.from_arrays(columns, schema=entry_schema)

    found_entries = stage(dealt.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(entries, "band long, bandkey long, key binary, sketch binary"), "ngram-entries")
    sizes = found_entries.groupBy("bandkey").agg(F.count(F.lit(1)).alias("n"))
    # at most HOT_BUCKETS rows pass this bound, whatever the corpus is
    over = max(TILE, -(-found_entries.count() // HOT_BUCKETS))
    spread = found_entries.join(F.broadcast(sizes.where(F.col("n") > over)), "bandkey", "left").withColumn("sides", F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int"))
    spread = spread.withColumn("side", F.pmod(F.xxhash64("key"), F.col("sides")).cast("int"))
    tile = lambda j: F.struct(F.least("side", j).alias("tile_i"), F.greatest("side", j).alias("tile_j"))
    tiles = spread.select("band", "bandkey", "key", "sketch", "side", F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), tile)).alias("t"))
    bucketed = tiles.select("band", "bandkey", "key", "sketch", "side", "t.*").withColumn("bucket", F.pmod(F.xxhash64("bandkey", "tile_i", "tile_j"), F.lit(pair_buckets)))
    pair_schema = pa.schema([("meet", pa.int64()), ("pairs", pa.binary())])

    def pairs(_key: tuple, table: pa.Table) -> pa.Table:
        meet, packed = [], []
        for at, x, y in _bucket_pairs(table, bands, rows, least, blocks, parts):
            order = np.argsort(at, kind="stable")
            at, both = at[order], np.stack([x[order], y[order]], axis=1)
            cuts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
            for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                meet.append(int(at[a]))
                packed.append(both[a:b].tobytes())
        return pa.Table.from_arrays([pa.array(meet, pa.int64()), pa.array(packed, pa.binary())], schema=pair_schema)

    met = stage(bucketed.groupBy("bucket").applyInArrow(pairs, "meet long, pairs binary"), "ngram-pairs")
    drop(found_entries)

    def who(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.unique(_keys(table["pairs"]))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(keys), pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["meet", "key"])

    wanted = stage(met.groupBy("meet").applyInArrow(who, "meet long, key binary"), "ngram-meetings")
    # one text for each key, by the id and the text's hash of one of its rows; the key is computed again to be sure
    chosen = copies.join(wanted.select("key").distinct(), "key").select(F.col("key").alias("want"), F.col("row.id").alias("id"), F.col("row.h").alias("h"))
    # a merge join at every size: which texts have partners grows with the corpus
    texts = plain.join(chosen.hint("merge"), (plain["h"] == chosen["h"]) & plain["id"].eqNullSafe(chosen["id"])).select("want", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams, begin, keys = text_keys(part.column(1), width)
                same = [k for k, want in enumerate(part.column(0).to_pylist()) if keys[k].tobytes() == want]
                held = [np.unique(grams[begin[k] : begin[k + 1]]).tobytes() for k in same]
                yield pa.RecordBatch.from_arrays([pa.array([keys[k].tobytes() for k in same], pa.binary()), pa.array(held, pa.binary())], names=["key", "grams"])

    found = texts.mapInArrow(sets, "key binary, grams binary").dropDuplicates(["key"])
    there = wanted.join(found, "key")
    link_schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("root", pa.binary())])

    def links(_key: tuple, table: pa.Table, texts_: pa.Table) -> pa.Table:
        if table.num_rows == 0 or texts_.num_rows == 0:
            return link_schema.empty_table()
        have = _keys(texts_["key"])
        order = np.argsort(have)
        have = have[order]
        raw = texts_["grams"].to_pylist()
        held = [np.frombuffer(raw[k], np.uint64) for k in order]
        both = _keys(table["pairs"]).reshape(-1, 2)
        x, y = np.searchsorted(have, both[:, 0]), np.searchsorted(have, both[:, 1])
        good = _verify(held, x, y, similarity)
        x, y = x[good], y[good]
        n = np.bincount(x, minlength=len(have)) + np.bincount(y, minlength=len(have))
        root = _forest(len(have), x, y)
        some = np.flatnonzero(n)
        return pa.Table.from_arrays([pa.array([have[k].tobytes() for k in some], pa.binary()), pa.array(n[some], pa.int64()), pa.array([have[root[k]].tobytes() for k in some], pa.binary())], schema=link_schema)

    linked = stage(met.groupBy("meet").cogroup(there.groupBy("meet")).applyInArrow(links, "key binary, n long, root binary"), "ngram-links")
    drop(met, wanted)
    roots = components(linked.select(F.col("key").alias("u"), F.col("root").alias("v")))
    counted = linked.groupBy("key").agg(F.sum("n").alias("n_links"))
    known = copies.select("key", "copy_id").join(counted, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = known.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = known.join(least_id, "root").select("key", "class_id", "copy_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    with_key = sketch.where("key is not null").select("id", "key").join(known, "key").select("id", "class_id", "copy_id", "n_links")
    alone = sketch.where("key is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return with_key.unionByName(alone).withColumnRenamed("id", id_col)
