"""Token ids as sorted-string-table shards.

A shard holds documents in order of their keys:

    block*  index  bloom  footer

* block: entries ``shared u32 | suffix u32 | value u32 | key suffix | value``, the key without what it shares with
  the key before it (nothing at a block's start), then crc32 of all that. A value is the ids, 2 bytes each if every
  id of the shard fits, else 4.
* index: for each block ``offset u64 | size u32 | documents u32 | ids u64 | key length u32 | last key``.
* bloom: ``bits u64 | hashes u32 | bytes``.
* footer, of fixed size: magic, version, width of an id, documents, ids, places of index and bloom, crc32 of both.

Keys are big-endian with the sign bit turned for integers, so that their bytes sort as numbers do, and UTF-8 for
strings. A null key is the empty one, before all others. Equal keys stand next to each other.

A manifest, itself a written table, has a row for each shard: its place in the order of keys, first and last key,
documents and ids. A lookup asks it for the shards whose range holds the key.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.packing import first_numbers
from quillstone.llm.shared import fresh, groups_for, open_shared, rename_shared, stage, text_bytes
from quillstone.llm.token_ids import encoder

MAGIC, VERSION = b"QSSSTv02", 2
FOOTER = struct.Struct("<8sIIQQQQQQI")
ENTRY = struct.Struct("<III")
BLOCK = struct.Struct("<QIIQI")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 32 << 10, 10, 7


def key_of(value: int | str | None) -> bytes:
    if value is None:
        return b""
    if isinstance(value, str):
        return b"\x01" + value.encode()
    return b"\x01" + struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1))


def value_of(key: bytes, string: bool) -> int | str | None:
    if not key:
        return None
    return key[1:].decode() if string else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % (1 << 64) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in order. Memory: one block, the index and the keys' Bloom places."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._new()

    def _new(self) -> None:
        self.block, self.last, self.block_docs, self.block_ids = io.BytesIO(), b"", 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        if self.docs and key < self.keys[-1]:
            raise ValueError("keys must come in order")
        shared = 0
        if self.block_docs:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        suffix = key[shared:]
        value = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        self.block.write(ENTRY.pack(shared, len(suffix), len(value)) + suffix + value)
        n = len(ids) // 4
        self.last, self.block_docs, self.block_ids = key, self.block_docs + 1, self.block_ids + n
        self.keys.append(key)
        self.docs, self.ids = self.docs + 1, self.ids + n
        if self.block.tell() >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block_docs:
            data = self.block.getvalue()
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append(BLOCK.pack(self.at, len(data), self.block_docs, self.block_ids, len(self.last)) + self.last)
            self.at += len(data)
            self._new()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<QI", bits, BLOOM_HASHES) + bytes(bloom)
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(MAGIC, VERSION, self.width, self.docs, self.ids, self.at, len(index), self.at + len(index), len(bloom), zlib.crc32(bloom, zlib.crc32(index))))


class Reader:
    """Reads one shard: all of it in order, or one key by Bloom filter, binary search in the index, and one block."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        if end < FOOTER.size:
            raise ValueError("not a shard")
        source.seek(end - FOOTER.size)
        magic, version, self.width, self.docs, self.ids, ia, il, ba, bl, crc = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard")
        source.seek(ia)
        index, bloom = source.read(il), source.read(bl)
        if ba != ia + il or zlib.crc32(bloom, zlib.crc32(index)) != crc:
            raise ValueError("damaged index or filter")
        self.blocks, at = [], 0
        while at < len(index):
            offset, size, docs, ids, n = BLOCK.unpack_from(index, at)
            at += BLOCK.size
            self.blocks.append((index[at : at + n], offset, size, docs, ids))
            at += n
        self.bits, _ = struct.unpack_from("<QI", bloom)
        self.bloom = bloom[12:]

    def _entries(self, offset: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        self.source.seek(offset)
        data = self.source.read(size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < size - 4:
            shared, suffix, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + suffix]
            at += suffix
            value = data[at : at + n]
            at += n
            yield key, np.frombuffer(value, "<u2").astype("<u4").tobytes() if self.width == 2 else value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, size, _, _ in self.blocks:
            yield from self._entries(offset, size)

    def get(self, key: bytes) -> bytes | None:
        """The ids of the first document with this key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, self.bits)):
            return None
        k = bisect.bisect_left(self.blocks, key, key=lambda b: b[0])
        if k < len(self.blocks):
            for found, ids in self._entries(*self.blocks[k][1:3]):
                if found == key:
                    return ids
        return None


MANIFEST = "grp long, first binary, last binary, file string, docs long, ids long"


def write(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encode every text, append ``end_id``, write shards in order of the keys; the manifest, a row for each shard.

    Keys are integers or strings of any length. Null and empty texts have their end id alone; null keys come first;
    repeated keys are kept, in order of a hash of their texts, and may fill several shards, however many they are.
    Other columns are ignored, whatever their names. An empty table gives no shards. A file gets its name when it is
    whole, and a task that runs again writes another file, so lost executors leave nothing that is read.
    """
    spark = docs.sparkSession
    path = path or fresh(spark, "sstable")
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if not isinstance(plain.schema["id"].dataType, (T.IntegralType, T.StringType)):
        raise TypeError("keys are integers or strings")
    _, n_bytes = text_bytes(plain, "text")
    end = int(end_id).to_bytes(4, "little")
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, writer = encoder(tokenizer), None, None
        first = b""
        unfinished, name = "", ""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    key = key_of(key)
                    if writer is None:
                        name = f"{path}/{uuid.uuid4().hex}.sst"
                        unfinished = f"{name}.unfinished"
                        out = open_shared(unfinished, "wb")
                        writer, first = Writer(out, width), key
                    writer.add(key, ids + end)
        if writer is not None:
            last = writer.keys[-1]
            writer.close()
            out.close()
            rename_shared(unfinished, name)
            grp = TaskContext.get().partitionId()  # ranges of keys in order
            yield pa.RecordBatch.from_pydict({"grp": pa.array([grp], pa.int64()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary()), "file": [name], "docs": [writer.docs], "ids": [writer.ids]})

    # a range may begin among rows of one key, and among equal rows
    keyed = plain.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["id", "h", "row"]
    ranged = keyed.repartitionByRange(groups_for(n_bytes, shard_bytes), *order).sortWithinPartitions(*order).select("id", "text")
    return stage(ranged.mapInArrow(run, MANIFEST), "sstable-manifest")


def read(spark: SparkSession, manifest: DataFrame, id_type: T.DataType | None = None, id_col: str = "doc_id", with_ids: bool = False, tasks: int = 4096) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, from the shards' bytes; start counts over all shards."""
    id_type = id_type or T.LongType()
    string = isinstance(id_type, T.StringType)
    kind = pa.string() if string else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, rows, held = [], [], []

                def full() -> pa.RecordBatch:
                    columns = [pa.array(keys, kind), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3))]
                    if with_ids:
                        columns.append(pa.array(held, pa.binary()))
                    return pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

                with open_shared(file, "rb") as source:
                    for key, ids in Reader(source):
                        keys.append(value_of(key, string))
                        rows.append((start, len(ids) // 4, zlib.crc32(ids)))
                        if with_ids:
                            held.append(ids)
                        start += len(ids) // 4
                        if len(keys) == 4096:
                            yield full()
                            keys, rows, held = [], [], []
                if keys:
                    yield full()

    bases = first_numbers(manifest.select("grp", F.col("ids").alias("n")))
    listed = manifest.join(bases, "grp").select("file", F.col("base").alias("start")).repartition(max(1, min(manifest.count(), tasks)))
    schema = f"id {'string' if string else 'long'}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return listed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Table:
    """Lookups in a written table: binary search among the shards' ranges, and then in the one shard that holds a key.

    What is kept are the ranges: two keys and a name for each shard.
    """

    def __init__(self, manifest: DataFrame):
        rows = manifest.orderBy("grp").collect()
        self.firsts, self.lasts, self.files = [bytes(r["first"]) for r in rows], [bytes(r["last"]) for r in rows], [r["file"] for r in rows]

    def get(self, key: int | str | None) -> np.ndarray | None:
        """The ids of the first document with this key, or None."""
        wanted = key_of(key)
        for k in range(bisect.bisect_left(self.lasts, wanted), len(self.files)):
            if self.firsts[k] > wanted:
                break
            with open_shared(self.files[k], "rb") as source:
                ids = Reader(source).get(wanted)
            if ids is not None:
                return np.frombuffer(ids, "<u4")
        return None
