"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit into memory. Pass two shuffles each bucket by
Fisher-Yates and writes it. The buckets one after another are the shuffled table; each shard is a stretch of it, as
long as any other or one record longer (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.packing import first_numbers
from quillstone.llm.shared import groups_for, stage, text_bytes

_LAW = {"size": "long", "text_crc32": "long", "law": "string", "shard": "int", "slot": "long", "grown_shard": "int"}


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of ``n`` by Fisher-Yates, from numpy's own in-place form of it."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def shuffle_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 16 << 20, overhead: int = 16, alike: int = 10_000
) -> DataFrame:
    """The columns of ``docs``, as written bucket by bucket, with size, text_crc32, law, shard, slot, grown_shard.

    Null texts count as empty. Where rows are alike in id and text, which of them gets which place is open, as they
    are equal; null ids are scattered by their texts. More than ``alike`` rows that are alike (or a ten-thousandth of
    all rows, if that is more) are spread over buckets by their places in the input. Result columns replace columns of
    the same names. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    docs = docs.drop(*[c for c in docs.columns if c in _LAW])
    names = list(docs.columns)
    rows, n_bytes = text_bytes(docs, text_col)
    buckets = groups_for(n_bytes + overhead * rows, bucket_bytes)
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), body).alias("tie"))
    # rows / most of them pass this bound: ten thousand ties at the most
    most = max(alike, rows // 10_000)
    many = inner.groupBy("tie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    salt = F.pmod(F.monotonically_increasing_id(), F.ceil(F.coalesce("n", F.lit(1)) / most))
    scattered = inner.join(F.broadcast(many), "tie", "left").withColumn("grp", F.pmod(F.xxhash64(F.lit(seed + 1), "tie", salt), F.lit(buckets))).drop("n")

    def mixed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("tie").drop_columns(["tie"])
        order = fisher_yates(table.num_rows, seed * 1_000_003 + key[0].as_py())
        return table.take(pa.array(order)).append_column("place", pa.array(np.arange(table.num_rows), pa.int64()))

    kinds = [f for f in scattered.schema.fields if f.name != "tie"]
    schema = T.StructType([*kinds, T.StructField("place", T.LongType())])
    placed = stage(scattered.select(*[f.name for f in kinds], "tie").groupBy("grp").applyInArrow(mixed, schema), "shards")
    each, more = divmod(placed.count(), shards)
    at = F.col("base") + F.col("place")
    long = F.lit(more * (each + 1)).cast("long")  # records of the shards that are one longer
    text = F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))
    shard = F.when(at < long, F.floor(at / (each + 1))).otherwise(more + F.floor((at - long) / max(each, 1)))
    slot = F.when(at < long, F.pmod(at, F.lit(each + 1))).otherwise(F.pmod(at - long, F.lit(max(each, 1))))
    bases = first_numbers(placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    return placed.join(bases, "grp").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names) ],
        (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str, text_col: str = "text", file_bytes: int = 128 << 20) -> None:
    """Write the records of each shard, in the order of their slots, to files of about ``file_bytes`` in a folder of its own."""
    files = groups_for(text_bytes(sharded, text_col)[1], file_bytes)
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
