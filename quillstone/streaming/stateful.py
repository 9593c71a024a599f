"""Stateful streams: throttled repeats, answers put together from their parts, windows of events."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators import relational
from quillstone.streaming import run

#: How long a counter is kept without events, where a time is wanted rather than a number of counters.
IDLE_MS = 24 * 3600 * 1000


def told(n: int) -> bool:
    return n <= 10 or (n <= 100 and n % 10 == 0) or n % 100 == 0


def throttle(events: DataFrame, keys: list[str], order: list[str], event_id: str = "event_id", idle_ms: int | None = None) -> DataFrame:
    """(event_id, occurrence) of the events that are told; a count for each key is all that is kept.

    Within a batch events count in order. Without ``idle_ms`` counters stay for good.
    """

    def step(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        number = range(n + 1, n + len(rows) + 1)
        state.update((n + len(rows),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        keep = [told(k) for k in number]
        yield pd.DataFrame({event_id: rows[event_id][keep], "occurrence": pd.Series([k for k in number if told(k)], dtype="int32", index=rows[event_id][keep].index)})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    kind = events.schema[event_id].dataType.simpleString()
    return events.groupBy(*keys).applyInPandasWithState(step, f"{event_id} {kind}, occurrence int", "n long", "append", timeout)


def drained_throttle(events: DataFrame, keys: list[str], order: list[str], event_id: str = "event_id", tag: str = "throttle") -> DataFrame:
    """What ``throttle`` tells of a stream that ends, as a table: each batch is numbered by one window, in which a key's
    counter stands before its events, so that no key costs a call of Python."""
    kind = events.schema[event_id].dataType.simpleString()

    def split(rows: DataFrame) -> DataFrame:
        event = F.struct(F.col(event_id).alias("id"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)])
        return rows.select(F.struct(*keys).alias("key"), F.lit(1).cast("long").alias("n"), event.alias("event"))

    def step(batch: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = split(batch)
        every = rows.unionByName(kept.withColumn("event", F.lit(None).cast(rows.schema["event"].dataType)))
        in_order = Window.partitionBy("key").orderBy(F.col("event").isNotNull(), *[F.col(f"event.by{k}").asc_nulls_last() for k in range(len(order))])
        numbered = every.select("event", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
        told = numbered.where(F.col("event").isNotNull() & relational.throttled(F.col("n"))).select(F.col("event.id").alias(event_id), F.col("n").cast("int").alias("occurrence"))
        return told, every.groupBy("key").agg(F.sum("n").alias("n"))

    kept = split(events).select("key", "n").schema
    return run.drain_by_steps(events, step, kept, events.sparkSession.createDataFrame([], f"{event_id} {kind}, occurrence int").schema, tag)


class RecentCounters(StatefulProcessor):
    """The counters of one shard, least recently written first, at most ``capacity``; beyond that the first is forgotten."""

    def __init__(self, capacity: int, event_id: str, order: list[str]):
        self.capacity, self.event_id, self.order = capacity, event_id, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "keys array<string>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts: OrderedDict[str, int] = OrderedDict()
        if self.recent.exists():
            keys, numbers = self.recent.get()
            counts = OrderedDict(zip(keys, numbers, strict=True))
        found: list[tuple] = []
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for event, name in zip(batch[self.event_id], batch["counter"], strict=True):
            n = counts.pop(name, 0) + 1
            counts[name] = n  # now the most recently written
            if len(counts) > self.capacity:
                counts.popitem(last=False)
            if told(n):
                found.append((event, n))
        self.recent.update((list(counts), list(counts.values())))
        yield pd.DataFrame(found, columns=[self.event_id, "occurrence"]).astype({"occurrence": "int32"})

    def close(self) -> None:
        pass


def throttle_recent(events: DataFrame, keys: list[str], order: list[str], shard: Column, capacity: int = 128, event_id: str = "event_id") -> DataFrame:
    """(event_id, occurrence) of the events that are told, with at most ``capacity`` counters for each shard.

    A shard stands for one process: it keeps the counters that were written last, and a key whose counter was forgotten
    counts from 1 again. So what is kept is bounded by shards times ``capacity``, however many keys there are; keys in
    which a column is null are keys. Within a batch events count in order; a shard's rows of one batch are sorted in
    one task, so the rows of a batch (files at once) should be bounded, too. Other columns are ignored. Needs the
    RocksDB state store (``run.drain`` with ``many_states``).
    """
    counter = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    rows = events.select(F.col(event_id), *[F.col(c) for c in order if c != event_id], counter.alias("counter"), shard.cast("string").alias("shard"))
    kind = events.schema[event_id].dataType.simpleString()
    return rows.groupBy("shard").transformWithStateInPandas(RecentCounters(capacity, event_id, order), f"{event_id} {kind}, occurrence int", "Append", "None")


def assemble(parts: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, response) once a message's last part has come. ``parts``: key, seq, text, done.

    Parts may come in any order and over several batches; done names the last, so that none is missing when it is told.
    """
    kind = parts.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, last = ([], [], -1) if not state.exists else (list(state.get[0]), list(state.get[1]), state.get[2])
        known = set(seqs)
        for pdf in batches:
            for r in pdf.itertuples():
                if r.seq not in known:
                    known.add(int(r.seq))
                    seqs.append(int(r.seq))
                    texts.append(r.text)
                if r.done:
                    last = int(r.seq)
        if last >= 0 and len(seqs) == last + 1:
            state.remove()
            yield pd.DataFrame({key: [group[0]], "response": ["".join(t for _, t in sorted(zip(seqs, texts, strict=True)))]})
        else:
            state.update((seqs, texts, last))

    return parts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, response string", "seqs array<long>, texts array<string>, last long", "append", GroupStateTimeout.NoTimeout)


def drained_responses(parts: DataFrame, key: str = "message_id", tag: str = "assemble") -> DataFrame:
    """What ``assemble`` gives of a stream that ends, as a table: each batch is grouped with the parts that still wait,
    so that no message costs a call of Python. Of parts with the same number the one that came in an earlier batch stands."""

    def split(rows: DataFrame, waiting: bool) -> DataFrame:
        part = F.struct(F.col("seq").cast("long").alias("seq"), F.lit(not waiting).alias("new"), "text", F.coalesce("done", F.lit(False)).alias("done"))
        return rows.select(F.col(key).alias("key"), part.alias("part"))

    def step(batch: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = split(batch, False).unionByName(split(kept, True)).groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("all"), F.max(F.when(F.col("part.done"), F.col("part.seq"))).alias("last"))
        first = F.filter("all", lambda p, k: (k == 0) | (p["seq"] != F.get("all", k - 1)["seq"]))
        found = found.select("key", "all", first.alias("parts"), (F.size(first) == F.col("last") + 1).alias("whole"))
        told = found.where("whole").select(F.col("key").alias(key), F.array_join("parts.text", "").alias("response"))
        left = found.where("whole is not true").select(F.col("key").alias(key), F.explode("all").alias("part"))
        return told, left.select(key, "part.seq", "part.text", "part.done")

    kind = parts.schema[key].dataType.simpleString()
    empty = lambda names: parts.sparkSession.createDataFrame([], names).schema
    return run.drain_by_steps(parts, step, empty(f"{key} {kind}, seq long, text string, done boolean"), empty(f"{key} {kind}, response string"), tag)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type and window of event time; an addition, with a watermark for late rows."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
