"""Streams over the test tables, drained into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.streaming import run, stateful


@register("x02_streamed_throttle", """
    SELECT event_id, n AS occurrence FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)::INT AS n FROM events)
    WHERE n <= 10 OR (n <= 100 AND n % 10 = 0) OR n % 100 = 0""")
def streamed_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = run.file_stream(spark, f"{sf_dir}/events.parquet", 1_000_000)
    return stateful.drained_throttle(events, ["event_type", "user_id"], ["ts", "event_id"])


#: A counter is forgotten between two of its events if, since the first of them, at least 128 other keys of the shard
#: were written: those whose last event before the second lies after the first.
@register("stream_x03_recent_counters", """
    WITH e AS (SELECT event_id, user_id % 4 AS shard, event_type || ':' || user_id AS k, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS p FROM events),
    n AS MATERIALIZED (SELECT *, lag(p) OVER w AS before, lead(p) OVER w AS after FROM e WINDOW w AS (PARTITION BY shard, k ORDER BY p)),
    d AS (SELECT a.event_id, count(b.event_id) AS others FROM n a JOIN n b ON b.shard = a.shard AND b.p > a.before AND b.p < a.p AND coalesce(b.after, 1000000000000) > a.p GROUP BY 1),
    r AS (SELECT n.*, sum(CASE WHEN before IS NULL OR coalesce(others, 0) >= 128 THEN 1 ELSE 0 END) OVER (PARTITION BY shard, k ORDER BY p) AS life FROM n LEFT JOIN d USING (event_id)),
    c AS (SELECT event_id, row_number() OVER (PARTITION BY shard, k, life ORDER BY p)::INT AS occurrence FROM r)
    SELECT event_id, occurrence FROM c WHERE occurrence <= 10 OR (occurrence <= 100 AND occurrence % 10 = 0) OR occurrence % 100 = 0""")
def recent_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards of users that keep 128 counters each; users whose counters were forgotten count anew."""
    events = run.file_stream(spark, f"{sf_dir}/events.parquet", 1_000_000)
    told = stateful.throttle_recent(events, ["event_type", "user_id"], ["ts", "event_id"], F.pmod("user_id", F.lit(4)), 128)
    return run.drain(told, "recent", many_states=True)


@register("x01_assembled_responses", "SELECT conv_id, turn, text AS response FROM conversations WHERE length(text) > 0")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into single words that stream, and put together again."""
    turns = run.file_stream(spark, f"{sf_dir}/conversations.parquet", 1_000_000)
    words = F.regexp_extract_all("text", F.lit(r"\s*\S+\s*|\s+"), F.lit(0))
    parts = turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), words.alias("words"))
    parts = parts.select("message_id", F.size("words").alias("n"), F.posexplode("words").alias("seq", "text"))
    done = stateful.drained_responses(parts.select("message_id", F.col("seq").cast("long").alias("seq"), "text", (F.col("seq") == F.col("n") - 1).alias("done")))
    ids = F.split("message_id", "-")
    return done.select(ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), "response")


@register("x06_streamed_resume", "SELECT vec_id, label FROM embeddings")
def streamed_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files streamed twice; the second time adds nothing."""
    path = run.work_dir(spark, "resume")
    for _ in range(2):
        rows = run.file_stream(spark, f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
        run.append_new(rows, path, ["vec_id"], "resume-state")
    return spark.read.parquet(path)


@register("x_windowed_events", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of event time, over the whole table at once: an addition to the reference's operators."""
    found = stateful.windowed_counts(table(spark, sf_dir, "events"))
    return found.select("event_type", "start", "n", F.round("total", 4).alias("total"))
