"""Sources and sinks over the test tables: each query writes to the shared folder, reads it back and returns that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.functions import strings as S
from quillstone.operators import relational as R
from quillstone.sources import readers, versions, writers
from quillstone.streaming.run import fan_out, file_stream, stored, work_dir


@register("s01_s02_merged_json_items", "SELECT url, 'Page ' || page_id AS title, html AS markdown FROM pages")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON arrays of up to 500 items, a file for each, read as one list."""
    place = work_dir(spark, "items")
    item = F.struct("url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.col("html").alias("markdown"))
    arrays = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 500).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))
    arrays.write.partitionBy("part").text(place)
    return readers.json_items(spark, [place]).select("url", "title", "markdown")


@register("s04_s05_s06_sidecar_overrides", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'side ' || n_name ELSE n_name END AS content FROM nation")
def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose content a file beside them replaces where there is one; the file is found by its path."""
    place = work_dir(spark, "sidecars")
    items = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("content"))
    side = items.where("n_nationkey % 3 = 0").select("n_nationkey", F.concat(F.lit("side "), "content").alias("value"))
    side.write.partitionBy("n_nationkey").text(place)
    files = readers.text_files(spark, place, "*.txt")
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int")
    return readers.with_override(items, files.select(key.alias("n_nationkey"), F.rtrim(F.replace("content", F.lit("\n"))).alias("content")), "n_nationkey", "content")


@register("s07_splits_as_markdown", "SELECT conv_id, array_to_string(list('--- ' || turn || ' ---' || chr(10) || text ORDER BY turn), chr(10) || chr(10)) || chr(10) AS content FROM conversations GROUP BY conv_id")
def splits_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "splits")
    splits = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("split_index"), F.col("text").alias("content"))
    writers.save_markdown(splits, place, "conv_id")
    files = readers.text_files(spark, place, "*.txt")
    return files.select(F.regexp_extract("path", "conv_id=([0-9]+)", 1).cast("long").alias("conv_id"), "content")


@register("s08_chunks_as_json", "SELECT doc_id, text, nullif(n_chars % 3, 0) AS page_number FROM documents")
def chunks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "chunks-json")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") % 3).alias("page_number"))
    writers.save_json(rows, place)
    return spark.read.schema("doc_id long, text string, page_number long").json(place)


@register("s11_s12_refreshed_datasets", """
    SELECT doc_id, source AS dataset, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS version FROM documents
    WHERE source <> (SELECT min(source) FROM documents) AND (lang = 'en' OR source = (SELECT max(source) FROM documents))""")
def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English rows are loaded; one dataset is dropped; the greatest is loaded anew with all languages, which replaces it."""
    place = work_dir(spark, "datasets")
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("dataset"), F.when(F.col("lang") == "en", 1).otherwise(2).alias("version"))
    ends = docs.agg(F.min("dataset").alias("low"), F.max("dataset").alias("high")).first()
    writers.save_chunks(docs.where("version = 1"), place, refresh=True)
    writers.save_chunks(docs.where(F.col("dataset") == ends["high"]), place, refresh=True)
    return R.drop_dataset(spark.read.parquet(place), ends["low"]).select("doc_id", "dataset", "version")


@register("s14_s17_s20_csv_round_trip", """SELECT item_id::VARCHAR AS id, 'What, "is" ' || chr(10) || text AS question, CASE WHEN item_id % 4 = 0 THEN NULL ELSE 'a' || item_id END AS answer FROM benchmark""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas and line breaks come back as they were; a lacking answer is null."""
    place = work_dir(spark, "csv")
    item = F.col("item_id").cast("string")
    rows = table(spark, sf_dir, "benchmark").select(item.alias("id"), F.concat(F.lit('What, "is" \n'), "text").alias("question"), F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("a"), item)).alias("answer"))
    writers.save_csv(rows, place)
    return readers.questions(spark, place).select("id", "question", "answer")


@register("s15_s16_t07_s35_latest_version", "SELECT item_id, '20240201_000000' AS version_id, text AS question FROM benchmark WHERE item_id % 2 = 0")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions beside each other; the greater name is read."""
    place = work_dir(spark, "versions")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    writers.save_version(rows.where("item_id % 2 = 0"), place, "20240201_000000")
    writers.save_version(rows, place, "20240131_235959")
    found = writers.latest_version(spark, place)
    return spark.read.parquet(place).where(F.col("version_id") == found).select("item_id", F.col("version_id").cast("string").alias("version_id"), "question")


@register("s18_e06_logged_batch", """
    SELECT 'results' AS part, doc_id::VARCHAR AS key, (quality = 1)::VARCHAR AS value FROM labels
    UNION ALL SELECT 'metrics', regexp_replace(md5('0.1||25||all'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'), round(avg(quality), 6)::VARCHAR FROM labels""")
def logged_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's results and its metrics under an id that follows from what it was configured with."""
    place = work_dir(spark, "batches")
    results = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), (F.col("quality") == 1).cast("string").alias("value"))
    batch = S.uuid_of(F.lit("0.1"), F.lit("25"), F.lit("all"))
    summary = table(spark, sf_dir, "labels").agg(F.round(F.avg("quality"), 6).alias("value")).select(batch.alias("key"), F.col("value").cast("string").alias("value"))
    config = versions.batch_config("b1", 25, samples=results.count(), commit="0" * 40)
    versions.log_batch(config, results, summary, place, "2024-01-02")
    read = lambda part: versions.logged(spark, place, "2024-01-02", "b1", part, "key string, value string").withColumn("part", F.lit(part))
    return read("results").unionByName(read("metrics")).select("part", "key", "value")


@register("s19_f10_flattened_csv", "SELECT doc_id::VARCHAR AS doc_id, lang AS meta_lang, source AS meta_from_source FROM documents")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "flat")
    nested = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", F.struct("source").alias("from")).alias("meta"))
    writers.save_csv(R.flatten_schema(nested), place)
    return readers.csv_rows(spark, place, ("doc_id",)).select("doc_id", "meta_lang", "meta_from_source")


@register("s22_user_upsert", "SELECT u AS identifier, CASE WHEN u % 2 = 0 THEN 'old' ELSE 'new' END AS first_seen, CASE WHEN u % 3 = 0 THEN 'new' ELSE 'old' END AS name FROM (SELECT DISTINCT user_id AS u FROM events) WHERE u % 2 = 0 OR u % 3 = 0")
def user_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even users are there, each third comes again: a known one keeps when it was first seen and takes the new name."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("identifier")).distinct()
    there = users.where("identifier % 2 = 0").select("identifier", F.lit("old").alias("first_seen"), F.lit("old").alias("name"))
    new = users.where("identifier % 3 = 0").select("identifier", F.lit("new").alias("first_seen"), F.lit("new").alias("name"))
    return R.upsert(there, new, "identifier", fixed=("first_seen",))


@register("s23_x05_fan_out", "SELECT 'primary' AS store, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events UNION ALL SELECT 'other', count(*), sum(event_id)::BIGINT FROM events")
def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into two stores; a third one that fails is told and stops nothing."""
    place = work_dir(spark, "stores")
    stream = file_stream(spark, f"{sf_dir}/events.parquet").select("event_id")
    failed = fan_out(stream, f"{place}/primary", [f"{place}/other", "nowhere://x/y"], "fan-out")
    if not failed:
        raise AssertionError("a store that isn't there was written")
    read = lambda s: stored(spark, f"{place}/{s}", "event_id long").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).select(F.lit(s).alias("store"), "n", "ids")
    return read("primary").unionByName(read("other"))


@register("s26_s37_archived_threads", "SELECT conv_id, list(text ORDER BY turn)[1] AS first_text, count(*) AS n_steps FROM conversations WHERE conv_id >= 10 AND conv_id < 60 GROUP BY conv_id")
def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with their steps archived as JSON, then a half-open range of them loaded."""
    place = work_dir(spark, "archive")
    steps = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("steps"))
    writers.save_json(steps, place, drop_empty=())
    threads = spark.read.schema("conv_id long, steps array<struct<turn:long,role:string,text:string>>").json(place)
    return threads.where("conv_id >= 10 and conv_id < 60").select("conv_id", F.get("steps", F.lit(0))["text"].alias("first_text"), F.size("steps").cast("long").alias("n_steps"))


@register("s30_faq_items", "SELECT 'faq/' || item_id AS route, '<h1>T' || item_id || '</h1><h2>' || text || '</h2>yes' AS html FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 5 <> 0")
def faq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without questions and test routes are left out."""
    item = F.col("item_id").cast("string")
    asked = F.when(F.col("item_id") % 3 != 0, F.array(F.struct(F.col("text").alias("question"), F.lit("yes").alias("answer"))))
    route = F.concat(F.lit("faq/"), item, F.when(F.col("item_id") % 5 == 0, "/test").otherwise(""))
    return readers.faq_items(table(spark, sf_dir, "benchmark").select(route.alias("route"), F.concat(F.lit("T"), item).alias("title"), asked.alias("faq")))


@register("s33_refresh_stats", "SELECT sum(o_custkey % 7)::BIGINT AS pages, sum(o_orderkey % 11)::BIGINT AS chunks FROM orders")
def refresh_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").select(F.format_string("loaded %d pages and %d chunks", F.col("o_custkey") % 7, F.col("o_orderkey") % 11).alias("value"))
    return readers.refresh_stats(log)


@register("s39_s24_backup_and_restore", "SELECT n_nationkey, n_name FROM nation")
def backed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is emptied after its backup is as it was when it is restored."""
    place = work_dir(spark, "backup")
    live = f"{place}/live"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.parquet(live)
    writers.backup(spark, {"nation": live}, f"{place}/to")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").where("false").write.mode("overwrite").parquet(live)
    writers.restore(spark, ["nation"], f"{place}/to", {"nation": live})
    return spark.read.parquet(live)


@register("p13_stamped_items", "SELECT doc_id, 'CA EDD' AS dataset, 'employment' AS program, 'California' AS region FROM documents")
def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.stamped(table(spark, sf_dir, "documents").select("doc_id"), "CA EDD", "employment", "California")
