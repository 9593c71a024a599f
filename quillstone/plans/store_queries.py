"""Stores with commits, change logs, pages and sidecar files over the test tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.operators import exports, runs
from quillstone.sources import change_log, datasets, paged, readers, sidecars, versions, writers
from quillstone.sources.commits import Committed
from quillstone.streaming.run import catch_up, fan_out, file_stream, stored, work_dir


@register("store_s25_t08_pages", "SELECT conv_id, count(*) AS n_steps, list(text ORDER BY turn)[1] AS first_text FROM conversations GROUP BY conv_id")
def paged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads as a store's pages of 25, a few ranges of ids side by side, each read by following its cursor to the end."""
    place = work_dir(spark, "pages")
    turns = table(spark, sf_dir, "conversations")
    first = F.min(F.struct("turn", "text"))["text"]
    threads = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_steps"), first.alias("first_text"))
    ends = turns.agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"), F.count_distinct("conv_id").alias("n")).first()
    ranges = paged.time_ranges(ends["low"] or 0, (ends["high"] or -1) + 1, max(8, ends["n"] // 10_000))
    of = F.lit(None).cast("string")
    for low, high in ranges:
        of = F.when((F.col("conv_id") >= low) & (F.col("conv_id") < high), f"{low}-{high}").otherwise(of)
    numbered = threads.withColumn("range", of).selectExpr("*", "row_number() OVER (PARTITION BY range ORDER BY conv_id) - 1 AS n", "count(*) OVER (PARTITION BY range) AS total")
    page = numbered.withColumn("cursor", F.floor(F.col("n") / 25)).groupBy("range", "cursor").agg(F.collect_list(F.struct("conv_id", "n_steps", "first_text")).alias("data"), F.first("total").alias("total_count"))
    more = (F.col("cursor") + 1) * 25 < F.col("total_count")
    info = F.struct(more.alias("has_next_page"), (F.col("cursor") + 1).alias("end_cursor"))
    page.select("range", "cursor", F.to_json(F.struct("data", info.alias("page_info"), "total_count"), {"ignoreNullFields": "false"}).alias("value")).write.partitionBy("range", "cursor").text(place)
    return paged.paged(spark, "thread_pages", paged.paged_folder(place), ranges, "conv_id long, n_steps long, first_text string")


@register("store_l07_entities", """
    WITH t AS (SELECT DISTINCT conv_id FROM conversations),
    threads AS (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN 'renamed' ELSE 'thread ' || conv_id END AS name FROM t WHERE conv_id % 4 <> 0),
    steps AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'edited' ELSE text END AS output FROM conversations WHERE conv_id % 4 <> 0 AND turn % 5 <> 4)
    SELECT 'users' AS kind, 'u' || (conv_id % 50) AS id, 'user ' || (conv_id % 50) AS first, NULL AS second FROM t GROUP BY ALL
    UNION ALL SELECT 'threads', conv_id::VARCHAR, name, 'u' || (conv_id % 50) FROM threads
    UNION ALL SELECT 'steps', conv_id || '-' || turn, md5(output), role FROM steps JOIN conversations USING (conv_id, turn)
    UNION ALL SELECT 'elements', 'e' || conv_id || '-' || turn, 'file ' || turn, conv_id || '-' || turn FROM conversations WHERE turn % 3 = 0 AND conv_id % 4 <> 0
    UNION ALL SELECT 'feedback', 'f' || conv_id || '-' || turn, CASE WHEN turn % 2 = 1 THEN '1' ELSE '0' END, NULL FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 0""")
def multi_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, threads, steps, elements and feedback made, changed and deleted in two stores; another session reads the second one.

    A third store that isn't there is told and stops nothing. A batch is sent twice, a change comes late, and the log is
    compacted between batches.
    """
    place = work_dir(spark, "stores")
    stores = change_log.Stores(spark, f"{place}/primary", (f"{place}/other", "nowhere://x/y"))
    c = table(spark, sf_dir, "conversations")
    conv, step = F.col("conv_id").cast("string"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    user = F.concat(F.lit("u"), (F.col("conv_id") % 50).cast("string"))
    threads = c.select("conv_id").distinct()
    put = lambda rows, kind, seq: change_log.changes(rows, kind, "id", F.lit(seq))
    users = threads.select(user.alias("id"), F.concat(F.lit("user "), (F.col("conv_id") % 50).cast("string")).alias("identifier")).distinct()
    named = threads.select(conv.alias("id"), F.concat(F.lit("thread "), conv).alias("name"), user.alias("user_id"))
    steps = c.select(step.alias("id"), conv.alias("thread_id"), F.col("role").alias("type"), F.col("text").alias("output"))
    elements = c.where("turn % 3 = 0").select(F.concat(F.lit("e"), step).alias("id"), conv.alias("thread_id"), step.alias("step_id"), F.concat(F.lit("file "), F.col("turn").cast("string")).alias("name"))
    rated = c.where("role = 'assistant'").select(F.concat(F.lit("f"), step).alias("id"), conv.alias("thread_id"), step.alias("step_id"), F.when(F.col("turn") % 2 == 1, "1").otherwise("0").alias("value"))
    made = put(users, "users", 1).unionByName(put(named, "threads", 2)).unionByName(put(steps, "steps", 3)).unionByName(put(elements, "elements", 4)).unionByName(put(rated, "feedback", 5))
    stores.write("a-made", made)
    late = put(threads.where("conv_id % 4 = 1").select(conv.alias("id"), F.lit("too late").alias("name")), "threads", 7)
    renamed = put(threads.where("conv_id % 4 = 1").select(conv.alias("id"), F.lit("renamed").alias("name")), "threads", 10)
    edited = put(c.where("turn = 0").select(step.alias("id"), F.lit("edited").alias("output")), "steps", 11)
    stores.write("b-changed", renamed.unionByName(edited))
    if stores.write("b-changed", renamed) or change_log.compact(spark, f"{place}/other") != 2:
        raise AssertionError("a batch that is sent again is written once")
    stores.write("c-late", late)
    gone = change_log.deletions(threads.where("conv_id % 4 = 0").select(conv.alias("id")), "threads", "id", F.lit(12))
    stores.write("d-deleted", gone.unionByName(change_log.deletions(c.where("turn % 5 = 4").select(step.alias("id")), "steps", "id", F.lit(13))))
    if len(stores.failed) != 5:
        raise AssertionError("a store that isn't there was written")
    other = change_log.Stores(spark.newSession(), f"{place}/other")
    shown = {"users": ("identifier", None), "threads": ("name", "user_id"), "elements": ("name", "step_id"), "feedback": ("value", None)}
    out = other.table("steps").select(F.lit("steps").alias("kind"), "id", F.md5("output").alias("first"), F.col("type").alias("second"))
    for kind, (first, second) in shown.items():
        out = out.unionByName(other.table(kind).select(F.lit(kind).alias("kind"), "id", F.col(first).alias("first"), (F.col(second) if second else F.lit(None).cast("string")).alias("second")))
    return out


@register("versions_s15_s35_qa_pairs", """
    SELECT item_id::VARCHAR AS id, 'What, "is" ' || chr(10) || text AS question, 'a' || item_id AS answer, 'ds' || (item_id % 3) AS document_source, '20240201_093005' AS version_id, '2024-02-01T09:30:05+00:00' AS version_timestamp, 'm2' AS version_llm_model,
        (SELECT count(*) FROM benchmark WHERE item_id % 2 = 0) AS total_pairs, (SELECT array_to_string(list_sort(list(DISTINCT 'ds' || (item_id % 3))), ',') FROM benchmark WHERE item_id % 2 = 0) AS datasets, 'abc' AS git_commit
    FROM benchmark WHERE item_id % 2 = 0""")
def versioned_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of question-answer pairs, and a third whose writing broke off: the second is the latest, and whole."""
    place = work_dir(spark, "qa-versions")
    item = F.col("item_id").cast("string")
    pairs = table(spark, sf_dir, "benchmark").select("item_id", item.alias("id"), F.concat(F.lit('What, "is" \n'), "text").alias("question"), F.concat(F.lit("a"), item).alias("answer"), F.concat(F.lit("ds"), (F.col("item_id") % 3).cast("string")).alias("document_source"))
    when = [datetime(2024, 1, 31, 23, 59, 59, tzinfo=UTC), datetime(2024, 2, 1, 9, 30, 5, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC)]
    name = [versions.version_id(t) for t in when]
    versions.save_qa_version(pairs, place, name[0], "m1", "abc", when[0])
    versions.save_qa_version(pairs.where("item_id % 2 = 0"), place, name[1], "m2", "abc", when[1])
    broken = pairs.withColumn("answer", F.when(F.col("item_id") >= 0, F.raise_error(F.lit("broken off"))).cast("string"))
    try:
        versions.save_qa_version(broken, place, name[2], "m3", "abc", when[2])
    except Exception as e:
        if "broken off" not in str(e):
            raise
    m = versions.qa_metadata(spark, place)
    told = {"total_pairs": F.lit(m["total_pairs"]).cast("long"), "datasets": F.lit(",".join(m["datasets"])), "git_commit": F.lit(m["git_commit"])}
    return versions.qa_pairs(spark, place).select("id", "question", "answer", "document_source", "version_id", "version_timestamp", "version_llm_model").withColumns(told)


@register("stream_x05_s23_fan_out_once", "SELECT store, count(*) AS n, count(DISTINCT event_id) AS different, sum(event_id)::BIGINT AS ids FROM events, (SELECT unnest(['primary', 'other', 'late']) AS store) GROUP BY store")
def fan_out_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that ends between two stores and runs again leaves each row once in both; a third store catches up."""
    place = work_dir(spark, "fan-out-once")
    path = f"{sf_dir}/events.parquet"
    events = file_stream(spark, path).select("event_id")
    # what a driver that was lost between the stores leaves: the first batch in one of them, nothing in the stream's own state
    Committed(spark, f"{place}/other").append("fan-out-000000000000", spark.read.parquet(path).select("event_id"))
    for _ in range(2):  # a second run has nothing left to do
        fan_out(events, f"{place}/primary", [f"{place}/other"], "fan-out", f"{place}/state")
    fan_out(events, f"{place}/primary", [f"{place}/other"], "fan-out", f"{place}/state-lost")  # its state lost, every batch comes again
    catch_up(spark, f"{place}/primary", f"{place}/late", "event_id long")
    sums = lambda s: stored(spark, f"{place}/{s}", "event_id long").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("different"), F.sum("event_id").alias("ids")).select(F.lit(s).alias("store"), "*")
    return sums("primary").unionByName(sums("other")).unionByName(sums("late"))


@register("export_e09_s27_columns", """
    WITH s AS (SELECT *, conv_id || '-' || turn AS id FROM conversations WHERE conv_id % 5 <> 0),
    p AS (SELECT q.conv_id, q.turn, q.id, q.text AS question, a.text AS answer FROM s q JOIN s a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' AND q.role = 'user' AND q.text <> '' AND a.text <> '')
    SELECT 'user ' || (conv_id % 7) AS "User ID", '03/0' || (1 + turn % 9) || '/2024' AS "Date", question AS "Question", answer AS "Response", 'http://lai.org/projects/p1/logs/threads/t' || conv_id || '?currentStepId=' || id AS "LiteralAI Thread",
        CASE WHEN conv_id % 2 = 0 THEN 'agency' END AS "Agency ID", 's' || conv_id AS "Session ID", CASE WHEN turn % 4 = 0 THEN 'CalWORKs' ELSE '' END AS "Program",
        CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://d.org/1' ELSE 'http://d.org/1' || chr(10) || 'http://d.org/2' END AS "Citation Links", CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'ds: Doc 1' ELSE 'ds: Doc 1' || chr(10) || ': Doc 2' END AS "Citation Sources",
        CASE WHEN turn > 0 THEN 'True' ELSE 'False' END AS "Has Chat History", 't' || conv_id AS "Thread ID", '2024-03-0' || (1 + turn % 9) || 'T10:00:00+00:00' AS "Timestamp",
        CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN '1.0' ELSE '[1.0, 0.5]' END AS "Feedback Scores", CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN 'it''s fine' ELSE '["it''s fine", '''']' END AS "Feedback Comments"
    FROM p""")
def fifteen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with nested metadata exported as fifteen columns, written as CSV and read back; each fifth thread is tagged."""
    c = table(spark, sf_dir, "conversations")
    steps = _lai_steps(c)
    threads = c.groupBy("conv_id").agg(F.collect_list("turn").alias("steps")).select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("id"), "steps", F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("chainlit"))).alias("tags"))
    rows = exports.export_columns(exports.qa_rows(threads, steps, "p1", "http://lai.org"))
    place = work_dir(spark, "lai-pairs")
    writers.save_csv(rows, place, exports.EXPORT_COLUMNS)
    # an empty field and a missing one look the same in a CSV; only these columns have missing ones
    filled = [n for n in exports.EXPORT_COLUMNS if n != "Agency ID"]
    return readers.csv_rows(spark, place, tuple(exports.EXPORT_COLUMNS)).select(exports.EXPORT_COLUMNS).na.fill("", filled)


def _lai_steps(c: DataFrame) -> DataFrame:
    """Turns as steps of another system: an answer has its question as parent, and what it cites as nested metadata."""
    n = lambda x: x.cast("string")
    conv, turn = F.col("conv_id"), F.col("turn")
    step = F.concat_ws("-", n(conv), n(turn))
    asked = turn - 1  # of an answer, its question's turn
    request = F.struct(F.concat(F.lit("user "), n(conv % 7)).alias("user_id"), F.when(conv % 2 == 0, "agency").alias("agency_id"), F.concat(F.lit("s"), n(conv)).alias("session_id"))
    cite = lambda k, ds: F.struct(F.lit(f"http://d.org/{k}").alias("uri"), (F.lit(ds) if ds else F.lit(None).cast("string")).alias("source_dataset"), F.lit(f"Doc {k}").alias("source_name"))
    cited = F.when(asked % 3 == 1, F.array(cite(1, "ds"))).when(asked % 3 == 2, F.array(cite(1, "ds"), cite(2, None)))
    past = F.when(asked > 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content"))))
    about = F.struct(cited.alias("citations"), past.alias("chat_history"), F.when(asked % 4 == 0, F.struct(F.lit("CalWORKs").alias("benefit_program"))).alias("attributes"))
    score = lambda v, t: F.struct(F.lit(v).alias("value"), F.lit(t).cast("string").alias("comment"))
    scores = F.when(asked % 5 == 1, F.array(score(1.0, "it's fine"))).when(asked % 5 > 1, F.array(score(1.0, "it's fine"), score(0.5, None)))
    is_answer, is_question = F.col("role") == "assistant", F.col("role") == "user"
    kept = c.where("text <> ''").withColumns({"before": F.lag("role").over(_by_turn()), "before_turn": F.lag("turn").over(_by_turn())})
    follows = is_answer & (F.col("before") == "user") & (F.col("before_turn") == asked)
    return kept.select(
        F.concat(F.lit("t"), n(conv)).alias("thread_id"), step.alias("id"), F.when(follows, F.concat_ws("-", n(conv), n(asked))).alias("parent_id"), F.when(is_question, "user_message").otherwise("assistant_message").alias("type"),
        F.concat(F.lit("2024-03-0"), n(1 + turn % 9), F.lit("T10:00:00+00:00")).alias("start_time"), F.to_json(F.struct(F.col("text").alias("content"))).alias("output"),
        F.when(is_question, F.to_json(F.struct(request.alias("request")))).otherwise(F.to_json(about)).alias("metadata"), F.when(is_answer, scores).alias("scores"),
    )


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


_PAGE_URL = "'http://h.org/p/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END"


@register("files_s05_s06_sidecars", f"""
    WITH p AS (SELECT page_id, {_PAGE_URL} AS url, CASE WHEN page_id % 6 = 1 THEN 'file of ' || page_id WHEN page_id % 6 IN (2, 4) THEN 'by hand ' || page_id ELSE md5(html) END AS content FROM pages)
    SELECT page_id, content, page_id % 6 IN (4, 5) AS edited, i AS split_index, CASE WHEN page_id % 6 IN (4, 5) THEN ['edited ' || page_id, 'twice'][i + 1] ELSE content END AS text,
           CASE WHEN page_id % 6 IN (4, 5) THEN 'e' || i ELSE 'Page' || chr(10) || chr(10) || content END AS text_to_encode, CASE WHEN page_id % 6 IN (4, 5) THEN 2 ELSE 1 END AS num_splits
    FROM p, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR page_id % 6 IN (4, 5)""")
def named_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which some name a file of their own, some have a text made by hand beside them, and some have edited splits."""
    place = work_dir(spark, "named")
    key = F.col("page_id").cast("string")
    r = F.col("page_id") % 6
    url = F.concat(F.lit("http://h.org/p/"), key, F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    items = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.md5("html").alias("markdown"), F.when(r == 1, F.concat(F.lit("extra/file "), key, F.lit(".md"))).alias("md_file"))
    own = F.concat(F.lit("p/"), key, F.when(F.col("page_id") % 2 == 0, "/_index").otherwise(""))
    writers.save_files(items.where(r == 1).select(F.col("md_file").alias("path"), F.concat(F.lit("file of "), key).alias("content")), f"{place}/json")
    writers.save_files(items.where(r.isin(1, 2, 4)).select(F.concat(own, F.lit(".md")).alias("path"), F.concat(F.lit("by hand "), key).alias("content")), f"{place}/md")
    part = lambda t, e: F.struct(F.array(F.lit("h")).alias("headings"), t.alias("text"), F.lit(e).alias("text_to_encode"))
    edited = F.to_json(F.array(part(F.concat(F.lit("edited "), key), "e0"), part(F.lit("twice"), "e1")))
    writers.save_files(items.where(r.isin(4, 5)).select(F.concat(own, F.lit(".splits.json")).alias("path"), edited.alias("content")), f"{place}/md")
    rows = sidecars.with_content(items, f"{place}/json", f"{place}/md", "http://h.org")
    rows = sidecars.with_splits(rows, f"{place}/md", F.array(sidecars.split(F.array(F.lit("h")), F.col("content"), F.lit("Page\n"))))
    return rows.select("page_id", "content", "edited", F.size("splits").alias("num_splits"), F.posexplode("splits").alias("split_index", "s")).select("page_id", "content", "edited", "split_index", "s.text", "s.text_to_encode", "num_splits")


@register("library_s11_s12_chunks", """
    WITH d AS (SELECT doc_id, coalesce(source, 'none') AS dataset, coalesce(text, '') AS content FROM documents),
    e AS (SELECT min(dataset) AS low, max(dataset) AS high FROM d),
    k AS (SELECT d.*, list_filter(string_split(content, chr(10)), lambda x: x <> '') AS lines FROM d, e WHERE dataset <> low AND (dataset = high OR doc_id % 3 <> 2)),
    c AS (SELECT doc_id, dataset, md5(content) AS content_md5, len(lines)::INT AS num_splits, unnest(lines) AS text, unnest(range(len(lines)))::INT AS split_index FROM k)
    SELECT doc_id, dataset, content_md5, split_index, num_splits, md5(text) AS text_md5 FROM c""")
def documents_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their lines as chunks, loaded in two parts and resumed; a load that breaks leaves neither; a dataset is dropped with its chunks, another replaced."""
    place = work_dir(spark, "library")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("dataset"), F.lit("t").alias("title"), F.concat(F.lit("http://d.org/"), F.col("doc_id").cast("string")).alias("url"), F.coalesce("text", F.lit("")).alias("content"))
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    splits = F.transform(lines, lambda x: sidecars.split(F.array().cast("array<string>"), x, F.lit("")))
    parts = lambda rows: sidecars.documents_and_chunks(rows.withColumn("splits", splits))
    library = datasets.Library(spark, place)
    library.load(*parts(docs.where("doc_id % 3 = 0")))
    library.resume(*parts(docs.where("doc_id % 3 <> 2")))  # of which the first third is there
    broken = parts(docs.where("doc_id % 3 = 2"))
    try:
        library.load(broken[0].where("doc_id < 0"), broken[1])
    except ValueError as e:
        if "no document" not in str(e):
            raise
    ends = docs.agg(F.min("dataset").alias("low"), F.max("dataset").alias("high")).first()
    if not library.drop(ends["low"]) or library.drop("no such dataset"):
        raise AssertionError("a drop tells whether there was anything")
    library.load(*parts(docs.where(F.col("dataset") == ends["high"])), replaces=ends["high"])
    shown = library.documents().select("doc_id", "dataset", F.md5("content").alias("content_md5"))
    return library.chunks().join(shown, ["doc_id", "dataset"]).select("doc_id", "dataset", "content_md5", "split_index", "num_splits", F.md5("text").alias("text_md5"))


@register("runs_s36_ingestion", "SELECT doc_id, 'CA EDD' AS dataset, 'employment' AS program, 'California' AS region FROM documents")
def ingestion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingestion from its arguments: a third of the documents first, and all of them when it is resumed."""
    place = work_dir(spark, "ingested")

    def load(asked: runs.Ingestion, resume: bool = False) -> int:
        rows = spark.read.parquet(asked.path).select("doc_id")
        return writers.ingest(readers.stamped(rows if resume else rows.where("doc_id % 3 = 0"), asked.dataset, asked.program, asked.region), place, ["doc_id"], resume)

    argv = ["ingest", "CA EDD", "employment", "California", f"{sf_dir}/documents.parquet"]
    first, rest = runs.run_ingestion(argv, load), runs.run_ingestion([*argv, "--resume"], load)
    if first == 0 or rest == 0 or runs.run_ingestion([*argv, "--resume"], load) != 0:
        raise AssertionError("a resumed ingestion loads what is lacking")
    return spark.read.parquet(place).select("doc_id", F.col("dataset").cast("string").alias("dataset"), "program", "region")


@register("files_s07_splits", """
    WITH s AS (SELECT conv_id, count(*) AS n, list(text ORDER BY turn) AS texts, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
    SELECT conv_id, i - 1 AS split_index, texts[i] AS text, roles[i] AS headings,
        'Talk ' || conv_id || ' => ' || n || ' splits' || chr(10) || chr(10) || array_to_string(list_transform(texts, lambda t, k: '---' || chr(10) || 'length:   ' || length(t || '!') || chr(10) || 'headings: ' || roles[k] || chr(10) || t), chr(10) || chr(10)) AS readable
    FROM s, unnest(range(1, n + 1)) AS u(i)""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the splits of conversations, as JSON and as readable texts in a few folders, and both read back."""
    place = work_dir(spark, "split-files")
    none = F.lit("")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.col("turn").alias("split_index"), F.array("role").alias("headings"), "text",
        F.concat("text", F.lit("!")).alias("text_to_encode"), none.alias("chunk_id"), none.alias("data_ids"),
    )
    writers.save_splits(rows, place, "conv_id", "title", 16)
    key = F.regexp_extract("path", r"/([0-9]+)\.splits", 1).cast("long")
    files = lambda glob: sidecars.folder_files(spark, place, glob).select(key.alias("conv_id"), "content")
    parts = files("*.splits.json").select("conv_id", F.posexplode(F.from_json("content", sidecars.SPLIT, {"mode": "FAILFAST"})).alias("split_index", "s"))
    readable = files("*.splits.md").withColumnRenamed("content", "readable")
    return parts.join(readable, "conv_id").select("conv_id", F.col("split_index").cast("long").alias("split_index"), "s.text", F.array_join("s.headings", ">").alias("headings"), "readable")


def _written_pages(spark: SparkSession, sf_dir: str, place: str) -> None:
    """Pages as HTML files in folders, and each second one as markdown beside it; one file is of another kind."""
    pages = table(spark, sf_dir, "pages").select("html", "page_id", F.concat_ws("/", F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string")), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("at"))
    html = pages.select(F.concat("at", F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    md = pages.where("page_id % 2 = 0").select(F.concat("at", F.lit(".md")).alias("path"), F.lit("# md").alias("content"))
    writers.save_files(html.unionByName(md), place)


@register("files_s03_s09_t10_html_folder", "SELECT row_number() OVER (ORDER BY page_id % 7, page_id) AS n, 'd' || (page_id % 7) || '/' || lpad(page_id::VARCHAR, 9, '0') || '.html' AS path, md5(coalesce(html, '')) AS html_md5, 'wic_scrapings.json' AS chosen FROM pages")
def html_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML files of a folder, whole and in the order of their paths; what is read where no file is named."""
    place = work_dir(spark, "html-folder")
    _written_pages(spark, sf_dir, place)
    files = readers.html_folder(spark, place).select(sidecars.below(F.col("path"), place).alias("path"), F.md5("html").alias("html_md5"))
    # a sort of all paths, numbered by the rows before each range of them
    places = files.select("path").orderBy("path").select("path", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33))
    sizes = places.groupBy("part").agg(F.count(F.lit(1)).alias("size")).selectExpr("part", "coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    numbered = places.join(sizes, "part").select("path", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("n"))
    return files.join(numbered, "path").select("n", "path", "html_md5", F.lit(readers.choose_input([], "wic")[0]).alias("chosen"))


@register("files_s33_refresh_counts", """
    SELECT (SELECT count(*) FROM pages) AS html_files, (SELECT count(*) FROM pages WHERE page_id % 2 = 0) AS markdown_files, (SELECT sum(page_id % 5)::BIGINT FROM pages) AS pages, (SELECT sum(page_id % 13)::BIGINT FROM pages) AS chunks""")
def refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh left: its files, and the pages and chunks of its log."""
    place = work_dir(spark, "refreshed")
    _written_pages(spark, sf_dir, place)
    log = table(spark, sf_dir, "pages").select(F.format_string("split into %d pages; %d chunks", F.col("page_id") % 5, F.col("page_id") % 13).alias("value"))
    return readers.refresh_counts(log, readers.html_folder(spark, place), readers.text_files(spark, place, "*.md"))
