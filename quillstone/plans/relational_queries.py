"""Joins, windows, dedup, upsert, paging and conversations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.operators import relational as R


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5("text").alias("name"), F.col("source").alias("dataset"), F.lit("all").alias("program"), F.col("lang").alias("region"), F.col("source"))


@register("j02_documents_with_chunks", "SELECT label, count(vec_id) AS n_chunks, min(vec_id) AS first_chunk FROM embeddings GROUP BY label")
def documents_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    docs = e.select("label").distinct()
    lists = e.groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("chunks"))
    return docs.join(lists, "label", "left").select("label", F.size("chunks").cast("long").alias("n_chunks"), F.get("chunks", F.lit(0)).alias("first_chunk"))


@register("j03_s13_resume_anti_join", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'en' AND o.source = d.source AND o.lang = d.lang)")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return R.resume(docs, docs.where("region = 'en'")).select("doc_id")


@register("j04_semi_join", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("j05_backfill_parents", """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL
    SELECT DISTINCT o_custkey, 'unknown' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are the customers with even keys; orders bring the others back."""
    parents = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.backfill_parents(children, parents, "c_custkey", {"c_name": F.lit("unknown")})


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    me = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parent = F.when(F.col("role") == "assistant", F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
    return c.select(F.col("conv_id").alias("thread_id"), "turn", "role", "text", me.alias("id"), parent.alias("parent_id"))


_STEPS = "steps AS (SELECT conv_id AS thread_id, turn, role, text, conv_id || '-' || turn AS id, CASE WHEN role = 'assistant' THEN conv_id || '-' || (turn - 1) END AS parent_id FROM conversations)"


@register("j06_e09_question_answer_pairs", f"WITH {_STEPS} SELECT q.thread_id, q.id AS question_id, a.id AS answer_id, q.text AS question, a.text AS answer FROM steps q JOIN steps a ON a.parent_id = q.id AND a.thread_id = q.thread_id")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    text = steps.select("thread_id", "id", "text")
    p = R.links_between(steps)
    p = p.join(text.select("thread_id", F.col("id").alias("question_id"), F.col("text").alias("question")), ["thread_id", "question_id"])
    return p.join(text.select("thread_id", F.col("id").alias("answer_id"), F.col("text").alias("answer")), ["thread_id", "answer_id"]).select("thread_id", "question_id", "answer_id", "question", "answer")


@register("j07_dangling_steps", f"""WITH {_STEPS}, p AS (SELECT q.id AS a, a.id AS b FROM steps q JOIN steps a ON a.parent_id = q.id AND a.thread_id = q.thread_id)
    SELECT id, thread_id FROM steps WHERE id NOT IN (SELECT a FROM p) AND id NOT IN (SELECT b FROM p)""")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    return R.dangling(steps, R.links_between(steps)).select("id", "thread_id")


@register("j08_t02_chat_history", "SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10)) AS history FROM conversations GROUP BY conv_id")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return turns.select("conv_id", F.array_join(F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


@register("j13_a13_string_aggregation", "SELECT r_name, array_to_string(list(n_name ORDER BY n_name), ',') AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY r_name")
def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@register("j14_tree_build", """
    WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth, turn::VARCHAR AS path FROM conversations WHERE turn = (SELECT min(turn) FROM conversations)
    UNION ALL SELECT c.conv_id, c.turn, t.depth + 1, t.path || '/' || c.turn FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, depth, path FROM t""")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a child of the one before; a recursive query gives depths and paths."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("qs_turns")
    return spark.sql("""
        WITH RECURSIVE t(conv_id, turn, depth, path) AS (
            SELECT conv_id, turn, 0, cast(turn AS string) FROM qs_turns WHERE turn = (SELECT min(turn) FROM qs_turns)
            UNION ALL SELECT c.conv_id, c.turn, t.depth + 1, concat(t.path, '/', c.turn) FROM t JOIN qs_turns c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
        SELECT conv_id, turn, depth, path FROM t""")


@register("w04_split_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS split_index, count(*) OVER (PARTITION BY conv_id) AS num_splits FROM conversations")
def split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).cast("long").alias("split_index"), F.count(F.lit(1)).over(w).alias("num_splits"))


@register("w05_u07_first_wins_dedup", "SELECT doc_id, md5(text) AS name FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_by(_docs(spark, sf_dir), ["name"], ["doc_id"]).select("doc_id", "name")


@register("w06_t03_latest_message", "SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, arg_max(role, turn) = 'user' AS waits FROM conversations GROUP BY conv_id")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role"), "turn").alias("m"))
    return c.select("conv_id", "m.turn", "m.role", (F.col("m.role") == "user").alias("waits"))


@register("w07_previous_element", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@register("w10_runs", """
    WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), n AS (SELECT *, sum((was IS DISTINCT FROM event_type)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
    SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM n GROUP BY user_id, run""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    e = e.withColumn("was", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("at")))
    found = R.islands(e, ["user_id"], "at", F.col("was") == F.col("event_type"), "run")
    return found.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@register("w11_nearest_preceding", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_turn FROM conversations")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("question_turn"))


@register("w12_x02_throttled_events", """
    SELECT event_id, n AS occurrence FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)::INT AS n FROM events)
    WHERE n <= 10 OR (n <= 100 AND n % 10 = 0) OR n % 100 = 0""")
def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.throttle(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_id", "occurrence")


@register("s21_bulk_upsert", """
    SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'new', c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return R.upsert(c.where("c_custkey % 2 = 0"), new, "c_custkey", fixed=("c_name",))


@register("l06_feedback_upsert", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS value FROM labels")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))
    return R.upsert(old, old.where("doc_id % 5 = 0").select("doc_id", (F.col("value") == 0).cast("int").alias("value")), "doc_id")


@register("t04_t05_page", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25, the feature being the page."""
    return R.page(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 3)[0]


@register("p04_time_range", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 2 DAY FROM events) AND user_id IN (1, 2, 3, 4, 5)")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").alias("t0"))
    return e.join(F.broadcast(start)).where("ts >= t0 + interval 1 day and ts < t0 + interval 2 day").where(F.col("user_id").isin(1, 2, 3, 4, 5)).select("event_id")


@register("p05_untagged_events_of_users", """
    WITH t AS (SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events), g AS (SELECT event_id, user_id, CASE WHEN k % 3 = 0 THEN 'third ' || k END AS tags FROM t)
    SELECT event_id FROM g WHERE user_id IN (1, 2, 3, 4, 5) AND tags IS NULL""")
def untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags come of props: a third of its values has one."""
    k = F.from_json("props", "k long")["k"]
    tags = F.when(k % 3 == 0, F.concat(F.lit("third "), k.cast("string")))
    e = table(spark, sf_dir, "events").withColumn("tags", tags)
    return e.where(F.col("user_id").isin(1, 2, 3, 4, 5) & F.col("tags").isNull()).select("event_id")


@register("p07_a17_sources_with_content", "SELECT lang, array_to_string(list(DISTINCT source ORDER BY source), ',') AS sources FROM documents WHERE text IS NOT NULL AND length(text) > 0 GROUP BY lang")
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.length("text") > 0))
    return d.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@register("p09_l01_raw_chat_history", "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN coalesce(nullif(trim(text), ''), 'none') ELSE text END AS content FROM conversations WHERE role <> 'system'")
def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("role") == "assistant", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("none"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", content.alias("content"))


@register("p12_like_filters", "SELECT n_name FROM nation WHERE n_name LIKE 'I%' AND n_name NOT LIKE '%N'")
def like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where(F.col("n_name").like("I%") & ~F.col("n_name").like("%N")).select("n_name")


@register("p16_rows_as_json", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS row_json FROM nation""")
def as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row_json"))


@register("p17_tags_by_user", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tag FROM events")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.createDataFrame([(0, "even"), (1, "odd")], "parity long, tag string")
    return table(spark, sf_dir, "events").withColumn("parity", F.col("user_id") % 2).join(F.broadcast(users), "parity").select("event_id", "tag")


@register("p18_special_commands", "SELECT conv_id, turn, lower(trim(text)) AS command FROM conversations")
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.functions.strings import special_command

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", special_command(F.col("text"))["command"].alias("command"))


@register("a12_e08_union_of_columns", "SELECT 'n' AS kind, n_name AS name, n_regionkey AS region, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT 'c', c_name, NULL, c_mktsegment FROM customer")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit("n").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return n.unionByName(c, allowMissingColumns=True)


@register("a14_s24_row_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "events", "conversations")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("a16_distinct_datasets", "SELECT DISTINCT source AS dataset, lang FROM documents")
def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "lang").distinct()


@register("a18_a19_ordered_groups", """SELECT conv_id, role, array_to_string(list(text ORDER BY turn), chr(10) || chr(10)) AS joined, min(turn) AS first_turn, bool_or(length(text) > 200) AS any_long FROM conversations GROUP BY conv_id, role""")
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.min("turn").alias("first_turn"), F.bool_or(F.length("text") > 200).alias("any_long"))
    return g.select("conv_id", "role", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("joined"), "first_turn", "any_long")


@register("u01_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@register("u02_u03_u08_set_operations", """
    WITH s AS (SELECT lang, list(DISTINCT source) AS have FROM documents GROUP BY lang)
    SELECT lang, array_to_string(list_sort(list_filter(have, lambda x: x NOT IN ('src1', 'src2'))), ',') AS rest, array_to_string(list_sort(list_filter(have, lambda x: x IN ('src1', 'none'))), ',') AS allowed FROM s""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set("source").alias("have"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return s.select("lang", F.array_join(F.sort_array(F.array_except("have", lit("src1", "src2"))), ",").alias("rest"), F.array_join(F.sort_array(F.array_intersect("have", lit("src1", "none"))), ",").alias("allowed"))


@register("r12_j09_passages_in_documents", """
    SELECT item_id, doc_id FROM (SELECT item_id, regexp_replace(text, '[\\s-]+', '', 'g') AS b FROM benchmark) JOIN (SELECT doc_id, regexp_replace(text, '[\\s-]+', '', 'g') AS d FROM documents) ON contains(d, b)""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment has no key: the passages, a small table whose size is checked, go to every task."""
    bare = lambda c: F.regexp_replace(c, r"[\s-]+", "")
    b = table(spark, sf_dir, "benchmark").select("item_id", bare("text").alias("b"))
    d = table(spark, sf_dir, "documents").select("doc_id", bare("text").alias("d"))
    return R.containing(d, "d", b, "b").select("item_id", "doc_id")


@register("x_orders_by_nation", "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relational query beside the reference's own."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("x_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
