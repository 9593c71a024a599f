"""Sessions, prompts, answers and clean-up over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.functions import strings as S
from quillstone.operators import conversations as C
from quillstone.plans.document_queries import CITED_SQL, with_citations
from quillstone.plans.relational_queries import pairs


@register("l01_prepared_messages", """
    SELECT conv_id, turn, 'system|sys;' || CASE WHEN turn % 4 = 0 THEN 'system|Use the following context to answer the question: ctx;' ELSE '' END || 'user|' || text AS messages FROM conversations WHERE role = 'user'""")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    context = F.when(F.col("turn") % 4 == 0, "ctx")
    m = C.messages(F.lit("sys"), F.col("text"), context, F.lit(None).cast(f"array<{C.MESSAGE}>"))
    return asked.select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat_ws("|", x["role"], x["content"])), ";").alias("messages"))


@register("l03_routes", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'canned' WHEN value > 50 THEN 'context' ELSE 'plain' END AS route FROM events")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    canned = F.when(F.col("event_type") == "click", "ready").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", C.route(canned, F.col("value") > 50).alias("route"))


@register("l04_merged_metadata", "SELECT n_nationkey, 'a=new,b=' || n_name AS metadata FROM nation")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = F.create_map(F.lit("a"), F.lit("new")), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("n_name"))
    entries = F.sort_array(F.map_entries(C.merged_metadata(new, old)))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@register("l05_history_checks", """
    WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND n > 1 THEN 'a new session has a history' WHEN conv_id % 2 = 1 AND n <= 1 THEN 'an old session has no history' END AS error FROM s""")
def history_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) - 1).alias("past"))
    return s.select("conv_id", C.history_error(F.col("conv_id") % 2 == 0, F.col("past")).alias("error"))


@register("l08_user_ids", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'EMPTY_USER_ID' ELSE user_id::VARCHAR END AS user FROM events")
def user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("user_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", C.user_id(given).alias("user"))


@register("l09_settings", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 25 END AS k, -1.0::DOUBLE AS min_score FROM nation")
def engine_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("k"))
    return C.settings(given, {"k": 25, "min_score": -1.0}, "main", ["main", "other"])


_CITED = """
    c AS (SELECT doc_id AS answer_id, unnest([1, 2, 3]) AS n FROM documents),
    d AS (SELECT answer_id, n, n::VARCHAR AS citation_id, CASE WHEN n = 2 THEN 'B' ELSE 'A' END AS document, 't' || n AS text FROM c)"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    return rows.select("answer_id", "n", F.col("n").cast("string").alias("citation_id"), F.when(F.col("n") == 2, "B").otherwise("A").alias("document"), F.concat(F.lit("t"), F.col("n").cast("string")).alias("text"))


@register("a19_cited_documents", f"WITH {_CITED} SELECT answer_id, document, min(n) AS first, array_to_string(list(citation_id ORDER BY n), ',') AS label FROM d GROUP BY answer_id, document")
def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cited_documents(_cited(spark, sf_dir)).select("answer_id", "document", "first", "label")


@register("f30_accordions", """
    SELECT doc_id AS answer_id, '<div class="usa-accordion"><h4>1,3. A</h4><div><div>Citation #1: </div><div>t1</div>' || chr(10) || '<div>Citation #3: </div><div>t3</div></div></div>' || chr(10) || '<div class="usa-accordion"><h4>2. B</h4><div><div>Citation #2: </div><div>t2</div></div></div>' AS sources_html FROM documents""")
def accordions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accordions(C.cited_documents(_cited(spark, sf_dir)))


@register("f29_f30_linked_answers", rf"""SELECT item_id, regexp_replace({CITED_SQL.format(first='item_id')}, ' ?\(citation-(\d+)\)', '<sup><a href="#citation-\1">\1</a></sup>', 'g') AS html FROM benchmark""")
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = with_citations(F.col("text"), F.col("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id", C.linked_answer(said).alias("html"))


@register("f20_edd_fixes", "SELECT item_id, 'a...' || chr(10) || '    + New' || chr(10) || ' Tab' || chr(10) || chr(10) || item_id AS md FROM benchmark")
def edd_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("a. . .\n* + New\n* ### Tab\n4. * \n"), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", S.edd_fixes(md).alias("md"))


@register("f29_list_repairs", "SELECT item_id, 'Text:' || chr(10) || chr(10) || '* one' || chr(10) || '    - inner ' || item_id AS md FROM benchmark")
def list_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("Text:\n* one\n  * inner "), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", S.list_repairs(md).alias("md"))


@register("h10_policy_cleanup", "SELECT item_id, '1. One' || chr(10) || 'a' || chr(10) || chr(10) || '**_Note_** ' || item_id AS md FROM benchmark")
def policy_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("* 1. One\n~~~~a\n--- \n\n\n * ** _Note_** "), F.col("item_id").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "benchmark").select("item_id", S.policy_cleanup(md).alias("md"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')"


def _shaped(spark: SparkSession, sf_dir: str, shape: Callable[[Column, Column], Column]) -> DataFrame:
    """Turns whose lines, blank ones apart, are shaped by their number from 0."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(lines, shape), "\n").alias("md"))


@register("texts_f20_edd_fixes", f"""
    SELECT conv_id, turn, array_to_string(list_transform({_LINES}, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '    + ' WHEN 1 THEN ' ' ELSE '...' END || x || '!'), chr(10)) AS md FROM conversations""")
def fixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns as sublists without a list, headings as items, and behind spaced dots; a mark behind each, as a line of two short sentences is an empty item."""
    rows = _shaped(spark, sf_dir, lambda x, i: F.concat(F.when(i % 3 == 0, "* + ").when(i % 3 == 1, "* ### ").otherwise(". . ."), x, F.lit("!")))
    return rows.withColumn("md", S.edd_fixes(F.col("md")))


@register("texts_f29_list_repairs", f"""
    SELECT conv_id, turn, array_to_string(list_transform({_LINES}, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN x || CASE WHEN i < len({_LINES}) THEN chr(10) ELSE '' END WHEN 1 THEN '* ' || x ELSE '    - ' || x END), chr(10)) AS md FROM conversations""")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns as paragraphs, items right below them, and items of inner lists."""
    rows = _shaped(spark, sf_dir, lambda x, i: F.concat(F.when(i % 3 == 0, "").when(i % 3 == 1, "* ").otherwise("  * "), x))
    return rows.withColumn("md", S.list_repairs(F.col("md")))


@register("texts_h10_policy_cleanup", f"""
    SELECT conv_id, turn, regexp_replace(array_to_string(list_transform({_LINES}, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '1. ' || x ELSE x END), chr(10)), '^\\s+|\\s+$', '', 'g') AS md FROM conversations""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns behind bullets before numbers, fences, and rules."""
    rows = _shaped(spark, sf_dir, lambda x, i: F.concat(F.when(i % 3 == 0, "* 1. ").when(i % 3 == 1, "~~~~").otherwise("--- \n"), x))
    return rows.withColumn("md", S.policy_cleanup(F.col("md")))


@register("texts_f26_query_values", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a ' || page_id || '&' END AS value FROM pages")
def query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of urls of which each second one has a key twice, its first value; none of the others."""
    i = F.col("page_id").cast("string")
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?z="), i, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&k=a%20"), i, F.lit("%26&k=c"))).otherwise(F.lit("&kk=no")))
    return table(spark, sf_dir, "pages").select("page_id", S.query_value(url, "k").alias("value"))


@register("h03_without_anchors", "SELECT item_id, text AS md FROM benchmark")
def without_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a text as a link to a part or a pane, by turns of the rows."""
    md = F.regexp_replace(F.col("text"), F.lit(r"(\S+)"), F.when(F.col("item_id") % 2 == 0, "[$1](#collapse-1)").otherwise("[$1](#pane-2)"))
    return table(spark, sf_dir, "benchmark").select("item_id", S.without_anchors(md).alias("md"))


@register("f34_header_parts", "SELECT n_nationkey, n_nationkey::VARCHAR AS page, '1-2-2020' AS day, (100 + n_nationkey)::VARCHAR AS section FROM nation")
def header_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = lambda *c: F.concat(*[x.cast("string") for x in c])
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", S.page_number(text(n, F.lit(" of 30"))).alias("page"), S.header_date(F.lit("on 1-2-2020")).alias("day"), S.section_number(text(F.lit("BEM "), n + 100)).alias("section")
    )


@register("f38_s32_links_and_names", "SELECT page_id, 'http://t.org/x/' || page_id AS link, 'f' || page_id || '.html' AS name, 's3://b/d/f' || page_id || '.md' AS renamed, 'b' AS bucket, 'd/f' || page_id || '.html' AS key FROM pages")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    path = F.concat(F.lit("s3://b/d/f"), i, F.lit(".html"))
    parts = S.bucket_and_key(path)
    return table(spark, sf_dir, "pages").select("page_id", S.thread_link("http://t.org/x/", i).alias("link"), S.file_name(path).alias("name"), S.with_extension(path, ".md").alias("renamed"), parts["bucket"].alias("bucket"), parts["key"].alias("key"))


@register("e09_s27_export_rows", """
    SELECT q.conv_id::VARCHAR AS "User ID", '01/02/2024' AS "Date", q.text AS "Question", a.text AS "Response", q.conv_id::VARCHAR AS "Thread ID", CASE WHEN q.turn > 0 THEN 'True' ELSE 'False' END AS "Has Chat History", '1.0' AS "Feedback Scores"
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select(
        F.col("thread_id").alias("user_id"), F.lit("2024-01-02").cast("timestamp").alias("ts"), "question", "answer", "thread_id", F.split("question_id", "-")[1].cast("int").alias("turn"), F.array(F.lit(1.0)).alias("scores")
    )
    return C.export_rows(p)


@register("e08_batch_answers", """SELECT conv_id, turn, text AS question, 'about ' || length(text) AS answer, 'Doc' AS citation_1_name, 'A > B' AS citation_1_headings, 'src' AS citation_1_source, 'cited' AS citation_1_text, '1' AS attrib__n FROM conversations WHERE role = 'user'""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn's question, in the order of conversations and turns."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("pos"), F.col("text").alias("question"))

    def engine(question: str) -> dict:
        return {"answer": f"about {len(question)}", "citations": [{"name": "Doc", "headings": ["A", "B"], "source": "src", "text": "cited"}], "attributes": {"n": 1}}

    return C.wide(C.batch_answers(asked, engine)).select("pos.*", "*").drop("pos")


@register("j15_zipped_lists", "SELECT label, unnest(list(vec_id ORDER BY vec_id)) AS vec_id, unnest(list(md5(vec_id::VARCHAR) ORDER BY vec_id)) AS hash FROM embeddings GROUP BY label")
def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    lists = lists.withColumn("hashes", F.transform("ids", lambda i: F.md5(i.cast("string"))))
    return lists.select("label", F.explode(F.arrays_zip("ids", "hashes")).alias("z")).select("label", F.col("z.ids").alias("vec_id"), F.col("z.hashes").alias("hash"))


@register("j11_cited_lookup", """
    SELECT conv_id, turn, q.n AS number, n_name FROM (SELECT conv_id, turn, unnest([turn % 25, (turn + 1) % 40]) AS n FROM conversations) q JOIN nation ON n_nationkey = q.n""")
def cited_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in a text joined to what they name; unknown ones fall out."""
    text = F.concat(F.lit("(citation-"), (F.col("turn") % 25).cast("string"), F.lit(") (citation-"), ((F.col("turn") + 1) % 40).cast("string"), F.lit(")"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(text, F.lit(r"citation-(\d+)"), F.lit(1))).alias("c"))
    n = table(spark, sf_dir, "nation")
    return rows.withColumn("number", F.col("c").cast("long")).join(n, F.col("number") == n["n_nationkey"]).select("conv_id", "turn", "number", "n_name")


@register("a07_a15_totals", "SELECT count(*) AS pages, sum(CASE WHEN length(html) > 0 THEN 1 ELSE 0 END)::BIGINT AS full_pages, round(avg(length(html)), 4) AS mean_length FROM pages")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length("html") > 0).alias("full_pages"), F.round(F.avg(F.length("html")), 4).alias("mean_length"))
