"""Lookups, projections, thread stores and request streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.functions import strings as S
from quillstone.operators import conversations as C
from quillstone.operators import documents as D
from quillstone.operators import evaluation as E
from quillstone.operators import relational as R
from quillstone.streaming import stateful
from quillstone.streaming.run import drain, file_stream

_UNIWORDS = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: w <> '')"


@register("p06_session_by_key", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup: the key reaches the scan."""
    return table(spark, sf_dir, "conversations").where("conv_id = 7").select("conv_id", "turn", "role")


@register("p08_exported_threads", "SELECT conv_id, count(*) FILTER (conv_id % 11 <> 0) AS n_steps FROM conversations WHERE conv_id % 11 <> 0 AND (conv_id % 7 = 0 OR conv_id % 5 <> 0) GROUP BY conv_id")
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eleventh thread has no steps, each fifth is tagged, each seventh has no list of tags at all."""
    key = F.col("conv_id")
    steps = F.when(key % 11 != 0, F.collect_list("turn")).otherwise(F.array().cast("array<bigint>"))
    tags = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.array(F.lit("chainlit"))).otherwise(F.array().cast("array<string>"))
    threads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(steps.alias("steps")).withColumn("tags", tags.cast("array<string>"))
    return C.exportable(threads).select("conv_id", F.size("steps").cast("long").alias("n_steps"))


@register("p10_citation_projection", f"""
    WITH w AS (SELECT doc_id, lang, source, 'http://h.org/' || doc_id AS url, {_UNIWORDS.format('text')} AS words, text FROM documents)
    SELECT 'citation-' || doc_id AS citation_id, doc_id::VARCHAR AS source_id, 'Doc ' || doc_id AS source_name, source AS source_dataset, NULL::INT AS page_number,
           url || '#:~:text=' || array_to_string(words[1:5], '%20') || ',' || array_to_string(words[greatest(len(words) - 4, 1):len(words)], '%20') AS uri, lang AS headings, md5(text) AS citation_text FROM w""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        key.alias("subsection_id"), key.alias("document_id"), F.concat(F.lit("Doc "), key).alias("document_name"), F.col("source").alias("dataset"), F.lit(None).cast("int").alias("page_number"),
        F.concat(F.lit("http://h.org/"), key).alias("document_source"), F.array("lang").alias("text_headings"), "text",
    )
    c = rows.select(C.citation().alias("c")).select("c.*")
    return c.withColumn("headings", F.array_join("headings", ">")).withColumn("citation_text", F.md5("citation_text"))


@register("p11_retrieval_metadata", """
    SELECT conv_id, 'sys' AS system_prompt, count(*) AS n_chunks, list('d' || role ORDER BY turn)[1] AS first_document, list(conv_id || ':' || turn ORDER BY turn)[1] AS first_chunk, list(text ORDER BY turn)[1] AS raw_response FROM conversations GROUP BY conv_id""")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a retrieval beside an answer, as one nested value; a few of its fields are shown."""
    chunk_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), chunk_id.alias("chunk_id"), F.concat(F.lit("d"), "role").alias("document_name"), F.lit(1.0).alias("score"), "text")
    m = C.retrieval_metadata(rows, "conv_id", F.lit("sys"), F.first("text"))
    first = F.get("m.chunks", F.lit(0))
    raw = F.get("m.subsections", F.lit(0))["text"]
    return m.select("conv_id", "m.system_prompt", F.size("m.chunks").cast("long").alias("n_chunks"), first["document_name"].alias("first_document"), first["chunk_id"].alias("first_chunk"), raw.alias("raw_response"))


@register("t09_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: the first five hundred by id."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(500)


@register("p03_dataset_labels", """
    WITH d AS (SELECT doc_id, ['CA_FTB', 'ca_public_charge', 'ca_wic', 'Covered_CA', 'edd', 'irs', 'la_policy', 'ssa', 'imagine_la', 'Other'][(doc_id % 10 + 1)::INT] AS name FROM documents)
    SELECT doc_id, name, ['CA FTB', 'Keep Your Benefits', 'WIC', 'Covered California', 'CA EDD', 'IRS', 'DPSS Policy', 'SSA', 'imagine_la', 'Other'][(doc_id % 10 + 1)::INT] AS label FROM d""")
def dataset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of commands and what they stand for; a name that isn't known stays."""
    names = ["CA_FTB", "ca_public_charge", "ca_wic", "Covered_CA", "edd", "irs", "la_policy", "ssa", "imagine_la", "Other"]
    name = F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 10).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("label", E.dataset_label(F.col("name")))


@register("f02_resolved_with_port", "SELECT page_id, 'see [q](http://h' || page_id || '.org:' || (8000 + page_id % 90) || '/q)' AS md FROM pages")
def with_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.format_string("http://h%d.org:%d/deep/page", F.col("page_id"), 8000 + F.col("page_id") % 90)
    return table(spark, sf_dir, "pages").select("page_id", S.resolve_urls(base, F.lit("see [q](/q)")).alias("md"))


@register("f19_masked_log_values", "SELECT event_id, '1' || lpad((event_id % 100000000)::VARCHAR, 8, '0') AS created, 'user *********, ' || event_type AS msg, 'é*********' AS name FROM events")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine digits stay under a key that is known to be safe, and go elsewhere, letters beyond ASCII beside them or not."""
    digits = F.concat(F.lit("1"), F.lpad((F.col("event_id") % 100000000).cast("string"), 8, "0"))
    record = F.create_map(F.lit("created"), digits, F.lit("msg"), F.concat(F.lit("user "), digits, F.lit(", "), "event_type"), F.lit("name"), F.concat(F.lit("é"), digits))
    rows = table(spark, sf_dir, "events").select("event_id", S.masked_values(record).alias("m"))
    return rows.select("event_id", *[F.col("m")[k].alias(k) for k in ("created", "msg", "name")])


@register("f05_char_diffs", "SELECT doc_id, 3 AS added, length(source)::INT AS removed FROM documents WHERE source IS NOT NULL")
def char_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's name against three characters that it lacks."""
    d = S.char_diffs(F.col("source"), F.lit("#%&"))
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", d.alias("d")).select("doc_id", "d.*")


@register("text_f05_count_diffs", "SELECT doc_id, 3 AS added, 0 AS removed FROM documents WHERE source IS NOT NULL")
def counted_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the engine that is matched counts it."""
    d = S.count_diffs(F.col("source"), F.lit("#%&"))
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", d.alias("d")).select("doc_id", "d.*")


@register("f35_sentences_by_marks", "SELECT item_id, unnest(['Dr. No ' || item_id || ' paid 3.50 at shop.com.', 'Why?', 'It is so!']) AS sentence FROM benchmark")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("Dr. No %d paid 3.50 at shop.com. Why? It is so!", F.col("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.marked_sentences(said)).alias("sentence"))


@register("r02_r03_basic_subsections", """
    SELECT doc_id, unnest([0, 1, 2])::INT AS subsection_index, unnest([source, 'between ' || lang, 'last']) AS text, unnest(['top>' || lang, 'top>' || lang || '>deep', 'top>new']) AS headings FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def basic_subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches between blank lines below the headings that stand over them."""
    md = F.concat(F.lit("# "), "lang", F.lit("\n\n"), "source", F.lit("\n\n### deep\n\nbetween "), "lang", F.lit("\n\n# new\n\nlast"))
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", D.basic_subsections(md, F.array(F.lit("top"))).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("subsection_index", "x")).select("doc_id", "subsection_index", "x.text", F.array_join("x.headings", ">").alias("headings"))


@register("l07_thread_store", "SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN 'renamed' ELSE 'thread ' || conv_id END AS name FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 <> 0) ORDER BY conv_id DESC LIMIT 20 OFFSET 20")
def thread_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of a store: each fourth is deleted, the next renamed, and the second page of twenty is listed, latest first."""
    threads = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("name", F.concat(F.lit("thread "), F.col("conv_id").cast("string")))
    changed = threads.where("conv_id % 4 = 1").select("conv_id", F.lit("renamed").alias("name"))
    left = R.deleted(R.upsert(threads, changed, "conv_id"), threads.where("conv_id % 4 = 0"), "conv_id")
    return R.page(left, [F.desc("conv_id")], 2, 20)[0]


@register("l10_canned_answers_as_streams", "SELECT event_id AS message_id, 'canned ' || event_type AS response FROM events WHERE event_type = 'click'")
def canned_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that stands ready is a stream of one part, and is put together like any other."""
    ready = file_stream(spark, f"{sf_dir}/events.parquet").where("event_type = 'click'")
    parts = ready.select(F.col("event_id").alias("message_id"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("canned "), "event_type").alias("text"), F.lit(True).alias("done"))
    return stateful.drained_responses(parts, tag="canned")


@register("x04_two_step_requests", "SELECT q.conv_id, q.turn, 'answer to ' || q.text AS answer FROM conversations q WHERE q.role = 'user'")
def two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's first step stores its question; its second, a stream of message ids, reads it and answers."""
    stored = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    asked = file_stream(spark, f"{sf_dir}/conversations.parquet").where("role = 'user'").select("conv_id", "turn")
    answered = asked.join(stored, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("answer to "), "text").alias("answer"))
    return drain(answered, "requests")
