"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import register, table
from quillstone.functions import strings as S
from quillstone.operators.sentences import abbreviations, split_list, split_paragraph, with_sentences

_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"
_UNIWORDS = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: w <> '')"


@register("f01_remove_links", "SELECT page_id, regexp_replace('see [' || url || '](' || url || ') and [x](y)', '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g') AS plain FROM pages")
def remove_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.remove_links(F.concat(F.lit("see ["), url, F.lit("]("), url, F.lit(") and [x](y)"))).alias("plain"))


@register("f02_resolve_urls", """
    SELECT page_id, 'a [x](' || regexp_extract(url, '^(https?://[^/]+)', 1) || '/q) b [y](http://z.org) c [z](' || CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END || 'rel)' AS md FROM pages""")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.lit("a [x](/q) b [y](http://z.org) c [z](rel)")
    return table(spark, sf_dir, "pages").select("page_id", S.resolve_urls(F.col("url"), md).alias("md"))


@register("f03_highlighted_uri", f"""
    WITH w AS (SELECT doc_id, 'http://a.b/' || doc_id || '/' AS url, {_UNIWORDS.format('text')} AS words FROM documents)
    SELECT doc_id, regexp_replace(url, '/$', '') || '#:~:text=' || array_to_string(words[1:5], '%20') || ',' || array_to_string(words[greatest(len(words) - 4, 1):len(words)], '%20') AS uri FROM w""")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("http://a.b/"), F.col("doc_id").cast("string"), F.lit("/"))
    return table(spark, sf_dir, "documents").select("doc_id", S.highlighted_uri(url, F.col("text")).alias("uri"))


@register("f04_basic_ascii", "SELECT doc_id, md5(regexp_replace(text, '[^ -~]', ' ', 'g')) AS ascii_md5 FROM documents")
def basic_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.basic_ascii(F.col("text"))).alias("ascii_md5"))


@register("f06_join_list", "SELECT conv_id, coalesce(array_to_string(list(text ORDER BY turn), chr(10)), '') AS joined FROM conversations GROUP BY conv_id")
def join_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", S.join_list(F.transform("t", lambda x: x["text"])).alias("joined"))


@register("f07_content_hash", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


_UUID = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@register("f08_f09_qa_pair_ids", f"""
    SELECT item_id, {_UUID.format("text || '||' || item_id")} AS id_v1, CASE WHEN item_id % 2 = 0 THEN 'given-' || item_id ELSE {_UUID.format("'ds||' || text || '||' || item_id")} END AS id_v2 FROM benchmark""")
def qa_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id").cast("string")
    given = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("given-"), item)).otherwise("")
    return table(spark, sf_dir, "benchmark").select("item_id", S.uuid_of(F.col("text"), item).alias("id_v1"), S.qa_pair_id(given, F.lit("ds"), F.col("text"), item).alias("id_v2"))


@register("f11_f12_headings", """
    SELECT doc_id, '# ' || source || chr(10) || '### ' || lang AS md, 3 AS level, lang AS heading FROM documents""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", S.headings_markdown(F.array("source", F.lit(""), "lang")).alias("md"))
    parsed = S.parse_heading(F.get(F.split("md", "\n"), F.lit(1)))
    return docs.select("doc_id", "md", parsed["level"].alias("level"), parsed["text"].alias("heading"))


@register("f18_table_separators", "SELECT item_id, '| a | b |' || chr(10) || '| --- | --- | ' || chr(10) || '| ' || item_id || ' | x |' AS md FROM benchmark")
def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("| a | b |\n| -------- | ------------ |\n| "), F.col("item_id").cast("string"), F.lit(" | x |"))
    return table(spark, sf_dir, "benchmark").select("item_id", S.separators(md).alias("md"))


@register("f19_mask_tax_ids")
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-around has no form in the oracle's dialect; tests hold this against a plain version."""
    masked = S.mask_tax_ids(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked"), (masked != F.col("text")).alias("changed"))


@register("f21_breadcrumb", "SELECT doc_id, CASE WHEN source = 'src1' THEN lang ELSE source || ' → ' || lang END AS crumbs FROM documents")
def breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.breadcrumb(F.array(F.lit("top"), F.lit(""), "source", "lang"), F.lit("src1")).alias("crumbs"))


@register("f22_file_path", "SELECT page_id, 'out/' || regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '^/', '') || CASE WHEN url LIKE '%/' THEN '_index' ELSE '' END AS path FROM pages")
def file_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace("url", "^https?://[^/]*", "")
    return table(spark, sf_dir, "pages").select("page_id", S.file_path(F.lit("out"), "", rest).alias("path"))


@register("f23_f24_dates", """
    SELECT event_id, strftime(ts, '%m/%d/%Y') AS us_date, CAST(ts AS DATE) AS day FROM events""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.us_date(F.col("ts")).alias("us_date"), F.to_date("ts").alias("day"))


@register("f25_simple_list", "SELECT label, CASE WHEN count(*) = 1 THEN min(vec_id)::VARCHAR ELSE '[' || array_to_string(list(vec_id::VARCHAR ORDER BY vec_id), ', ') || ']' END AS items FROM embeddings GROUP BY label")
def simple_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("v"))
    return e.select("label", S.simple_list(F.transform("v", lambda x: x.cast("string"))).alias("items"))


@register("f26_query_value", "SELECT page_id, 'a b' AS first_value FROM pages")
def query_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?k=a%20b&z=1&k=c"))
    return table(spark, sf_dir, "pages").select("page_id", S.query_value(url, "k").alias("first_value"))


@register("f27_first_line", "SELECT conv_id, turn, split_part(replace(trim(text), chr(13) || chr(10), chr(10)), chr(10), 1) AS thread_name FROM conversations")
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.first_line(F.col("text")).alias("thread_name"))


@register("f32_f33_mock_embedding", f"""
    WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents), m AS (SELECT doc_id, len(words) AS tokens, list_sum(list_transform(words, lambda x: length(x)))::DOUBLE / nullif(len(words), 0) AS mean FROM w)
    SELECT doc_id, tokens::INT AS tokens, round(coalesce(cos(1.5707963267948966 * mean), 0), 6) + 0.0 AS first, round(coalesce(sin(1.5707963267948966 * mean), 0), 6) + 0.0 AS second FROM m""")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", S.token_length(F.col("text")).alias("tokens"), S.mock_embedding(F.col("text"), 4).alias("v"))
    return docs.select("doc_id", "tokens", (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("v", F.lit(1)), 6) + 0.0).alias("second"))


_W = "greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1)::DOUBLE"
_N = "greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::DOUBLE"
_Y = "greatest(len(regexp_extract_all(lower(text), '[aeiouy]+')), 1)::DOUBLE"


@register("a20_readability", f"""
    WITH n AS (SELECT doc_id, {_W} AS w, {_N} AS s, {_Y} AS y, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE AS l,
               len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3))::DOUBLE AS h FROM documents),
    g AS (SELECT doc_id, 206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (y / w) AS ease, 0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE AS grade, 0.4::DOUBLE * (w / s + 100 * h / w) AS fog, 0.0588::DOUBLE * (100 * l / w) - 0.296::DOUBLE * (100 * s / w) - 15.8::DOUBLE AS coleman FROM n)
    SELECT doc_id, round(ease, 4) AS flesch_ease, round(grade, 4) AS flesch_kincaid, round(fog, 4) AS gunning_fog, round(coleman, 4) AS coleman_liau, round((grade + fog + coleman) / 3, 4) AS average_grade,
           (grade + fog + coleman) / 3 <= 12 AND ease >= 50 AS readable FROM g""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.readability(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[(c if k == "readable" else F.round(c, 4)).alias(k) for k, c in found.items()])


@register("p14_p15_titles", "SELECT doc_id, source || ': ' || lang AS title, coalesce(CASE WHEN lang = 'en' THEN text END, source) AS main FROM documents")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws(": ", "source", "lang").alias("title"), F.coalesce(F.when(F.col("lang") == "en", F.col("text")), F.col("source")).alias("main"))


@register("f36_f40_log_lines", "SELECT event_id, event_type || ' user=' || user_id || ' k=' || json_extract_string(props, '$.k') AS line FROM events WHERE event_type <> 'click'")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k string")["k"]
    lines = table(spark, sf_dir, "events").where("event_type <> 'click'")
    return lines.select("event_id", F.format_string("%s user=%s k=%s", F.col("event_type"), F.col("user_id").cast("string"), k).alias("line"))


@register("f39_audit_selection", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
def audit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


#: A piece of a line that has no room: its parts up to commas, semicolons and line breaks put together, or cut hard.
_FOLD = """list_reduce(list_prepend({{'pieces': []::VARCHAR[], 'piece': '', 'line': '', 'cut': []::VARCHAR[]}}, {items}), lambda s, e: CASE
    WHEN length(CASE WHEN s.piece <> '' THEN s.piece || {sep} || e.line ELSE e.line END) <= room THEN {{'pieces': s.pieces, 'piece': CASE WHEN s.piece <> '' THEN s.piece || {sep} || e.line ELSE e.line END, 'line': '', 'cut': []::VARCHAR[]}}
    WHEN length(e.line) < room THEN {{'pieces': CASE WHEN s.piece <> '' THEN list_append(s.pieces, s.piece) ELSE s.pieces END, 'piece': e.line, 'line': '', 'cut': []::VARCHAR[]}}
    ELSE {{'pieces': list_concat(CASE WHEN s.piece <> '' THEN list_append(s.pieces, s.piece) ELSE s.pieces END, e.cut), 'piece': '', 'line': '', 'cut': []::VARCHAR[]}} END)"""


@register("lists_f15_f16_pieces", f"""
    WITH t AS (SELECT conv_id, turn, string_split('The ' || role || ' says:' || chr(10) || text, chr(10)) AS lines FROM conversations WHERE text IS NOT NULL),
    r AS (SELECT conv_id, turn, lines[1] AS intro, 200 - length(lines[1]) - len(lines) AS room, unnest(lines[2:]) AS line, unnest(range(len(lines) - 1)) AS n FROM t),
    w AS (SELECT conv_id, turn, intro, room, n, line, list_transform(regexp_extract_all(line, '[,;\n]|[^,;\n]+'), lambda x: {{'pieces': []::VARCHAR[], 'piece': '', 'line': x, 'cut': list_transform(range(1, greatest(length(x), 1) + 1, room), lambda i: substr(x, i, room))}}) AS words FROM r),
    c AS (SELECT conv_id, turn, intro, room, n, line, {_FOLD.format(items='words', sep="''")} AS f FROM w),
    g AS (SELECT conv_id, turn, any_value(intro) AS intro, any_value(room) AS room, list({{'pieces': []::VARCHAR[], 'piece': '', 'line': line, 'cut': list_append(f.pieces, f.piece)}} ORDER BY n) AS items FROM c GROUP BY conv_id, turn),
    p AS (SELECT conv_id, turn, intro, {_FOLD.format(items='items', sep='chr(10)')} AS f FROM g)
    SELECT conv_id, turn, (i - 1)::INT AS pos, intro || chr(10) || list_append(f.pieces, f.piece)[i] AS piece FROM p, unnest(range(1, len(f.pieces) + 2)) AS u(i)""")
def list_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lists behind a line that tells who speaks, in pieces of at most 200 characters, each with that line."""
    said = F.concat(F.lit("The "), "role", F.lit(" says:\n"), "text")
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(split_list(said, 200)).alias("pos", "piece"))


@register("paragraphs_f14_f16_pieces")
def paragraph_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of at most 500 characters, by sentences as abbreviations of the whole corpus leave them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = with_sentences(docs, "text", abbreviations(docs, "text"), "doc_id")
    return cut.select("doc_id", F.posexplode(split_paragraph(F.col("sentences"), F.col("text"), 500)).alias("pos", "piece"))
