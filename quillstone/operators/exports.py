"""Threads as question-answer rows with all fifteen columns, from nested metadata of their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.strings import us_date
from quillstone.operators.conversations import exportable

#: The columns of an export, in order.
EXPORT_COLUMNS = [
    "User ID", "Date", "Question", "Response", "LiteralAI Thread", "Agency ID", "Session ID", "Program", "Citation Links", "Citation Sources",
    "Has Chat History", "Thread ID", "Timestamp", "Feedback Scores", "Feedback Comments",
]
CITATIONS = "array<struct<uri:string,source_dataset:string,source_name:string>>"


def _needed(value: Column, ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _quoted(text: Column) -> Column:
    """A text as Python shows it within a list."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    plain = F.replace(plain, F.lit("\t"), F.lit("\\t"))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.when(F.contains(text, F.lit("'")), single).otherwise(F.concat(F.lit("'"), plain, F.lit("'"))))


def simplified(items: Column, shown: Column, quoted: Column) -> Column:
    """Nothing for no items, the one as it is, or a list of them."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, "").when(F.size(items) == 1, F.get(shown, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def qa_rows(threads: DataFrame, steps: DataFrame, project: str, link: str) -> DataFrame:
    """One row for each answer with its question: the fields of an export, by names of their own.

    ``threads``: id, tags, steps (anything with a size); those without steps and those of the tagged front end are left
    out. ``steps``: thread_id, id, parent_id, type, start_time, output and metadata as JSON texts, scores as an array of
    (value, comment). A step with a parent is an answer to it; a parent that isn't in the thread pairs with nothing.
    Steps of the wrong type, questions or answers without content or metadata, and a question with two answers are
    errors. Null comments are empty; citations may lack a dataset or a name, attributes and citations may be missing.
    """
    kept = exportable(threads).select(F.col("id").alias("thread_id"))
    own = steps.join(kept, "thread_id", "left_semi")
    fields = ["type", "start_time", "output", "metadata", "scores"]
    as_ = lambda side: [F.col(f).alias(f"{side}_{f}") for f in fields]
    questions = own.select("thread_id", F.col("id").alias("question_id"), *as_("q"))
    answers = own.where(F.col("parent_id").isNotNull()).select("thread_id", F.col("parent_id").alias("question_id"), F.col("id").alias("answer_id"), *as_("a"))
    rows = questions.join(answers, ["thread_id", "question_id"])
    answered = F.count(F.lit(1)).over(Window.partitionBy("thread_id", "question_id"))
    q, a = F.try_parse_json("q_metadata"), F.try_parse_json("a_metadata")
    text = lambda v, path: F.try_variant_get(v, path, "string")
    said = lambda side: text(F.try_parse_json(f"{side}_output"), "$.content")
    rows = rows.withColumns({"n_answers": answered, "q": q, "a": a, "question": said("q"), "answer": said("a")})
    cited = F.coalesce(F.try_variant_get("a", "$.citations", CITATIONS), F.array().cast(CITATIONS))
    # an empty list or text is no history
    past = F.coalesce(F.size(F.try_variant_get("a", "$.chat_history", "array<variant>")) > 0, F.length(text("a", "$.chat_history")) > 0, F.lit(False))
    scores = F.coalesce("a_scores", F.array().cast("array<struct<value:double,comment:string>>"))
    named = lambda c, f: F.coalesce(c[f], F.lit(""))
    question = _needed(F.col("question"), (F.col("q_type") == "user_message") & (F.col("question") != "") & F.col("q").isNotNull() & F.col("q_start_time").isNotNull() & (F.col("n_answers") == 1), "a question needs the type of a user's message, content, metadata, a time and one answer")
    answer = _needed(F.col("answer"), (F.col("a_type") == "assistant_message") & (F.col("answer") != "") & F.col("a").isNotNull(), "an answer needs the type of an assistant's message, content and metadata")
    return rows.select(
        F.lit(project).alias("project_id"), "thread_id", "question_id", F.col("q_start_time").alias("timestamp"),
        *[text("q", f"$.request.{f}").alias(f) for f in ("user_id", "agency_id", "session_id")], question.alias("question"), answer.alias("answer"), text("a", "$.attributes.benefit_program").alias("program"),
        F.transform(cited, lambda c: c["uri"]).alias("citation_links"), F.transform(cited, lambda c: F.concat(named(c, "source_dataset"), F.lit(": "), named(c, "source_name"))).alias("citation_sources"),
        past.alias("has_chat_history"), F.transform(scores, lambda s: s["value"]).alias("scores"), F.transform(scores, lambda s: F.coalesce(s["comment"], F.lit(""))).alias("comments"),
        F.concat(F.lit(f"{link}/projects/{project}/logs/threads/"), "thread_id", F.lit("?currentStepId="), "question_id").alias("link"),
    )


def export_columns(rows: DataFrame) -> DataFrame:
    """Rows of ``qa_rows`` as the fifteen columns of a CSV, all strings."""
    value = lambda x: F.when(x == F.floor(x), F.format_string("%d.0", F.floor(x))).otherwise(x.cast("string"))
    numbers = F.transform("scores", value)
    made = [
        F.col("user_id"), us_date(F.to_timestamp("timestamp")), F.col("question"), F.col("answer"), F.col("link"), F.col("agency_id"), F.col("session_id"), F.coalesce("program", F.lit("")),
        F.array_join("citation_links", "\n"), F.array_join("citation_sources", "\n"), F.when(F.col("has_chat_history"), "True").otherwise("False"), F.col("thread_id"), F.col("timestamp"),
        simplified(F.col("scores"), numbers, numbers), simplified(F.col("comments"), F.col("comments"), F.transform("comments", _quoted)),
    ]
    return rows.select(*[c.cast("string").alias(n) for c, n in zip(made, EXPORT_COLUMNS, strict=True)])
