"""Sessions, messages, answers and their exports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what stands before a context in a prompt.
CONTEXT = "Use the following context to answer the question: "
MESSAGE = "struct<role:string,content:string>"


def messages(system: Column, question: Column, context: Column, history: Column) -> Column:
    """The messages of a model call: system, context if there is one, history, question."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.when(context.isNotNull() & (context != ""), F.array(one("system", F.concat(F.lit(CONTEXT), context)))).otherwise(F.array().cast(f"array<{MESSAGE}>"))
    past = F.coalesce(history, F.array().cast(f"array<{MESSAGE}>"))
    return F.concat(F.array(one("system", system)), said, past, F.array(one("user", question)))


def route(canned: Column, needs_context: Column) -> Column:
    """How a message is answered: by what stands ready, from a context, or plainly."""
    return F.when(F.coalesce(canned, F.lit("")) != "", "canned").when(F.coalesce(needs_context, F.lit(False)), "context").otherwise("plain")


def merged_metadata(new: Column, stored: Column) -> Column:
    """New metadata, and of the stored what it lacks; the new map's keys are the only ones that can be in both."""
    fill = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _v: ~F.map_contains_key(new, k))
    return F.map_concat(new, fill)


def history_error(new_session: Column, history_size: Column) -> Column:
    """What is wrong with a request's history; null if nothing is."""
    return F.when(new_session & (history_size > 0), "a new session has a history").when(~new_session & (history_size == 0), "an old session has no history")


def user_id(given: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) == "", "EMPTY_USER_ID").otherwise(given)


def settings(given: DataFrame, defaults: dict[str, object], engine: str, engines: list[str]) -> DataFrame:
    """An engine's settings, those given in place of its own where they aren't null; an unknown engine is an error."""
    if engine not in engines:
        raise ValueError(f"unknown engine: {engine}")
    return given.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in given.columns else F.lit(v) for k, v in defaults.items()})


def cited_documents(citations: DataFrame) -> DataFrame:
    """Citations of an answer grouped by document, in order of the first of each."""
    item = F.struct("n", "citation_id", "text")
    return citations.groupBy("answer_id", "document").agg(F.sort_array(F.collect_list(item)).alias("cited"), F.min("n").alias("first")).withColumn(
        "label", F.concat_ws(",", F.transform("cited", lambda c: c["citation_id"]))
    )


def exportable(threads: DataFrame) -> DataFrame:
    """Threads that have steps and don't come from the tagged front end; a missing list of tags is no tag."""
    tagged = F.coalesce(F.array_contains("tags", "chainlit"), F.lit(False))
    return threads.where((F.coalesce(F.size("steps"), F.lit(0)) > 0) & ~tagged)


def citation() -> Column:
    """The eight fields of a citation, from a row of a subsection with its document."""
    from quillstone.functions.strings import highlighted_uri

    return F.struct(
        F.concat(F.lit("citation-"), "subsection_id").alias("citation_id"), F.col("document_id").alias("source_id"), F.col("document_name").alias("source_name"), F.col("dataset").alias("source_dataset"),
        "page_number", highlighted_uri(F.col("document_source"), F.col("text")).alias("uri"), F.col("text_headings").alias("headings"), F.col("text").alias("citation_text"),
    )


def retrieval_metadata(found: DataFrame, key: str, system: Column, response: Column) -> DataFrame:
    """(key, m): system prompt, chunks and subsections in order of rank, and the raw response, for each answer.

    ``found``: key, rank, chunk_id, document_name, score, text.
    """
    chunks = F.sort_array(F.collect_list(F.struct("rank", "document_name", "chunk_id", "score")))
    parts = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "document_name", "text")))
    rows = found.groupBy(key).agg(chunks.alias("chunks"), parts.alias("subsections"), response.alias("raw_response"))
    return rows.select(key, F.struct(system.alias("system_prompt"), "chunks", "subsections", "raw_response").alias("m"))


def linked_answer(answer: Column) -> Column:
    """Citations as superscript links to their places."""
    return F.regexp_replace(answer, r" ?\(citation-(\d+)\)", '<sup><a href="#citation-$1">$1</a></sup>')


def accordions(grouped: DataFrame) -> DataFrame:
    """The sources of each answer as HTML; ids follow from the order of documents, so that they stay the same."""
    part = F.concat(
        F.lit('<div class="usa-accordion"><h4>'), F.col("label"), F.lit(". "), F.col("document"), F.lit("</h4><div>"),
        F.array_join(F.transform("cited", lambda c: F.concat(F.lit("<div>Citation #"), c["citation_id"], F.lit(": </div><div>"), c["text"], F.lit("</div>"))), "\n"), F.lit("</div></div>"),
    )
    listed = grouped.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("first", part.alias("html")))).alias("h"))
    return listed.select("answer_id", F.array_join(F.transform("h", lambda x: x["html"]), "\n").alias("sources_html"))


def batch_answers(questions: DataFrame, answer: Callable[[str], dict], key: str = "pos") -> DataFrame:
    """(key, question, column, value) of every question's answer and citations by a pluggable engine, errors as answers.

    ``answer`` gives {"answer", "citations": [{"name", "headings", "source", "text"}], "attributes": {...}}; attributes
    are told only where there is a citation.
    """
    kind = questions.schema[key].dataType.simpleString()

    def one(question: str) -> list[tuple[str, str]]:
        try:
            found = answer(question)
        except Exception as e:  # an answer that fails is told in its place
            return [("answer", f"Error processing question: {e}")]
        out = [("answer", found["answer"])]
        for n, c in enumerate(found.get("citations", []), 1):
            out += [(f"citation_{n}_name", c["name"]), (f"citation_{n}_headings", " > ".join(c.get("headings") or [])), (f"citation_{n}_source", c["source"]), (f"citation_{n}_text", c["text"])]
        if found.get("citations"):
            out += [(f"attrib__{k}", str(v)) for k, v in found.get("attributes", {}).items()]
        return out

    def run(batches):
        for pdf in batches:
            rows = [(k, q, c, v) for k, q in zip(pdf[key], pdf["question"], strict=True) for c, v in one(q)]
            yield pd.DataFrame(rows, columns=[key, "question", "column", "value"])

    return questions.select(key, "question").mapInPandas(run, f"{key} {kind}, question string, column string, value string")


def wide(answers: DataFrame, key: str = "pos") -> DataFrame:
    """One row for each question, a column for each name that any has, in their order; what is lacking is empty."""
    names = [r["column"] for r in answers.select("column").distinct().collect()]  # names of columns, a few for each citation
    rows = answers.groupBy(key, "question").pivot("column", sorted(names)).agg(F.first("value"))
    return rows.na.fill("").orderBy(key)


QA_EXPORT = T.StructType([T.StructField(n, T.StringType()) for n in ("User ID", "Date", "Question", "Response", "Thread ID", "Has Chat History", "Feedback Scores")])


def export_rows(pairs: DataFrame) -> DataFrame:
    """Question-answer pairs as the columns of an export. ``pairs``: user_id, ts, question, answer, thread_id, turn, scores."""
    from quillstone.functions.strings import simple_list, us_date

    return pairs.select(
        F.col("user_id").cast("string").alias("User ID"), us_date(F.col("ts")).alias("Date"), F.col("question").alias("Question"), F.col("answer").alias("Response"), F.col("thread_id").cast("string").alias("Thread ID"),
        F.when(F.col("turn") > 0, "True").otherwise("False").alias("Has Chat History"), simple_list(F.transform("scores", lambda s: s.cast("string"))).alias("Feedback Scores"),
    )
