"""Texts of a document merged in order, where what joins a text depends on what it has been joined to: folded by blocks.

A fold that runs from a document's first text to its last needs one task for a document. Here a document is cut into
blocks of positions. What a text sees of all before it is a small state, and after nearly every text that state is the
same whatever came before (the text is *settled*). So three small steps make one long fold: each block tells its texts
from the last settled one on; along a document these few are folded into the state that each block begins with; and
with that, all blocks are folded at the same time. Only types, headings and the ends of texts travel for it; the texts
themselves are moved once, to be put together.
"""

from __future__ import annotations

import json
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM, LIST, NARRATIVE, TITLE = "ListItem", "List", "NarrativeText", "Title"
SEEN = ["pos", "type", "headings", "page", "ending", "goes_on"]


class Seen(NamedTuple):
    """What is seen of a text: headings as one string, its last three characters, whether it begins in lower case."""

    pos: int
    type: str
    headings: str
    page: int | None
    ending: str
    goes_on: bool


class Rule(Protocol):
    """How texts join. States are lists of plain values."""

    def begin(self, e: Seen) -> list: ...

    def joins(self, state: list, e: Seen) -> str | None:
        """What stands between a text and the one that it joins; None if it begins anew."""

    def after(self, state: list, e: Seen, between: str) -> list: ...

    def settled(self, before: Seen, e: Seen) -> bool:
        """Whether the state after ``e`` is that of a beginning, whatever the state before ``before`` was."""


class Lists:
    """Items join what stands before them under the same headings; a bullet that was cut from its text gets it back.

    State: headings and whether it is a list, of what has been put together, and its last three characters.
    """

    def begin(self, e: Seen) -> list:
        return [e.headings, e.type in (ITEM, LIST), e.ending]

    def joins(self, state: list, e: Seen) -> str | None:
        headings, listed, ending = state
        if listed and ending == "\n- " and e.type == NARRATIVE:
            return ""
        return "\n" if e.type == ITEM and headings == e.headings else None

    def after(self, state: list, e: Seen, between: str) -> list:
        return [state[0], state[1] or between == "\n", (state[2] + between + e.ending)[-3:]]

    def settled(self, before: Seen, e: Seen) -> bool:
        if e.type == ITEM:
            return len(e.ending) == 3
        return e.type != NARRATIVE or (len(before.ending) == 3 and before.ending != "\n- ")


class Pages:
    """A sentence that goes on in lower case on the next page joins its beginning; a title joins what follows it.

    State: headings, page and whether it is a title, of what has been put together.
    """

    def begin(self, e: Seen) -> list:
        return [e.headings, e.page, e.type == TITLE]

    def joins(self, state: list, e: Seen) -> str | None:
        headings, page, title = state
        if headings == e.headings and page is not None and e.page == page + 1 and e.goes_on:
            return " "
        return "\n\n" if title else None

    def after(self, state: list, e: Seen, between: str) -> list:
        return state if between == " " else [state[0], state[1], e.type == TITLE]

    def settled(self, before: Seen, e: Seen) -> bool:
        return not e.goes_on and before.type != TITLE and not before.goes_on


def _seen(pdf: pd.DataFrame) -> list[Seen]:
    pages = [None if pd.isna(p) else int(p) for p in pdf["page"]]
    return [Seen(int(r[0]), r[1], r[2], p, r[3], bool(r[4])) for r, p in zip(pdf[["pos", "type", "headings", "ending", "goes_on"]].itertuples(index=False, name=None), pages, strict=True)]


def joined_by(rows: DataFrame, rule: Rule, doc: str, block_rows: int = 4096) -> DataFrame:
    """(doc, pos, start, between): for each text the position of the first that it is put together with, and what stands
    before it there (null for the first). ``rows``: doc, the columns of SEEN; positions are whole numbers, each once."""
    kind = rows.schema[doc].dataType.simpleString()
    small = rows.select(doc, *SEEN).withColumn("block", F.floor(F.col("pos") / block_rows))
    columns = f"{doc} {kind}, block long, pos long, type string, headings string, page int, ending string, goes_on boolean"

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        seen = _seen(pdf)
        at = next((k for k in range(len(seen) - 1, 0, -1) if rule.settled(seen[k - 1], seen[k])), 0)
        return pdf.iloc[at:].assign(settled=at > 0)[[doc, "block", *SEEN, "settled"]]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state that each block of a document begins with; nothing for the first."""
        pdf = pdf.sort_values("pos")
        state: list | None = None
        out = []
        for block, part in pdf.groupby("block", sort=True):
            out.append((pdf[doc].iloc[0], block, None if state is None else json.dumps(state)))
            if part["settled"].iloc[0]:
                state = None
            for e in _seen(part):
                between = rule.joins(state, e) if state is not None else None
                state = rule.begin(e) if between is None else rule.after(state, e, between)
        return pd.DataFrame(out, columns=[doc, "block", "state"])

    def decide(pdf: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        given = begun["state"].iloc[0] if len(begun) else None
        state = json.loads(given) if isinstance(given, str) else None
        out = []
        for e in _seen(pdf):
            between = rule.joins(state, e) if state is not None else None
            state = rule.begin(e) if between is None else rule.after(state, e, between)
            out.append(between)
        return pd.DataFrame({doc: pdf[doc], "block": pdf["block"], "pos": pdf["pos"], "between": out})

    tails = small.groupBy(doc, "block").applyInPandas(tail, f"{columns}, settled boolean")
    states = tails.groupBy(doc).applyInPandas(compose, f"{doc} {kind}, block long, state string")
    decided = small.groupBy(doc, "block").cogroup(states.groupBy(doc, "block")).applyInPandas(decide, f"{doc} {kind}, block long, pos long, between string")
    # the first of what a text is put together with: within its block, or else the last that began in a block before
    began = F.when(F.col("between").isNull(), F.col("pos"))
    within = F.max(began).over(Window.partitionBy(doc, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    blocks = decided.groupBy(doc, "block").agg(F.max(began).alias("last"))
    carried = F.max("last").over(Window.partitionBy(doc).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carry = blocks.select(doc, "block", carried.alias("carried"))
    return decided.withColumn("within", within).join(carry, [doc, "block"]).select(doc, "pos", F.coalesce("within", "carried").alias("start"), "between")


def _look(rows: DataFrame) -> DataFrame:
    """Rows with what a fold sees of them; null texts are empty, headings that are null are headings of their own."""
    text = F.coalesce("text", F.lit(""))
    first = F.left(F.regexp_replace(text, r"(?U)^\s+", ""), F.lit(1))
    shown = {"text": text, "named": F.coalesce(F.to_json("headings"), F.lit("null")), "ending": F.right(text, F.lit(3)), "goes_on": first.rlike(r"^\p{Ll}")}
    return rows.withColumns(shown)


def _put_together(rows: DataFrame, rule: Rule, doc: str, merged_type: Column, block_rows: int) -> DataFrame:
    looked = _look(rows)
    found = joined_by(looked.select(doc, "pos", "type", F.col("named").alias("headings"), "page", "ending", "goes_on"), rule, doc, block_rows)
    part = F.struct("pos", F.coalesce("between", F.lit("")).alias("between"), "text", "type", "headings", "page")
    groups = looked.join(found, [doc, "pos"]).groupBy(doc, "start").agg(F.sort_array(F.collect_list(part)).alias("p"))  # the parts of one text
    first = F.get("p", F.lit(0))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["between"], x["text"])), "")
    return groups.select(doc, F.col("start").alias("pos"), text.alias("text"), merged_type.alias("type"), first["headings"].alias("headings"), first["page"].alias("page"))


def merge_texts(texts: DataFrame, doc: str = "doc_id", block_rows: int = 4096) -> DataFrame:
    """(doc, pos, text, type, headings, page): a document's texts put together, each at the position of its first.

    Lists first: an item joins what stands before it under the same headings, as a line of its own, and makes it a list;
    a narrative text joins a list that ends in a bare bullet. Then sentences that go on in lower case on the next page
    (by the page of the first part), and titles with what follows, whose type they take. ``texts``: doc, pos, text, type,
    headings, page; positions are whole numbers, each once in a document. Null texts are empty and go on nothing, a null
    page follows none, rows without a document are a document. No rows, no texts.
    """
    rows = texts.select(doc, F.col("pos").cast("long").alias("pos"), "text", "type", "headings", F.col("page").cast("int").alias("page"))
    first = F.get("p", F.lit(0))["type"]
    as_list = F.when(F.exists("p", lambda x: x["between"] == "\n"), F.lit(LIST)).otherwise(first)
    lists = _put_together(rows, Lists(), doc, as_list, block_rows)
    titled = F.filter("p", lambda x: x["between"] == "\n\n")
    return _put_together(lists, Pages(), doc, F.when(F.size(titled) > 0, F.get(titled, F.size(titled) - 1)["type"]).otherwise(first), block_rows)


def by_headings(merged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One text for each document and headings: parts by blank lines in order, narrative if any but the first is; the
    first one's position and page."""
    part = F.struct("pos", "text", "type", "page")
    groups = merged.groupBy(doc, "headings").agg(F.sort_array(F.collect_list(part)).alias("p"))
    first = F.get("p", F.lit(0))
    narrative = F.exists(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["type"] == NARRATIVE)
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return groups.select(doc, first["pos"].alias("pos"), text.alias("text"), F.when(narrative, F.lit(NARRATIVE)).otherwise(first["type"]).alias("type"), "headings", first["page"].alias("page"))
