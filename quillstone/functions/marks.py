"""Markdown put into plain texts as column expressions: bold, links and lists, in the order in which they apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.strings import stripped

DONE = "struct<text:string,left:array<string>>"


def _put(text: Column, at: Column, size: Column, new: Column) -> Column:
    """A text with ``size`` characters from ``at`` (counted from 1) replaced."""
    return F.concat(F.left(text, at - 1), new, F.substring(text, at + size, F.length(text)))


def with_bold(text: Column, styles: Column) -> Column:
    """(text, left): each style's first place made bold, one after the other, white space at its ends apart; and the
    styles, as given, that had no place. A style of white space alone has none. Null styles change nothing."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("left")).cast(DONE)

    def add(s: Column, style: Column) -> Column:
        plain = stripped(style)
        at = F.when(plain != "", F.position(plain, s["text"])).otherwise(F.lit(0))
        bold = F.struct(_put(s["text"], at, F.length(plain), F.concat(F.lit("**"), plain, F.lit("**"))).alias("text"), s["left"].alias("left")).cast(DONE)
        return F.when(at > 0, bold).otherwise(F.struct(s["text"].alias("text"), F.array_append(s["left"], style).alias("left")).cast(DONE))

    return F.aggregate(F.coalesce(styles, F.array().cast("array<string>")), start, add)


def with_links(text: Column, links: Column) -> Column:
    """(text, left): links as markdown, each at the first place of its words from its start on (counted from 0, in the
    text as it is by then); and the words of those that had no place. ``links``: array of (text, url, start_index)."""
    kind = "array<struct<text:string,url:string,start_index:int>>"
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("left")).cast(DONE)

    def add(s: Column, link: Column) -> Column:
        at = F.when(link["start_index"] < F.length(s["text"]), F.position(link["text"], s["text"], link["start_index"] + 1)).otherwise(F.lit(0))
        new = F.concat(F.lit("["), link["text"], F.lit("]("), link["url"], F.lit(")"))
        put = F.struct(_put(s["text"], at, F.length(link["text"]), new).alias("text"), s["left"].alias("left")).cast(DONE)
        return F.when(at > 0, put).otherwise(F.struct(s["text"].alias("text"), F.array_append(s["left"], link["text"]).alias("left")).cast(DONE))

    return F.aggregate(F.coalesce(links, F.array()).cast(kind), start, add)


def with_bullets(text: Column, kind: Column, before: Column) -> Column:
    """A list item with its mark; behind another item, bullets within it as a list below, empty ones left out."""
    lines = F.split(F.concat(F.lit("  - "), F.replace(text, F.lit("•"), F.lit("\n  - "))), "\n")
    below = F.array_join(F.filter(lines, lambda x: ~stripped(x).isin("", "-")), "\n")
    item = F.when((before == "ListItem") & F.contains(text, F.lit("•")), below).otherwise(F.concat(F.lit("- "), text))
    return F.when(kind == "ListItem", item).otherwise(text)
