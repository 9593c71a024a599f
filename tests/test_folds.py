"""Folds by blocks against a plain fold from first to last, on random texts that join in every way."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import folds as D

SCHEMA = "doc_id string, pos long, text string, type string, headings array<string>, page int"


def plain(rows):
    """One document's (text, type, headings, page) in order, put together."""
    lists = []
    for text, kind, headings, page in rows:
        text = text or ""
        last = lists[-1] if lists else None
        if last and last[0].endswith("\n- ") and last[1] in (D.ITEM, D.LIST) and kind == D.NARRATIVE:
            last[0] += text
        elif last and kind == D.ITEM and last[2] == headings:
            last[0] += "\n" + text
            last[1] = D.LIST
        else:
            lists.append([text, kind, headings, page])
    out = []
    for text, kind, headings, page in lists:
        last = out[-1] if out else None
        if last and last[2] == headings and None not in (last[3], page) and last[3] == page - 1 and text.strip()[:1].islower():
            last[0] += " " + text
        elif last and last[1] == D.TITLE:
            last[0] += "\n\n" + text
            last[1] = kind
        else:
            out.append([text, kind, headings, page])
    return [tuple(x) for x in out]


def plain_headings(merged):
    groups = {}
    for text, kind, headings, page in merged:
        key = None if headings is None else tuple(headings)
        if key in groups:
            g = groups[key]
            groups[key] = (f"{g[0]}\n\n{text}", kind if kind == D.NARRATIVE else g[1], *g[2:])
        else:
            groups[key] = (text, kind, headings, page)
    return list(groups.values())


def document(r, n):
    out, page = [], 1
    for _ in range(n):
        page += r.random() < 0.3
        text = r.choice(["Some text", "goes on", "x\n- ", "- ", "a", "", None, " lower", "Ünder", "\n- ", " "])
        out.append((text, r.choice([D.ITEM, D.ITEM, D.NARRATIVE, D.NARRATIVE, D.TITLE, D.LIST, "Other"]), r.choice([["A"], ["A"], ["A", "B"], None]), r.choice([page, page, page, None])))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_blocks_agree_with_one_fold(spark, block_rows):
    r = random.Random(block_rows)
    docs = {f"d{k}": document(r, r.choice([1, 2, 5, 30, 60])) for k in range(8)}
    docs["bullets"] = [("x\n- ", D.ITEM, ["A"], 1)] + [("y\n- ", D.NARRATIVE, ["B"], 1)] * 12 + [("z", D.ITEM, ["A"], 1)]
    docs["items"] = [(f"item {k}", D.ITEM, ["A"], 1) for k in range(20)]
    docs["titles"] = [("T", D.TITLE, ["A"], k) for k in range(9)]
    rows = [(d, k * 3, *t) for d, texts in docs.items() for k, t in enumerate(texts)]
    r.shuffle(rows)
    merged = D.merge_texts(spark.createDataFrame(rows, SCHEMA).repartition(5), block_rows=block_rows)
    got, whole = {}, {}
    for x in merged.orderBy("doc_id", "pos").collect():
        got.setdefault(x["doc_id"], []).append((x["text"], x["type"], x["headings"], x["page"]))
    assert got == {d: plain(t) for d, t in docs.items()}
    if block_rows in (3, 4096):
        for x in D.by_headings(merged).orderBy("doc_id", "pos").collect():
            whole.setdefault(x["doc_id"], []).append((x["text"], x["type"], x["headings"], x["page"]))
        assert whole == {d: plain_headings(plain(t)) for d, t in docs.items()}


def test_a_long_document_is_folded_by_many_tasks(spark):
    """Blocks tell a few texts each, so that what is folded along the document is a small part of it."""
    rows = spark.range(30_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") % 10 == 0, "Text").otherwise("item").alias("text"), F.when(F.col("id") % 10 == 0, D.NARRATIVE).otherwise(D.ITEM).alias("type"), F.array(F.lit("h")).alias("headings"), F.lit(1).alias("page"))
    merged = D.merge_texts(rows, block_rows=500)
    assert merged.count() == 3000 and merged.where(F.col("text") != "Text" + "\nitem" * 9).count() == 0
    seen = [D.Seen(k, D.NARRATIVE if k % 10 == 0 else D.ITEM, "h", 1, "ext", False) for k in range(500)]
    assert all(D.Lists().settled(a, b) and D.Pages().settled(a, b) for a, b in zip(seen, seen[1:], strict=False))
    assert D.merge_texts(rows.where("false")).count() == 0
