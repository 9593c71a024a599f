"""Sentences, greedy pieces and learned abbreviations against plain versions."""

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import sentences as S


def plain_join(lines, limit, sep=" ", cut=None):
    pieces, piece = [], ""
    for line in lines:
        longer = f"{piece}{sep}{line}" if piece else line
        if len(longer) <= limit:
            piece = longer
            continue
        pieces += [piece] if piece else []
        if len(line) < limit:
            piece = line
        elif cut is None:
            pieces += plain_join(re.findall(r"[,;\n]|[^,;\n]+", line), limit, "", lambda w: [w[k : k + limit] for k in range(0, len(w), limit)])
            piece = ""
        else:
            pieces += cut(line)
            piece = ""
    return [*pieces, piece]


def column(spark, rows, make, schema):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(rows)), f"n int, v {schema}").coalesce(1).select("n", make(F.col("v")).alias("x")).orderBy("n").collect()]


LINE = st.text("ab ,;é\n", max_size=30)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(LINE, max_size=8), min_size=1, max_size=12), st.integers(1, 20))
def test_pieces_agree_with_a_plain_fold(spark, rows, limit):
    got = column(spark, rows, lambda v: S.join_up_to(v, limit), "array<string>")
    assert got == [plain_join(r, limit) for r in rows]
    assert all(len(p) <= limit for r in got for p in r)
    assert [re.sub(r"\s", "", "".join(p)) for p in got] == [re.sub(r"\s", "", "".join(r)) for r in rows]  # no character is lost


def test_limits_of_pieces(spark):
    join = lambda lines, limit: column(spark, [lines], lambda v: S.join_up_to(v, limit), "array<string>")[0]
    assert join(["abcde", "fghij"], 5) == ["abcde", "fghij", ""]  # as long as the limit: no longer a line to begin with
    assert join(["abcd", "efgh"], 5) == ["abcd", "efgh"] and join(["ab", "cd"], 5) == ["ab cd"]
    assert join(["abcdefghijkl"], 5) == ["abcde", "fghij", "kl", "", ""] and join([], 5) == [""] and join(None, 5) is None
    with pytest.raises(Exception, match="no room"):
        join(["a"], 0)


def test_lists_behind_their_introduction(spark):
    text = "Of these:\n  - one thing is here.\n  - another thing.\n  - more, and; yet more of it\nend"
    for limit in (40, 50, 60, 200):
        lines = text.split("\n")
        want = [f"{lines[0]}\n{p}" for p in plain_join(lines[1:], limit - len(lines[0]) - len(lines), "\n")]
        assert column(spark, [text], lambda v, limit=limit: S.split_list(v, limit), "string") == [want] and all(len(p) <= limit for p in want)
    bare = [f"\n{p}" for p in plain_join(text.split("\n"), 40 - 5, "\n")]
    assert column(spark, [text, None, "", "intro"], lambda v: S.split_list(v, 40, intro=False), "string")[:2] == [bare, None]
    assert column(spark, ["", "intro"], lambda v: S.split_list(v, 40), "string") == [["\n"], ["intro\n"]]
    with pytest.raises(Exception, match="no room"):
        column(spark, ["a very long introduction\nx"], lambda v: S.split_list(v, 10), "string")


def _cut(spark, texts, short=(), limit=None, most=10_000):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("_tokens", F.lit("mine"))
    found = S.with_sentences(docs, "text", spark.createDataFrame([(w,) for w in short], "word string"), "id", most=most).orderBy("id")
    assert {r["_tokens"] for r in found.collect()} == {"mine"}
    return [r["sentences"] if limit is None else r["p"] for r in (found if limit is None else found.withColumn("p", S.split_paragraph(F.col("sentences"), F.col("text"), limit))).collect()]


@pytest.mark.parametrize("most", [10_000, 0])
def test_sentences(spark, most):
    texts = ["It is so. Is it? Yes! \"No.\" (Well.) End", "Dr. No came at 3 p.m. today. He left.", "J. Doe et al. wrote it... and so on. Éa va.", "one", "", " \n", None, "A.\x1eb. C"]
    want = [["It is so.", "Is it?", "Yes!", '"No."', "(Well.)", "End"], ["Dr. No came at 3 p.m. today.", "He left."], ["J. Doe et al. wrote it... and so on.", "Éa va."], ["one"], [], [], None, ["A.", "b.", "C"]]
    assert _cut(spark, texts, ("dr", "al"), most=most) == want


def test_paragraphs(spark):
    three = "This is one. That is another, and it is far longer than it should be. Third."
    got = _cut(spark, [three, "no end here\n\nbut, a long second part of it\n\nc", None, ""], limit=30)
    assert got[0] == plain_join(["This is one.", "That is another, and it is far longer than it should be.", "Third."], 30)
    assert got[1] == plain_join(["no end here", "but, a long second part of it", "c"], 30, "\n\n") and got[2:] == [None, [""]]


def test_abbreviations_are_learned(spark):
    texts = [f"Mr. Smith{k} saw it. The end is near. They met Dr. No, etc., and more. We saw the mr file {'x' * (k % 3)}" if k == 0 else f"Mr. Smith{k} saw it. The end is near. They met Dr. No, etc., and more." for k in range(30)]
    n, dotted = Counter(), Counter()
    for t in texts:
        for token in t.lower().split():
            m = re.match(r"^[\"'(\[]*([^\W\d_](?:[^\W\d_]|\.)*?)(\.?)[,;:!?\"')\]]*$", token)
            if m:
                n[m[1]] += 1
                dotted[m[1]] += m[2] == "."
    rate = sum(dotted.values()) / sum(n.values())
    want = {}
    for w, c in dotted.items():
        if c:
            plain, letters = n[w] - c, len(w.replace(".", ""))
            ratio = 2 * (c * math.log(0.99) + plain * math.log(0.01) - c * math.log(rate) - plain * math.log(1 - rate))
            score = ratio * math.exp(-letters) * (w.count(".") + 1) * letters ** -float(plain)
            if score > 0.3:
                want[w] = score
    found = {r["word"]: r["score"] for r in S.abbreviations(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string"), "t").collect()}
    assert found == pytest.approx(want) and {"mr", "dr", "etc"} & set(found) >= {"dr", "etc"} and "near" not in {w for w in found if len(w) > 5}
    assert S.abbreviations(spark.createDataFrame([], "t string"), "t").collect() == []


def test_marks_in_texts(spark):
    from quillstone.functions import marks

    rows = [("say It is so", [" is ", "zz", "  ", "so"], [("It", "u", 0), ("say", "v", 1), ("so", "w", 99)]), ("aa", ["a", "a"], [("a", "u", 1), ("a", "v", 0)]), ("", ["x"], [("x", "u", 0)]), (None, None, None), ("t", None, None)]
    found = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, t string, s array<string>, l array<struct<text:string,url:string,start_index:int>>")
    got = found.select("n", marks.with_bold(F.col("t"), F.col("s")).alias("b"), marks.with_links(F.col("t"), F.col("l")).alias("k")).orderBy("n").collect()
    assert [tuple(r["b"]) for r in got] == [("say It **is** **so**", ["zz", "  "]), ("****a****a", []), ("", ["x"]), (None, []), ("t", [])]
    assert [tuple(r["k"]) for r in got] == [("say [It](u) is so", ["say", "so"]), ("[a](v)[a](u)", []), ("", ["x"]), (None, []), ("t", [])]
    items = spark.createDataFrame([(0, "one • two •  • three", "ListItem", "ListItem"), (1, "one • two", "ListItem", ""), (2, "x", "ListItem", "ListItem"), (3, "• x", "Title", "ListItem")], "n int, t string, k string, b string")
    assert [r["x"] for r in items.select("n", marks.with_bullets(F.col("t"), F.col("k"), F.col("b")).alias("x")).orderBy("n").collect()] == ["  - one \n  -  two \n  -  three", "- one • two", "- x", "• x"]
