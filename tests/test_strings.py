import re
import uuid
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import strings as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("a row without digits", "a row without digits"), ("call 555 now", "call 555 now"), ("id:321-54-9876;", "id:*********;"), ("both 321549876 and 321-549-876.", "both ********* and *********."),
        ("host db-10-20-30-400 is up", "host db-10-20-30-400 is up"), ("ratio 321549876.25", "ratio 321549876.25"), ("x321549876", "x321549876"), ("321549876_", "321549876_"), ("3215498765", "3215498765"),
        ("é321549876", "é*********"), ("321549876ß", "*********ß"), ("中321-54-9876文", "中*********文"),
    ],
)
def test_masked_tax_ids(spark, given_, wanted):
    assert one(spark, S.mask_tax_ids(F.col("t")), t=given_) == wanted


def test_mask_agrees_with_a_plain_version(spark):
    texts = [(r["text"],) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(f"a{i} 12{i}-45-678{i} x",) for i in range(10)]
    got = [r["x"] for r in spark.createDataFrame(texts, "t string").select(S.mask_tax_ids(F.col("t")).alias("x")).collect()]
    pattern = re.compile(r"\b(?<![A-Za-z0-9_]-)(\d-?){8}\d\b(?!\.\d)", re.ASCII)
    assert got == [pattern.sub("*********", t) for (t,) in texts]


def test_links(spark):
    assert one(spark, S.remove_links(F.col("t")), t="see [a b](http://x.y) and [c](d)") == "see a b and c"
    base, md = "https://h.org/a/b", "[x](/r) [y](rel) [z](http://q.r)"
    assert one(spark, S.resolve_urls(F.col("b"), F.col("m")), b=base, m=md) == "[x](https://h.org/r) [y](https://h.org/a/b/rel) [z](http://q.r)"
    assert one(spark, S.highlighted_uri(F.col("u"), F.col("t")), u="http://a.b/", t="One two, three!") == "http://a.b#:~:text=One%20two%20three,One%20two%20three"
    assert one(spark, S.highlighted_uri(F.lit(None).cast("string"), F.col("t")), t="x") is None


def test_ids_are_uuids_of_md5(spark):
    want = str(uuid.UUID(bytes=hashlib.md5(b"q||a").digest()))
    assert one(spark, S.uuid_of(F.col("q"), F.col("a")), q="q", a="a") == want
    assert one(spark, S.qa_pair_id(F.lit("given"), F.lit("d"), F.col("q"), F.col("a")), q="q", a="a") == "given"


def test_headings(spark):
    assert one(spark, S.headings_markdown(F.array(F.lit("A"), F.lit(""), F.lit("B")))) == "# A\n### B"
    assert tuple(one(spark, S.parse_heading(F.lit("## Two words")))) == (2, "Two words")
    with pytest.raises(Exception, match="not a heading"):
        one(spark, S.parse_heading(F.col("t")), t="plain")


def test_breadcrumb_and_lists(spark):
    crumbs = lambda *h: one(spark, S.breadcrumb(F.array(*[F.lit(x) for x in h]), F.lit("Doc")))
    assert crumbs("Doc", "A", "", "B") == "A → B"
    assert crumbs("Doc", "B") == "B"
    assert crumbs("only") == "only"
    assert crumbs("") == ""
    assert one(spark, S.simple_list(F.array(F.lit("a")))) == "a"
    assert one(spark, S.simple_list(F.array(F.lit("a"), F.lit("b")))) == "[a, b]"
    assert one(spark, S.simple_list(F.array().cast("array<string>"))) == ""


def test_other_scalars(spark):
    assert one(spark, S.basic_ascii(F.col("t")), t="né\n☃x") == "n   x"
    assert one(spark, S.file_path(F.lit("out"), "http://a.b", F.col("u")), u="http://a.b/c/") == "out/c/_index"
    assert one(spark, S.query_value(F.col("u"), "k"), u="http://x/?a=1&k=one%20two&k=3") == "one two"
    assert one(spark, S.first_line(F.col("t")), t="  first\r\nsecond ") == "first"
    assert one(spark, S.separators(F.col("t")), t="| a | b |\n| ---- | ------ |\n| 1 | 2 |") == "| a | b |\n| --- | --- | \n| 1 | 2 |"
    vector = one(spark, S.mock_embedding(F.col("t"), 5), t="aa")
    assert len(vector) == 5
    assert abs(vector[0] + 1.0) < 1e-12
    assert one(spark, S.mock_embedding(F.col("t"), 3), t="") == [0.0, 0.0, 0.0]


@given(st.text(max_size=60))
def test_link_pattern_is_idempotent_on_its_result(text):
    plain = re.sub(S.LINK, r"\1", text)
    assert re.sub(S.LINK, r"\1", re.sub(S.LINK, r"\1", plain)) == re.sub(S.LINK, r"\1", plain) or "[" in plain


def test_known_faults_of_sources(spark):
    assert one(spark, S.edd_fixes(F.col("t")), t="a. . .b\n* + New\n* ### Tab\n* +\n4. * \nx") == "a...b\n    + New\n Tab\n\n\nx"
    assert one(spark, S.list_repairs(F.col("t")), t="Text:\n- a\n  - b") == "Text:\n\n- a\n    - b"
    assert one(spark, S.without_anchors(F.col("t")), t="[a](#collapse-1) [b](#pane-x) [c](d)") == "a b [c](d)"
    assert one(spark, S.shortened(F.col("t"), 20), t="one two three four five six\nsecond line") == "one two three...\n..."
    assert one(spark, S.shortened(F.col("t"), 30), t="short\nsecond\nthird") == "short\nsecond"
    assert one(spark, S.page_number(F.col("t")), t="3 of 12") == "3"
    assert one(spark, S.page_number(F.col("t")), t="three") is None


def test_null_and_empty_inputs(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string")
    got = rows.select(S.mask_tax_ids(F.col("t")).alias("m"), S.remove_links(F.col("t")).alias("l"), S.join_list(F.split("t", "x")).alias("j"), S.first_line(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(None, None, "", None), ("", "", "", "")]


def test_links_keep_the_port(spark):
    assert one(spark, S.resolve_urls(F.col("b"), F.col("m")), b="http://a.b:8080/x", m="[q](/q)") == "[q](http://a.b:8080/q)"


def test_white_space_at_the_ends(spark):
    assert one(spark, S.policy_cleanup(F.col("t")), t="\n\n\ttext\n \u2003") == "text"
    assert one(spark, S.policy_cleanup(F.col("t")), t="* 1. one\n- a) two") == "1. one\na) two"
    assert one(spark, S.first_line(F.col("t")), t="\n \u00a0first\rsecond\n") == "first"
    assert one(spark, S.first_line(F.col("t")), t="only") == "only"


def test_masked_values_by_key(spark):
    row = spark.createDataFrame([({"msg": "id 321549876", "created": "321549876", "thread": "1"},)], "m map<string,string>")
    assert row.select(S.masked_values(F.col("m")).alias("x")).first()["x"] == {"msg": "id *********", "created": "321549876", "thread": "1"}


def test_char_diffs(spark):
    pairs = [("", ""), ("abc", "abc"), ("abc", "axc"), (None, "ab"), ("abcd", ""), ("kitten", "sitting")]
    got = spark.createDataFrame(pairs, "a string, b string").select(S.char_diffs(F.col("a"), F.col("b")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [(0, 0), (0, 0), (1, 1), (2, 0), (0, 4), (3, 2)]


def test_sentences_by_marks(spark):
    row = spark.createDataFrame([('Mr. Poe paid 3.50 at shop.com. "Well!" said J. Doe... Was it? Yes',)], "t string")
    assert row.select(S.marked_sentences(F.col("t")).alias("x")).first()["x"] == ["Mr. Poe paid 3.50 at shop.com.", '"Well!"', "said J. Doe...", "Was it?", "Yes"]
