"""Queries of pages, documents and conversations: results as their SQL's on odd pages, and Python's share of a batch."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.util import PythonEvalType

import __spark_entry__ as entry
from quillstone.functions import markdown as M
from quillstone.operators import documents as D

ODD = [
    "<h1>Cut in a name&amp</h1>", "<h1>&lt;b&gt; &amp;amp; &quot;q&quot; it&#x27;s &copy; &lt</h1>", "<h1>One</h1><p>x</p><h1>Two</h1>", "<title>Own</title><p>none</p>", "<h1>  wide  gap  </h1>",
    "<h1>two\nlines</h1><h1>next</h1>", "<h1>a\rb\u0085c d</h1>", "<h1><b>bold</b></h1>", "<h1>\ttab \n</h1>", "<h1 id=a>named</h1>", "<H1>Big</H1>", "<h1>end \t</h1>", "<h1></h1>", "", None,
]


def test_titles_are_their_sqls(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string").selectExpr("page_id", "'http://x/' as url", "html").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {tuple(r) for r in entry.queries()["h01_h05_s10_page_titles"](spark, f"file://{tmp_path}").collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(db.execute(entry.oracle_sql()["h01_h05_s10_page_titles"]).fetchall())


def test_a_slice_of_a_batch_at_a_time():
    seen = []
    made = D._of_rows(lambda x, y: seen.append(x) or f"{x}{y}", "string", pa.string())
    numbers = pa.array(range(1000))
    slices = made.func(iter([(numbers, numbers), (numbers.slice(0, 0),) * 2, (numbers.slice(0, 1),) * 2]))
    first = next(slices)
    assert seen == list(range(D.AT_ONCE)) and first.to_pylist() == [f"{n}{n}" for n in seen]
    assert sum(map(len, slices)) + len(first) == 1001


def _python_steps(df) -> list[int]:
    """The kinds of the Python steps in a query's plan."""
    return [int(kind) for kind in re.findall(r"\], \[pythonUDF0#\d+\], (\d+)", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize(("name", "steps"), [
    ("c08_chunk_bounds", 2),
    ("c11_embedded_chunks", 2),
    ("c02_c10_tree_chunks", 2),
    ("r01_r04_subsections", 3),
    ("r06_r11_simplified_citations", 1),
    ("m07_m11_page_trees", 2),
    ("m10_headings_by_level", 1),
    ("h02_pages_as_markdown", 1),
])
def test_python_takes_slices_and_no_step_twice(spark, name, steps):
    assert _python_steps(entry.queries()[name](spark, entry.DATA)) == [PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF] * steps


def test_chunks_of_more_documents_than_a_slice(spark):
    texts = [None, "", *(f"# Top {n}\n\n" + f"word{n} " * (n % 40) + "\n\n## Deep\n\nlast" for n in range(300))]
    rows = D.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string").repartition(1), "md", 20).collect()
    want = {(n, c.index): (len(found), c.text, c.length, list(c.headings), c.to_embed()) for n, t in enumerate(texts) for found in [M.chunks(t or "", M.ChunkingConfig(20))] for c in found}
    assert len(rows) == len(want) and {(r["doc_id"], r["split_index"]): (r["num_splits"], r["content"], r["tokens"], r["headings"], r["text_to_encode"]) for r in rows} == want
