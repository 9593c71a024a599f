import pytest
from pyspark.sql import functions as F

from quillstone.functions.strings import mock_embedding
from quillstone.operators import documents as D
from quillstone.operators import evaluation as E
from quillstone.operators import relational as R
from quillstone.operators import retrieval as V
from quillstone.sources import readers, writers
from quillstone.streaming import run, stateful


def test_golden_retrieval(spark):
    texts = [(1, "Incomprehensibility characterizes unintelligible, overwhelmingly convoluted dissertations."), (2, "Curiosity inspires creative, innovative communities worldwide."), (3, "The quick brown red fox jumps.")]
    chunks = spark.createDataFrame(texts, "chunk_id long, t string").select("chunk_id", mock_embedding(F.col("t"), 8).alias("embedding"), F.lit("d").alias("dataset"))
    query = spark.createDataFrame([(9, "Very tiny words.")], "query_id long, t string").select("query_id", mock_embedding(F.col("t"), 8).alias("query_vector"))
    rows = V.retrieve(query, chunks, 2, 0.0).orderBy("rank").collect()
    assert len(rows) == 2
    assert rows[0]["score"] >= rows[1]["score"]
    assert V.retrieve(query, chunks, 2, 0.0, datasets=[]).count() == 2
    assert V.retrieve(query, chunks, 2, 0.0, datasets=["none"]).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        V.retrieve(query, chunks, 2, 0.0, colours=["x"])


def judged(spark, rows):
    schema = "query_id long, dataset string, expected_hash string, expected_document long, retrieved_chunks array<struct<rank:int,chunk_id:long,score:double,content_hash:string,document_id:long>>, correct_chunk_retrieved boolean, correct_document_retrieved boolean"
    return spark.createDataFrame(rows, schema)


def test_metrics_of_three(spark):
    chunk = lambda s: [(1, 1, s, "h", 1), (2, 2, s / 2, "i", 2)]
    rows = judged(spark, [(1, "d1", "h", 1, chunk(0.9), True, True), (2, "d1", "x", 1, chunk(0.7), False, True), (3, "d2", "x", 9, chunk(0.5), False, False)])
    total = E.metrics(rows).where("overall").first()
    assert (round(total["recall_at_k"], 6), round(total["document_recall_at_k"], 6), round(total["avg_score_incorrect"], 6)) == (0.333333, 0.666667, 0.6)
    empty = E.metrics(rows.where("false")).where("overall").collect()
    assert all(r["recall_at_k"] == 0.0 for r in empty)
    assert [r["dataset"] for r in E.failure_analysis(rows).collect()] == ["d1", "d2"]


@pytest.mark.parametrize(("sizes", "fraction", "least", "want"), [((20, 5, 10), 0.1, 8, (8, 5, 8)), ((100, 50), 0.2, 15, (20, 15)), ((1, 1, 1), 0.1, None, (1, 1, 1)), ((4, 2), None, None, (4, 2)), ((4, 2), None, 0, (0, 0))])
def test_stratified_sizes(spark, sizes, fraction, least, want):
    rows = spark.createDataFrame([(100 * g + k, f"g{g}") for g, n in enumerate(sizes) for k in range(n)], "id long, g string")
    got = {r["g"]: r["count"] for r in E.stratified_sample(rows, F.col("g"), "id", fraction, least).groupBy("g").count().collect()}
    assert tuple(got.get(f"g{g}", 0) for g in range(len(sizes))) == want


def test_fractions():
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError, match="fraction"):
            E.check_fraction(bad)
    E.check_fraction(0.5)


def test_upsert_and_backfill(spark):
    old = spark.createDataFrame([(i, i) for i in range(100)], "id long, num int")
    new = spark.createDataFrame([(i, -i) for i in range(50, 150)], "id long, num int")
    got = {r["id"]: r["num"] for r in R.upsert(old, new, "id").collect()}
    assert got == {i: i if i < 50 else -i for i in range(150)}
    parents = R.backfill_parents(new, old.where("id < 140"), "id", {"num": F.lit(7)})
    assert parents.where("num = 7 and id >= 140").count() == 10
    assert parents.count() == 150


def test_pages(spark):
    rows = spark.range(10)
    page, pages = R.page(rows, ["id"], 2, 4)
    assert ([r["id"] for r in page.collect()], pages) == ([4, 5, 6, 7], 3)
    assert R.page(rows, ["id"], 4, 4)[0].count() == 0
    with pytest.raises(ValueError, match="page"):
        R.page(rows, ["id"], 1, 0)


def test_containment_by_broadcast_and_by_key(spark):
    texts = spark.createDataFrame([(k, f"{k} lorem ipsum dolor sit amet {k} consectetur adipiscing") for k in range(5)], "id long, t string")
    passages = spark.createDataFrame([(1, "ipsum dolor sit amet 3 consectetur"), (2, "amet 2"), (3, "absent passage of text")], "p long, b string")
    a = sorted((r["p"], r["id"]) for r in R.containing(texts, "t", passages, "b").collect())
    b = sorted((r["p"], r["id"]) for r in R.containing(texts, "t", passages, "b", broadcast_bytes=0).collect())
    assert a == b == [(1, 3), (2, 2)]


def test_flat_columns(spark):
    nested = spark.createDataFrame([(((1,), 2), 3)], "a struct<b:struct<c:int>,d:int>, e int")
    assert R.flatten_schema(nested).columns == ["a_b_c", "a_d", "e"]
    assert R.flatten_schema(nested, ".").columns == ["a.b.c", "a.d", "e"]
    assert E.column_order(["z", "b", "a", "id"], ["id", "x"]) == ["id", "a", "b", "z"]


def test_a_thousand_repeats_are_told_28_times(spark, tmp_path):
    rows = spark.createDataFrame([(k, "e", 1) for k in range(1000)], "event_id long, event_type string, user_id long")
    want = [*range(1, 11), *range(20, 101, 10), *range(200, 1001, 100)]
    assert [r["occurrence"] for r in R.throttle(rows, ["event_type", "user_id"], ["event_id"]).orderBy("occurrence").collect()] == want
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    stream = stateful.throttle(run.file_stream(spark, f"file://{tmp_path}/e"), ["event_type", "user_id"], ["event_id"])
    assert sorted(r["occurrence"] for r in run.drain(stream, "t").collect()) == want


def test_responses_assemble_over_batches(spark, tmp_path):
    parts = [("m", 1, "b", False), ("m", 0, "a", False), ("n", 0, "x", False), ("m", 2, "c", True)]
    for p in parts:
        spark.createDataFrame([p], "message_id string, seq long, text string, done boolean").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/p")
    got = run.drain(stateful.assemble(run.file_stream(spark, f"file://{tmp_path}/p", 1)), "a").collect()
    assert [(r["message_id"], r["response"]) for r in got] == [("m", "abc")]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"url": "u1", "title": "a", "main_content": "x"}, {"url": "u1", "title": "later", "main_content": "y"}, {"url": "u2", "title": "b", "main_primary": "z"}]')
    items = readers.main_text(readers.first_of_each_url(readers.json_items(spark, [f"file://{tmp_path}/items.json"])))
    docs = readers.stamped(items, "IRS", "tax credit", "US").select(F.col("url").alias("source"), "title", "content", "dataset", "program", "region")
    path = f"file://{tmp_path}/docs"
    assert writers.ingest(docs, path, R.DOCUMENT_KEY, resume=True) == 2
    assert writers.ingest(docs, path, R.DOCUMENT_KEY, resume=True) == 0
    assert writers.ingest(docs, path, R.DOCUMENT_KEY, resume=False) == 2
    assert {(r["title"], r["content"]) for r in spark.read.parquet(path).collect()} == {("a", "x"), ("b", "z")}
    with pytest.raises(Exception, match="no content"):
        readers.main_text(items.drop("content").withColumns({c: F.lit(None).cast("string") for c in ("main_content", "main_primary", "markdown")})).collect()


def test_csv_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿question,metadata\n"What, ""now""?\nreally",x\nTwo,\n')
    rows = readers.questions(spark, f"file://{tmp_path}/q.csv").collect()
    assert [r["question"] for r in rows] == ['What, "now"?\nreally', "Two"]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="question"):
        readers.questions(spark, f"file://{tmp_path}/bad.csv")


def test_versions_and_backup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q")], "id long, question string")
    path = f"file://{tmp_path}/qa"
    with pytest.raises(ValueError, match="version"):
        writers.latest_version(spark, path)
    for v in ("20240101_000000", "20250101_000000"):
        writers.save_version(rows, path, v)
    assert writers.latest_version(spark, path) == "20250101_000000"
    counts = writers.backup(spark, {"qa": path}, f"file://{tmp_path}/backup")
    assert counts == {"qa": 2}
    assert writers.restore(spark, ["qa"], f"file://{tmp_path}/backup", {"qa": f"file://{tmp_path}/again"}) == counts
    with pytest.raises(ValueError, match="schema"):
        writers.backup(spark, {}, "x", "bad name;")


def test_store_pages():
    pages = {None: {"data": [1, 2], "has_next_page": True, "cursor": "a", "total": 3}, "a": {"data": [3], "has_next_page": False, "total": 3}}
    assert list(readers.all_pages(pages.__getitem__)) == [1, 2, 3]
    with pytest.raises(ValueError, match="came"):
        list(readers.all_pages({None: {"data": [1], "has_next_page": False, "total": 2}}.__getitem__))


def test_pluggable_models(spark):
    chunks = spark.createDataFrame([(1, "a b", None), (2, "c", "c d")], "chunk_id long, content string, text_to_encode string")
    got = D.embed(chunks, lambda texts: [[float(len(t))] for t in texts], 5).collect()
    assert sorted((r["chunk_id"], r["embedding"]) for r in got) == [(1, [3.0]), (2, [3.0])]
    with pytest.raises(Exception, match="longer"):
        D.embed(chunks, lambda texts: [[0.0]] * len(texts), 1).collect()
    pairs = D.generate_pairs(chunks, lambda c: {"question": c, "answer": "x"} if c == "c" else None).collect()
    assert [(r["chunk_id"], r["question"]) for r in pairs] == [(2, "c")]


def test_styles_match_texts(spark):
    styles = spark.createDataFrame([(1, 1, "h", "the wider text"), (2, 1, "h", "nowhere"), (3, 2, "h", "the wider text")], "style_id long, page int, headings string, wider_text string")
    texts = spark.createDataFrame([(7, 1, "h", "the wider text."), (8, 1, "h", "the wider text and very much more of it")], "text_id long, page int, headings string, text string")
    matched, left = D.match_styles(styles, texts)
    assert [(r["style_id"], r["text_id"]) for r in matched.collect()] == [(1, 7)]
    assert sorted(r["style_id"] for r in left.collect()) == [2, 3]


def test_queries_are_registered_with_oracles():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 80


def test_prompts_and_routes(spark):
    from quillstone.operators import conversations as C

    rows = spark.createDataFrame([("q", "ctx", [("user", "a")]), ("r", None, None)], "q string, c string, h array<struct<role:string,content:string>>")
    got = [[tuple(m) for m in r["m"]] for r in rows.select(C.messages(F.lit("s"), F.col("q"), F.col("c"), F.col("h")).alias("m")).collect()]
    assert got == [[("system", "s"), ("system", C.CONTEXT + "ctx"), ("user", "a"), ("user", "q")], [("system", "s"), ("user", "r")]]
    with pytest.raises(ValueError, match="engine"):
        C.settings(rows, {}, "x", ["y"])


def test_batch_answers_keep_order_and_errors(spark):
    from quillstone.operators import conversations as C

    def engine(question):
        if question == "bad":
            raise RuntimeError("no")
        return {"answer": question.upper(), "citations": [{"name": "n", "headings": None, "source": "s", "text": "t"}] if question == "a" else [], "attributes": {"k": 1}}

    rows = C.wide(C.batch_answers(spark.createDataFrame([(0, "a"), (1, "bad"), (2, "c")], "pos long, question string"), engine)).collect()
    assert [r["answer"] for r in rows] == ["A", "Error processing question: no", "C"]
    assert [r["citation_1_name"] for r in rows] == ["n", "", ""]
    assert [r["attrib__k"] for r in rows] == ["1", "", ""]


def test_containment_keeps_repeated_rows_on_every_path(spark):
    said = ["one lorem ipsum dolor sit amet 3", "ab", "ab", "", None, "a a a lorem ipsum dolor sit amet 3"]
    held = ["lorem ipsum dolor sit", "lorem ipsum dolor sit", "a", "a", "ab", "", "", None, "amet 3", "b ", "absent passage of text"]
    texts = spark.createDataFrame([(t,) for t in said], "t string")
    passages = spark.createDataFrame([(b,) for b in held], "b string")
    want = sorted((t, b) for t in said for b in held if t is not None and b is not None and b in t)
    for most in (8 << 20, 250, 0):  # all sent, the short ones sent, none sent
        assert sorted(tuple(r) for r in R.containing(texts, "t", passages, "b", broadcast_bytes=most).collect()) == want


def test_long_passages_meet_texts_by_anchors(spark):
    import random

    r = random.Random(12)
    words = lambda n: "".join(r.choice("abé 🎉") for _ in range(n))
    texts = [words(r.choice([0, 10, 46, 47, 60, 400])) for _ in range(60)] + ["ab " * 100, None]
    held = [t[k : k + n] for t in texts if t for n in (1, 5, 15, 16, 20, 46, 47, 48, 90) for k in [r.randrange(max(1, len(t) - n + 1))]] + ["ab " * 20, "not anywhere " * 6, "", None, texts[3], texts[3]]
    a, b = spark.createDataFrame([(t, n) for n, t in enumerate(texts)], "t string, _t0 int"), spark.createDataFrame([(t, n) for n, t in enumerate(held)], "b string, _p0 int")
    want = sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(held) if t is not None and p is not None and p in t)
    got = R.containing(a, "t", b, "b", broadcast_bytes=0)
    assert got.columns == ["t", "_t0", "b", "_p0"] and sorted((x["_t0"], x["_p0"]) for x in got.collect()) == want
    text = words(20_000)
    assert len(set(R.window_anchors(text).tolist())) < 20_000 / 12  # about two in AMONG + 1
    assert set(R.window_anchors(text[500:600]).tolist()) <= set(R.window_anchors(text).tolist())
