"""Retrieval and evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.catalog import register
from quillstone.operators import evaluation as E
from quillstone.operators import retrieval as R
from quillstone.operators import runs
from quillstone.plans import views as V
from quillstone.sources import writers
from quillstone.streaming.run import work_dir

KS = [5, 10, 25]


def _hits(spark: SparkSession, sf_dir: str, k: int, min_score: float = -1.0, **filters) -> DataFrame:
    found = R.retrieve(V.questions(spark, sf_dir), V.chunks(spark, sf_dir), k, min_score, **filters)
    return found.join(V.chunks(spark, sf_dir).select("chunk_id", "content_hash", "document_id"), "chunk_id")


def judged(spark: SparkSession, sf_dir: str, k: int, min_score: float = -1.0) -> DataFrame:
    asked = V.questions(spark, sf_dir).drop("query_vector")
    return E.judge(asked, _hits(spark, sf_dir, k, min_score))


_JUDGED = """
    judged AS (SELECT q.query_id, any_value(q.dataset) AS dataset, any_value(q.expected_hash) AS expected_hash, min(CASE WHEN r.content_hash = q.expected_hash THEN r.rank END) AS crank,
               min(CASE WHEN r.document_id = q.expected_document THEN r.rank END) AS drank, count(r.rank) AS got, max(r.score) AS top
               FROM questions q LEFT JOIN (SELECT * FROM ranked WHERE rank <= {k} AND score >= {least}) r ON r.query_id = q.query_id GROUP BY q.query_id)
"""
_MEASURES = """
    count(*) AS sample_size, coalesce(round(avg((crank IS NOT NULL)::INT), 6), 0.0) AS recall_at_k, coalesce(round(avg((drank IS NOT NULL)::INT), 6), 0.0) AS document_recall_at_k,
    coalesce(round(avg(CASE WHEN crank IS NULL AND got > 0 THEN top END), 6), 0.0) AS avg_score_incorrect, count(crank) AS successful_retrievals, count(drank) AS successful_document_retrievals
"""
_ROUNDED = ("recall_at_k", "document_recall_at_k", "avg_score_incorrect")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@register("flagship_recall_by_dataset", f"WITH {V.SQL} {_JUDGED.format(k=10, least=-1)} SELECT dataset, (grouping(dataset) = 1) AS overall, {_MEASURES} FROM judged GROUP BY ROLLUP (dataset)")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of all questions, by dataset and overall."""
    return _rounded(E.metrics(judged(spark, sf_dir, 10)))


@register("a01_a04_a08_metrics_min_score", f"WITH {V.SQL} {_JUDGED.format(k=10, least=0.1)} SELECT dataset, (grouping(dataset) = 1) AS overall, {_MEASURES} FROM judged GROUP BY ROLLUP (dataset)")
def metrics_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.metrics(judged(spark, sf_dir, 10, 0.1)))


@register("j10_w01_p02_batch_top_k", f"WITH {V.SQL[:V.SQL.rindex(',')]} SELECT query_id, rank::INT AS rank, chunk_id, round(score, 9) AS score FROM ranked WHERE rank <= 10 AND score >= 0.1")
def batch_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve(V.questions(spark, sf_dir), V.chunks(spark, sf_dir), 10, 0.1).withColumn("score", F.round("score", 9))


@register("j01_p01_filtered_top_k", f"WITH {V.SQL} f AS (SELECT query_id, chunk_id, document_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored WHERE chunk_dataset IN ('ds0', 'ds2')) SELECT query_id, r::INT AS rank, chunk_id, document_id, score FROM f WHERE r <= 8")
def filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hits(spark, sf_dir, 8, datasets=["ds0", "ds2"])
    return found.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 9).alias("score"))


@register("t01_single_query_top_k", """
    WITH q AS (SELECT list_transform(embedding::DOUBLE[], lambda x: 1.0) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], v), 9) AS score FROM embeddings, q ORDER BY list_inner_product(embedding::DOUBLE[], v) DESC, vec_id LIMIT 25""")
def single_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve_one([1.0] * 64, V.chunks(spark, sf_dir), 25, -1e9).withColumn("score", F.round("score", 9))


@register("f31_inner_product_of_neighbours", """
    SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.chunks(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), F.col("embedding").alias("x"))
    b = V.chunks(spark, sf_dir).select((F.col("chunk_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(R.inner_product("x", "y"), 9).alias("score"))


_EACH_K = "WITH " + V.SQL + ", ".join(f"j{k} AS (SELECT * FROM ({'SELECT q.query_id, any_value(q.dataset) AS dataset, min(CASE WHEN r.content_hash = q.expected_hash THEN r.rank END) AS crank, min(CASE WHEN r.document_id = q.expected_document THEN r.rank END) AS drank, count(r.rank) AS got, max(r.score) AS top FROM questions q LEFT JOIN (SELECT * FROM ranked WHERE rank <= ' + str(k) + ') r ON r.query_id = q.query_id GROUP BY q.query_id'}))" for k in KS) + " " + " UNION ALL ".join(f"SELECT {k} AS k, dataset, (grouping(dataset) = 1) AS overall, {_MEASURES} FROM j{k} GROUP BY ROLLUP (dataset)" for k in KS)


@register("e03_metrics_at_each_k", _EACH_K)
def metrics_at_each_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval at the largest k serves all."""
    rows = E.at_each_k(judged(spark, sf_dir, max(KS)), KS)
    return _rounded(E.metrics(rows, keys=("k",)))


@register("runs_e10_evaluation", _EACH_K.replace("FROM questions q LEFT JOIN", "FROM (SELECT * FROM questions WHERE dataset IN ('ds0', 'ds2')) q LEFT JOIN"))
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two datasets from a CSV, evaluated at each k with a retrieval that is given, and read from the log."""
    place = work_dir(spark, "evaluation")
    writers.save_csv(V.questions(spark, sf_dir).select(*runs.QUESTION_COLUMNS), f"{place}/questions")
    vectors, chunks = V.questions(spark, sf_dir).select("query_id", "query_vector"), V.chunks(spark, sf_dir)

    def retrieve(asked: DataFrame, k: int, min_score: float) -> DataFrame:
        found = R.retrieve(vectors.join(asked.select("query_id"), "query_id"), chunks, k, min_score)
        return found.join(chunks.select("chunk_id", "content_hash", "document_id"), "chunk_id")

    ids = runs.run_evaluation(spark, f"{place}/questions", KS, retrieve, f"{place}/log", "2024-01-02", ["ds0", "ds2"], commit="0" * 40)
    return _rounded(runs.logged_metrics(spark, f"{place}/log", "2024-01-02", list(ids.values()))).withColumn("k", F.col("k").cast("int"))


@register("e02_w03_judged_questions", f"WITH {V.SQL} {_JUDGED.format(k=10, least=-1)} SELECT query_id, dataset, crank::INT AS rank_if_found, drank::INT AS document_rank_if_found, crank IS NOT NULL AS correct_chunk_retrieved, drank IS NOT NULL AS correct_document_retrieved, got::INT AS n_retrieved FROM judged")
def judged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, 10).select("query_id", "dataset", "rank_if_found", "document_rank_if_found", "correct_chunk_retrieved", "correct_document_retrieved", F.size("retrieved_chunks").alias("n_retrieved"))


@register("a05_a06_t06_failure_analysis", f"WITH {V.SQL} {_JUDGED.format(k=10, least=-1)} SELECT dataset, count(*) AS failures FROM judged WHERE crank IS NULL GROUP BY dataset ORDER BY failures DESC, dataset")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_analysis(judged(spark, sf_dir, 10))


@register("a09_precision_recall", f"WITH {V.SQL} {_JUDGED.format(k=5, least=-1)} SELECT round(avg((crank IS NOT NULL)::INT / 5.0), 6) AS precision_at_k, round(avg((crank IS NOT NULL)::INT), 6) AS recall_at_k FROM judged")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.precision_recall(judged(spark, sf_dir, 5), 5).select(F.round("precision_at_k", 6).alias("precision_at_k"), F.round("recall_at_k", 6).alias("recall_at_k"))


@register("a10_positional_recall", f"WITH {V.SQL[:V.SQL.rindex(',')]} SELECT round(avg(hit), 6) AS recall FROM (SELECT query_id, max((chunk_id = query_id)::INT) AS hit FROM ranked WHERE rank <= 5 GROUP BY query_id)")
def positional_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.retrieve(V.questions(spark, sf_dir), V.chunks(spark, sf_dir), 5)
    hit = found.groupBy("query_id").agg(F.max((F.col("chunk_id") == F.col("query_id")).cast("int")).alias("hit"))
    return hit.agg(F.round(F.avg("hit"), 6).alias("recall"))


@register("e01_w02_exploded_results", f"""WITH {V.SQL} {_JUDGED.format(k=5, least=0.12)}
    SELECT j.query_id, j.dataset, crank IS NOT NULL AS correct_chunk_retrieved, r.rank::INT AS retrieved_rank, r.chunk_id, round(r.score, 9) AS score, coalesce(r.content_hash = j.expected_hash, false) AS is_correct
    FROM judged j LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5 AND score >= 0.12) r ON r.query_id = j.query_id""")
def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.explode_results(judged(spark, sf_dir, 5, 0.12))
    return rows.select("query_id", "dataset", "correct_chunk_retrieved", "retrieved_rank", "chunk_id", F.round("score", 9).alias("score"), "is_correct")


@register("j12_membership", f"WITH {V.SQL} hits AS (SELECT query_id, list(content_hash) AS got, any_value(expected_hash) AS want FROM ranked WHERE rank <= 10 GROUP BY query_id) SELECT query_id, list_contains(got, want) AS found FROM hits")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _hits(spark, sf_dir, 10).groupBy("query_id").agg(F.collect_list("content_hash").alias("got"))
    asked = V.questions(spark, sf_dir).select("query_id", "expected_hash")
    return got.join(asked, "query_id").select("query_id", F.array_contains("got", F.col("expected_hash")).alias("found"))


@register("e04_a11_w13_stratified_sample", """
    WITH d AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents)
    SELECT doc_id, lang FROM d WHERE r <= least(n, greatest(8, floor(n * 0.1::DOUBLE)))""")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: a tenth of each language, at least eight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return E.stratified_sample(docs, F.col("lang"), "doc_id", 0.1, 8, 7)


@register("p03_dataset_filter", """
    SELECT doc_id, source, lang FROM documents WHERE CASE lower(lang) WHEN 'en' THEN 'en' ELSE lang END IN ('en', 'fr')""")
def dataset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    return docs.where(E.dataset_label(F.col("lang")).isin("en", "fr"))


@register("w14_numbered_hits", f"WITH {V.SQL[:V.SQL.rindex(',')]} SELECT query_id, chunk_id, 'citation-' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation FROM ranked WHERE rank <= 5")
def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.retrieve(V.questions(spark, sf_dir), V.chunks(spark, sf_dir), 5)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.select("query_id", "chunk_id", F.concat(F.lit("citation-"), n.cast("string")).alias("citation"))
