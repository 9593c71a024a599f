"""Evaluations and ingestions from their arguments."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import runs
from quillstone.sources import versions, writers


def test_evaluations_are_logged_by_k(spark, tmp_path):
    place = f"file://{tmp_path}"
    asked = spark.createDataFrame([(n, "edd" if n < 6 else "irs", f"h{n}", n % 2) for n in range(10)], "query_id long, dataset string, expected_hash string, expected_document long")
    writers.save_csv(asked, f"{place}/q")
    seen = []

    def retrieve(questions, k, min_score):
        seen.append((k, min_score))
        ranks = questions.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
        return ranks.select("query_id", "rank", F.col("rank").cast("long").alias("chunk_id"), (1.0 / F.col("rank")).alias("score"), F.when(F.col("rank") == F.col("query_id"), F.concat(F.lit("h"), F.col("query_id").cast("string"))).alias("content_hash"), F.lit(1).cast("long").alias("document_id"))

    ids = runs.run_evaluation(spark, f"{place}/q", [1, 3], retrieve, f"{place}/log", "2024-01-01", ["EDD"], 0.25, commit="c")
    assert seen == [(3, 0.25)] and set(ids) == {1, 3}
    found = {(r["k"], r["dataset"]): (r["sample_size"], r["successful_retrievals"], r["successful_document_retrievals"]) for r in runs.logged_metrics(spark, f"{place}/log", "2024-01-01", list(ids.values())).collect()}
    assert found == {(1, "edd"): (6, 1, 3), (1, None): (6, 1, 3), (3, "edd"): (6, 3, 3), (3, None): (6, 3, 3)}
    told = {b["batch_id"]: b for b in versions.batches(spark, f"{place}/log", "2024-01-01")}
    assert told[ids[3]]["evaluation_config"] == {"k_value": 3, "num_samples": 6, "dataset_filter": ["EDD"]} and told[ids[3]]["software_info"]["git_commit"] == "c"
    sampled = runs.run_evaluation(spark, f"{place}/q", [2], retrieve, f"{place}/log", "2024-01-02", None, -1.0, 0.5, 1, 7, "c")
    assert {r["sample_size"] for r in runs.logged_metrics(spark, f"{place}/log", "2024-01-02", list(sampled.values())).where("overall").collect()} == {5}
    for bad in ({"datasets": ["none"]}, {"ks": []}, {"sample_fraction": 0.0}, {"sample_fraction": 1.5}):
        with pytest.raises(ValueError):
            runs.run_evaluation(spark, f"{place}/q", **({"ks": [1]} | bad), retrieve=retrieve, log_root=f"{place}/log", date="d", commit="c")
    assert versions.batches(spark, f"{place}/log", "d") == []


def test_ingestions_are_asked_for_what_they_can():
    asked = ["cmd", "CA EDD", "employment", "California", "items.json"]
    assert runs.run_ingestion(asked, lambda config: config) == runs.Ingestion("CA EDD", "employment", "California", "items.json")
    assert runs.run_ingestion([*asked, "--resume"], lambda config, resume=False: (config.path, resume)) == ("items.json", True)
    for option in ("--resume", "--skip_db"):
        with pytest.raises(NotImplementedError):
            runs.run_ingestion([*asked, option], lambda config: config)
    with pytest.raises(SystemExit):
        runs.run_ingestion(asked[:3], lambda config: config)
    took = []
    with pytest.raises(KeyError), runs.timed(lambda what, s: took.append((what, s >= 0)), "x"):
        raise KeyError
    assert took == [("x", True)]
