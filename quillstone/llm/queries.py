"""Queries of the training-data operators: thin forms over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import dual_tree, lloyd, ngram_join, norm_buckets, permutation_index, pii, quality_rules, secret_scan, sentencepiece_fst, sstable
from quillstone.llm.packing import pack
from quillstone.llm.sharding import shuffle_shards
from quillstone.llm.substring_dedup import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed formats, and candidates that boosted trees select."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train()).drop("text")


def op2_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled and dealt into 40 shards; sizes and checksums are those of the written records."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_shards(docs, shards=40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and its links: five-word n-grams, Jaccard similarity of 0.8."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs, width=5, similarity=0.8)


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: fixed formats, and runs that the Markov models tell from identifiers."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, secret_model(spark, docs)).drop("text")


def secret_model(spark: SparkSession, docs: DataFrame) -> secret_scan.Model:
    return secret_scan.train(secret_scan.samples(spark, docs, rows=1000))


def quality_list(docs: DataFrame, labels: DataFrame) -> list[quality_rules.Rule]:
    return quality_rules.learn(quality_rules.labelled_rows(docs, labels, most=4000))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 35-word windows that start twice or more, removed from every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in sorted-string-table shards, read back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = sstable.write(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return sstable.read(spark, manifest, docs.schema["doc_id"].dataType)


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and the learned list's verdict on all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_list(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).drop("text")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids, and whether and to what they decode."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_fst.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others found for every vector whose id is divisible by 20."""
    return permutation_index.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_plain_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components, after three rounds from 16 of them."""
    return lloyd.cluster(_table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, dims=64, scale=64)


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every vector whose id is divisible by 50."""
    return norm_buckets.search(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; each seventh id has the next label."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return dual_tree.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100)


QUERIES = {
    "op1_boosted_pii": op1_boosted_pii,
    "op2_two_pass_shuffle": op2_two_pass_shuffle,
    "op3_differencing_pack": op3_differencing_pack,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sstable": op7_sstable,
    "op8_decision_list": op8_decision_list,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_permutation_index": op10_permutation_index,
    "op11_plain_lloyd": op11_plain_lloyd,
    "op12_norm_buckets": op12_norm_buckets,
    "op13_dual_tree": op13_dual_tree,
}

#: Words of each text, their five-word n-grams (all words of a shorter text), exact Jaccard similarities of texts with
#: different n-grams, and the components of links by the least document that each reaches.
_NGRAM_ORACLE = """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
    g AS (SELECT doc_id, list_sort(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(list_slice(words, i, i + 4), ' ')))
                                        WHEN len(words) > 0 THEN [md5(array_to_string(words, ' '))] ELSE [] END) AS grams FROM w),
    k AS (SELECT doc_id, grams, CASE WHEN len(grams) = 0 THEN 'alone ' || doc_id ELSE md5(array_to_string(grams, ' ')) END AS key FROM g),
    c AS MATERIALIZED (SELECT key, min(doc_id) AS copy_id, list_distinct(any_value(grams)) AS grams FROM k GROUP BY key),
    u AS MATERIALIZED (SELECT copy_id, len(grams) AS n, unnest(grams) AS gram FROM c),
    p AS (SELECT a.copy_id AS x, b.copy_id AS y, count(*) AS same_n, any_value(a.n) AS m, any_value(b.n) AS n FROM u a JOIN u b ON a.gram = b.gram AND a.copy_id < b.copy_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT x, y FROM p WHERE same_n >= 0.8 * (m + n - same_n) - 1e-9),
    e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    least_id AS (SELECT x, min(y) AS low FROM r GROUP BY x),
    links AS (SELECT x, count(*) AS n FROM e GROUP BY x)
    SELECT k.doc_id, least(c.copy_id, coalesce(low, c.copy_id)) AS class_id, c.copy_id, coalesce(links.n, 0)::BIGINT AS n_links
    FROM k JOIN c USING (key) LEFT JOIN least_id ON least_id.x = c.copy_id LEFT JOIN links ON links.x = c.copy_id
"""

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_oracle(rounds: int = 3) -> str:
    """A step of assignment for each round and one more; centroids are lists of whole numbers."""
    steps = [
        f"""r AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_FINITE})""",
        """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS c, v FROM r WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16)""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT n, vec_id, v, p[2]::INT AS cluster, p[1] AS distance FROM (SELECT n, any_value(r.vec_id) AS vec_id, any_value(r.v) AS v,
            min([list_sum(list_transform(list_zip(r.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c]) AS p FROM r CROSS JOIN c{k} GROUP BY n))"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS (SELECT cluster, i, floor(sum(x) / count(*)::DOUBLE)::BIGINT AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY cluster, i),
                c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM s{k} GROUP BY cluster) m ON m.cluster = c{k}.c)"""
            )
    return f"""WITH {", ".join(steps)} SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = cluster"""


#: Rows that take part, their components times 256, and products of pairs, which are exact as doubles.
_WHOLE = f"""w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_FINITE})"""

ORACLES = {
    "op11_plain_lloyd": _lloyd_oracle(),
    "op12_norm_buckets": f"""
        WITH {_WHOLE}, p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5""",
    "op13_dual_tree": f"""
        WITH {_WHOLE}, l AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM w WHERE label IS NOT NULL),
        p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM l a JOIN l c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
        f AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM f JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    "op4_ngram_jaccard": _NGRAM_ORACLE,
    "op6_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
        i AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS p0, words FROM w WHERE len(words) >= 35),
        h AS (SELECT doc_id, p0, md5(array_to_string(list_slice(words, p0, p0 + 34), ' ')) AS h FROM i),
        r AS (SELECT doc_id, p0 FROM (SELECT doc_id, p0, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(p0, p0 + 35)) AS p FROM r),
        l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)
    """,
}
