"""The pipeline's stages on a small folder, held against plain versions of what each decides."""

import re
import struct
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillstone.llm import quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = f"file://{tmp_path_factory.mktemp('pipeline')}"
    say = lambda seed, n: " ".join(f"{chr(97 + (seed * 7 + k * k) % 26)}{(seed * 31 + k * 17) % 997}" for k in range(n))
    passage = say(77, 60)
    texts = {k: say(k, 120) for k in range(1, 13)}
    texts |= {20: texts[1], 21: texts[2] + " tail", 30: f"{say(30, 80)} {passage}", 31: f"{passage} {say(31, 90)}", 40: "short text", 41: None, 42: "", 50: "spam spam spam " * 40}
    texts |= {60: say(60, 60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + say(61, 40)}
    texts |= {k: " ".join(w + "###" for w in say(k, 120).split()) for k in range(70, 82)}
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts.items()] + [(None, say(90, 80), None, None, 5)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(k, 0 if k >= 70 else 1, 0) for k in (*range(1, 13), *range(70, 82))], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place, rows


def test_stages(spark, folder):
    place, rows = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    kept = P.quality(spark, docs, place)
    assert kept.columns == P.COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {*range(1, 13), 20, 21, 30, 31, 60, None}  # short, repeated and marked texts are gone
    single = P.near_duplicates(spark, kept, place)
    assert {r["doc_id"] for r in single.collect()} == ids - {20, 21}
    cut = P.substrings(spark, single, place)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    before = {r[0]: r[1] for r in rows}
    assert len(words(texts[30])) == 80
    assert len(words(texts[31])) == 90
    assert all(texts[k] == before[k] for k in texts if k not in (30, 31))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("doc_id in (30, 31)").collect())
    clean = P.secrets(spark, cut, place)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "24be6443" not in texts[60]
    assert "[secret]" in texts[60]
    assert all(texts[k] == before[k] for k in range(1, 13))
    packed = P.packing(spark, clean, place).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    sums = Counter()
    for r in packed:
        sums[r["sequence_id"]] += r["length"]
    assert max(sums.values()) <= 2048
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in (1, 30, 60, None):
        ids = [i for r in sorted((r for r in packed if r["doc_id"] == k), key=lambda r: r["start"]) for i in struct.unpack(f"<{r['length']}H", r["ids"])]
        assert ids == [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 1]


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    place, _ = folder
    assert P.run(spark, place).count() > 0
    empty = f"file://{tmp_path}/e"
    spark.createDataFrame([], DOC).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).count() == 0
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "substrings", "secrets", "packing"]


def test_repeated_rows_leave_one(spark, folder):
    place, _ = folder
    docs = spark.read.parquet(f"{place}/documents.parquet").where("doc_id = 1")
    both = docs.unionByName(docs)
    assert P.near_duplicates(spark, both, place).count() == 1


def test_kept_rows_are_the_verdict_s(spark, folder):
    place, _ = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    rules = [(quality_rules.Condition("symbols_per_word", True, 0.5),)]
    want = sorted(str(r["doc_id"]) for r in quality_rules.apply_rules(docs, rules).collect() if r["kept"])
    assert sorted(str(r["doc_id"]) for r in quality_rules.keep(docs, rules).collect()) == want


def test_repeated_ids_with_different_texts(spark, folder):
    place, rows = folder
    a, b, c, d = (next(t for k, t, *_ in rows if k == n) for n in (1, 2, 3, 4))
    given = [(3, b), (5, b + " tail"), (5, a), (7, c), (7, d), (-2, c + " end"), (9, None), (9, None), (9, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in given], DOC)
    got = Counter((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, place).collect())
    assert got == Counter([(3, b), (5, a), (7, d), (-2, c + " end"), (9, None), (9, ""), (None, a), (None, a)])


def test_unrelated_texts_of_one_id_stay(spark, folder):
    """Whether ids repeat elsewhere changes nothing: rows are decided by their classes."""
    place, rows = folder
    a, b, c = (next(t for k, t, *_ in rows if k == n) for n in (1, 2, 3))
    make = lambda given: spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in given], DOC)
    assert P.near_duplicates(spark, make([(1, a), (1, b), (2, c)]), place).count() == 3
    got = P.near_duplicates(spark, make([(1, a), (1, a), (2, a + " tail"), (1, b), (3, c)]), place).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, a), (1, b), (3, c)])
