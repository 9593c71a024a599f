"""The registered queries themselves on the smallest given tables, against plain versions written apart from the operators."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in docs.items()}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


def luhn(digits):
    total = sum(d if n % 2 == 0 else d * 2 - 9 * (d > 4) for n, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_pii(text):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return found + [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def base_secrets(text):
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


@pytest.mark.parametrize(("query", "base", "kinds"), [(queries.op1_boosted_pii, base_pii, ("email", "ip", "card", "phone")), (queries.op5_markov_secrets, base_secrets, ("assign", "access", "hex"))])
def test_base_spans(spark, docs, query, base, kinds):
    rows = query(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    for r in rows:
        spans = base(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in spans) for k in kinds] and r["base_sha256"] == digest(spans)
        assert {f"{k}:{a}:{b}" for a, _, k, b in spans} <= set(r["spans"].split(","))  # base spans stay


def test_shards(spark, docs):
    rows = queries.op2_two_pass_shuffle(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs)) and {r["law"] for r in rows} == {"rows"}
    slots = defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_packed_pieces(spark, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op3_differencing_pack(spark, DATA).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    for k, own in pieces.items():
        whole, at = [*ids[k], 1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole) and r["ids_crc32"] == crc(whole[at : at + r["length"]])
            at += r["length"]
        assert at == len(whole)
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert sum(len(i) + 1 for i in ids.values()) > 0.9 * 2048 * len(sequences)


def test_sorted_tables(spark, ids):
    start = 0
    rows = sorted(queries.op7_sstable(spark, DATA).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(ids)
    for r in rows:
        whole = [*ids[r["doc_id"]], 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(whole), crc(whole))
        start += len(whole)


def test_quality_statistics(spark, docs):
    rows = queries.op8_decision_list(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    for r in rows:
        text = docs[r["doc_id"]]
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        repeated = {j for k, w in enumerate(windows) if seen[w] > 1 for j in range(k, k + 3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and r["kept"])


def test_nearest_found(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    vectors, keys = np.array([r["embedding"] for r in e], np.float64), np.array([r["vec_id"] for r in e])
    hits = n = 0
    found = defaultdict(list)
    for r in queries.op10_permutation_index(spark, DATA).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for k in np.flatnonzero(keys % 20 == 0):
        scores = np.cumsum(vectors * vectors[k], axis=1)[:, -1]
        order = [j for j in np.lexsort((keys, -scores)) if j != k][:20]
        own = found.pop(int(keys[k]))
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and all(s == scores[np.flatnonzero(keys == i)[0]] for i, s in own)
        hits += len({int(keys[j]) for j in order} & {i for i, _ in own})
        n += 20
    assert not found and hits >= 0.9 * n


def test_round_trips_of_pieces(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op9_sentencepiece(spark, DATA)
    assert rows.count() == len(docs)
    column = next(c for c in rows.columns if c.startswith("n_"))
    for r in rows.collect():
        assert r[column] == len(model.encode(docs[r["doc_id"]]))
