"""Registered queries hold all rows of their tables: each against a plain version on a small folder."""

import re
from collections import defaultdict

import __spark_entry__ as entry
from quillstone.functions import citations as C


def test_simple_lists_hold_every_id(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [(k, k % 3) for k in range(60)] + [(100, 7)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{place}/embeddings.parquet")
    ids = defaultdict(list)
    for k, label in rows:
        ids[label].append(str(k))
    want = {label: v[0] if len(v) == 1 else f"[{', '.join(v)}]" for label, v in ids.items()}
    assert {r["label"]: r["items"] for r in entry.queries()["f25_simple_list"](spark, place).collect()} == want


def test_batch_answers_of_every_user_turn(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [(k, turn, "user" if turn % 2 == 0 else "assistant", f"text {k} of {turn}" + "!" * turn) for k in (2, 10, 1) for turn in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{place}/conversations.parquet")
    got = entry.queries()["e08_batch_answers"](spark, place).collect()
    want = sorted((k, turn, text, f"about {len(text)}") for k, turn, role, text in rows if role == "user")
    assert [(r["conv_id"], r["turn"], r["question"], r["answer"]) for r in got] == want
    assert {(r["citation_1_name"], r["citation_1_headings"], r["citation_1_source"], r["citation_1_text"], r["attrib__n"]) for r in got} == {("Doc", "A > B", "src", "cited", "1")}


def test_untagged_events_of_users(spark, tmp_path):
    place = f"file://{tmp_path}"
    props = [(1, '{"k": 3}'), (1, '{"k": 4}'), (5, '{"k": 0}'), (5, '{"k": 5}'), (6, '{"k": 5}'), (2, "{}"), (2, None), (None, '{"k": 1}')]
    spark.createDataFrame([(n, u, p) for n, (u, p) in enumerate(props)], "event_id long, user_id long, props string").write.parquet(f"{place}/events.parquet")
    queries = entry.queries()
    assert sorted(r["event_id"] for r in queries["p05_untagged_events_of_users"](spark, place).collect()) == [1, 3, 5, 6]
    assert not [name for name in queries if "p04_p05" in name]  # the time range alone doesn't hold P05


SAID = ["One. Two?  Three! Four... Five", "No mark", "", None, " \n a. b.\tc?\n", "A (citation-9). B. C. D. E. F. G. H. I."]


def sentences(text):
    return re.split(r"(?<=[.?!])", text)


def with_citations(text, first):
    name = lambda n: f" (citation-{n % 7 + 1})"
    return "".join(s[:-1] + name(first + 3 * i) + name(first + 3 * i + 1) + s[-1] if s[-1:] in (".", "?", "!") and s else s for i, s in enumerate(sentences(text)))


def test_citations_in_the_texts_of_documents(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [(k, SAID[k % len(SAID)]) for k in range(18)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{place}/documents.parquet")
    want = {}
    for k, text in rows:
        of = [*sentences(text or ""), *[""] * 5]
        known = [C.Cited(f"citation-{i + 1}", "a" if i < 3 else "b", i, of[i]) for i in range(5)]
        response, cited = C.simplified(with_citations(text or "", k), known)
        assert list(dict.fromkeys(re.findall(r"\(citation-(\d+)\)", response))) == [str(n + 1) for n in range(len(cited))] or "citation-9" in (text or "")
        want[k] = (response, len(cited), cited[0].text if cited else None)
    assert {r["doc_id"]: tuple(r)[1:] for r in entry.queries()["r06_r11_simplified_citations"](spark, place).collect()} == want


def test_citations_behind_marks_and_their_order(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [(k, SAID[k % len(SAID)]) for k in range(18)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([(k, 3, t) for k, t in rows], "conv_id long, turn long, text string").write.parquet(f"{place}/conversations.parquet")
    moved = {r["item_id"]: r["moved"] for r in entry.queries()["r07_citations_behind_marks"](spark, place).collect()}
    assert moved == {k: None if t is None else C.behind_marks(with_citations(t, k)) for k, t in rows}
    order = {r["conv_id"]: r["cited"] for r in entry.queries()["w09_citation_order"](spark, place).collect()}
    assert order == {k: None if t is None else ",".join(dict.fromkeys(C.CITATION.findall(with_citations(t, k + 3)))) for k, t in rows}


def test_links_in_the_texts_of_items(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [(k, SAID[k % len(SAID)]) for k in range(18)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    html = {r["item_id"]: r["html"] for r in entry.queries()["f29_f30_linked_answers"](spark, place).collect()}
    assert html == {k: None if t is None else re.sub(r" ?\(citation-(\d+)\)", r'<sup><a href="#citation-\1">\1</a></sup>', with_citations(t, k)) for k, t in rows}
    assert {r["item_id"]: r["md"] for r in entry.queries()["h03_without_anchors"](spark, place).collect()} == dict(rows)
