"""Commits, versions, change logs, paged stores, exports, sidecars: what is broken off, sent again or comes late."""

import json
import random
from collections import OrderedDict
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quillstone.operators import exports
from quillstone.sources import change_log, datasets, paged, sidecars, versions, writers
from quillstone.sources.commits import Committed, get, names, put
from quillstone.streaming import run, stateful


@pytest.fixture()
def place(spark, tmp_path):
    return f"file://{tmp_path}"


# commits


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, place):
    table = Committed(spark, f"{place}/t")
    assert table.rows("x long").collect() == [] and table.names() == []
    assert table.append("a", spark.range(3).toDF("x"))
    with pytest.raises(RuntimeError):
        table.add("b", lambda where: spark.range(5).toDF("x").write.parquet(where) or (_ for _ in ()).throw(RuntimeError()))
    assert table.names() == ["a"] and table.rows("x long").count() == 3
    assert table.append("b", spark.range(2).toDF("x")) and not table.append("a", spark.range(9).toDF("x"))
    assert table.rows("x long").count() == 5
    with pytest.raises(FileNotFoundError):
        table.get("c")


def test_small_files_are_whole_or_not_there(spark, place):
    put(spark, f"{place}/d/a.json", "é\n")
    assert get(spark, f"{place}/d/a.json") == "é\n" and names(spark, f"{place}/d") == ["a.json"] and names(spark, f"{place}/none") == []


# versions


def test_versions_tell_their_metadata(spark, place):
    with pytest.raises(ValueError, match="no version"):
        versions.latest_qa_version(spark, f"{place}/v")
    pairs = spark.createDataFrame([("1", 'a "quoted",\nq', None, "ds2"), ("2", "", "x", "ds1")], "id string, question string, answer string, document_source string")
    now = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)
    name = versions.version_id(now)
    assert name == "20240506_070809" and versions.save_qa_version(pairs, f"{place}/v", name, "m", "abc", now)
    assert not versions.save_qa_version(pairs.limit(0), f"{place}/v", name)
    m = versions.qa_metadata(spark, f"{place}/v")
    assert {k: m[k] for k in ("version_id", "timestamp", "llm_model", "total_pairs", "datasets", "git_commit")} == {
        "version_id": name, "timestamp": now.isoformat(), "llm_model": "m", "total_pairs": 2, "datasets": ["ds1", "ds2"], "git_commit": "abc",
    }
    rows = versions.qa_pairs(spark, f"{place}/v").orderBy("id").collect()
    assert len(rows[0]) == 14 and rows[0]["question"] == 'a "quoted",\nq' and rows[0]["answer"] is None and rows[1]["version_llm_model"] == "m"
    assert versions.save_qa_version(pairs.limit(0), f"{place}/v", "20240506_070810", "m")
    assert versions.qa_metadata(spark, f"{place}/v")["llm_model"] is None and versions.qa_pairs(spark, f"{place}/v").count() == 0


def test_batches_say_what_they_are(spark, place):
    config = versions.batch_config("b7", 5, ["x"], 3, package="1.2")
    assert len(config["software_info"]["git_commit"]) == 40 and config["evaluation_config"] == {"k_value": 5, "num_samples": 3, "dataset_filter": ["x"]}
    results, bad = spark.range(3).toDF("n"), spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("n"))
    with pytest.raises(Exception, match="no"):
        versions.log_batch(config, results, bad, f"{place}/log", "2024-01-01")
    assert versions.batches(spark, f"{place}/log", "2024-01-01") == []
    versions.log_batch(config, results, results, f"{place}/log", "2024-01-01")
    assert [b["batch_id"] for b in versions.batches(spark, f"{place}/log", "2024-01-01")] == ["b7"]
    assert versions.logged(spark, f"{place}/log", "2024-01-01", "b7", "results", "n long").count() == 3
    with pytest.raises(RuntimeError):
        versions.git_commit("/")


# streams into stores


def test_a_stream_that_fails_between_stores_repeats_nothing(spark, place, monkeypatch):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).toDF("n").coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = lambda: spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    append, calls = Committed.append, []

    def failing(self, name, rows):
        calls.append(name)
        if self.root.endswith("primary") and len(calls) == 3:  # the second batch, after the first is everywhere
            raise OSError("lost")
        return append(self, name, rows)

    monkeypatch.setattr(Committed, "append", failing)
    with pytest.raises(Exception, match="lost"):
        run.fan_out(stream(), f"{place}/primary", [f"{place}/other"], "s", f"{place}/state")
    assert run.stored(spark, f"{place}/primary", "n long").count() == 10
    assert run.fan_out(stream(), f"{place}/primary", [f"{place}/other", "nowhere://x/y"], "s", f"{place}/state") == ["nowhere://x/y: Py4JJavaError"] * 2
    run.fan_out(stream(), f"{place}/primary", [f"{place}/other"], "s", f"{place}/new-state")  # all batches come again
    for store in ("primary", "other"):
        assert sorted(r["n"] for r in run.stored(spark, f"{place}/{store}", "n long").collect()) == list(range(30))
    monkeypatch.undo()
    order = []
    monkeypatch.setattr(Committed, "append", lambda self, name, rows: order.append(self.root[-5:]) or append(self, name, rows))
    run.fan_out(stream(), f"{place}/after", [f"{place}/first"], "s", f"{place}/last-state", primary_last=True)
    assert order == ["first", "after"] * 3
    assert len(run.catch_up(spark, f"{place}/primary", f"{place}/third", "n long")) == 3
    assert run.catch_up(spark, f"{place}/primary", f"{place}/third", "n long") == []


def test_recent_counters_forget_what_was_written_first(spark, place):
    rng = random.Random(4)
    events = [(k, rng.choice("abcdefgh"), rng.randrange(3) if k % 50 else None) for k in range(900)]
    for part in range(3):
        rows = spark.createDataFrame(events[part * 300 : part * 300 + 300], "n long, kind string, who int")
        rows.coalesce(1).write.mode("append").parquet(f"{place}/in")
    shown = sorted(__import__("glob").glob(f"{place[7:]}/in/*.parquet"), key=lambda p: __import__("os").path.getmtime(p))
    assert len(shown) == 3
    stream = spark.readStream.schema("n long, kind string, who int").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    got = run.drain(stateful.throttle_recent(stream, ["kind", "who"], ["n"], F.lit(0), capacity=20, event_id="n"), "recent", many_states=True)
    counts, want = OrderedDict(), []
    for n, kind, who in events:
        c = counts.pop((kind, who), 0) + 1
        counts[(kind, who)] = c
        if len(counts) > 20:
            counts.popitem(last=False)
        if stateful.told(c):
            want.append((n, c))
    assert sorted((r["n"], r["occurrence"]) for r in got.collect()) == want
    assert len(want) > sum(stateful.told(k) for k in range(1, 41)) * 20  # some counted anew


# change logs


def test_change_logs_agree_with_a_dictionary(spark, place):
    rng = random.Random(9)
    batches, state, gone, seq = [], {}, set(), 0
    order = list(range(400))
    rng.shuffle(order)
    ops = []
    for s in order:
        key = f"s{rng.randrange(40)}"
        ops.append((s, key, None if rng.random() < 0.2 else {f: f"{f}{s}" for f in rng.sample(["thread_id", "name", "output"], rng.randrange(0, 4))}))
    for s, key, fields in sorted(ops, key=lambda o: o[0]):
        if fields is None:
            state.pop(key, None)
        else:
            state[key] = state.get(key, {}) | fields
    store = change_log.Stores(spark, f"{place}/a", (f"{place}/b",))
    for n in range(0, 400, 100):
        rows = [("steps", key, s, fields is None, fields or {}) for s, key, fields in ops[n : n + 100]]
        batches.append(spark.createDataFrame(rows, change_log.LOG))
        assert store.write(f"batch-{n:04d}", batches[-1])
        if n in (100, 300):
            assert change_log.compact(spark, f"{place}/b") == (2 if n == 100 else 5)
    assert not store.write("batch-0100", batches[0])
    change_log.clean(spark, f"{place}/b")
    want = {k: (v.get("thread_id"), v.get("name"), v.get("output")) for k, v in state.items()}
    for s in (f"{place}/a", f"{place}/b"):
        got = {r["id"]: (r["thread_id"], r["name"], r["output"]) for r in store.table("steps", s).collect()}
        assert got == want
    key = sorted(state)[0]
    assert [r["name"] for r in store.get("steps", key).collect()] == [want[key][1]] and store.get("steps", "none").collect() == []


def test_threads_are_listed_and_go_with_what_they_hold(spark, place):
    store = change_log.Stores(spark, f"{place}/s")
    assert store.table("threads").collect() == [] and change_log.compact(spark, f"{place}/s") == 0
    threads = spark.createDataFrame([(f"t{k}", f"Thread {k}", "u1" if k % 2 else "u2", f"2024-01-{k + 10}") for k in range(9)], "id string, name string, user_id string, created_at string")
    steps = spark.createDataFrame([(f"s{k}", f"t{k}") for k in range(9)], "id string, thread_id string")
    users = spark.createDataFrame([("u1", "one"), ("u2", "two")], "id string, identifier string")
    log = change_log.changes(threads, "threads", "id", F.lit(1)).unionByName(change_log.changes(steps, "steps", "id", F.lit(1))).unionByName(change_log.changes(users, "users", "id", F.lit(1)))
    store.write("a", log.unionByName(change_log.deletions(threads.where("id = 't5'"), "threads", "id", F.lit(2))))
    rows, pages = store.list_threads("u1", page=1, size=2)
    assert [r["id"] for r in rows.collect()] == ["t7", "t3"] and pages == 2
    assert [r["id"] for r in store.list_threads(search="READ 8")[0].collect()] == ["t8"]
    assert sorted(r["id"] for r in store.table("steps").collect()) == [f"s{k}" for k in range(9) if k != 5] and store.get("steps", "s5").collect() == []
    assert [r["identifier"] for r in store.thread_author("t4").collect()] == ["two"]
    with pytest.raises(ValueError, match="no colour"):
        change_log.changes(threads.withColumn("colour", F.lit("x")), "threads", "id", F.lit(1))


# pages


def _fetch(total=None, stuck=False):
    def fetch(part, cursor):
        low, high = part
        at = cursor or low
        data = [{"n": n, "extra": "x"} for n in range(at, min(at + 3, high))]
        more = at + 3 < high
        return {"data": data, "page_info": {"has_next_page": more or stuck, "end_cursor": at if stuck else at + 3}, "total_count": high - low if total is None else total}

    return fetch


def test_pages_are_followed_to_their_end(spark):
    ranges = paged.time_ranges(0, 50, 4)
    assert ranges == [(0, 12), (12, 25), (25, 37), (37, 50)] and paged.time_ranges(3, 3, 4) == [] and len(paged.time_ranges(0, 2, 9)) == 2
    rows = paged.paged(spark, "numbers", _fetch(), ranges, "n long, lacking string")
    assert rows.rdd.getNumPartitions() == 4
    assert sorted((r["n"], r["lacking"]) for r in rows.collect()) == [(n, None) for n in range(50)]
    assert paged.paged(spark, "numbers", _fetch(), [], "n long").collect() == []
    with pytest.raises(Exception, match="expected 11 entities, but got 1[23]"):
        paged.paged(spark, "numbers", _fetch(11), ranges, "n long").collect()
    with pytest.raises(ValueError, match="stands still"):
        list(paged.entities(_fetch(stuck=True), (1, 3)))


# exports


def _step(i, parent, kind, content, meta, scores=None, thread="t1", start="2024-02-03T04:05:06+00:00"):
    return (thread, i, parent, kind, start, json.dumps({"content": content}), meta if meta is None else json.dumps(meta), scores)


STEPS = "thread_id string, id string, parent_id string, type string, start_time string, output string, metadata string, scores array<struct<value:double,comment:string>>"


def test_exports_have_all_columns(spark):
    request = {"request": {"user_id": "u", "agency_id": "a", "session_id": "s"}}
    cites = [{"uri": "http://x/1", "source_dataset": "D", "source_name": "N"}, {"uri": "http://x/2"}]
    full = {"citations": cites, "attributes": {"benefit_program": "P"}, "chat_history": [{"role": "user"}]}
    rows = [
        _step("q1", None, "user_message", "Q?", request), _step("a1", "q1", "assistant_message", "A.", full, [(1.0, "it's \"so\""), (0.25, None)]),
        _step("q2", None, "user_message", "Q2", request), _step("a2", "q2", "assistant_message", "A2", {"citations": None, "chat_history": []}, [(0.0, "c")]),
        _step("lone", None, "user_message", "?", request), _step("x", "gone", "assistant_message", "?", request), _step("q1", None, "user_message", "no", request, thread="t2"), _step("a9", "q1", "assistant_message", "no", {}, thread="t2"),
    ]
    threads = spark.createDataFrame([("t1", None, ["x"]), ("t2", ["chainlit"], ["x"]), ("t3", [], [])], "id string, tags array<string>, steps array<string>")
    found = exports.export_columns(exports.qa_rows(threads, spark.createDataFrame(rows, STEPS), "p", "http://h"))
    assert found.columns == exports.EXPORT_COLUMNS
    assert [list(r) for r in found.orderBy("Question").collect()] == [
        ["u", "02/03/2024", "Q2", "A2", "http://h/projects/p/logs/threads/t1?currentStepId=q2", "a", "s", "", "", "", "False", "t1", "2024-02-03T04:05:06+00:00", "0.0", "c"],
        ["u", "02/03/2024", "Q?", "A.", "http://h/projects/p/logs/threads/t1?currentStepId=q1", "a", "s", "P", "http://x/1\nhttp://x/2", "D: N\n: ", "True", "t1", "2024-02-03T04:05:06+00:00", "[1.0, 0.25]", "['it\\'s \"so\"', '']"],
    ]


@pytest.mark.parametrize("bad", [
    [_step("q", None, "tool", "Q", {"request": {}}), _step("a", "q", "assistant_message", "A", {})],
    [_step("q", None, "user_message", "", {"request": {}}), _step("a", "q", "assistant_message", "A", {})],
    [_step("q", None, "user_message", "Q", None), _step("a", "q", "assistant_message", "A", {})],
    [_step("q", None, "user_message", "Q", {"request": {}}), _step("a", "q", "user_message", "A", {})],
    [_step("q", None, "user_message", "Q", {"request": {}}), _step("a", "q", "assistant_message", "A", {}), _step("b", "q", "assistant_message", "B", {})],
])
def test_exports_refuse_what_is_no_pair(spark, bad):
    threads = spark.createDataFrame([("t1", None, ["x"])], "id string, tags array<string>, steps array<string>")
    with pytest.raises(Exception, match="needs"):
        exports.qa_rows(threads, spark.createDataFrame(bad, STEPS), "p", "l").collect()


# sidecars


def test_files_stand_in_for_items(spark, place):
    files = spark.createDataFrame([("sub dir/a+b é.md", "own"), ("_x.md", "under")], "path string, content string")
    assert writers.save_files(files, f"{place}/json") == 2
    md = spark.createDataFrame([("deep/_index.md", "folder page"), ("two.md", "by hand"), ("two.splits.json", '[{"headings": ["h"], "text": "t"}]')], "path string, content string")
    writers.save_files(md, f"{place}/md")
    rows = [("http://h/one", "sub dir/a+b é.md", None), ("http://h/deep/", None, "said"), ("http://h/two", None, "said"), ("http://h/three", None, "said"), ("http://h/four", "_x.md", None)]
    items = spark.createDataFrame(rows, "url string, md_file string, markdown string").withColumn("_own", F.lit("mine"))
    found = sidecars.with_splits(sidecars.with_content(items, f"{place}/json", f"{place}/md", "http://h"), f"{place}/md", F.array(sidecars.split(F.array(F.lit("x")), F.col("content"), F.lit(" c "))))
    got = {r["url"][9:]: (r["content"], r["edited"], r["splits"][0]["text"], r["splits"][0]["text_to_encode"], r["_own"]) for r in found.collect()}
    assert got == {
        "one": ("own", False, "own", "c\n\nown", "mine"), "deep/": ("folder page", False, "folder page", "c\n\nfolder page", "mine"), "two": ("by hand", True, "t", None, "mine"),
        "three": ("said", False, "said", "c\n\nsaid", "mine"), "four": ("under", False, "under", "c\n\nunder", "mine"),
    }
    for lost in [("http://h/x", "none.md", "said"), ("http://h/x", None, None)]:
        with pytest.raises(Exception, match="an item"):
            sidecars.with_content(spark.createDataFrame([lost], "url string, md_file string, markdown string"), f"{place}/json", f"{place}/nothing", "http://h").collect()


def test_documents_and_chunks_come_and_go_together(spark, place):
    library = datasets.Library(spark, f"{place}/lib")
    assert library.documents().collect() == [] and not library.drop("a")
    items = lambda ids, ds, n: spark.createDataFrame([(i, ds, "t", f"u{i}", "c", [(["h"], f"x{k}", "e", "", "") for k in range(n)]) for i in ids], f"doc_id long, dataset string, title string, url string, content string, splits {sidecars.SPLIT}")
    load = lambda *a, **b: library.load(*sidecars.documents_and_chunks(items(*a)), **b)
    load([1, 2], "a", 2)
    load([3], "b", 1)
    library.resume(*sidecars.documents_and_chunks(items([2, 4], "a", 3)))
    count = lambda: (sorted(r["doc_id"] for r in library.documents().collect()), library.chunks().count())
    assert count() == ([1, 2, 3, 4], 8)
    documents, chunks = sidecars.documents_and_chunks(items([7, 8], "c", 2))
    with pytest.raises(ValueError, match="no document"):
        library.load(documents.where("doc_id = 7"), chunks)
    assert count() == ([1, 2, 3, 4], 8)
    load([1], "a", 1, replaces="a")
    assert count() == ([1, 3], 2)
    assert library.drop("b") and not library.drop("b") and count() == ([1], 1)
    load([3], "b", 2)
    assert count() == ([1, 3], 3)
