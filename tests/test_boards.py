"""Board files read by many tasks against whole-file parsing."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolegrain.sources import board_files, snapshots

TEXTS = ['plain', 'a "quoted" part', 'back\\slash', 'ends with \\', '{"jobs": [{"id": 1}]}', '}{][', '\\"}{', 'é 😀 ß', '', '\n\t', '"', '\\\\"', '"jobs":[']


def job(rng, number):
    text = "".join(rng.choice(TEXTS) for _ in range(rng.randint(0, 12)))
    return {
        "id": rng.choice([number, str(number), f" {number} "]), "title": rng.choice(TEXTS), "absolute_url": "u", "content": text * rng.choice([1, 1, 40]),
        "location": {"name": rng.choice(TEXTS)}, "offices": [{"name": "HQ", "location": {"name": rng.choice(TEXTS)}}, {"name": None, "location": "Rome"}][: rng.randint(0, 2)],
        "metadata": [{"name": "N", "value": rng.choice([5, ["x", "y"], "z"])}], "jobs": [{"id": -1}],
    }


def document(rng, number):
    jobs = [job(rng, 1000 * number + i) for i in range(rng.choice([0, 1, 3, 60]))]
    fields = [("board_token", f"b{number}"), ("run_id", rng.choice(TEXTS)), ("jobs", jobs), ("meta", {"total": 3, "jobs": [{"id": 7}], "x": {"y": {}}}),
              ("departments", [{"id": 8, "jobs": [{"id": 9}]}]), ("company", "C"), ("fetch_status", rng.choice(["SUCCESS", None]))]
    rng.shuffle(fields)
    return dict(fields)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for key, value in names.items():
        spark.conf.set(key, value)
    yield
    for key in names:
        spark.conf.unset(key)


def test_files_over_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(4)
    expected, status = {}, {}
    for number in range(25):
        doc = document(rng, number)
        (tmp_path / f"{number}.json").write_text(json.dumps(doc, indent=rng.choice([None, None, 2]), ensure_ascii=rng.random() < 0.5), newline="")
        for j in doc["jobs"]:
            expected[str(j["id"]).strip()] = (doc["board_token"], doc["run_id"], j["title"], j["content"], j["location"]["name"], len(j["offices"]))
        status[doc["board_token"]] = "SUCCESS" if doc["jobs"] else "NO_JOBS"
    assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 50
    postings, found = board_files.read_boards(spark, str(tmp_path), chunk=300)
    rows = postings.select("posting_id", "board_token", "run_id", "title", "content", "location.name", F.size("offices")).collect()
    assert len(rows) == len(expected) and {r[0]: tuple(r[1:]) for r in rows} == expected
    assert {r.board_token: r.fetch_status for r in found.collect()} == status
    # The same rows as from documents that are parsed whole.
    whole = snapshots.postings_from_documents(spark.read.text(str(tmp_path), wholetext=True))
    assert sorted(map(str, whole.collect())) == sorted(map(str, postings.collect()))


def test_files_that_are_no_whole_document(spark, tmp_path, small_splits):
    jobs = [{"id": i, "title": "t" * 300, "content": "c"} for i in range(20)]
    text = json.dumps({"board_token": "cut", "jobs": jobs})
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    (tmp_path / "string.json").write_text(json.dumps({"board_token": "open"})[:-3])
    (tmp_path / "two.json").write_text('{"board_token": "two", "jobs": [{"id": 1}]}\n{"board_token": "three", "jobs": [{"id": 2}]}')
    (tmp_path / "failed.json").write_text('{"board_token": "failed", "fetch_status": "FETCH_FAILED"}')
    (tmp_path / "none.json").write_text('{"board_token": "none", "jobs": null}\n')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "good.json").write_text('{"board_token": "good", "jobs": [{"id": 1}, 5, null, [{"id": 3}], {"id": 2, "offices": [{"name": "x"}]}]}')
    postings, status = board_files.read_boards(spark, str(tmp_path), chunk=100)
    assert sorted((r.board_token, r.posting_id) for r in postings.collect()) == [("good", "1"), ("good", "2")]
    found = {r.board_token: r.fetch_status for r in status.collect()}
    assert {k: found[k] for k in ("failed", "none", "good", "two")} == {"failed": "FETCH_FAILED", "none": "NO_JOBS", "good": "SUCCESS", "two": "FETCH_FAILED"}
    assert "SUCCESS" not in [v for k, v in found.items() if k != "good"]


def test_one_scan_of_the_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"board_token": "a", "jobs": [{"id": 1}]}')
    postings, status = board_files.read_boards(spark, str(tmp_path))
    for frame in (postings, status):  # both read the stored parse, not the files
        assert "Scan text" not in frame._jdf.queryExecution().executedPlan().toString()
    assert postings.count() == 1 and status.first().fetch_status == "SUCCESS"


def test_one_chunk_of_a_batch_is_in_python_at_a_time():
    size, rows = 1 << 20, 24
    text = '{"jobs": [{"content": "' + "x" * size + '"}]}'
    columns = [["f"] * rows, [0] * rows, list(range(rows)), [text] * rows, [0] * rows, [0] * rows]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "block", "chunk", "text", "quoted", "depth"])
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in board_files._entries(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == rows * 4 and peak < rows * size
