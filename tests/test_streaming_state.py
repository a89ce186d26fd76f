"""State that a stream of snapshots keeps up to date."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rolegrain.streaming import state as S

SCHEMA = f"board_token string, posting_id string, title string, {S.STAMPS}"
POSTING = "board_token string, posting_id string, title string, fetched_at timestamp"


def at(hour):
    return dt.datetime(2024, 3, 1, hour)


def rows(frame):
    names = [c for c in ("owner_id", "board_token", "posting_id", "title", "is_active", "last_seen_at", "updated_at", "as_of") if c in frame.columns]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


def snapshot(spark, board, ids, hour, title="t"):
    return spark.createDataFrame([(board, i, f"{title}{hour}", at(hour)) for i in ids], POSTING)


def model(state, snapshots):
    """The same rule, one snapshot after another."""
    state = {k: dict(v) for k, v in state.items()}
    for board, hour, ids in sorted(snapshots, key=lambda s: s[1]):
        if any(v["as_of"] >= at(hour) for (b, _), v in state.items() if b == board):
            continue
        for (b, i), v in state.items():
            if b == board:
                if v["active"] and i not in ids:
                    v.update(active=False, updated=at(hour))
                v["as_of"] = at(hour)
        for i in ids:
            state[board, i] = {"title": f"t{hour}", "active": True, "seen": at(hour), "updated": at(hour), "as_of": at(hour)}
    return state


def test_batches_against_one_snapshot_after_another(spark, tmp_path):
    rng = random.Random(9)
    store = S.BucketedState(spark, str(tmp_path / "state"), SCHEMA, buckets=5)
    known, hours = {}, iter(rng.sample(range(1, 24), 18))
    for batch in range(6):
        snapshots = [(rng.choice("abc"), next(hours), sorted({str(rng.randint(0, 6)) for _ in range(rng.randint(1, 5))})) for _ in range(3)]
        frame = None
        for board, hour, ids in snapshots:
            one = snapshot(spark, board, ids, hour)
            frame = one if frame is None else frame.union(one)
        store.update(batch, frame, S.merge_snapshots)
        known = model(known, snapshots)
        got = {(r[0], r[1]): (r[2], r[3], r[4], r[6]) for r in rows(store.read())}
        assert got == {k: (v["title"], v["active"], v["seen"], v["as_of"]) for k, v in known.items()}, batch


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = S.BucketedState(spark, str(tmp_path / "state"), SCHEMA, buckets=4)
    store.update(0, snapshot(spark, "a", ["1", "2"], 1), S.merge_snapshots)
    store.update(1, snapshot(spark, "a", ["2", "3"], 2), S.merge_snapshots)
    first = rows(store.read())
    store.update(1, snapshot(spark, "a", ["2", "3"], 2), S.merge_snapshots)
    assert rows(store.read()) == first
    assert {r[1]: r[3] for r in first} == {"1": False, "2": True, "3": True}
    # A version that was not finished does not count.
    (tmp_path / "state" / "batch=1" / "_SUCCESS").unlink()
    assert {r[1] for r in rows(store.read())} == {"1", "2"}


def test_late_and_unusable_snapshots(spark, tmp_path):
    store = S.BucketedState(spark, str(tmp_path / "state"), SCHEMA, buckets=4)
    store.update(0, snapshot(spark, "a", ["1", "2"], 5), S.merge_snapshots)
    store.update(1, snapshot(spark, "a", ["2"], 8), S.merge_snapshots)
    before = rows(store.read())
    store.update(2, snapshot(spark, "a", ["1", "9"], 6), S.merge_snapshots)  # late: 1 stays closed, 9 unknown
    assert rows(store.read()) == before
    odd = spark.createDataFrame([("a", None, "x", at(20)), ("a", " ", "x", at(20)), (None, "1", "x", at(20)), ("a", "2", "x", None)], POSTING)
    store.update(3, odd, S.merge_snapshots)
    assert rows(store.read()) == before
    store.update(4, snapshot(spark, "a", [" 1 "], 9), S.merge_snapshots)
    assert {r[1]: r[3] for r in rows(store.read())} == {"1": True, "2": False}


def test_owners_have_boards_of_their_own(spark):
    state = spark.createDataFrame([], f"owner_id string, {SCHEMA}")
    seen = spark.createDataFrame([("x", "a", "1", "t", at(1)), ("y", "a", "2", "t", at(2))], f"owner_id string, {POSTING}")
    state = S.merge_snapshots(state, seen)
    later = spark.createDataFrame([("x", "a", "3", "t", at(2))], f"owner_id string, {POSTING}")
    state = S.merge_snapshots(state, later)
    assert {(r[0], r[2]): r[4] for r in rows(state)} == {("x", "1"): False, ("x", "3"): True, ("y", "2"): True}


def test_few_boards_touch_few_buckets(spark, tmp_path):
    store = S.BucketedState(spark, str(tmp_path / "state"), SCHEMA, buckets=64)
    boards = spark.range(400).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("board_token"))
    full = boards.select("board_token", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("posting_id"), F.lit("t").alias("title"), F.lit(at(1)).alias("fetched_at"))
    # Which buckets 400 boards fall into is up to the hash: all that they fall into are written, no other.
    assert store.update(0, full, S.merge_snapshots) == sorted(r[0] for r in boards.select(store.bucket()).distinct().collect())
    part = full.filter("board_token in ('b1', 'b2', 'b3', 'b4')").withColumn("fetched_at", F.lit(at(2)))
    touched = store.update(1, part.filter("posting_id = '1'"), S.merge_snapshots)
    assert len(touched) <= 4
    folders = store._folders(str(tmp_path / "state" / "batch=1"))
    assert sum(name.startswith("bucket=") for name in folders) == len(touched)
    assert store.read().count() == 800 and store.read().filter("not is_active").count() == 4
    assert store.drop_replaced() == len(touched) and store.read().count() == 800


@pytest.mark.parametrize("files", [1, 100])
def test_stream_of_files(spark, tmp_path, files):
    landed = tmp_path / "landed"
    landed.mkdir()

    def land(name, board, ids, hour):
        jobs = [{"id": i, "title": f"t{hour}", "content": "{" * 50} for i in ids]
        (landed / name).write_text(json.dumps({"board_token": board, "fetched_at": at(hour).isoformat(), "jobs": jobs}))

    store = S.BucketedState(spark, str(tmp_path / "state"), SCHEMA, buckets=4)
    land("1.json", "a", [1, 2], 1)
    land("2.json", "b", [1], 1)
    S.stream_state(spark, str(landed), store, str(tmp_path / "checkpoint"), files).awaitTermination(200)
    assert {(r[0], r[1]) for r in rows(store.read())} == {("a", "1"), ("a", "2"), ("b", "1")}
    before = rows(store.read())
    S.stream_state(spark, str(landed), store, str(tmp_path / "checkpoint"), files).awaitTermination(200)
    assert rows(store.read()) == before
    land("3.json", "a", [2], 3)
    (landed / "4.json").write_text('{"board_token": "b", "jobs": [{"id": 5')  # cut short: closes nothing
    S.stream_state(spark, str(landed), store, str(tmp_path / "checkpoint"), files).awaitTermination(200)
    assert {(r[0], r[1]): r[3] for r in rows(store.read())} == {("a", "1"): False, ("a", "2"): True, ("b", "1"): True}


def test_rows_of_one_fetch_come_once(spark, tmp_path):
    source = str(tmp_path / "rows")
    snapshot(spark, "a", ["1", "2"], 1).write.parquet(source)
    snapshot(spark, "a", ["1", "2"], 1).write.mode("append").parquet(source)
    snapshot(spark, "a", ["1"], 2).write.mode("append").parquet(source)
    stream = S.once_per_fetch(spark.readStream.schema(POSTING).parquet(source))
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
    assert spark.read.parquet(out).count() == 3
