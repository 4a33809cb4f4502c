"""Streams over several files, with late rows and a closing row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.config import Config
from emberline.operators import features
from emberline.plans import queries
from emberline.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def files(spark, path, batches):
    import os
    import time

    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), u, t, v) for e, m, u, t, v in rows], SCHEMA)
        made.coalesce(1).write.mode("append").parquet(path)
        new = max((f.path for f in os.scandir(path) if f.name.endswith(".parquet")), key=os.path.getctime)
        os.utime(new, (time.time() - 1000 + 10 * k,) * 2)


def test_batch_equals_stream_after_a_closing_row(spark, tmp_path):
    path = str(tmp_path / "a")
    files(spark, path, [[(1, 5, 1, "a", 1.0), (2, 70, 1, "a", 3.0)], [(3, 75, 1, "a", 5.0)], [(9, 10_000, 1, "a", 0.0)]])
    got = jobs.run_to_tier(jobs.tumbling(jobs.event_stream(spark, path, 1)), "t")
    want = features.tumbling(spark.read.parquet(path)).where(F.col("start") < F.lit(T0 + dt.timedelta(days=5)))
    assert {(r["start"], r["n"], r["v"]) for r in got.collect()} == {(r["start"], r["n"], r["v"]) for r in want.collect()}


def test_a_late_row_is_dropped_two_batches_later(spark, tmp_path):
    path = str(tmp_path / "b")
    files(spark, path, [[(1, 5, 1, "a", 1.0)], [(2, 600, 1, "a", 1.0)], [(3, 610, 1, "a", 1.0)], [(4, 6, 1, "a", 99.0)], [(9, 10_000, 1, "a", 0.0)]])
    got = {r["start"]: r["n"] for r in jobs.run_to_tier(jobs.tumbling(jobs.event_stream(spark, path, 1)), "late").collect()}
    assert got[T0] == 1


def test_duplicates_are_dropped_across_files(spark, tmp_path):
    path = str(tmp_path / "c")
    files(spark, path, [[(1, 5, 1, "a", 1.0)], [(1, 5, 1, "a", 1.0), (2, 6, 1, "a", 1.0)]])
    got = jobs.run_to_tier(jobs.deduplicated(jobs.event_stream(spark, path, 1)).select("event_id"), "d")
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2]


def test_ewma_state_spans_files(spark, tmp_path):
    path = str(tmp_path / "e")
    files(spark, path, [[(1, 5, 1, "a", 1.0)], [(2, 6, 1, "a", 2.0)]])
    got = jobs.run_to_tier(jobs.ewma(jobs.event_stream(spark, path, 1)), "w", "update", lambda rows: rows.where("known").groupBy("user_id").agg(F.max_by("ewma", "batch").alias("ewma")))
    assert [(r["user_id"], round(r["ewma"], 9)) for r in got.collect()] == [(1, 1.3)]


@pytest.fixture(scope="module")
def overlapping(spark, tmp_path_factory):
    """The same events as one file, and as three files of which each spans all the time."""
    root = tmp_path_factory.mktemp("overlap")
    rows = [(i, 45 * i, i % 2, ("click", "error", "view")[i % 7 % 3], float(i * i % 11)) for i in range(120)]
    files(spark, str(root / "one" / "events.parquet"), [rows])
    files(spark, str(root / "three" / "events.parquet"), [[x for x in rows if x[0] % 3 == k] for k in (2, 0, 1)])
    return root


@pytest.mark.parametrize("name", ["j1_stream_tumbling", "j2_stream_sessions", "j3_stream_dedup", "j4_stream_join", "j5_stream_ewma"])
def test_files_that_overlap_in_time_lose_no_row(spark, overlapping, name):
    one, three = (sorted(map(tuple, queries.QUERIES[name](spark, str(overlapping / x)).collect())) for x in ("one", "three"))
    assert one and three == one


def test_slices_are_replayed_in_time_order(spark, overlapping):
    replay = jobs.time_sliced(spark, str(overlapping / "three" / "events.parquet"), rows_a_trigger=25, rows_a_file=8)
    assert replay.slices == 5
    got = jobs.run_to_tier(jobs.deduplicated(replay.stream()), "sliced", fold=lambda rows: rows, replay=replay)
    seen = [(r["ts"], r["batch"]) for r in got.orderBy("ts").collect()]
    assert len(seen) == 120 and len({b for _, b in seen}) == 5 and [b for _, b in seen] == sorted(b for _, b in seen)
    # a slice is several files, read at once by as many tasks
    assert spark.read.parquet(f"{replay.root}/sliced/slice=1").rdd.getNumPartitions() > 1 or spark.read.parquet(f"{replay.root}/sliced/slice=1").select(F.input_file_name()).distinct().count() > 1


def test_replay_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "events.parquet"))
    replay = jobs.time_sliced(spark, str(tmp_path / "events.parquet"))
    assert replay.slices == 1 and spark.read.schema(replay.schema).parquet(f"{replay.root}/sliced/slice=0").count() == 0


def test_an_idle_users_state_goes(spark, tmp_path):
    """User 1 is idle for longer than a day, by the timer; user 2 for less; and user 3 within one batch."""
    path, day = str(tmp_path / "idle"), 24 * 60
    files(spark, path, [
        [(1, 0, 1, "a", 1.0), (2, 0, 2, "a", 1.0), (3, 0, 3, "a", 1.0), (4, 3 * day, 3, "a", 5.0)],
        [(5, day - 60, 2, "a", 2.0), (6, 4 * day, 9, "a", 0.0)],
        [(7, 4 * day + 1, 9, "a", 0.0)],
        [(8, 4 * day + 2, 1, "a", 2.0)],
    ])
    out = jobs.run_to_tier(jobs.ewma(jobs.event_stream(spark, path, 1), config=Config(idle_days=1)), "idle", "update", lambda rows: rows)
    rows = out.collect()
    last = {u: max((r["batch"], r["ewma"]) for r in rows if r["user_id"] == u and r["known"])[1] for u in (1, 2, 3, 9)}
    assert last == {1: 2.0, 2: pytest.approx(1.3), 3: 5.0, 9: 0.0}
    assert 1 in {r["user_id"] for r in rows if not r["known"]}
