"""Live pairing of lines out of order."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators.audit import pair_events
from lexloom.streaming import jobs as S
from lexloom.streaming import ordered as O

SCHEMA = "key long, ts timestamp, id long, kind string"


@pytest.fixture
def rocks(spark):
    with O.rocksdb(spark):
        yield spark


def _frame(spark, rows):
    return spark.createDataFrame([(k, m, i, kind) for k, m, i, kind in rows], "key long, m long, id long, kind string").select("key", F.timestamp_seconds(F.lit(1_704_100_000) + F.col("m") * 60).alias("ts"), "id", "kind")


def test_lines_out_of_order_across_batches_pair_like_the_batch(rocks, tmp_path):
    """Lines come up to an hour late, over several runs of one checkpoint, after a batch that left starts pending."""
    spark, rng = rocks, random.Random(3)
    lines = [(i % 3, 2 * i, i, rng.choice(["start", "start", "done", "fail", "other"])) for i in range(360)]
    before, after = lines[:60], sorted(lines[60:], key=lambda x: x[1] + rng.randrange(50))
    end = [(9, 5000, 999, "start")]  # moves the watermark past all lines
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    initial = O.pending_starts(_frame(spark, before))
    for part in (after[:110], after[110:111], after[111:], end):
        _frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = S.run_available(O.pair_ordered(stream, idle="30 days", late="1 hour", initial=initial), folder=folder)
    want = pair_events(_frame(spark, lines), "key", ["ts", "id"], "kind", ["id"]).where("id >= 60")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want.select("key", F.col("start_id"), F.col("id").alias("end_id"), "status")) and got.count() > 50


def test_starts_without_an_end_go(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "in")
    for part in ([(1, 0, 1, "start"), (2, 0, 2, "start")], [(2, 30, 3, "done"), (8, 500, 4, "start")], [(1, 600, 5, "done"), (8, 2000, 6, "start")]):
        _frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        got = S.run_available(O.pair_ordered(spark.readStream.schema(SCHEMA).parquet(source), idle="2 hours", late="10 minutes"), folder=str(tmp_path / "out"))
    assert list(map(tuple, got.collect())) == [(2, 2, 3, "completed")]


def test_calls_grow_with_groups_not_with_logs(rocks, tmp_path, monkeypatch):
    """Many logs, one of them without a key, share the calls of their groups; microseconds decide the order."""
    spark, seen, source = rocks, str(tmp_path / "seen"), str(tmp_path / "in")

    class Counted(O._Pairing):
        def handleInputRows(self, key, rows, timerValues):
            with open(seen, "a") as f:
                print(key, file=f)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(O, "_Pairing", Counted)
    base = 1_704_100_000_000_000
    lines = [(k or None, base + 3, 10 * k + 1, "done") for k in range(60)] + [(k or None, base + 2, 10 * k + 2, "start") for k in range(60)] + [(k or None, base + 1, 10 * k + 3, "fail") for k in range(60)]
    events = spark.createDataFrame([*lines, (99, base + 10**12, 999, "start"), (7, None, 998, "done")], "key long, us long, id long, kind string")
    events.select("key", F.timestamp_micros("us").alias("ts"), "id", "kind").coalesce(1).write.parquet(source)
    got = S.run_available(O.pair_ordered(spark.readStream.schema(SCHEMA).parquet(source), idle="30 days", late="1 hour", groups=4))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k or None, 10 * k + 2, 10 * k + 1, "completed")) for k in range(60))
    assert len(open(seen).readlines()) <= 4
