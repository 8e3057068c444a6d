"""Work in one order: packing of long texts, pairing of one long log."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import audit as A
from lexloom.operators import chunking as C


def _folded(paragraphs, most, overlap):
    """The rule, paragraph by paragraph."""
    pieces = [p[i : i + most] for p in paragraphs if p for i in range(0, len(p), most)]
    done, cur = [], []
    for p in pieces:
        if not cur or len(cur) + len(p) <= most:
            cur = cur + p
        else:
            done.append(cur)
            tail = cur[max(0, len(cur) - overlap) :] if overlap else []
            cur = (tail if len(tail) + len(p) <= most else []) + p
    return [" ".join(c) for c in [*done, cur] if c]


@pytest.mark.parametrize(("most", "overlap"), [(1, 0), (5, 0), (5, 2), (7, 6), (40, 9)])
def test_packing_like_the_rule(spark, most, overlap):
    rng = random.Random(most)
    texts = [[[f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 2, 3, 9, 30]))] for _ in range(rng.randrange(40))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(" ".join(p) for p in t)) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["c"] for r in C.packed(df, "t", "c", most, overlap, "\n").collect()}
    assert got == {i: _folded(t, most, overlap) for i, t in enumerate(texts)} | {99: []}
    rows = C.chunk(df, "t", most, overlap, "\n").collect()
    assert sorted((r["i"], r["chunk_index"], r["chunk"]) for r in rows) == sorted((i, k, c) for i, t in enumerate(texts) for k, c in enumerate(_folded(t, most, overlap)))


def test_packing_takes_time_in_proportion(spark):
    """One text of 32,000 paragraphs, each a chunk, against eight of 4,000."""

    def seconds(texts, paragraphs):
        df = spark.range(texts).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(paragraphs)), lambda i: F.concat(F.lit("one two three four "), i.cast("string"))), "\n").alias("t")).repartition(1)
        began = time.time()
        assert C.chunk(df, "t", 5, 0, "\n").count() == texts * paragraphs
        return time.time() - began

    seconds(1, 100)
    assert seconds(1, 32_000) < 3 * seconds(8, 4000) + 1


def _log(spark, n, logs):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("start", "done", "other", "start", "fail")]), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    log = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.col("id") % logs).otherwise(F.lit(0)).cast("long")
    return spark.range(n).select(log.alias("log"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("ts"), "id", kind.alias("kind"), (F.col("id") % 11).alias("value")).repartition(4)


def test_one_long_log_goes_over_all_tasks(spark, monkeypatch):
    df = _log(spark, 60_000, 50)
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    want = A.pair_events(df, "log", ["ts", "id"], "kind", ["id", "value"])
    monkeypatch.setattr(A, "LINES_OF_TASK", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = A.pair_events(df, "log", ["ts", "id"], "kind", ["id", "value"])
        assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert A.pair_events(df.limit(0), "log", ["ts", "id"], "kind", ["id"]).count() == 0


def test_what_is_pending_is_carried_over_ranges_without_the_log(spark, monkeypatch):
    """A start at the very beginning of a log whose next line comes much later."""
    monkeypatch.setattr(A, "LINES_OF_TASK", 1)
    lines = [("b", 0, "start")] + [("a", i, "start" if i % 2 else "done") for i in range(400)] + [("b", 10_000, "fail"), ("b", 10_001, "done"), ("c", 5, "done")]
    df = spark.createDataFrame(lines, "log string, ts long, kind string")
    got = {tuple(r) for r in A.pair_events(df, "log", ["ts"], "kind", ["ts"]).select("log", "start_ts", "ts", "status").collect()}
    assert got == {("a", i - 1, i, "completed") for i in range(2, 400, 2)} | {("b", 0, 10_000, "failed")}
    w = Window.partitionBy("log").orderBy("ts")
    assert df.withColumn("p", F.lag("kind").over(w)).where("kind <> 'start' and p = 'start'").count() == len(got)


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "intent string")
    assert {(r["intent"], r["n"], r["share"]) for r in A.distribution(df, "intent").collect()} == {("a", 2, 0.4), ("b", 1, 0.2), ("unknown", 2, 0.4)}
