"""Streams that stop and go on."""

from pyspark.sql import functions as F

from lexloom.streaming import jobs as S

SCHEMA = "key long, ts timestamp, id long, kind string, value double"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "key long, ts string, id long, kind string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_pairs_and_windows_go_on_where_they_stopped(spark, tmp_path):
    source, pairs, windows = (str(tmp_path / x) for x in ("in", "pairs", "windows"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    _write(spark, source, [(1, "2024-01-01 10:00:00", 1, "start", 1.0), (1, "2024-01-01 10:10:00", 2, "start", 1.0), (2, "2024-01-01 10:20:00", 3, "done", 2.0)])
    assert S.run_available(S.pair_live(stream()), folder=pairs).count() == 0
    assert S.run_available(S.per_window(stream(), "1 hour", late="1 hour"), folder=windows).count() == 0
    _write(spark, source, [(1, "2024-01-01 12:30:00", 4, "fail", 4.0), (1, "2024-01-01 12:40:00", 5, "done", 1.0), (2, "2024-01-01 12:50:00", 6, "start", 1.0), (2, "2024-01-01 12:55:00", 7, "done", 1.0)])
    assert sorted(map(tuple, S.run_available(S.pair_live(stream()), folder=pairs).collect())) == [(1, 2, 4, "failed"), (2, 6, 7, "completed")]
    closed = S.run_available(S.per_window(stream(), "1 hour", late="1 hour"), folder=windows).collect()
    assert [(r["n"], r["total_value"]) for r in closed] == [(3, 4.0)]
    _write(spark, source, [(2, "2024-01-01 10:30:00", 8, "done", 9.0), (2, "2024-01-01 15:00:00", 9, "done", 1.0)])  # the first is too late
    assert sorted((r["n"], r["total_value"]) for r in S.run_available(S.per_window(stream(), "1 hour", late="1 hour"), folder=windows).collect()) == [(3, 4.0), (4, 7.0)]


def test_upserts_go_on_where_they_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    shape = "k long, v string, w string, ord int"
    start = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    stream = lambda: spark.readStream.schema(shape).parquet(source)
    spark.createDataFrame([(1, "a1", None, 1), (1, "a2", None, 2), (3, None, "z", 1)], shape).coalesce(1).write.parquet(source)
    assert sorted(map(tuple, S.upsert_stream(stream(), start, ["k"], "ord", folder).collect())) == [(1, "a2", "x"), (2, "b", "y"), (3, None, "z")]
    spark.createDataFrame([(1, None, "x9", 1), (3, "c", None, 1)], shape).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # nothing new the second time
        assert sorted(map(tuple, S.upsert_stream(stream(), start, ["k"], "ord", folder).collect())) == [(1, "a2", "x9"), (2, "b", "y"), (3, "c", "z")]


def _files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.parquet"))


def test_changes_are_folded_and_files_stay_few(spark, tmp_path):
    """Many batches: the table and its log hold a bounded number of files, other buckets are not rewritten, and
    doing it all again changes nothing."""
    source, folder = tmp_path / "in", tmp_path / "state"
    shape = "k long, v string, w string, ord int"
    start = spark.createDataFrame([(i, "a", f"w{i}") for i in range(40)], "k long, v string, w string")
    for b in range(14):
        spark.createDataFrame([(b % 5, f"v{b}", None, 1), (100 + b, "new", None, 1)], shape).coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(source))
    want = {(i, "a" if i > 4 else None, f"w{i}") for i in range(5, 40)} | {(100 + b, "new", None) for b in range(14)} | {(k, f"v{max(b for b in range(14) if b % 5 == k)}", f"w{k}") for k in range(5)}
    got = S.upsert_stream(stream(), start, ["k"], "ord", str(folder), fold_every=4, buckets=6)
    # files are read in the order of their times, which may tie: only keys that one batch changes are sure
    sure = lambda rows: {r for r in rows if r[0] > 4}
    assert sure(map(tuple, got.collect())) == sure(want) and got.count() == 54
    held = _files(folder / "table")
    assert 1 <= len(held) <= 6 and len({f.split("/")[0] for f in _files(folder / "changes")}) < 4
    first = sorted(map(tuple, got.collect()))
    again = S.upsert_stream(stream(), start, ["k"], "ord", str(folder), fold_every=4, buckets=6)
    assert sorted(map(tuple, again.collect())) == first and _files(folder / "table") == held


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    from lexloom.operators import buckets as B
    from lexloom.sources import sinks

    path = tmp_path / "t"
    B.create_buckets(spark.range(200).select("id", (F.col("id") * 2).alias("v")), str(path), ["id"], 8)
    before = set(_files(path))
    assert len(before) == 8
    touched = B.upsert_buckets(spark.createDataFrame([(7, None), (7_000, 1)], "id long, v long"), str(path), ["id"], 8)
    after = set(_files(path))
    assert {f.split("/")[0] for f in after ^ before} == {f"bucket={b}" for b in touched} and len(after) == 8
    rows = {(r["id"], r["v"]) for r in B.read_buckets(spark, str(path)).collect()}
    assert rows == {(i, 2 * i) for i in range(200)} | {(7000, 1)}
    assert B.upsert_buckets(spark.createDataFrame([], "id long, v long"), str(path), ["id"], 8) == []
    out = str(tmp_path / "vectors")
    sinks.publish_vectors(spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("b", [2.0])], "chunk_id string, embedding array<double>"), out)
    sinks.publish_vectors(spark.createDataFrame([("b", [3.0])], "chunk_id string, embedding array<double>"), out)
    assert sorted((r["chunk_id"], r["embedding"]) for r in spark.read.parquet(out).collect()) == [("a", [1.0]), ("b", [3.0])]


def test_new_weights_count_from_the_next_batch(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    shape = "question_id long, question string"
    now = [("factual", "keyword", "sea", 1.0)]
    read = lambda s: s.createDataFrame(now, "intent string, kind string, term string, weight double")
    stream = lambda: spark.readStream.schema(shape).parquet(source)
    spark.createDataFrame([(1, "the sea")], shape).write.parquet(source)
    S.score_live(stream(), read, folder)
    now[:] = [("thematic", "keyword", "sea", 1.0)]
    spark.createDataFrame([(2, "the sea")], shape).write.mode("append").parquet(source)
    for _ in range(2):
        got = {r["question_id"]: r for r in S.score_live(stream(), read, folder).collect()}
    assert [got[1]["intent"], got[2]["intent"]] == ["factual", "thematic"] and got[1]["version"] != got[2]["version"]


def test_panes_show_what_is_not_closed_and_equal_a_full_scan(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    rows = lambda a, b: [(i % 37, f"2024-01-0{1 + i // 48} {i // 2 % 24:02d}:{30 * (i % 2)}:00", i, "x", float(i)) for i in range(a, b)]
    _write(spark, source, rows(0, 90))
    S.live_panes(stream(), users="key", folder=folder)
    _write(spark, source, rows(90, 150) + rows(149, 150))
    panes = S.live_panes(stream(), users="key", folder=folder)
    every = rows(0, 150) + rows(149, 150)
    assert panes.count() == 75 and panes.agg(F.sum("n")).first()[0] == len(every)
    got = S.over_panes(panes, 24).first()
    recent = [r for r in every if r[2] >= 150 - 48]
    exact = spark.createDataFrame(recent, SCHEMA.replace("timestamp", "string")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("key"))).first()[0]
    assert (got["n"], got["total_value"], got["users"]) == (len(recent), sum(r[4] for r in recent), exact)
    whole = S.run_available(S.rolling(stream(), "6 hours", "2 hours", late="1 hour"), folder=str(tmp_path / "r"))
    plain = S.run_available(S.per_window(stream(), "6 hours", "2 hours", late="1 hour"), folder=str(tmp_path / "p"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, plain.collect())) and whole.count() > 10
