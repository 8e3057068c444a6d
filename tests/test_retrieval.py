import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import retrieval as R


def _scored(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from([0.0, 0.1, 0.2, 0.3, 0.9])), min_size=1, max_size=40, unique_by=lambda x: x[:2]))
def test_fallback_bounds(spark, rows):
    out = R.with_fallback(_scored(spark, rows), 0.2, 3, 5).collect()
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        got = [r for r in out if r["query_id"] == q]
        passed = [r for r in mine if r[2] >= 0.2]
        want = min(5, len(passed)) if len(passed) >= 3 else min(3, len(mine))
        assert len(got) == want
        assert {r["filtering_reason"] for r in got} == {"threshold" if len(passed) >= 3 else "min_return_fallback"}


def test_merge_keeps_best_and_prefers_other_kinds(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "ceremony"), (2, [1.0, 0.0], "lecture"), (3, [0.0, 1.0], "lecture")], "chunk_id long, vec array<float>, kind string")
    terms = spark.createDataFrame([(7, 10, 0, 0.9, [1.0, 0.0]), (7, 11, 1, 0.1, [0.0, 1.0])], "query_id long, term_id long, term_rank int, weight double, vec array<float>")
    got = R.retrieve_terms(terms, corpus, 3, 0.2, 1, None, True, "kind", "ceremony", dim=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1, 3]
    assert got[0]["score"] == pytest.approx(math.exp(1.8), abs=1e-6) and got[2]["boost_factor"] == pytest.approx(math.exp(0.2), abs=1e-6)


def test_top_k_skips_bad_vectors_and_handles_empty(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "chunk_id long, vec array<float>")
    asked = spark.createDataFrame([(5, [1.0, 0.0])], "query_id long, vec array<float>")
    assert [tuple(r) for r in R.top_k(asked, corpus, 3, None, 2).collect()] == [(5, 1, 1.0, 0)]
    assert R.top_k(asked.limit(0), corpus, 3, None, 2).count() == 0


def _ring(n, salt):
    a = np.random.default_rng(salt).uniform(0, 2 * np.pi, n)
    return np.round(np.stack([np.cos(a), np.sin(a)], 1), 3)


def _brute(q, c, k):
    out = set()
    for i, scores in enumerate(np.round(q.astype(np.float32).astype(float) @ c.astype(np.float32).astype(float).T, 6)):
        out |= {(i, int(j), float(scores[j]), r) for r, j in enumerate(np.lexsort((np.arange(len(c)), -scores))[:k])}
    return out


def test_many_queries_meet_the_corpus_in_tiles(spark, monkeypatch):
    q, c = _ring(20_000, 1), _ring(40, 2)
    frame = lambda x, name: spark.createDataFrame(pd.DataFrame({name: range(len(x)), "vec": x.tolist()}), f"{name} long, vec array<float>")
    got = R.top_k(frame(q, "query_id"), frame(c, "chunk_id"), 3, None, 2)
    assert set(map(tuple, got.toPandas().round(6).itertuples(index=False))) == _brute(q, c, 3)
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 7)
    few = frame(q[:30], "query_id").repartition(3)
    assert set(map(tuple, R.top_k(few, frame(c, "chunk_id").repartition(5), 4, None, 2).collect())) == _brute(q[:30], c, 4)
    named = frame(c, "chunk_id").withColumn("chunk_id", F.format_string("c%03d", "chunk_id"))
    assert {(r["query_id"], int(r["chunk_id"][1:]), r["score"], r["rank"]) for r in R.top_k(few, named, 4, None, 2).collect()} == _brute(q[:30], c, 4)


def test_ties_are_cut_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(R, "CANDIDATES", 10_000)
    same = spark.range(100_000).select((99_999 - F.col("id")).alias("chunk_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vec")).repartition(3)
    asked = spark.createDataFrame([(i, [1.0, 0.0], 5 + i) for i in range(3)] + [(9, [1.0, 0.0], 0)], "query_id long, vec array<float>, k int")
    got = R.top_k(asked, same, None, None, 2)
    assert sorted((r["query_id"], r["chunk_id"]) for r in got.collect()) == [(i, c) for i in range(3) for c in range(5 + i)]
    found = R._near_few(same, asked.where("k > 0").withColumn("value", F.lit(None).cast("string")).toArrow(), 2, False)
    assert found.count() <= 3 * 18 * same.rdd.getNumPartitions()


def test_fallback_with_limits_of_each_query(spark):
    rows = [(q, c, 0.9 - c / 10) for q in (1, 2) for c in range(9)]
    limits = spark.createDataFrame([(1, 0.85, 5, 12), (2, 0.25, 3, 4)], "query_id long, t double, least int, most int")
    got = R.with_fallback(_scored(spark, rows).join(limits, "query_id"), F.col("t"), F.col("least"), F.col("most")).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in got) == [(1, c) for c in range(5)] + [(2, c) for c in range(4)]
    assert {(r["query_id"], r["filtering_reason"]) for r in got} == {(1, "min_return_fallback"), (2, "threshold")}


def test_short_terms_do_not_retrieve_without_weights(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a")], "chunk_id long, vec array<float>, kind string")
    terms = spark.createDataFrame([(7, 10, 0, 0.1, "of", [1.0, 0.0]), (7, 11, 1, 0.1, "sea", [0.0, 1.0])], "query_id long, term_id long, term_rank int, weight double, term string, vec array<float>")
    for weighted, n in ((False, {11}), (True, {10, 11})):
        assert {r["term_id"] for r in R.retrieve_terms(terms, corpus, 1, 0.2, 1, None, weighted, "kind", "b", dim=2).collect()} == n


@pytest.mark.parametrize("bad", [{"k": 0}, {"threshold": -1.0}, {"max_return": 1}, {"min_return": 9}])
def test_parameters(spark, bad):
    df = spark.createDataFrame([(5, [1.0])], "query_id long, vec array<float>")
    with pytest.raises(ValueError):
        R.retrieve(df, df, **bad)


def test_texts_are_embedded_like_the_corpus(spark):
    from lexloom.functions.vectors import embed_table
    from lexloom.operators.themes import term_vectors

    docs = spark.createDataFrame([(1, "hope and light"), (2, "war and peace"), (3, "")], "chunk_id long, text string")
    corpus = embed_table(docs, "text").withColumnRenamed("embedding", "vec")
    asked = spark.createDataFrame([(9, "peace and war")], "query_id long, question string")
    got = R.retrieve_texts(asked, corpus, k=1, threshold=0.2, min_return=1).collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(2, pytest.approx(1.0))]
    themes = spark.createDataFrame([("a", "hope"), ("b", "hope"), ("b", "light")], "theme string, keyword string")
    assert sorted(r["keyword"] for r in term_vectors(themes).collect()) == ["hope", "light"]


def _scoped_rows():
    """A third of the rows under one value, a value that nobody has, rows without one, queries of one, two, no and all values."""
    c = _ring(600, 3)
    names = [None if i % 10 == 9 else "hot" if i % 3 == 0 else f"v{i % 7}" for i in range(len(c))]
    scopes = [["hot"], ["v1", "v2"], None, [], ["nobody"], ["hot", None], [None], ["v3", "v3", "hot"]]
    q = _ring(160, 4)
    return c, names, q, [scopes[i % len(scopes)] for i in range(len(q))]


@pytest.mark.parametrize("most", [16_384, 5])
def test_scoped_queries_meet_only_their_rows(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_QUERIES", most)
    c, names, q, scopes = _scoped_rows()
    corpus = spark.createDataFrame([(i, v.tolist(), n) for i, (v, n) in enumerate(zip(c, names, strict=True))], "chunk_id long, vec array<float>, author string").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(q, scopes, strict=True))], "query_id long, vec array<float>, author array<string>").repartition(3)
    got = {}
    for r in R.top_k(asked, corpus, 4, None, 2, scope="author").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    scores = np.round(q.astype(np.float32).astype(float) @ c.astype(np.float32).astype(float).T, 6)
    for i, s in enumerate(scopes):
        own = [j for j in range(len(c)) if not s or names[j] in [v for v in s if v is not None]]
        best = sorted(own, key=lambda j: (-scores[i, j], j))[:4]
        assert sorted(got.get(i, [])) == [(k, j, scores[i, j]) for k, j in enumerate(best)], s


def test_tiles_split_the_hot_value(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("value"))
    asked = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("value"))
    plan = {r["value"]: r for r in R._tile_plan(rows, asked, 1000).collect()}
    hot = plan["hot"]
    assert hot["asks"] / hot["groups"] <= 1000 and hot["groups"] * hot["parts"] >= 4
    assert all(r["asks"] * r["held"] / (r["groups"] * r["parts"]) <= 1.5e7 / 4 for r in plan.values())


def test_terms_of_scoped_queries(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a", "x"), (2, [0.9, 0.1], "a", "y"), (3, [0.0, 1.0], "a", "y")], "chunk_id long, vec array<float>, kind string, author string")
    terms = spark.createDataFrame([(7, "t", 0, 0.5, [1.0, 0.0], ["y"]), (8, "t", 0, 0.5, [1.0, 0.0], None), (9, "u", 0, 0.5, [0.0, 1.0], ["x"])], "query_id long, term_id string, term_rank int, weight double, vec array<float>, author array<string>")
    got = R.retrieve_terms(terms, corpus, 1, 0.2, 1, None, True, "kind", "b", dim=2, scope="author")
    assert sorted((r["query_id"], r["chunk_id"], r["term_id"]) for r in got.collect()) == [(7, 2, "t"), (8, 1, "t"), (9, 1, "u")]


def _clusters(n, salt, dim=8):
    rng = np.random.default_rng(salt)
    centers = np.random.default_rng(99).normal(size=(25, dim))
    m = centers[rng.integers(0, 25, n)] + 0.05 * rng.normal(size=(n, dim))
    return np.round(m / np.linalg.norm(m, axis=1, keepdims=True), 3)


@pytest.mark.parametrize("most", [16_384, 20])
def test_pruned_top_k_is_exact_and_skips(spark, monkeypatch, most):
    """Clusters, copies, vectors of different lengths and unusable ones; a k above the rows of a block and of the corpus."""
    from lexloom.operators.pruning import index_corpus, top_k_pruned

    monkeypatch.setattr(R, "BROADCAST_QUERIES", most)
    c, q = _clusters(900, 1), _clusters(60, 2)
    c[100:140], c[200:205] = c[100], c[200:205] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, vec array<float>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "query_id long, vec array<float>").repartition(3)
    index = index_corpus(corpus, 8, 150)
    for k, probe in ((5, 2), (60, 1), (1000, 3)):
        got, report = top_k_pruned(asked, index, k, probe)
        assert set(map(tuple, got.collect())) == _brute(q, c, k)
        told = report.first()
        assert told["pairs"] == 60 * 900 and told["scored"] <= told["pairs"]
        if k == 5:
            assert told["skipped"] > 0.6
    assert top_k_pruned(asked.limit(0), index, 3)[0].count() == 0


def test_a_task_holds_few_candidates_from_the_first_rows_on():
    rng = np.random.default_rng(7)
    vectors, rows, seen = rng.normal(size=(1024, 8)), rng.integers(-2, 3, (4096, 8)).astype(float), []

    class Counted(R._Best):
        def _cut(self):
            seen.append(self.n)
            super()._cut()

    best = Counted(np.arange(1024), vectors, np.full(1024, 5))
    best.add(np.arange(4096), rows)
    got = [tuple(x) for b in best.rows(pa.int64()) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    scores = np.round(rows @ vectors.T, 6)
    want = [(q, i, scores[i, q]) for q in range(1024) for i in np.lexsort((np.arange(4096), -scores[:, q]))[:5].tolist()]
    assert got == want and max(seen) < 1_000_000


def test_similarities_of_the_map_are_rounded_as_in_sql(spark, duck):
    """Of six digits that end in 50, half are rounded down in binary arithmetic."""
    values = [(1, i, (300_050 + 100 * i) / 1e6) for i in range(500)]
    m = R.similarity_map(spark.createDataFrame(values, "query_id int, term_id int, similarity double")).first()["similarities"]
    want = {str(i): duck.execute("select round(?::double, 4)", [v]).fetchall()[0][0] for _, i, v in values}
    assert m == want
