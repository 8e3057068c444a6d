import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators.audit import pair_events, parse_service_log
from lexloom.sources import readers as R
from lexloom.sources import sinks as S


def test_text_corpus(spark, tmp_path):
    for name, text in (("1993_morrison.txt", " talk "), ("2000.txt", "ceremony"), ("2001_x.txt", " "), ("notes.txt", "n")):
        (tmp_path / name).write_text(text)
    got = sorted(map(tuple, R.read_text_corpus(spark, str(tmp_path)).collect()))
    assert got == [(1993, "morrison", "talk"), (2000, None, "ceremony")]


def test_jsonl_and_awards(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    schema = spark.range(0).selectExpr("int(id) as k").schema
    assert sorted(r["k"] for r in R.read_records(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    (tmp_path / "b.json").write_text(json.dumps([{"year_awarded": 2000, "category": "c", "laureates": [{"full_name": "A B", "grand_lecture_file": "f.txt", "grand_lecture_title": "On rivers", "declined": False}]}]))
    person = R.read_awards(spark, str(tmp_path / "b.json"), "grand").select(F.explode("laureates").alias("p")).first()["p"]
    assert (person["full_name"], person["lecture_file"], person["lecture_title"], person["declined"], person["country"]) == ("A B", "f.txt", "On rivers", False, None)
    with pytest.raises(ValueError, match="prefix"):
        R.read_awards(spark, str(tmp_path / "b.json"), "other")
    counts = R.validate_jsonl(spark, str(tmp_path / "a.jsonl"), ["k"]).first()
    assert (counts["total"], counts["malformed"], counts["valid"]) == (3, 1, 2)


def test_dimensions(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"hope": ["Dream", "dream", "light"]}')
    assert sorted(map(tuple, R.read_dimension(spark, "themes", str(tmp_path / "t.json")).collect())) == [("hope", "dream"), ("hope", "light")]
    (tmp_path / "i.json").write_text(json.dumps({"intents": {"factual": {"keywords": {"who": 0.4}, "phrases": {"who won": 0.8}}}}))
    assert sorted(map(tuple, R.read_dimension(spark, "intents", str(tmp_path / "i.json")).collect())) == [("factual", "keyword", "who", 0.4), ("factual", "phrase", "who won", 0.8)]
    assert R.read_dimension(spark, "intents").count() > 40 and R.read_dimension(spark, "templates").count() == 15


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "x" * 600, True, ["a", "b"], 7), ("2", None, None, [], 7)], "query_id string, final_answer string, error_occurred boolean, retrieval_method array<string>, answer_length int")
    S.export_audit_csv(df, str(tmp_path / "a"))
    read = lambda name: spark.read.csv(str(tmp_path / name), header=True)
    got = {r["query_id"]: r for r in read("a").collect()}
    assert len(read("a").columns) == 26 and read("a").columns == list(S.AUDIT_COLUMNS)
    assert (got["1"]["error_occurred"], got["1"]["retrieval_method"], got["1"]["answer_length"]) == ("Yes", "a, b", "600")
    assert (got["2"]["error_occurred"], got["2"]["answer_length"], got["2"]["user_query"]) == ("No", "7", None)
    S.export_focused_csv(df, str(tmp_path / "f"))
    assert read("f").columns == list(S.FOCUSED_COLUMNS) and max(len(r["final_answer"] or "") for r in read("f").collect()) == 503
    S.export_analysis_csv(df, str(tmp_path / "n"))
    assert read("n").columns == list(S.ANALYSIS_COLUMNS) and {r["error_occurred"] for r in read("n").collect()} == {"true", "false"}
    assert df.select(S.without_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ["a"])).first()[0] == {"b": 2}
    S.write_report(df, str(tmp_path / "r"))
    assert len([json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r")).collect()]) == 2
    v = spark.createDataFrame([("c1", [1.0]), ("c1", [1.0])], "chunk_id string, embedding array<float>")
    S.publish_vectors(v, str(tmp_path / "v"))
    S.publish_vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    S.write_metadata(v, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).columns == ["chunk_id"]
    S.append_audit(spark.createDataFrame([("2024-01-01 00:00:00", 1)], "ts string, n int").withColumn("ts", F.to_timestamp("ts")), str(tmp_path / "d"))
    assert [p.name for p in (tmp_path / "d").glob("dt=*")] == ["dt=2024-01-01"]


def test_service_log_pairs(spark):
    kinds = ["start a", "start b", "done 5 100", "done 6 100", "start c", "fail boom"]
    lines = [(f"2024-01-01 10:00:0{i} {k}",) for i, k in enumerate(kinds)] + [("noise",), ("2024-xx",)]
    parsed = parse_service_log(spark.createDataFrame(lines, "value string"), r"start (\w+)", r"done (\d+) (\d+)", r"fail (\w+)").withColumn("log", F.lit(1))
    got = pair_events(parsed, "log", ["ts"], "kind", ["query"]).orderBy("ts").collect()
    assert [(r["start_query"], r["status"], r["chunk_count"], r["error"]) for r in got] == [("b", "completed", 5, None), ("c", "failed", None, "boom")]


def test_variant_lines(spark):
    from lexloom.sources.readers import parse_variants, shape_counts

    lines = ['{"a": 1, "b": "x"}', '{"a": "7", "b": null}', '{"a": "no", "c": 1}', '{"a": [1], "b": {"d": 2}}', "not json", "", None, "[1, 2]", '{"a": 1.5, "b": true}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    parsed = parse_variants(df, {"a": "bigint", "b": "string"})
    got = {r["i"]: (r["a"], r["b"], r["malformed"], r["missing"], r["drifted"]) for r in parsed.collect()}
    assert got[0] == (1, "x", False, [], []) and got[1] == (7, None, False, [], []) and got[2] == (None, None, False, ["b"], ["a"])
    assert got[3][0] is None and got[3][4][:1] == ["a"] and got[7] == (None, None, False, ["a", "b"], [])
    assert all(got[i] == (None, None, True, [], []) for i in (4, 5, 6)) and got[8][1] == "true"
    counts = {(r["what"], r["field"]): r["n"] for r in shape_counts(parsed).collect()}
    assert counts[("lines", None)] == 9 and counts[("malformed", None)] == 3 and counts[("missing", "b")] == 2


def test_sql_functions_like_the_frame_ones(spark):
    from lexloom.functions.text import clean_text
    from lexloom.functions.vectors import l2_normalize
    from lexloom.operators.chunking import chunk
    from lexloom.session import register_sql

    assert {"lex_clean_text", "lex_l2", "lex_chunk", "lex_links"} <= set(register_sql(spark))
    texts = ["  a [note] “b”  c\n\n\n\nd \n e…", "x *Translated by me\nSource: y\nz", None, "", "it’s ‘so’ – or\\n not", "[" + "long " * 30 + "] kept"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df.createOrReplaceTempView("sql_texts")
    assert sorted(map(tuple, spark.sql("select i, lex_clean_text(t) from sql_texts").collect())) == sorted(map(tuple, df.select("i", clean_text(F.col("t"))).collect()))
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "i int, v array<float>")
    v.createOrReplaceTempView("sql_vectors")
    assert sorted(map(repr, spark.sql("select i, lex_l2(v) from sql_vectors").collect())).__len__() == 3
    assert [r[0] for r in spark.sql("select lex_l2(v) from sql_vectors order by i").collect()] == [r[0] for r in v.orderBy("i").select(l2_normalize("v")).collect()]
    long = spark.createDataFrame([(1, "a b c\n\nd e\n\nf g h i j k"), (2, None)], "i int, t string")
    long.createOrReplaceTempView("sql_long")
    got = spark.sql(r"select i, c.chunk_index, c.chunk from sql_long, lateral lex_chunk(t, 4, 1, r'\n\s*\n') c")
    assert sorted(map(tuple, got.collect())) == sorted((r["i"], r["chunk_index"], r["chunk"]) for r in chunk(long, "t", 4, 1).collect())
    page = "<p><a class='x' href='/a.pdf'>The <b>talk</b>\n &amp; more</a><A HREF=\"b\">c</A><a name='n'>no</a></p>"
    spark.createDataFrame([(page,), (None,)], "html string").createOrReplaceTempView("sql_pages")
    assert sorted(map(tuple, spark.sql("select l.* from sql_pages, lateral lex_links(html) l").collect())) == [(0, "/a.pdf", "The talk & more"), (1, "b", "c")]
