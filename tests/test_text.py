import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexloom.functions import html as W
from lexloom.functions import text as T
from lexloom.functions import vectors as V
from lexloom.operators import chunking as C
from lexloom.operators.filters import is_vague, query_fault
from lexloom.operators.intent import classify, subtype
from lexloom.sources.readers import INTENT_WEIGHTS, parse_query_log


def _one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(expr(F.col("c"))).collect()]


def test_clean_text(spark):
    assert _one(spark, T.clean_text, "  “a”  b [note] — c…\n\n\n\nd \n e ", None) == ['"a" b - c...\n\nd\ne', None]


def test_lines(spark):
    assert _one(spark, T.drop_boilerplate, "Share this\n\n  Real line \nCopyright 2020\nx-ray") == ["Real line"]
    assert _one(spark, T.cut_ceremony, "Your Majesties,\nbody\nTo cite this section\nrest") == ["body"]
    assert _one(spark, T.distinct_paragraphs, "a\nb\n a \n\nb") == ["a\nb"]
    assert _one(spark, T.first_line, "\n  \n t \nu", "") == ["t", None]


def test_dates_names_places(spark):
    assert [str(x) for x in _one(spark, T.parse_date, "1902-05-11", "Born: 23 September 1901", "1931-02-30", "")] == ["1902-05-11", "1901-09-23", "None", "None"]
    assert _one(spark, T.last_name, "Inês Duarté", "") == ["duarté", None]


def test_folded_keys_are_those_of_decomposition(spark):
    names = ["Žižkov O'Neil", "Nguyễn Thị Mộng", "ǒﬁ Straße", "ＦＵＬＬ ½ ㎏", "Łódź Ørsted Þ", "e\u0301", ""]
    want = ["".join(x for x in unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower() if x.isalnum()) for n in names]
    assert _one(spark, T.folded_key, *names) == want


def test_award_lines(spark):
    text = "Grand lecture\nBody\nGRAND Diploma"
    assert _one(spark, T.drop_boilerplate, text) == [text]
    assert _one(spark, lambda c: T.drop_boilerplate(c, award="Grand"), text) == ["Body"]
    assert _one(spark, T.country_from_place, "Žižkov, Austria-Hungary") == ["Austria-Hungary"]
    assert _one(spark, T.gender_from_pronouns, "He wrote", "her work", "theirs") == ["Male", "Female", None]


def test_questions(spark):
    assert _one(spark, query_fault, None, "", "  ", "a", "123", "?!", "what is it") == ["empty", "empty", "blank", "short", "digits", "specials", None]
    assert _one(spark, is_vague, "tell me about it please", "two words", "1 2 3 4", "what is the theme") == [True, True, True, False]


@pytest.mark.parametrize(
    "text, intent, sub",
    [("What year did she win", "factual", None), ("Compare themes and patterns across speeches", "thematic", "analytical"), ("Write a draft in the style of a poet", "generative", None), ("How do laureates think about justice", "thematic", "synthesis")],
)
def test_intents(spark, text, intent, sub):
    df = spark.createDataFrame([(text,)], "q string")
    got = subtype(classify(df, "q", INTENT_WEIGHTS), "q").first()
    assert got["intent"] == intent and 0.1 <= got["confidence"] <= 1
    assert sub is None or got["subtype"] == sub


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n", max_size=120), st.integers(2, 6), st.integers(0, 1))
def test_packing_keeps_words(spark, text, most, overlap):
    chunks = C.packed(spark.createDataFrame([(text,)], "t string"), "t", "c", most, overlap, "\n").first()[0]
    assert all(0 < len(c.split()) <= most for c in chunks)
    if not overlap:
        assert [w for c in chunks for w in c.split()] == text.split()


def test_packing_example(spark):
    df = spark.createDataFrame([("a b c | d e | f g h i | j",), (None,)], "t string")
    assert [r["c"] for r in C.packed(df, "t", "c", 5, 0, r"\|").collect()] == [["a b c d e", "f g h i j"], []]


def test_uuid_and_vectors(spark):
    assert _one(spark, V.uuid5, "a", "é_1") == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("a", "é_1")]
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],), ([float("nan"), 1.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.vector_fault("v", 2)).collect()] == [None, "zero", "null", "dim", "nan"]
    assert df.select(V.l2_normalize("v")).first()[0] == pytest.approx([0.6, 0.8])


def test_embedder_failures_become_null(spark):
    import numpy as np

    def factory():
        def embed(texts):
            if "bad" in texts:
                raise ValueError
            return np.ones((len(texts), 2), np.float32)

        return embed

    V.register_embedder("fixed", 2, factory)
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string").coalesce(1)
    assert [r["embedding"] for r in V.embed_table(df, "t", "fixed").collect()] == [[1.0, 1.0], None, None]


def test_pages(spark):
    page = "<h1>T</h1><p>Born: 23 September 1901, Žižkov, Austria-Hungary</p><p>Language: Czech</p><h3>Life</h3><p>a</p><p>b</p><p>a</p><h3>Work</h3><p>c</p>"
    b = W.parse_pages(spark.createDataFrame([(page,), (None,)], "html string"))
    got = b.select(W.facts(F.col("blocks")).alias("f"), W.section(F.col("blocks"), "life").alias("life"), W.section(F.col("blocks"), "none").alias("none"), W.absence(F.col("blocks")).alias("d")).collect()
    f = got[0]["f"]
    assert (str(f["born"]), f["died"], f["country"], f["language"]) == ("1901-09-23", None, "Austria-Hungary", "Czech")
    assert (got[0]["life"], got[0]["none"], got[0]["d"]["delivered"], got[1]["d"]["reason"]) == ("a\nb", "", True, "no_text")


SPEECH = """<html><head><title>x</title><script>var p = "<p>no</p>";</script></head><body><div class="nav"><p>Menu</p></div>
<h1>Evening</h1><h2>Site</h2><h2>On rivers</h2><div class="article-body"><p>By the staff</p><p>Ladies and gentlemen, I speak of rivers.</p>
<p class="smallprint citation">cite me</p><p>They run &amp; run.</p><p>Share this</p><p>To cite this section</p><p>footer</p></div></body></html>"""


def _blocks(spark, *pages):
    return W.parse_pages(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string"))


def test_main_text_prefers_the_article(spark):
    long = " ".join(f"w{i}" for i in range(60))
    pages = [f"<p>out</p><div class='article-body'><p>{long}</p></div>", f"<p>menu</p><main><p>{long}</p></main>", f"<p>{long}</p><p>more</p>", "<div class='content'><p>short</p></div>"]
    got = {r["i"]: r["m"] for r in _blocks(spark, *pages).select("i", W.main_text(F.col("blocks")).alias("m")).collect()}
    assert got == {0: long, 1: long, 2: f"{long}\nmore", 3: None}


def test_article_speech_and_transcript(spark):
    b = F.col("blocks")
    got = _blocks(spark, SPEECH, "<h1>Only</h1><p>one</p>", None).select(
        "i", W.article(b).alias("a"), W.speech_span(b, ("ladies", "your majest")).alias("span"), W.transcript(b, 5).alias("t"), W.transcript(b, 50)["text"].alias("gated")
    )
    speech, plain, empty = got.orderBy("i").collect()
    assert (speech["a"]["title"], speech["a"]["body"].split("\n")[0]) == ("On rivers", "By the staff")
    assert "cite me" not in speech["a"]["body"] and "Menu" not in speech["a"]["body"]
    assert speech["span"] == "Ladies and gentlemen, I speak of rivers.\ncite me\nThey run & run.\nShare this"
    assert speech["t"]["title"] == "Evening" and "Share this" not in speech["t"]["text"] and "They run & run." in speech["t"]["text"] and speech["gated"] is None
    assert (plain["a"]["title"], plain["a"]["body"], plain["span"], plain["t"]["text"]) == ("Only", "", "one", None)
    assert (empty["a"]["title"], empty["span"], empty["t"]["title"]) == (None, "", None)


def test_absence_and_links(spark):
    pages = ["<h1>Page not found</h1>", "<p>She did not deliver a lecture.</p>", "<p> </p>", "<p>Speech</p><a href='/a.PDF'>the talk</a><a href='http://x/b.pdf'>other</a><a href='/c.html'>the talk</a>"]
    got = _blocks(spark, *pages).select("i", W.absence(F.col("blocks")).alias("d"), W.pick_links(F.col("links"), "http://h", ".pdf", "", "talk").alias("l")).orderBy("i").collect()
    assert [(r["d"]["delivered"], r["d"]["reason"]) for r in got] == [(False, "missing_page"), (False, "not_delivered"), (False, "no_text"), (True, None)]
    assert got[3]["l"] == ["http://h/a.PDF"]


def test_large_theme_dimensions_are_cut_into_shards(spark, monkeypatch):
    from lexloom.operators import matching
    from lexloom.operators import themes as H

    docs = spark.createDataFrame([(1, "light of the sea"), (2, "dark"), (3, None), (4, "Sea, sea")], "i int, t string")
    themes = spark.createDataFrame([("water", "sea"), ("water", "of the"), ("day", "light"), ("day", "sun")], "theme string, keyword string")
    here = [sorted(map(repr, f(docs, "i", "t", themes, {"sea": "sun"}).collect())) for f in (H.extract_themes, H.expand_keywords)]
    assert here[0] == sorted(map(repr, [Row(i=1, themes=["day", "water"]), Row(i=4, themes=["day", "water"])]))
    monkeypatch.setattr(matching, "SHARD_BYTES", 300)
    assert here == [sorted(map(repr, f(docs, "i", "t", themes, {"sea": "sun"}).collect())) for f in (H.extract_themes, H.expand_keywords)]


def test_query_log(spark):
    lines = spark.createDataFrame([("2024-01-01 10:00:00\tweb\tq1\textra",), ("bad\tweb\tq",), ("2024-01-01 10:00:00\tweb",)], "value string")
    assert [(r["source"], r["query"]) for r in parse_query_log(lines).collect()] == [("web", "q1")]
