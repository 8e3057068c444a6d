"""The corpus build against chunks packed by hand, for each kind of text."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from tables import SMALL
from lexloom.operators import chunking as C
from lexloom.plans import texts


def _packed(text, most, paragraphs):
    chunks, now = [], []
    for p in re.split(paragraphs, text or ""):
        w = p.split()
        for piece in (w[i : i + most] for i in range(0, len(w), most)):
            if now and len(now) + len(piece) > most:
                chunks.append(" ".join(now))
                now = []
            now = now + piece
    return chunks + ([" ".join(now)] if now else [])


def test_corpus_build_by_hand(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    people = [(r["c_custkey"], r["c_name"]) for r in spark.read.parquet(f"{SMALL}/customer.parquet").collect()]
    longest, own = {}, {d: _packed(t, 200, "\n") for d, t in docs}
    for d, t in docs:
        longest[d % 100] = max(longest.get(d % 100, (-1,)), (len(t or ""), -d, t or ""))
    shared = {y: len(_packed(x[2], 200, "\n")) for y, x in longest.items()}
    want = defaultdict(lambda: [0, 0])
    for key, _ in people:
        for kind, n in (("motivation", 1), ("life", 1), ("lecture", len(own.get(key, []))), ("ceremony", shared.get(key % 100, 0))):
            want[kind][0] += n
            want[kind][1] += n > 0
    got = {r["source_type"]: (r["chunks"], r["ids"], r["entities"]) for r in texts.corpus_build(spark, SMALL).collect()}
    assert got == {k: (n, n, m) for k, (n, m) in want.items()} and got["ceremony"][0] > got["motivation"][0]


def test_shared_texts_reach_every_entity_of_their_year(spark):
    people = spark.createDataFrame([("Ada One", 1901, "m"), ("Bo Two", 1901, "n"), ("Cy Three", 1902, " ")], "full_name string, year_awarded int, motivation string")
    own = spark.createDataFrame([], "year_awarded int, lastname string, source_type string, text string")
    shared = spark.createDataFrame([(1901, "ceremony", "a b\nc d e\nf"), (1902, "ceremony", " "), (1903, "ceremony", "x"), (1901, "toast", None)], "year_awarded int, source_type string, text string")
    got = C.build_corpus(people, own, shared, {"motivation": False}, 3, 0, "\n").select("full_name", "source_type", "chunk_index", "chunk").collect()
    want = [(n, "ceremony", k, c) for n in ("Ada One", "Bo Two") for k, c in enumerate(_packed("a b\nc d e\nf", 3, "\n"))]
    assert sorted(map(tuple, got)) == sorted([*want, ("Ada One", "motivation", 0, "m"), ("Bo Two", "motivation", 0, "n")])


def test_counts_of_a_corpus_sum_up_texts_first(spark):
    """Two entities of a year share a last name, so their chunks share ids; the longer text has them all."""
    rows = [("Ada One", 1901, "one", "a", k) for k in range(3)] + [("Bo One", 1901, "one", "a", k) for k in range(5)] + [("Cy Two", 1902, "two", "a", 0), (None, 1902, "two", "b", 0)]
    built = spark.createDataFrame(rows, "full_name string, year_awarded int, lastname string, source_type string, chunk_index int").withColumn("chunk_id", C.chunk_id(*map(F.col, ("year_awarded", "lastname", "source_type", "chunk_index"))))
    assert sorted(map(tuple, C.corpus_counts(built).collect())) == [("a", 9, 6, 3), ("b", 1, 1, 0)]
