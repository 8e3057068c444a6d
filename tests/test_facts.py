import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.operators import facts as X
from lexloom.operators.filters import flatten
from lexloom.operators.merge import upsert
from lexloom.plans import answers as answer_plans
from lexloom.plans import facts as facts_plans
from lexloom.session import materialize
from tables import SMALL

ROWS = [
    (0, "Mira Halvorsen", 1951, "female", "norway", "letters", "for her river songs", "1902-05-11", "1980-01-03"),
    (1, "Tomas Okafor-Lind", 1952, "male", "ghana", "letters", "for plain speech", "1911-12-30", None),
    (2, "Inês Duarte", 1955, "female", "portugal", "letters", "for novels of the coast", "1920-07-07", None),
    (3, "Joanna Duarte Reis", 1956, "female", "portugal", "letters", "for short plays", "1931-03-14", "1999-09-09"),
    (4, "Tomas Okafor-Lind", 1958, "male", "ghana", "letters", "for late essays", "1911-12-30", None),
]
SCHEMA = "ord int, full_name string, year_awarded int, gender string, country string, category string, prize_motivation string, date_of_birth string, date_of_death string"
#: One question or more for each rule, with other cases, punctuation and names that are parts or unknown.
CASES = [
    ("what year did mira halvorsen win", "Mira Halvorsen won in 1951."),
    ("When did DUARTE win the prize??", "Inês Duarte won in 1955."),
    ("When was Duarte Reis awarded!", "Joanna Duarte Reis won in 1956."),
    ("When did Okafor-Lind win?", "Tomas Okafor-Lind won in 1952."),
    ("When did an win?", "Joanna Duarte Reis won in 1956."),
    ("Who received the prize in 1955?", "In 1955, the prize went to Inês Duarte."),
    ("Winner in 1953?", "No laureate found for 1953."),
    ("Where is Halvorsen from?", "Mira Halvorsen is from norway."),
    ("country of Nobody Known?", "No laureate found matching 'Nobody Known'."),
    ("How many women won since 1952?", "2 women won the prize since 1952."),
    ("How many women won since 2050", "0 women won the prize since 2050."),
    ("Which country has received the most awards?", "ghana has won the most, with 2 laureates."),
    ("Who was the last woman laureate?", "The last female laureate was Joanna Duarte Reis in 1956."),
    ("who was the first male winner", "The first male laureate was Tomas Okafor-Lind in 1952."),
    ("How many winners are from Portugal?", "2 laureates are from Portugal."),
    ("How many laureates are from Narnia?", "0 laureates are from Narnia."),
    ("What is the motivation for Joanna Duarte?", "Joanna Duarte Reis was recognised for short plays."),
    ("When was Mira Halvorsen died?", "Mira Halvorsen was died on 1980-01-03."),
    ("When was Inês Duarte died?", "No date of that kind is known for Inês Duarte."),
    ("Which years was the prize not awarded?", "The prize was not awarded in: 1953, 1954, 1957."),
    ("Who was the last portugal laureate?", "The last portugal laureate was Joanna Duarte Reis in 1956."),
    ("How many men have won?", "2 men have won."),
]


@pytest.fixture(scope="module")
def answers(spark):
    facts = spark.createDataFrame(ROWS, SCHEMA)
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)] + [(97, "Who was the prize for?"), (98, "How many, please?"), (99, "Sing of the coast")], "question_id int, question string")
    return {r["question_id"]: r["answer"] for r in X.answer_facts(asked, facts).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(answers, i):
    assert answers[i] == CASES[i][1]


def test_no_rule(answers):
    assert not {97, 98, 99} & set(answers)


def test_countries(spark):
    dim = X.country_dimension(spark)
    df = spark.createDataFrame([("norway",), (" USA ",), ("Soviet Union",), ("Narnia",), (None,)], "c string")
    assert {r["c"]: r["flag"] for r in X.with_flag(df, "c", dim).collect()} == {"norway": "🇳🇴", " USA ": "🇺🇸", "Soviet Union": "🇷🇺", "Narnia": None, None: None}


def test_flatten(spark):
    df = spark.createDataFrame([(1980, [("Mo",), ("Nia",)]), (1981, [("Ola",)]), (1982, [])], "year int, items array<struct<name: string>>")
    assert [tuple(r) for r in flatten(df, "items", ["year"]).orderBy("year", "ord").collect()] == [(1980, 0, "Mo"), (1980, 1, "Nia"), (1981, 0, "Ola")]


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, None, "z"), (3, "c", None)], "k int, v string, w string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a", "z"), (2, "b", "y"), (3, "c", None)]


def test_scoped_entities(spark):
    names = spark.createDataFrame([("Mira Halvorsen",), ("Inês Duarte",), ("Ann Halv",)], "full_name string")
    asked = spark.createDataFrame([(1, "Compare Mira Halvorsen and Duarte"), (2, "What about Halvorsens?")], "question_id int, question string")
    got = {r[0]: r[1] for r in X.scoped_entities(asked, names).collect()}
    assert got == {1: ["Mira Halvorsen", "Inês Duarte"]}


def _people(spark, n=40):
    rows = [(i, f"Ada {i:09d}", 1990 + i % 3, "Female", "chile", "for work", "1900-01-01", None) for i in range(n)]
    return spark.createDataFrame(rows, "ord long, full_name string, year_awarded int, gender string, country string, prize_motivation string, date_of_birth string, date_of_death string")


def test_names_of_facts_are_not_broadcast_by_the_size_of_their_file(spark):
    facts = materialize(_people(spark))
    matched = spark.createDataFrame([(1, "ada 000000007", "")], "question_id long, a string, b string")
    found = X._by_name(matched, facts)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select("f.ord").first()[0] == 7


def test_names_of_a_year_are_joined_run_by_run_in_order(spark, monkeypatch):
    monkeypatch.setattr(X, "NAMES_AT_ONCE", 4)
    asked = spark.createDataFrame([(i, f"Who won the prize in {1990 + i % 4}?") for i in range(40)], "question_id long, question string")
    got = {r["question_id"]: r["answer"] for r in X.answer_facts(asked, _people(spark)).collect()}
    said = [f"In {1990 + y}, the prize went to " + ", ".join(f"Ada {i:09d}" for i in range(y, 40, 3)) + "." for y in range(3)] + ["No laureate found for 1993."]
    assert got == {i: said[i % 4] for i in range(40)}


def test_long_answers_of_rules_are_not_written(spark, monkeypatch):
    written = []
    for module in (answer_plans, X):
        monkeypatch.setattr(module, "materialize", lambda df: written.append(df.columns) or materialize(df))
    answer_plans._answers(spark, SMALL)
    assert written and not any("answer" in columns for columns in written)


def test_a_shared_answer_takes_its_form_once(spark):
    """A year's names are built and digested for each year, not for each of its questions."""
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(answer):
        built.add(1)
        return hashlib.md5(answer.encode()).hexdigest()

    asked = materialize(spark.createDataFrame([(i, f"Who won the prize in {1990 + i % 4}?") for i in range(40)], "question_id long, question string"))
    matched, facts = X.matched_questions(asked), materialize(_people(spark))
    rules = [r for r in X.RULES if r.name == "winner_in_year"]
    got = {r["question_id"]: r["answer"] for r in X.answer_matched(matched, facts, rules=rules, form=digest).collect()}
    whole = {r["question_id"]: r["answer"] for r in X.answer_matched(matched, facts, rules=rules).collect()}
    assert len(got) == 40 and got == {i: hashlib.md5(a.encode()).hexdigest() for i, a in whole.items()}
    assert built.value == 4


def test_long_answers_are_not_held_by_the_hundred(spark, tmp_path):
    """Fifty rows of a megabyte each don't wait for one another in a task that writes them."""
    facts_plans.facts_answers(spark, SMALL)
    rows = spark.range(50).coalesce(1).select(F.expr("concat(id, repeat(cast(rand() as string), 60000))").alias("answer"))
    rows.write.option("parquet.block.size", 4 << 20).option("compression", "none").parquet(f"{tmp_path}/out")
    assert sum(pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("out/*.parquet")) > 5


def test_counting_answers_retrieves_nothing(spark, monkeypatch):
    """Counts by type are those of the whole answers, without a retrieval."""
    monkeypatch.setattr(answer_plans.R, "top_k", lambda *a, **b: pytest.fail("retrieved"))
    assert {r["answer_type"] for r in answer_plans.answer_types(spark, SMALL).collect()} == {"facts", "invalid", "prompt"}


def test_rules_look_names_up_together(spark, monkeypatch):
    """One lookup for all rules that go by a name, so that the plan of the answers doesn't grow with these rules."""
    calls, look = [], X._by_name
    monkeypatch.setattr(X, "_by_name", lambda *a: calls.append(a) or look(*a))
    asked = ["When did Duarte win?", "Where is Okafor-Lind from?", "What is the motivation for Nobody?", "When was Mira Halvorsen born?", "Winner in 1953?"]
    out = X.answer_facts(spark.createDataFrame(list(enumerate(asked)), "question_id int, question string"), spark.createDataFrame(ROWS, SCHEMA))
    assert {r["question_id"]: (r["rule"], r["answer"]) for r in out.collect()} == {
        0: ("award_year_by_name", "Inês Duarte won in 1955."), 1: ("country_of_laureate", "Tomas Okafor-Lind is from ghana."), 2: ("prize_motivation_by_name", "No laureate found matching 'Nobody'."),
        3: ("birth_death_date_by_name", "Mira Halvorsen was born on 1902-05-11."), 4: ("winner_in_year", "No laureate found for 1953."),
    }
    assert len(calls) == 1
