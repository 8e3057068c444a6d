"""Many patterns in texts against plain search, whole and in shards."""

import random
import re
import time

import pytest

from lexloom.functions import automaton
from lexloom.functions.automaton import Automaton
from lexloom.operators import facts as X
from lexloom.operators import matching
from lexloom.operators import themes as T


def _plain(texts, patterns, bounded):
    word = lambda c: c == "_" or c.isalnum()
    out = set()
    for i, t in enumerate(texts):
        for j, (p, b) in enumerate(zip(patterns, bounded, strict=True)):
            for m in re.finditer("(?=" + re.escape(p) + ")", t) if p else ():
                a, e = m.start(), m.start() + len(p)
                if not b or (not (word(p[0]) and a and word(t[a - 1])) and not (word(p[-1]) and e < len(t) and word(t[e]))):
                    out.add((i, j))
                    break
    return out


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_automaton_like_plain_search(monkeypatch, block):
    monkeypatch.setattr(automaton, "BLOCK", block)
    rng = random.Random(block)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for letters in ("ab", "ab -'", "aé日_1 .\x00"):
        patterns = [draw(letters, 6) for _ in range(40)] + ["a", "a"]
        bounded = [rng.random() < 0.5 for _ in patterns]
        texts = [draw(letters + "x", 60) for _ in range(30)] + ["", "a", letters * 50]
        text, pattern = Automaton(patterns, bounded).find(texts)
        assert set(zip(text.tolist(), pattern.tolist(), strict=True)) == _plain(texts, patterns, bounded)
        assert len(text) == len(set(zip(text.tolist(), pattern.tolist(), strict=True)))
    assert len(Automaton([], []).find(["a"])[0]) == len(Automaton([""], [True]).find(["a"])[0]) == len(Automaton(["a"], [True]).find([])[0]) == 0


def test_a_hundred_thousand_names():
    """Built from 10^5 names, the arrays stay within the stated bytes; texts are found as by a set of words."""
    rng = random.Random(1)
    part = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    names = sorted({f"{part()} {part()}-{part()}" for _ in range(100_000)})
    began = time.time()
    found = Automaton(names, [True] * len(names))
    assert found.nbytes <= automaton.BYTES_PER_CHARACTER * sum(map(len, names))
    texts = [f"what did {names[(k * 37) % len(names)]}'s book say, and {part()}?" for k in range(2000)]
    text, pattern = found.find(texts)
    assert [(t, names[p]) for t, p in zip(text.tolist(), pattern.tolist(), strict=True)] == [(k, names[(k * 37) % len(names)]) for k in range(2000)]
    assert time.time() - began < 60


@pytest.mark.parametrize("shard", [1 << 26, 2000])
def test_labels(spark, monkeypatch, shard):
    monkeypatch.setattr(matching, "SHARD_BYTES", shard)
    words = [f"w{i}" for i in range(60)]
    patterns = [(w, True, f"L{i % 7}") for i, w in enumerate(words)] + [("w1", False, "part"), ("a b", False, "phrase"), ("w2", True, "more"), (None, True, "x"), ("", False, "x"), ("w3", True, None)]
    texts = [(1, "w1 w12"), (1, "xw1x"), (2, None), (3, ""), (4, "an a bc, w2"), (4, "an a bc, w2"), (None, "w59"), (5, " ".join(words) * 50)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    table = spark.createDataFrame(patterns, "pattern string, bounded boolean, label string")
    got = sorted(((r["id"], tuple(r["found"])) for r in matching.find_labels(df, "text", table, "found").collect()), key=repr)
    good = [p for p in patterns if p[0] and p[2]]
    want = [(i, tuple(sorted({good[j][2] for _, j in _plain([t or ""], [p[0] for p in good], [p[1] for p in good])}))) for i, t in texts]
    assert got == sorted(want, key=repr)
    assert matching.find_labels(df.limit(0), "text", table, "found").count() == 0
    assert {tuple(r["found"]) for r in matching.find_labels(df, "text", table.limit(0), "found").collect()} == {()}


@pytest.mark.parametrize("shard", [1 << 26, 2000])
def test_names_with_any_punctuation(spark, monkeypatch, shard):
    monkeypatch.setattr(matching, "SHARD_BYTES", shard)
    names = spark.createDataFrame([(n,) for n in ("Tomas Okafor-Lind", "Eugene O'Neill", "Łucja Żak", "Ana Lind", "Jean-Marie Gustave Le Clézio", "Lind", "St. John Perse", None, "  ")], "full_name string")
    asked = {
        1: "Tell me about Tomas Okafor-Lind", 2: "what did O'Neill write", 3: "what did Okafor-Lind say", 4: "ŻAK's poems?", 5: "blindness", 6: "Lind and ana lind",
        7: "le clézio, o'neill, żak and perse", 8: None, 9: "", 10: "(O'Neill)", 11: "O’Neill",
    }
    got = {r["question_id"]: r["entities"] for r in X.scoped_entities(spark.createDataFrame(list(asked.items()), "question_id long, question string"), names).collect()}
    assert got == {
        1: ["Tomas Okafor-Lind", "Lind", "Ana Lind"], 2: ["Eugene O'Neill"], 3: ["Lind", "Tomas Okafor-Lind", "Ana Lind"], 4: ["Łucja Żak"], 5: ["Lind"], 6: ["Ana Lind", "Lind"],
        7: ["Eugene O'Neill", "Jean-Marie Gustave Le Clézio", "St. John Perse"], 10: ["Eugene O'Neill"],
    }


@pytest.mark.parametrize("shard", [1 << 26, 400])
def test_themes_alike_for_any_size_of_the_dimension(spark, monkeypatch, shard):
    """The same rows whether the patterns are broadcast or cut into shards: phrases anywhere, words as tokens, repeated ids."""
    monkeypatch.setattr(matching, "SHARD_BYTES", shard)
    themes = spark.createDataFrame([("arts", "art world"), ("sky", "cloud"), ("water", "cloud"), ("water", "sea"), ("sea", "deep-sea")], "theme string, keyword string")
    docs = spark.createDataFrame([(1, "A smart world"), (7, "Cloud, clouds"), (7, "the sea"), (8, "cloudy"), (9, None), (3, "running")], "id long, text string")
    rows = lambda df, c: sorted((r["id"], tuple(r[c])) for r in df.collect())
    assert rows(T.extract_themes(docs, "id", "text", themes), "themes") == [(1, ("arts",)), (7, ("sky", "water")), (7, ("water",))]
    assert rows(T.extract_themes(docs, "id", "text", themes, {"running": "sea", "clouds": "cloud"}), "themes") == [(1, ("arts",)), (3, ("water",)), (7, ("sky", "water")), (7, ("water",))]
    assert rows(T.expand_keywords(docs, "id", "text", themes), "keywords") == [(1, ("art world",)), (7, ("cloud", "sea")), (7, ("cloud", "sea"))]


def test_large_tables_of_patterns_meet_windows_of_texts_not_whole_texts(spark, monkeypatch):
    """Texts aren't repeated for parts of the table; odd characters and boundaries count as in plain search."""
    monkeypatch.setattr(matching, "SHARD_BYTES", 100)
    monkeypatch.setattr(matching, "WINDOW_CHARS", 50)
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for letters in ("ab -'", "aé日😀_1 .\x00"):
        patterns = sorted({(draw(letters, 12), rng.random() < 0.5) for _ in range(80)})
        texts = [draw(letters + "x", 60) for _ in range(40)] + ["", letters * 50]
        table = spark.createDataFrame([(p, b, f"{j:03d}") for j, (p, b) in enumerate(patterns)], "pattern string, bounded boolean, label string")
        found = matching.find_labels(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", table, "found")
        got = {(r["id"], int(x)) for r in found.collect() for x in r["found"]}
        assert got == _plain(texts, [p for p, _ in patterns], [b for _, b in patterns]) and len(got) > 100
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
