"""Very long texts, ids that are strings, and archives and conversations of many megabytes."""

import hashlib
import re
from collections import Counter

import pytest
from lexloom.llm import bpe, chat, exact_dedup, langid, mixing, quality_model, quality_rules, simhash, suffix_dedup, warc
from test_operators import _fingerprint, _passages_by_brute_force, reference_encoder  # noqa: F401


def _prose(n, step):
    return " ".join(f"word{(i * step) % 9973} lies,\n" if i % 11 == 0 else f"w{(i * step) % 7919}" for i in range(n))


@pytest.fixture(scope="module")
def long(spark):
    """A text of more than 3 MB and a near copy of it, and one of a single piece of more than 1 MB."""
    base = _prose(560_000, 7)
    rows = [(1, base, "en", "a"), (2, base[:-9] + " changed", "en", "b"), (3, "x" * 1_100_000, None, "a"), (4, "short text", "en", "a")]
    assert len(rows[0][1]) > 3_000_000
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


def test_encoding(long, reference_encoder):  # noqa: F811
    rows, df = long
    got = {r["doc_id"]: r for r in bpe.token_digests(df, *bpe.default_vocabulary()).collect()}
    merges = bpe.Merges(open(bpe.default_vocabulary()[0], "rb").read())
    for i, text, *_ in rows:
        ids = merges.merge_long(text.encode()).tolist() if i == 3 else reference_encoder.encode_ordinary(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    path, pattern = bpe.default_vocabulary()
    both = bpe.decode(bpe.encode(df, path, pattern), path).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in both} == {r[0]: r[1] for r in rows}


def test_rules(long):
    rows, df = long
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    for i, text, *_ in rows:
        words = text.split()
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        at = {k + o for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for o in range(3)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(words), sum(map(len, words)), len(at))


def test_passages(long):
    rows, df = long
    rows = [(i, t[:400_000] if i < 3 else t) for i, t, *_ in rows]  # brute force holds every 50 bytes
    df = df.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).collect()
    want = _passages_by_brute_force(rows)
    assert Counter((r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == want


def test_copies_and_near_copies(long):
    rows, df = long
    kept = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df.unionByName(df.where("doc_id = 1"))).collect()}
    assert kept[1]["group_size"] == 2 and kept[2]["group_size"] == 1
    assert kept[1]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", rows[0][1]).encode()).hexdigest()
    near = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert {i: r["fingerprint"] for i, r in near.items()} == {i: f"{_fingerprint(t):016x}" for i, t, *_ in rows}
    assert (near[2]["component_id"], near[4]["component_id"]) == (1, 4)


def test_models_and_mix(long):
    rows, df = long
    texts = {r[0]: r[1] for r in rows}
    filters = langid.train(df.where("doc_id <> 3"))
    got = {r["doc_id"]: r for r in langid.predict(df, filters).collect()}
    for i, t in texts.items():
        lang, score = filters.decide([t])
        assert (got[i]["lang_pred"], got[i]["score"]) == (lang[0], score[0])
    model = quality_model.fit([texts[1], texts[4]], __import__("numpy").array([1, 0]))
    scored = {r["doc_id"]: r["score"] for r in quality_model.score(df, model).collect()}
    assert scored == {i: pytest.approx(model.scores([t])[0], abs=1e-12) for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in mixing.plan_mix(df).collect()} == {i: len(t.split()) for i, t in texts.items()}


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "one two three four five", "en", "s"), ("a", "one  two three four five", "en", "s"), (None, None, None, None)], "doc_id string, text string, lang string, source string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {"a": "a", "b": "a", None: None}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {"a": "a", "b": "a", None: None}
    for f in (langid.identify, quality_rules.quality_rules, mixing.plan_mix):
        assert {r["doc_id"] for r in f(df).collect()} == {"a", "b", None}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_digests(df, *bpe.default_vocabulary()).collect()}[None] == 0
    chats = spark.createDataFrame([("c1", 0, "user", "hi"), ("c2", 0, "user", "x"), ("c1", 1, "assistant", "yo"), (None, 0, "user", None)], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: (r["n_turns"], r["loss_texts"]) for r in chat.read_chats(chat.format_chats(chats)).collect()} == {"c1": (2, ["yo"]), "c2": (1, []), None: (1, [])}


def test_a_conversation_of_many_megabytes(spark):
    texts = [f"turn {i} <#\\ " * 30_000 for i in range(12)]
    rows = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(8, 0, "user", "a")]
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert sum(map(len, texts)) > 4_000_000
    assert [t["text"] for t in got[7]["turns"]] == texts and got[7]["loss_texts"] == texts[1::2]


def test_archives_never_replace_each_other(spark, tmp_path, monkeypatch):
    """Forty archives whose last record is the same."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2500)
    last = hashlib.sha256(b"x").hexdigest() * 40
    rows = [(4 * k + j, f"u{k}", last if j == 3 else f"{k} {j}") for k in range(40) for j in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartitionByRange(2, "page_id").sortWithinPartitions("page_id")
    monkeypatch.setattr(warc, "REVISIT_BYTES", 1 << 20)
    archives = warc.write_archives(warc.plan_records(pages)).cache()
    assert archives.count() == archives.select("name").distinct().count() >= 40
    warc.export_archives(archives, f"file://{tmp_path}")
    assert len(list(tmp_path.glob("*.warc.zst"))) == archives.count()


@pytest.mark.parametrize("hot", [2, 10_000])
def test_many_groups_meet_by_a_shuffle(spark, monkeypatch, hot):
    body = lambda k: f"page {k} " * 300
    rows = [(i, f"u{i}", body(i % 7 if i % 3 else 0)) for i in range(60)] + [(100 + i, None, "short") for i in range(5)] + [(None, "n", body(0)), (59, "again", body(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = sorted(map(repr, warc.plan_records(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    assert sorted(map(repr, warc.plan_records(pages).collect())) == want
    archives = warc.write_archives(warc.plan_records(pages))
    ids = [f["warc-record-id"] for r in archives.collect() for f, _ in warc.read_archive(bytes(r["content"]))]
    assert len(ids) == len(set(ids)) == len(rows)
