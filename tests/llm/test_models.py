"""Language filters and the classifier against plain loops over exact sets and features."""

import zlib

import numpy as np
import pytest

from lexloom.llm import langid, quality_model
from lexloom.llm.hashing import scatter, windows

TEXTS = ["the rivers run", "", "ab", "éé über 12", "one one two one", "  spaced\tout \n"]


def _grams(text):
    data = f" {text.lower()} ".encode().ljust(langid.NGRAM)
    return [int.from_bytes(data[i : i + langid.NGRAM], "little") for i in range(len(data) - langid.NGRAM + 1)]


@pytest.mark.parametrize("n_languages", [3, 64, 70, 130])
def test_masks_hold_every_language_of_a_gram(n_languages):
    rng = np.random.default_rng(n_languages)
    grams = {f"l{i:03d}": np.unique(rng.integers(0, 2**40, 3000, np.uint64)) for i in range(n_languages)}
    f = langid.Filters.build(grams)
    probes = np.concatenate([*list(grams.values())[:: max(1, n_languages // 5)], rng.integers(0, 2**40, 4000, np.uint64)])
    masks = f.masks(probes)
    assert len(masks) == -(-n_languages // 64)
    for l, lang in enumerate(f.languages):
        said = (masks[l // 64] >> masks[l // 64].dtype.type(l % 64)) & masks[l // 64].dtype.type(1) > 0
        true = np.isin(probes, grams[lang])
        assert said[true].all()
        assert abs(float(said[~true].mean()) - f.false_rate[l]) < 0.01


def test_counts_and_decisions_are_those_of_exact_sets():
    rng = np.random.default_rng(5)
    words = {f"l{i:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40)] for i in range(70)}
    grams = {lang: np.unique(np.array([g for w in ws for g in _grams(w)], np.uint64)) for lang, ws in words.items()}
    f = langid.Filters.build(grams)
    names = list(words)
    texts = [" ".join(rng.choice(words[names[k % 70]], 60)) for k in range(140)] + ["123 !!", ""]
    langs, scores = f.decide(texts)
    n, counts = f.counts(texts)
    for k, text in enumerate(texts):
        mine = np.array(_grams(text), np.uint64)
        exact = np.array([np.isin(mine, grams[lang]).sum() for lang in f.languages])
        assert n[k] == len(mine) and np.abs(counts[k] - exact).max() <= 4 + 4 * np.sqrt(len(mine) * f.false_rate.max())
        assert langs[k] == ("und" if k >= 140 else f.languages[exact.argmax()]) and 0 <= scores[k] <= 1


def test_missing_labels_cost_no_document(spark):
    rows = [(1, "some text", None), (2, "123", None), (3, None, None), (None, "ß", None), (1, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in langid.keep_identified(docs).collect()) == ["some text", "x", "ß"]
    named = spark.createDataFrame([("a", "some text", "en"), ("b", "", "en"), (None, "autre", "fr")], "doc_id string, text string, lang string")
    assert sorted(r["text"] for r in langid.keep_identified(named).collect()) == ["autre", "some text"]


def _features(text):
    """Bucket lists of each family, feature by feature."""
    data, bits, power = text.encode(), quality_model.BITS, 0x100000001B3
    one = lambda x, salt: max(1, int(scatter(np.array([x % 2**64], np.uint64), bits, salt)[0]))
    codes, at = [], 0
    for word in data.replace(b"\t", b" ").replace(b"\n", b" ").split(b" "):
        if word:
            x, p = 0, 1
            for b in word:
                p = p * power % 2**64
                x = (x + (b + 1) * p) % 2**64
            codes.append(x)
        at += len(word) + 1
    padded = np.frombuffer(data + b" ", np.uint8)
    words = [one(x, 1) for x in codes]
    pairs = [0 if a == b else one(a * 31 + b, 2) for a, b in zip(codes, codes[1:], strict=False)]
    return [words, pairs, *[[one(int(g), 2 + n) for g in windows(padded, n)] for n in quality_model.CHAR_NGRAMS]]


def test_scores_are_those_of_a_loop_over_features():
    rng = np.random.default_rng(1)
    model = quality_model.Model(rng.normal(0, 3, 1 << quality_model.BITS), 0.3)
    for text, score in zip(TEXTS, model.scores(TEXTS), strict=True):
        z = model.bias + sum(sum(model.logits[b] for b in family) / len(family) for family in _features(text) if family)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_one_step_is_the_gradient_by_hand(monkeypatch):
    monkeypatch.setattr(quality_model, "EPOCHS", 1)
    labels = np.array([1, 0, 1, 0, 1, 0])
    model = quality_model.fit(TEXTS, labels)
    rng, dim = np.random.default_rng(7), quality_model.DIM
    vectors = rng.uniform(-0.5, 0.5, (1 << quality_model.BITS, dim)).astype(np.float32).astype(float) / dim
    out, bias = rng.normal(0, 0.3, (dim, 2)).astype(np.float32).astype(float), np.zeros(2)
    change, out_change, bias_change = np.zeros_like(vectors), np.zeros_like(out), np.zeros(2)
    for text, label in zip(TEXTS, labels, strict=True):
        weight: dict[int, float] = {}
        for family in _features(text):
            for b in family:
                weight[b] = weight.get(b, 0) + 1 / len(family)
        hidden = sum((w * vectors[b] for b, w in weight.items()), np.zeros(dim))
        z = hidden @ out + bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        error = p - np.eye(2)[label]
        norm = sum(w * w for w in weight.values())
        for b, w in weight.items():
            change[b] -= np.clip(quality_model.RATE * w / norm * (out @ error), -0.5, 0.5)
        out_change -= quality_model.RATE * np.outer(hidden, error) / len(TEXTS)
        bias_change -= quality_model.RATE * error / len(TEXTS)
    out, bias = out + out_change, bias + bias_change
    assert np.allclose(model.logits, (vectors + change) @ (out[:, 1] - out[:, 0]), atol=1e-5)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_sample_stays_within_its_bounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda texts, labels, seed=7: seen.append((texts, labels)))
    monkeypatch.setattr(quality_model, "TRAIN_DOCS", 40)
    monkeypatch.setattr(quality_model, "TRAIN_CHARS", 3000)
    docs = spark.createDataFrame([(i % 60, f"text {i} " * (1 + 300 * (i % 7 == 0))) for i in range(300)] + [(5, "again")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (None, 0)], "doc_id long, quality int")
    quality_model.train(docs, labels)
    texts, given = seen[0]
    assert 0 < len(texts) == len(given) <= 40 and sum(map(len, texts)) <= 3000 and len(set(texts)) == len(texts)
    assert not any(t.startswith("text 4 ") or t.startswith("text 64 ") for t in texts)  # labelled both ways


def test_a_long_labelled_text_does_not_end_the_sample(spark, monkeypatch):
    """Wherever it stands in the order of the draw, the other texts are learned from; alone it is an error."""
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda texts, labels, seed=7: seen.append(sorted(texts)))
    monkeypatch.setattr(quality_model, "TRAIN_CHARS", 1000)
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:21]
    small = {i: f"text {i}" for i in kept}
    for long in kept[:8]:
        docs = spark.createDataFrame([(i, "x" * 2000 if i == long else t) for i, t in small.items()], "doc_id long, text string")
        quality_model.train(docs, spark.createDataFrame([(i, i % 2) for i in kept], "doc_id long, quality int"))
        assert seen.pop() == sorted(t for i, t in small.items() if i != long)
    alone = spark.createDataFrame([(kept[0], "x" * 2000)], "doc_id long, text string")
    with pytest.raises(ValueError, match="1000 characters"):
        quality_model.train(alone, spark.createDataFrame([(kept[0], 1)], "doc_id long, quality int"))
