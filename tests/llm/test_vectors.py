"""Operators on vectors and the resampling, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import resampling, vector_codes, vector_dedup

FIELDS = "vec_id long, embedding array<float>, label int, rep long, vec string, n int, id string, key string"
NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    """Further columns bear the names that the operators use inside."""
    return spark.createDataFrame([(i, v, label, None, "x", 1, "y", None) for i, v, label in rows], FIELDS).repartition(3)


def _near(rng, v, cosine):
    z = rng.normal(size=v.shape)
    z -= (z * v).sum(-1, keepdims=True) * v
    z /= np.linalg.norm(z, axis=-1, keepdims=True)
    return cosine * v + math.sqrt(1 - cosine * cosine) * z


def _unit(rng, n, dim=64):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _linked_by_hand(rows):
    good = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, least = {}, {}
    for size in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == size]
        m = np.array([rows[k][1] for k in own], np.float32).astype(np.float64)
        norm = np.sqrt((m * m).sum(1))
        near = (m @ m.T) / np.outer(norm, norm) >= 0.95
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near), strict=True):
            root[find(own[a])] = find(own[b])
        links |= zip(own, near.sum(1).tolist(), strict=True)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, links.get(k, 0), least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows))


def _rows_with_groups(seed=5, near=120):
    rng = np.random.default_rng(seed)
    apart = _unit(rng, 150)
    centre = _unit(rng, 1)
    tight = _near(rng, np.repeat(centre, near, 0), 0.985)
    chain = [_unit(rng, 1)]
    for _ in range(12):
        chain.append(_near(rng, chain[-1], 0.962))
    pairs = _near(rng, apart[:60], 0.955)
    below = _near(rng, apart[60:110], 0.945)
    m = np.concatenate([apart, tight, *chain, pairs, below, apart[:5] * 3.0, np.repeat(apart[7:8], 40, 0)])
    rows = [(int(k), [float(x) for x in v], int(k % 3) if k % 5 else None) for k, v in zip(rng.permutation(len(m)), m, strict=True)]
    return rows + [
        (9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 2), (9004, [None] + [0.5] * 63, None), (9005, [NAN] + [0.5] * 63, 1), (9006, [INF] * 64, 1),
        (None, rows[0][1], 1), (None, rows[0][1], 1), (None, rows[3][1], None), (rows[4][0], rows[4][1], 1), (rows[4][0], rows[200][1], 1), (None, None, None),
        (9007, [0.3, 0.4], 1), (9008, [0.6, 0.8], 1), (9009, [1.0], 0), (9010, [-2.0], 0), (9011, [1e30] * 64, 0), (9012, [1e-30] * 64, 0),
    ]


@pytest.mark.parametrize(("part", "few", "width"), [(2048, 64, None), (16, 4, 2), (40, 1000, 3)])
def test_near_duplicate_vectors(spark, monkeypatch, part, few, width):
    """Groups of copies and near copies, chains, pairs at either side of the threshold; whole and split buckets."""
    monkeypatch.setattr(vector_dedup, "PART", part)
    monkeypatch.setattr(vector_dedup, "FEW", few)
    monkeypatch.setattr(vector_dedup, "TILE", 32)
    rows = _rows_with_groups()
    got = vector_dedup.near_duplicate_vectors(_vectors(spark, rows), width=width)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == _linked_by_hand(rows)


def test_vectors_of_an_empty_table(spark):
    none = _vectors(spark, [(1, [1.0] * 64, 1)]).limit(0)
    assert vector_dedup.near_duplicate_vectors(none).count() == 0
    assert vector_codes.compress(none).count() == 0
    only_bad = _vectors(spark, [(1, None, 1), (None, [0.0] * 64, None)])
    assert sorted(map(tuple, vector_dedup.near_duplicate_vectors(only_bad).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]


@pytest.mark.parametrize(("width", "cosine", "least"), [(2, 0.95, 0.9995), (3, 0.95, 0.9995), (4, 0.95, 0.9985), (3, 0.97, 0.99995)])
def test_recall_at_the_threshold(width, cosine, least):
    """A pair is found if one of the two probes the other's own bucket in some table."""
    rng = np.random.default_rng(width)
    x = _unit(rng, 4096 if width == 4 else 8192)
    y = _near(rng, x, cosine)
    tables = []
    for v in (x, y):
        tables.append(np.concatenate([vector_dedup.bucket_keys(v[i : i + 512], width) for i in range(0, len(v), 512)]))
    a, b = tables
    found = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    assert found.mean() >= least


def test_rotation_keeps_lengths_and_does_not_depend_on_the_batch():
    v = _unit(np.random.default_rng(0), 9)
    r = vector_dedup.rotate(v, 1, 2)
    assert np.allclose(r @ r.T, v @ v.T)
    assert np.array_equal(vector_dedup.rotate(v[3:4], 1, 2), r[3:4])


# 13


def test_transform_is_walsh_hadamard_by_sign_changes():
    for dim in (1, 2, 8, 11, 16):
        size = 1 << max(0, dim - 1).bit_length()
        got = vector_codes.sequency_transform(np.eye(dim, dtype=np.int64)).T
        assert got.shape == (size, dim) and set(np.unique(got)) <= {-1, 1}
        if dim == size:
            assert (np.diff(got, axis=1) != 0).sum(1).tolist() == list(range(size))
            assert np.array_equal(got @ got.T, size * np.eye(size, dtype=np.int64))


@pytest.mark.parametrize("dim", [1, 3, 16, 20])
def test_nearest_like_all_distances(dim):
    rng = np.random.default_rng(dim)
    entries = rng.integers(-3, 4, (40, dim))
    entries[20:25] = entries[3:8]  # ties go to the lower index
    points = np.concatenate([rng.integers(-3, 4, (3000, dim)), rng.integers(-(1 << 20), 1 << 20, (50, dim))])
    index, distance = vector_codes.nearest(points, entries)
    whole = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == whole.argmin(1).tolist() and distance.tolist() == whole.min(1).tolist()


def _coded_by_hand(rows, parts=4, most=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = m[:most].transpose(1, 0, 2).copy()
    assign = lambda: [((m[:, k, None] - books[k][None]) ** 2).sum(2) for k in range(parts)]
    for _ in range(rounds):
        for k, d in enumerate(assign()):
            near = d.argmin(1)
            for j in set(near.tolist()):
                own = m[near == j, k]
                books[k, j] = own.sum(0) // len(own)
    last = assign()
    codes = ["".join(f"{d[i].argmin():02x}" for d in last) for i in range(len(kept))]
    errors = [int(sum(d[i].min() for d in last)) for i in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return Counter((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))


def test_codes_by_hand(spark, monkeypatch):
    """Nulls, ties, copies, repeated ids and fewer rows than entries; labels met by a broadcast and by a shuffle."""
    rows = [(i, v, label) for i, v, label in _rows_with_groups(6, 60) if i is None or i < 9007]
    rows += [(i, v, 7) for i, v, _ in rows[:30]]
    df = _vectors(spark, rows)
    want = _coded_by_hand(rows)
    assert Counter(map(tuple, vector_codes.compress(df).collect())) == want
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert Counter(map(tuple, vector_codes.compress(df).collect())) == want
    few = [r for r in rows if r[0] is not None and r[0] < 9]
    assert Counter(map(tuple, vector_codes.compress(_vectors(spark, few)).collect())) == _coded_by_hand(few)


def test_vectors_that_cannot_be_coded_are_told(spark):
    with pytest.raises(Exception, match="2048 or more"):
        vector_codes.compress(_vectors(spark, [(1, [4000.0] * 64, 1)])).count()
    with pytest.raises(ValueError, match="6 components"):
        vector_codes.compress(_vectors(spark, [(1, [1.0] * 6, 1)]))


# 11


def _resampled_by_hand(rows, target):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        w = word.findall((text or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [features(t) for _, t in rows]
    raw, goal = Counter(b for _, f in own for b in f), Counter(b for t in target for b in features(t)[1])
    s, t = sum(raw.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in raw}
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {}
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        place.setdefault(r, []).append(k + 1)
    return Counter((r[0], *r[2:], (place.get(r) or [None]).pop(0) if place.get(r) else None) for r in out)


def test_resampling_by_hand(spark, monkeypatch):
    """Null and empty texts, words beyond ASCII, copies, repeated and null ids; one batch and batches of a text each."""
    rng = np.random.default_rng(2)
    words = ["the", "Fox", "ÄRGER", "straße", "日本", "x1", "O'Neill", "re-run", "\x7f", "a\x00b", "😀", "Been"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 90)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "---"), (None, rows[3][1]), (None, "the " * 30), (5, rows[5][1]), (5, "other words " * 12), (404, "x" * 70_000 + " y" * 3000)]
    target = ["the fox the straße", None, "", "日本 日本 x1 Been", "been THE fox"]
    docs = spark.createDataFrame([(i, t, None, "z", 1, 2, "q") for i, t in rows], "doc_id long, text string, row long, id string, n int, weight int, bucket string").repartition(3)
    goal = spark.createDataFrame([(t, k) for k, t in enumerate(target)], "text string, n long")
    for size in (1 << 20, 1):
        monkeypatch.setattr(resampling, "BATCH_BYTES", size)
        got = resampling.resample(docs, goal)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == _resampled_by_hand(rows, target)
    assert resampling.resample(docs.limit(0), goal).count() == 0
    assert resampling.resample(docs, goal.limit(0)).count() == len(rows)


def test_features_never_cross_texts():
    texts = [b"one two", b"", b"Three", b"four five six seven"]
    got = Counter()
    for bucket, text in resampling.ngram_buckets(texts):
        got.update(zip(text.tolist(), bucket.tolist(), strict=True))
    want = Counter()
    for k, t in enumerate(texts):
        w = t.lower().split()
        want.update((k, zlib.crc32(b" ".join(w[i : i + n])) % 10000) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert got == want
