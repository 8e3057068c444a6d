"""Stages on tables whose ids are null or repeated: verdicts belong to rows."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from lexloom.llm import exact_dedup, mixing, simhash
from lexloom.llm.common import scratch_dir
from test_operators import _fingerprint, reference_encoder  # noqa: F401

#: Null ids and repeated ids, once as a copy of another row and once with a text of their own.
SHARED_IDS = [
    (1, "alpha beta gamma delta epsilon", "en", "a"),
    (None, "alpha  beta gamma delta epsilon", "en", "a"),
    (None, "alpha beta gamma delta epsilon", "en", "b"),
    (None, "a text that nobody else has", "en", "a"),
    (None, "another one, of which there is one copy only", "en", None),
    (2, "alpha beta gamma delta epsilon", "en", "b"),
    (2, "the second text of the row with the id two, longer than the others are", "en", "b"),
    (3, "twice with no id", "en", "c"),
    (None, "twice with no id", "en", "c"),
]


def _table(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _texts(df):
    return sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))


def test_exact_copies_of_shared_ids(spark):
    got = _texts(exact_dedup.keep_first_copies(_table(spark, SHARED_IDS), rows_per_salt=2))
    assert got == sorted([(0, SHARED_IDS[1][1]), (0, SHARED_IDS[3][1]), (0, SHARED_IDS[4][1]), (2, SHARED_IDS[6][1]), (3, SHARED_IDS[7][1])])


def test_one_of_rows_repeated_in_full_stays(spark, duck):
    rows = SHARED_IDS + [SHARED_IDS[7]] * 5 + [(None, "no id and repeated", "en", "a")] * 4 + [(9, "", "en", "a"), (9, None, "en", "a")]
    df = _table(spark, rows)
    got = exact_dedup.exact_dedup(df, rows_per_salt=2)
    duck.execute("create schema repeated; create table repeated.documents (doc_id bigint, text varchar)")
    duck.executemany("insert into repeated.documents values (?, ?)", [r[:2] for r in rows])
    want = duck.execute(exact_dedup.OP8_SQL.replace("from documents", "from repeated.documents")).fetchall()
    # the text of a kept row decides nothing here, so the rows can be compared as they are
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    texts = _texts(exact_dedup.keep_first_copies(df, repeats=False))
    assert len(texts) == len({"".join(t.split()) if t else "" for *_, t in texts}) == got.where("kept").count() == 7


def test_near_copies_of_shared_ids(spark):
    got = _texts(simhash.keep_one_of_each(_table(spark, SHARED_IDS)))
    assert got == sorted([(1, SHARED_IDS[0][1]), (0, SHARED_IDS[3][1]), (0, SHARED_IDS[4][1]), (2, SHARED_IDS[6][1]), (3, SHARED_IDS[7][1])])
    alone = _table(spark, [(None, "a b c d", "en", "a"), (None, "A b  c d", "en", "a")])
    assert simhash.keep_one_of_each(alone).count() == 1


def _mixed_by_hand(rows):
    """Rows as often as the mix takes them, by clamping rounds and one walk over each source."""
    sized = [(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), i, t, s) for i, t, _, s in rows]
    names = sorted({s for *_, s in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[0] for x in sized if x[3] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken = []
    for s in names:
        before, whole = 0, int(target[s] // size[s]) if size[s] else 0
        digest = lambda i: hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()
        for n, i, t, _ in sorted((x for x in sized if x[3] == s), key=lambda x: (int(digest(x[1])[:4], 16) % 256, digest(x[1]), x[0])):
            taken += [(i, t, s)] * ((whole + (before + n / 2 < target[s] - whole * size[s])) if n else 0)
            before += n
    return Counter(taken)


MANY_IDS = [(None, " ".join(f"w{k}x{j}" for j in range(3 * k + 1)), "en", "ab"[k % 2]) for k in range(12)]
MANY_IDS += [(7, " ".join(f"v{k}y{j}" for j in range(3 * k + 2)), "en", ["c", None][k % 2]) for k in range(8)]


def test_mix_of_shared_ids(spark):
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix(_table(spark, MANY_IDS)).collect())
    assert got == _mixed_by_hand(MANY_IDS) and max(got.values()) == 2


def _pipeline_by_hand(rows, encoder):
    rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    rows.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r[1]), r)
    rows = sorted(first.values(), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    mixed = _mixed_by_hand([r for k, r in enumerate(rows) if group[k] == k])
    out = Counter()
    for (i, t, _), n in mixed.items():
        ids = encoder.encode_ordinary(t)
        out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    return out


def test_pipeline_by_brute_force(spark, tmp_path, reference_encoder):  # noqa: F811
    rows = SHARED_IDS + [SHARED_IDS[7]] * 5 + [MANY_IDS[4]] * 3 + MANY_IDS + [(50 + k, f"text number {k} about a thing of its own " * (k + 1), "de", "a") for k in range(6)]
    rows += [(80, "123 456", "en", "a"), (81, None, "en", "a"), (82, "", None, None)]
    rows += [(83, "Text number 1 about a thing of its own text number 1 about a thing of its own", "de", "b")]
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == _pipeline_by_hand(rows, reference_encoder)


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, tmp_path, reference_encoder):  # noqa: F811
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    awkward.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    assert Counter(map(tuple, got)) == _pipeline_by_hand(rows, reference_encoder)
    awkward.select(*names).limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    kept = Path(scratch_dir(spark)).parent
    before = set(kept.iterdir())
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
    assert len(set(kept.iterdir()) - before) == len(corpus_pipeline.STAGES) - 1  # what stages wrote for themselves is gone


def test_many_repeated_digests_meet_by_a_shuffle_without_the_hot_ones(spark, monkeypatch):
    """One text in half of the rows: the same result whichever way digests meet, and no task that has it all."""
    rows = [(i, "the hot text " + " " * (i % 3) if i % 2 else f"text {i // 6} {'x' * (i % 5)}") for i in range(6000)] + [(None, None), (7, ""), (None, "the hot text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda d: sorted(map(repr, map(tuple, d.collect())))
    want = key(exact_dedup.exact_dedup(df, rows_per_salt=100))
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    for hot_digests in (1, 100, 100_000):
        monkeypatch.setattr(exact_dedup, "HOT_DIGESTS", hot_digests)
        assert key(exact_dedup.exact_dedup(df, rows_per_salt=100)) == want
    assert len(_texts(exact_dedup.keep_first_copies(df, rows_per_salt=100, repeats=False))) == exact_dedup.exact_dedup(df).where("kept").count()
    off = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c) for c in off}
    try:
        spark.conf.set(off[0], "false"), spark.conf.set(off[1], "-1")
        base = exact_dedup._normalised(df, "doc_id", "text", F.lit(1))
        counts = base.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("salts", F.lit(3))
        parts = [counts.where(c).drop("n") for c in ("n > 0", "n >= 100", "n < 100")]
        sizes = sorted(r["n"] for r in exact_dedup._salted(base, *parts)[0].groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
