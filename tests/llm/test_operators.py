"""Each operator against brute force, a round trip or held-out accuracy, and on awkward and empty tables."""

import hashlib
import random
import uuid
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tables import SMALL
from lexloom.llm import bpe, chat, common, exact_dedup, langid, mixing, quality_model, quality_rules, registry, simhash, suffix_dedup, warc
from lexloom.llm.components import components


def _docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


# 1


@pytest.fixture(scope="module")
def reference_encoder():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = bpe.Merges(open(path, "rb").read()).ranks
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark, awkward, reference_encoder):
    for df in (awkward.select("doc_id", "text"), _docs(spark).select("doc_id", "text")):
        path, pattern = bpe.default_vocabulary()
        got = bpe.decode(bpe.encode(df, path, pattern), path).collect()
        want = Counter((r["doc_id"], tuple(reference_encoder.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in df.collect())
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.token_digests(awkward.limit(0), path, pattern).count() == 0


def test_bpe_long_pieces_equal_matrix():
    m = bpe.Merges(open(bpe.default_vocabulary()[0], "rb").read())
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"theanorit ") for _ in range(n)) for n in (1, 2, 17, 100, 256)]
    for piece, ids in zip(pieces, m.encode_pieces(pieces), strict=True):
        assert ids.tolist() == m.merge_long(piece).tolist()


# 2


def test_quality_rules(spark, awkward):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(awkward).collect()}
    assert (got[3]["n_words"], got[3]["base_failed"], got[3]["kept"]) == (0, True, False)
    assert got[9]["n_repeat_words"] == 5000 and got[9]["base_failed"]
    assert quality_rules.quality_rules(awkward.limit(0)).count() == 0


def test_quality_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    judged = quality_rules.quality_rules(docs).join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    shares = {r["quality"]: r["k"] for r in judged.collect()}
    assert shares[1] > 0.99 and shares[0] < 0.7


# 3


def _passages_by_brute_force(rows):
    key = lambda i: 2**63 if i is None else i
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


def _removed(df, **how):
    got = suffix_dedup.remove_repeats(df, **how).collect()
    return Counter((r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)


def test_suffix_dedup(spark, awkward, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(50)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(8)]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(passages)
            cut = rng.randint(0, len(x) // 2)
            parts.append(rng.choice([x[cut : cut + rng.randint(20, len(x))], " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))), (rng.choice(words) + " ") * rng.randint(5, 60)]))
        rows.append((100 + rng.randint(0, 100), "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _passages_by_brute_force(rows)
    assert _removed(df) == want and _removed(df, decide="ranks") == want
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 20_000)  # many batches, so that anchors meet in buckets
    assert _removed(df) == want and _removed(df, decide="ranks") == want
    assert _removed(df.limit(0)) == Counter()
    with pytest.raises(ValueError, match="whole number"):
        suffix_dedup.remove_repeats(df.select(F.col("doc_id").cast("string"), "text"))


def test_passages_leave_one_table_behind(spark, awkward, tmp_path, monkeypatch):
    """The tables of the steps are deleted before the texts are shuffled."""
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"{tmp_path}/{uuid.uuid4().hex}")
    rows = suffix_dedup.remove_repeats(awkward)
    assert rows.count() == awkward.count() and len(list(tmp_path.iterdir())) == 1


# 4


def test_mix(spark, awkward):
    plan = mixing.plan_mix(_docs(spark))
    got = plan.collect()
    per: dict = {}
    source = {r["doc_id"]: r["source"] for r in _docs(spark).collect()}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        s = per.setdefault(source[r["doc_id"]], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= longest for taken, target, longest in per.values())
    total = sum(r["size"] for r in got)
    assert sum(t for _, t, _ in per.values()) == pytest.approx(1.5 * total)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, got))
    again = mixing.plan_mix(awkward)
    assert again.count() == awkward.count() and mixing.plan_mix(awkward.limit(0)).count() == 0
    assert mixing.mix(_docs(spark)).count() == sum(r["repeats"] for r in got)
    finer = mixing.plan_mix(_docs(spark), rows_per_cell=1)
    assert sorted(map(tuple, finer.collect())) == sorted(map(tuple, got))


def test_mix_without_ids_and_many_sources(spark, monkeypatch):
    from pyspark.sql import functions as F

    n = spark.range(20_000)
    text = F.expr("repeat('w ', int(id % 50))")
    hot = n.select(F.lit(None).cast("bigint").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    plan = mixing.plan_mix(hot).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(plan) == 2 and all(abs(r["taken"] - r["target"]) <= 49 for r in plan)
    # rows without an id lie in several ranges of the order: no range holds more than half of them
    kept = []
    wrapped = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df: (kept.append(wrapped(df)), kept[-1])[1])
    mixing.plan_mix(hot)
    ranges = next(df for df in kept if "salt" in df.columns).groupBy("salt").count().collect()
    assert len(ranges) > 2 and max(r["count"] for r in ranges) <= 10_000
    monkeypatch.undo()
    # one task or ranges for the order of sources: the same plan
    many = n.limit(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("source"))
    one = sorted(map(tuple, mixing.plan_mix(many).collect()))
    monkeypatch.setattr(mixing, "ROWS_OF_TASK", 10)
    assert sorted(map(tuple, mixing.plan_mix(many).collect())) == one


@pytest.mark.parametrize("size", [10**9, 3 * 10**9])
def test_targets_of_billions_of_words(spark, size):
    """One and a half times what still fits into 32 bits, and what doesn't."""
    sources = spark.createDataFrame([("a", size, 3), ("b", size // 2, 1), (None, 7, 2)], "source string, source_size long, weight int")
    total, got = size + size // 2 + 7, {r["source"]: r["target"] for r in mixing.water_fill(sources).collect()}
    left = 1.5 * total - 14  # two copies of the small source, the rest 3 to 1 below two copies
    assert got == {"a": pytest.approx(0.75 * left), "b": pytest.approx(0.25 * left), None: 14.0}


# 5


def test_warc(spark, tmp_path):
    long = "<html>" + "é" * 700 + "</html>"
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (None, "http://n", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "v", ""), (7, "w", "z" * 200_000), (2, None, long)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, id int, digest string")
    archives = warc.write_archives(warc.plan_records(pages)).cache()
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[1, "revisit", 2] == 1 and kinds[2, "response", None] == 2 and kinds[None, "revisit", 2] == 1 and kinds[3, "response", None] == 1
    for r in got:
        if r["payload"] is not None:
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["stated_digest"] and len(r["payload"]) == r["stated_bytes"]
    warc.export_archives(archives, str(tmp_path))
    files = list(tmp_path.glob("*.warc.zst"))
    assert sum(len(list(warc.read_archive(f.read_bytes()))) for f in files) == len(rows)
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.limit(0)))).count() == 0


# 6


def test_chat_round_trip(spark):
    odd = [r"\### Assistant: </turn> ok", "", None, "a\nb\\h\\\\l#<", "😀" * 3, "x" * 50_000, "</turn>\n### user\n"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(9) for t, role in enumerate(["system", "user", "assistant", None, "as\nsi#st"])]
    rows += [(None, 0, "user", "n"), (4, None, "assistant", "first"), (4, 1, "user", odd[5]), (4, 1, "user", odd[5])]
    chats = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n int").repartition(3)
    read = chat.read_chats(chat.format_chats(chats)).collect()
    assert len(read) == 10
    for r in read:
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss_texts"] == [x[3] or "" for x in mine if x[2] == "assistant"]
    assert chat.format_chats(chats.limit(0)).count() == 0


# 7


def test_language(spark, awkward):
    big = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    got = langid.op7_language_id(spark, big).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    found = langid.identify(awkward).collect()
    assert len(found) == awkward.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (3, 4, 5, 8)} == dict.fromkeys((3, 4, 5, 8), "und")
    assert langid.identify(awkward.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.keep_identified(awkward).columns == awkward.columns


# 8


def test_exact_dedup(spark, awkward):
    got = exact_dedup.exact_dedup(awkward, rows_per_salt=2)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == awkward.count()
    assert (rows[1]["keep_id"], rows[10]["keep_id"], rows[2]["kept"], rows[1]["group_size"]) == (2, 2, True, 3)
    assert (rows[3]["keep_id"], rows[4]["keep_id"], rows[5]["keep_id"]) == (5, 5, 5)
    assert rows[6]["group_size"] == 2 and rows[None]["kept"]
    assert exact_dedup.exact_dedup(awkward.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.keep_first_copies(awkward).collect()) == [0, 2, 5, 6, 6, 7, 8, 9]


# 9


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, awkward):
    for df in (awkward, _docs(spark)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        fps = [_fingerprint(t) for _, t in rows]
        root = list(range(len(rows)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[find(i)] = find(j)
        least = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
        want = Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("n_blocks", [5, 6, 7])
def test_every_block_choice_and_split_buckets(spark, n_blocks, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(n_blocks)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 150:
        x = int(rng.choice(list(fps)))
        for b in rng.choice(63, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    links = simhash.similar_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, n_blocks)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    seen, want = set(), {}
    for x in fps:
        if x in seen:
            continue
        group, todo = {x}, [x]
        while todo:
            y = todo.pop()
            near = {z for z in fps if z not in group and bin(y ^ z).count("1") <= 4}
            group |= near
            todo += near
        seen |= group
        want |= {y: min(group) for y in group}
    assert {x: got.get(x, x) for x in fps} == want


@pytest.mark.parametrize("sizes", [[5], [64], [65], [2] * (1 << 14) + [3]])
def test_planes_of_a_single_word(sizes):
    """One word in all, or one left over behind full steps of 2**14 words."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    fps = (group.astype(np.uint64) << np.uint64(20)) | np.arange(len(group)).astype(np.uint64) % np.uint64(2)
    root = simhash.link_groups(fps, group, np.full(len(fps), 2), 4)
    assert (root == np.searchsorted(group, group)).all()


# 10


def test_quality_classifier(spark, awkward):
    big = SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = quality_model.op10_quality_classifier(spark, big).join(labels, "doc_id").where("held_out").select("quality", "score").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    model = quality_model.train(awkward, spark.createDataFrame([(1, 1), (8, 0), (8, 0), (None, 1), (9, None)], "doc_id long, quality int"))
    scored = quality_model.score(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_model.score(awkward.limit(0), model).count() == 0
    assert set(quality_model.train(awkward, labels.limit(0)).scores(["", "a b"])) == {0.5}


# stages


@pytest.mark.parametrize("stage", [langid.keep_identified, exact_dedup.keep_first_copies, simhash.keep_one_of_each, mixing.mix])
def test_stages_carry_columns_of_any_name(spark, awkward, stage):
    names = ["_dropped", "_DROPPED_", "_mix_id", "_mix_times", "repeats", "_label", "component_id", "kept", "lang_pred"]
    wide = awkward.withColumns({n: F.lit("x") for n in names})
    got = stage(wide)
    assert got.columns == wide.columns
    plain = stage(awkward)
    assert sorted(map(repr, got.select(*awkward.columns).collect())) == sorted(map(repr, plain.collect()))
    assert stage(wide.limit(0)).count() == 0


# pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = _docs(spark)
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
    by_hand = docs.groupBy("doc_id").count()
    out = pipeline.run(spark, SMALL)
    assert sorted(map(tuple, out.groupBy("doc_id").count().collect())) == sorted(map(tuple, by_hand.collect()))
