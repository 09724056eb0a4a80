"""Edge cases of each operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import chat, components, decontam, langid, mixing, near_dup, ppm, quality, runtime, suffix_dedup, topk, warc
from vecloom.llm import vectext as V

from . import brute


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def messy_rows():
    base, other = prose(120, 1), prose(90, 2)
    changed = base.replace(base.split()[60], "XYZ", 1)
    passage = prose(60, 3)
    long = prose(60_000, 4, 10**6)  # over 2**18 bytes: several blocks
    return [
        (1, base, "a"), (2, base.upper(), "b"), (3, changed, None), (4, None, "a"), (5, "", "a"), (6, "  \n\t ", "b"), (7, "one two", "c"), (8, "one TWO", "c"),
        (9, other + " " + passage, "a"), (10, passage + " " + prose(80, 5), None), (11, long, "a"), (12, "é" * 300 + " ß", "a"), (7, "one two", "c"), (13, base + "\n" + base, "b"), (14, "ünï " * 3, "a"),
    ]


CLASH = ["size", "score", "d", "t", "c", "n", "block", "z", "kept", "target", "_d", "_t", "_n", "_stats", "taken", "predicted", "train", "hash", "items", "label", "lang_pred", "_train", "_z"]


@pytest.fixture(scope="module")
def messy(spark, messy_rows):
    df = spark.createDataFrame(messy_rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(messy):
    return messy.where("false")


def test_shingles_match_brute(messy_rows):
    for _, text, _ in messy_rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        doc, _ = near_dup.shingle_sets(raw, np.array([0, len(raw)]), 5)
        assert len(doc) == len(brute.shingles(text))


def test_block_boundaries_do_not_matter():
    texts = [prose(n, n) for n in (3, 0, 50, 7, 200)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = near_dup.shingle_sets(raw, off, 5)
    parts = [(d + i, v) for i, _, b, o in V.blocks(raw, off, 64) for d, v in [near_dup.shingle_sets(b, o, 5)]]
    assert np.array_equal(whole[0], np.concatenate([d for d, _ in parts])) and np.array_equal(whole[1], np.concatenate([v for _, v in parts]))


def test_near_duplicates(messy, messy_rows, empty):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(messy).collect()}
    want = brute.components([(d, t) for d, t, _ in messy_rows])
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert got[2]["component_id"] == 1 and got[5]["kept"] and got[4]["n_shingles"] == 0
    assert near_dup.near_duplicates(empty).count() == 0
    one = near_dup.keep_one(messy)
    assert one.columns == [c for c in messy.columns if c not in ("_d", "_t", "_n")]
    assert sorted(r["doc_id"] for r in one.select("doc_id").collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    assert near_dup.keep_one(empty).count() == 0


def test_near_duplicates_null_ids(spark):
    text = prose(40, 9)
    df = spark.createDataFrame([(None, text), (5, text), (None, "lonely words here"), (3, prose(40, 10))], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).where("n_shingles > 4").collect())
    assert got == [(-1, 5, False), (3, 3, True), (5, 5, True)]


def test_keep_one_null_and_repeated_ids(spark):
    """Unlike texts without an id, or under one id, are groups of their own."""
    a, b, c, d = (prose(40, s) for s in (9, 11, 12, 13))
    rows = [(None, a), (None, b), (None, b), (None, b + " more"), (5, c), (5, d), (5, d), (6, c), (None, d)]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {(r["doc_id"], r["text"]) for r in got} - {(None, b), (None, b + " more")} == {(None, a), (5, c), (5, d)}


def test_exact_links_find_every_component():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for _ in range(40):
        drop = r.random(200) < r.uniform(0, 0.25)
        sets.append(np.unique(np.r_[base[~drop], r.integers(0, 2**63, r.integers(0, 30)).astype(np.uint64)]))
    value, first = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
    every = np.arange(40)
    links = near_dup.exact_links(value, first, every, every, 75)
    halves = near_dup.exact_links(value, first, every[:20], every[20:], 75) + near_dup.exact_links(value, first, every[:20], every[:20], 75) + near_dup.exact_links(value, first, every[20:], every[20:], 75)

    def label(pairs):
        p = list(range(40))
        for a, b in pairs * 40:
            p[a] = p[b] = min(p[a], p[b])
        return p

    true = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert label(links) == label(true) == label(halves)


def test_pigeonhole_keys():
    """Signatures that differ in fewer than twice the number of chunks share a key."""
    r = np.random.default_rng(8)
    a = r.integers(0, 2**16, (200, near_dup.CHUNKS * near_dup.WIDTH)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        b[i, r.permutation(a.shape[1])[: 2 * near_dup.CHUNKS - 1]] += 1
    same = (near_dup.chunk_keys(a) == near_dup.chunk_keys(b)).any(axis=1)
    assert same.all()


def test_forest_spans_every_component():
    r = np.random.default_rng(9)
    for n, m in ((30, 25), (40, 90), (1, 0)):
        edges = {tuple(sorted(e)) for e in r.integers(0, n, (m, 2)).tolist() if e[0] != e[1]}
        near = lambda i, pool: np.array([j for j in pool.tolist() if tuple(sorted((i, j))) in edges], np.int64)  # noqa: B023, E731
        every = np.arange(n)

        def label(pairs):
            p = list(range(n))  # noqa: B023
            for a, b in list(pairs) * n:  # noqa: B023
                p[a] = p[b] = min(p[a], p[b])
            return p

        whole = near_dup.forest(every, every, near)
        assert len(whole) <= n - 1 and label(whole) == label(edges)
        left, right = every[: n // 2], every[n // 2 :]
        assert label(near_dup.forest(left, right, near)) == label([(a, b) for a, b in edges if a < n // 2 <= b])


def test_candidates_are_the_pairs_under_the_distance(spark, monkeypatch):
    """Every pair under the signature distance is connected, and nothing else; also when keys are frequent."""
    r = np.random.default_rng(12)
    sig = r.integers(0, 2**16, (90, near_dup.CHUNKS * near_dup.WIDTH)).astype(np.uint16)
    for i in range(30, 90):
        sig[i] = sig[i % 30]
        sig[i, r.permutation(64)[: r.integers(20, 45)]] += 1
    sig[:, :3] = 7  # a key that all share
    apart = (sig[:, None, :] != sig[None, :, :]).sum(axis=2)

    def label(pairs):
        p = list(range(90))
        for a, b in pairs * 90:
            p[a] = p[b] = min(p[a], p[b])
        return p

    want = label([(i, j) for i in range(90) for j in range(i) if apart[i, j] < near_dup.DISTANCE])
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "c long, signature binary")
    for rows in (4000, 7):
        monkeypatch.setattr(near_dup, "RUN_ROWS", rows)
        monkeypatch.setattr(near_dup, "BUCKET_ROWS", 50 if rows == 7 else 400_000)
        got = [(r["a"], r["b"]) for r in near_dup.candidate_links(df, 3).collect()]
        assert label(got) == want and all(apart[a, b] < near_dup.DISTANCE for a, b in got)


def test_large_groups_are_compared_in_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dup, "RUN_ROWS", 5)
    base = prose(80, 20).split()
    rows = []
    for i in range(30):
        w = list(base)
        for j in range(i % 6):
            w[(i * 7 + j * 13) % 80] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 50)] + [(3, 9), (9, 7), (3, 7), (5, 5), (100, 20)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 20 for i in [*range(20, 51), 100]} | {3: 3, 9: 3, 7: 3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(250, 24)).astype(np.float32)
    x[7] = x[8] = x[9]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(300, None, "x"), (301, [], "x"), (302, [float("nan")] * 24, "x"), (303, [1.0, 2.0], "x"), (None, [0.0] * 24, "x"), (304, [None] * 24, "x"), (400, [3.0, 4.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 10, groups=3).collect()
    y = np.floor(x.astype(float) * 1024)
    for q in (0, 100, 200):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(250), -s)) if i != q][:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, int(s[i])) for i in order]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 400] == [(303, 1024 * 1024 * 11)]
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_top_k_is_exact_for_large_components(spark):
    """Products beyond 2**53 are summed as integers, beyond a long they are cut to its limits."""
    r = np.random.default_rng(5)
    for size, n in ((1.2e5, 60), (3e7, 40), (1e200, 5)):
        x = r.normal(size=(n, 12)) * size
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10, groups=2).collect())
        y = [[int(c) for c in np.floor(v * 1024)] for v in x]
        score = [min(max(sum(a * b for a, b in zip(y[0], v, strict=True)), -(2**63)), 2**63 - 1) for v in y]
        order = sorted(range(1, n), key=lambda i: (-score[i], i))[:10]
        assert got == [(k + 1, i, score[i]) for k, i in enumerate(order)]


def test_top_k_repeated_ids(spark):
    """Rows that repeat the query's id are left out; equal scores go to the smaller id."""
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [9.0, 9.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>").select("*", F.lit("own").alias("dim"), F.lit("own").alias("g"))
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, (F.col("vec_id") == 0) & (F.col("embedding")[0] == 1), 10, groups=2).orderBy("rank").collect()]
    assert got == [(i, 3 << 20) for i in (1, 2, 2)]


def test_segment_bounds_hold():
    r = np.random.default_rng(4)
    q, x = r.normal(size=(20, 30)), r.normal(size=(50, 30))
    for s in (1, 4, 7, 16, 40):
        assert (topk.segment_statistics(q, s) @ topk.segment_statistics(x, s).T >= q @ x.T - 1e-9).all()


def test_suffix_dedup(spark, messy, messy_rows, empty):
    got = suffix_dedup.remove_repeats(messy).collect()
    want = brute.without_repeats([t for _, t, _ in messy_rows])
    have = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got)
    assert have == sorted((d, len((t or "").encode()), n, runs, hashlib.sha256(k).hexdigest(), k) for (d, t, _), (k, n, runs) in zip(messy_rows, want, strict=True))
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(messy, as_text=True).where("doc_id = 12").first()["kept"].endswith(" ß")


def test_suffix_dedup_pieces_of_long_texts(spark):
    """A text of over 2**20 bytes comes in pieces; repeats across their borders are found."""
    long = prose(190_000, 30, 10**7)
    cut = (1 << 20) - 200
    rows = [(1, long), (2, "x " + long[cut - 150 : cut + 250] + " y"), (3, long[cut - 199 : cut]), (4, long[cut - 200 : cut])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) > 1 << 20 and got == {1: (450, 1), 2: (400, 1), 3: (0, 0), 4: (200, 1)}


def test_suffix_dedup_many_buckets(spark, monkeypatch):
    """Groups that many buckets share are decided across boundaries."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 6)
    monkeypatch.setattr(suffix_dedup, "BUCKET_SPANS", 3)
    passage = prose(70, 40)
    r = random.Random(1)
    rows = []
    for i in range(60):
        p = passage if i % 3 else passage[r.randrange(100) :]
        w = list(p)
        if i % 5 == 0:
            w[r.randrange(len(w))] = "#"
        rows.append((i, prose(8, 100 + i) + " " + "".join(w) + " " + prose(9, 200 + i)))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.without_repeats([t for _, t in rows])
    assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in got} == {d: (n, k) for (d, _), (k, n, _) in zip(rows, want, strict=True)}


def test_ranges_keep_order_and_spread_frequent_suffixes():
    r = np.random.default_rng(2)
    lead, g = r.integers(0, 6, 4000), r.integers(0, 5, 4000)
    lead[:1500], g[:1500] = 3, 2
    order = np.lexsort((g, lead))
    at = order[np.arange(1, 20) * 200]
    got = suffix_dedup._ranges(lead, g, np.arange(4000), (lead[at], g[at]))
    for b in range(20):  # ranges are ordered, and only rows equal to a splitter occur in several
        for c in range(b + 1, 20):
            x, y = got == b, got == c
            assert not x.any() or not y.any() or max(zip(lead[x], g[x], strict=True)) <= min(zip(lead[y], g[y], strict=True))
    assert np.bincount(got).max() < 700


def test_multikey_classes():
    r = np.random.default_rng(1)
    keys = r.integers(0, 3, (3, 300))
    got = suffix_dedup.multikey_classes([lambda x, k=k: k[x] for k in keys], 300)
    whole = [tuple(keys[:, i]) for i in range(300)]
    for i in range(300):
        assert (got[i] >= 0) == (whole.count(whole[i]) > 1)
        assert got[i] < 0 or all((got[j] == got[i]) == (whole[j] == whole[i]) for j in range(i))


def test_language(spark, messy, empty):
    rows = [(i, " ".join(random.Random(i).choices(w, k=12)), lang) for i in range(60) for lang, w in [(("en", ["the", "of", "and", "this"]), ("de", ["der", "und", "nicht", "ist"]))[i % 2]]]
    docs = spark.createDataFrame([*rows, (99, None, "en"), (98, "le la", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ("de", "en")
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text", F.lit(1).alias("score")), model).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang in rows) and got[99]["lang_pred"] == "und" and got[99]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    messy_got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(messy, model).collect()}
    assert messy_got[5] == messy_got[6] == messy_got[4] == "und" and messy_got[12] in ("de", "en")
    none = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(docs, bits=26)


def test_ngrams_stay_within_documents():
    raw = np.frombuffer("abcd".encode(), np.uint8)
    whole = langid.ngram_buckets(*langid.code_points(raw, np.array([0, 1, 1, 4])), 2, 10)
    alone = langid.ngram_buckets(*langid.code_points(raw[1:], np.array([0, 3])), 2, 10)
    assert np.array_equal(whole[0], alone[0]) and whole[1].tolist() == [0, 0, 0, 2]


def test_mixing(spark, messy, messy_rows, empty):
    got = mixing.mix(messy).collect()
    assert len(got) == len(messy_rows)
    sizes = {}
    for _, t, s in messy_rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    for r in got:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(messy.where("doc_id IN (4, 5)")).agg(F.sum("taken")).first()[0] == 0


def test_mixing_comes_near_targets(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "s0", prose(1 + i % 40, i)) for i in range(3000)]
    df = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    want = brute.mix(rows)
    assert {r["doc_id"]: r["taken"] for r in df.select("doc_id", "taken").collect()} == want
    for r in df.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 40


def test_mixing_without_ids(spark):
    """Rows without an id, or of one id, are drawn apart by their texts."""
    rows = [(None if i % 5 < 2 else 7 if i % 5 == 2 else i, f"s{i % 4}", prose(1 + i % 30, i)) for i in range(2000)]
    df = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    for r in df.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 60


def test_word_count(spark, messy_rows):
    rows = [(t,) for _, t, _ in messy_rows] + [("\x0ba\x1cb\xa0c  ",), (" a b",)]
    got = spark.createDataFrame(rows, "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert all(r["n"] == len(brute.words(r["t"])) for r in got)


def test_ppm(spark, messy, messy_rows, empty):
    rows = [(d, t, d % 3 != 0) for d, t, _ in messy_rows if d != 11]
    got = ppm.score(messy.where("doc_id <> 11"), F.col("doc_id") % 3 != 0).collect()
    want = brute.ppm(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])
    assert ppm.score(empty, F.lit(True)).count() == 0
    alone = ppm.score(messy.where("doc_id = 7"), F.lit(False)).first()
    assert alone["n_known"] == 0 and alone["score"] == pytest.approx(-np.log10(256) * 8)


def test_ppm_parts(spark, monkeypatch):
    """Small blocks, and suffixes that are grown byte by byte until a part holds one context, don't change a score."""
    rows = [(i, prose(30, i, 12) + (" aaaa aaaa" * (i % 7)), i % 4 != 0) for i in range(40)] + [(40, None, True), (41, "ü" * 300, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    want = brute.ppm(rows)
    monkeypatch.setattr(ppm, "PART_GRAMS", 9)
    monkeypatch.setattr(ppm, "PART_BYTES", 500)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 1000)
    for r in ppm.score(df, F.col("t")).collect():
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and (r["base_score"], r["score"]) == pytest.approx(w[3:])


def test_ppm_depends_on_the_order_of_words(spark):
    rows = [(i, prose(60, 7) + f" w{i}") for i in range(6)] + [(10, prose(60, 7)), (11, " ".join(reversed(prose(60, 7).split())))]
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 10).collect()}
    assert got[10][1] == pytest.approx(got[11][1]) and got[10][0] > got[11][0] / 4


def test_ppm_probabilities_sum_to_one():
    raw, off = ppm.streams(np.frombuffer(b"then there the a the then", np.uint8), np.array([0, 10, 25]))
    unique, count = ppm._distinct(ppm.grams(raw, off))
    low = []
    for o in range(2):
        keys = (ppm._prefix(unique, o) << np.uint64(8)) | (unique & np.uint64(255))
        u, inverse = np.unique(keys, return_inverse=True)
        low.append((u, np.bincount(inverse, weights=count).astype(np.int64)))
    for context in np.unique(unique >> np.uint64(8))[:8]:
        every = (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)
        have = np.union1d(unique, every)
        n = np.zeros(len(have), np.int64)
        n[np.searchsorted(have, unique)] = count
        cost = ppm.code_lengths(have, n, low)
        assert (10.0 ** cost[np.searchsorted(have, every)]).sum() == pytest.approx(1)


def test_warc(spark, tmp_path):
    big = "<p>" + "z" * 120
    trap = "x" * 40 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + "y" * 40
    rows = [(1, "http://a/", big, 0), (2, "http://b/ c", big, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (7, "u", trap, 0), (None, "u", big, 0), (8, "ü", "é" * 90, 0), (1, "again", big, 0), (9, "u", "w" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write(pages, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"), payload=True).collect()
    assert len(got) == len(rows) and 666 not in {r["page_id"] for r in got}
    by = sorted((r["page_id"] or -1, r["record_type"], r["payload_bytes"], r["refers_to"]) for r in got)
    assert by == sorted([(1, "response", 123, None), (1, "response", 123, None), (2, "revisit", 123, 1), (-1, "revisit", 123, 1), (3, "response", 0, None), (4, "response", 0, None), (5, "response", 5, None), (6, "response", 5, None), (7, "response", len(trap), None), (8, "response", 180, None), (9, "response", 300_000, None)], key=lambda x: (x[0], x[1], x[2]))
    for r in got:
        want = next(h or "" for p, _, h, _ in rows if p == r["page_id"])
        assert r["payload_digest"] == hashlib.sha256(want.encode()).hexdigest() and (r["record_type"] == "revisit" or bytes(r["payload"]) == want.encode())
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_members_and_chain():
    import gzip

    record = lambda n, body: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body)) + body + b"\r\n\r\n"
    raw = record(1, b"HTTP/1.1 200 OK\r\n\r\n" + record(9, b"")) + record(2, b"")
    assert warc.unzip(gzip.compress(raw[:50]) + gzip.compress(raw[50:])) == raw
    found = list(warc.candidates(raw))
    assert [f[2] for f in found] == [1, 9, 2]
    keep = warc.reachable(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
    assert [f[2] for f, k in zip(found, keep, strict=True) if k] == [1, 2]
    chain = np.arange(1000) * 7
    assert warc.reachable(chain[::-1], chain[::-1] + 7).all()


def test_warc_unread_bytes(spark, tmp_path):
    """A broken boundary, a file cut short and garbage are told; zeros after the last member are not bytes of the archive."""
    import gzip

    record = lambda n, body: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body)) + body + b"\r\n\r\n"
    one, two = record(1, b"a\r\n\r\nb"), record(2, b"c" * 50)
    for name, raw in (("whole", gzip.compress(one) + gzip.compress(two)), ("padded", gzip.compress(one) + b"\0" * 600), ("broken", one + b"??" + two), ("short", one + two[:-20]), ("junk", gzip.compress(one) + b"garbage"), ("empty", b"")):
        (tmp_path / f"part-{name}").write_bytes(raw)
    got = {}
    for r in warc.read(spark, f"file://{tmp_path}").collect():
        got.setdefault(r["path"].rpartition("-")[2], []).append((r["at"], r["page_id"], r["record_type"], r["payload_bytes"] if r["record_type"] == "unread" else None))
    n = len(one)
    first = (0, 1, "response", None)
    assert {k: sorted(v) for k, v in got.items()} == {
        "whole": [first, (n, 2, "response", None)], "padded": [first], "broken": [first, (n, None, "unread", 2 + len(two))], "short": [first, (n, None, "unread", len(two) - 20)], "junk": [first, (n, None, "unread", 7)],
    }


def test_warc_files_by_size(spark, tmp_path, monkeypatch):
    """A large page has a file of its own and doesn't cut the others small."""
    monkeypatch.setattr(warc, "CLASSES", (4000, 1000, 100))
    monkeypatch.setattr(warc, "MAX_BYTES", 40_000)
    pages = spark.createDataFrame([(i, "u", "x" * (5000 if i < 2 else 50) + str(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    per = sorted(r["count"] for r in warc.read(spark, str(tmp_path / "w")).groupBy("path").count().collect())
    assert per[:2] == [1, 1] and sum(per) == 60 and len(per) < 20


def test_decontaminate(spark, messy, messy_rows, empty):
    base = messy_rows[0][1].split()
    items = [(1, " ".join(base[5:40])), (2, "ONE two"), (3, None), (4, "!!"), (10, " ".join(base[5:40])), (None, "ünï"), (5, " ".join(base[10:19]))]
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, term string")
    got = decontam.match(messy, bench).collect()
    assert len(got) == len(messy_rows)
    for r in got:
        text = next(t for d, t, _ in messy_rows if d == r["doc"])
        n, hit, found = brute.hits(text, items)
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (n, hit, sorted(str(x) for x in found if x is not None), len(found))
    assert decontam.match(empty, bench).count() == 0
    assert decontam.match(messy, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_decontaminate_null_items_count(spark):
    """An item without an id is counted as the SQL of the query counts it."""
    docs = spark.createDataFrame([(1, "un deux trois")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "deux"), (4, "trois"), (4, "trois"), (None, "quatre")], "item_id long, text string")
    got = decontam.match(docs, bench).first()
    assert (got["n_items"], got["items"], got["n_hit"]) == (3, ["4", "4"], 2)


def test_decontaminate_small_blocks(spark, messy, monkeypatch):
    """Blocks, candidates at once and crowded cells don't change a result."""
    bench = spark.createDataFrame([(i, prose(60, i)) for i in range(1, 6)], "item_id long, text string")
    key = lambda df: sorted((r["doc"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["spans"])) for r in df.collect())
    once = key(decontam.match(messy, bench))
    for name, value in (("BLOCK", 300), ("CANDIDATES", 3), ("CELL_BITS", 2), ("SIEVE_BITS", 7)):
        monkeypatch.setattr(decontam, name, value)
    assert key(decontam.match(messy, bench)) == once and any(x[2] for x in once)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 30 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc"]: r["items"] for r in decontam.match(docs, bench, proximity=4).collect()}
    assert got == {1: ["1"], 2: ["1"], 3: []}


def test_chat(spark):
    rows = [(1, 0, "Hello there.\nHow are you?"), (1, 1, "> How are YOU?\nFine."), (1, 2, "X wrote:\n> Fine.\n>> How are you?\nGood"), (1, 4, "> never said\nhm"), (2, 0, None), (2, 1, ">"), (None, 1, "q"), (3, None, "> q\nt"), (1, 1, "> How are YOU?\nFine."), (4, 0, "a\n" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").select("*", F.lit("user").alias("role"), F.lit("own").alias("depth"), F.lit("own").alias("h"))
    out = chat.link(df)
    got = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["n_quotes"], r["n_linked"], r["depth"], r["thread"]) for r in out.collect()}
    assert got[1, 1] == ("Fine.", 0, 1, 1, 1, 0) and got[1, 2] == ("Good", 1, 2, 2, 2, 0) and got[1, 4] == ("hm", 2, 1, 0, 3, 0)
    assert got[2, 0][0] == "" and got[2, 1] == ("", 0, 0, 0, 1, 0) and got[3, None] == ("t", None, 0, 0, 0, None) and got[None, 1][5] == 1
    assert out.count() == len(rows) and chat.link(df.where("false")).count() == 0
    parts = chat.conversations(out, part_turns=2).where("conv_id = 1 AND thread = 0").orderBy("part").collect()
    assert [[m["turn"] for m in r["messages"]] for r in parts] == [[0, 1, 1], [2], [4]]
    in_order = chat.messages_in_order(chat.conversations(out, part_turns=2)).collect()
    assert len(in_order) == len(rows) and all(r["position"] == 0 for r in in_order if r["turn"] is None)


def test_chat_partial_quotes(spark):
    """Two lines of three, two paragraphs of three, and an answer of two lines between two quotes find their originals."""
    rows = [
        (1, 0, "one a\ntwo b\nthree c"), (1, 1, "p q\n\nr s\n\nt u"), (1, 2, "> one a\n> TWO  b\nyes\nindeed\n> three c\nno\nnever"), (1, 3, "> r s\n>\n> t u\nok"),
        (1, 4, "> yes\n> indeed\nsure"), (1, 5, "> one a\n> three c\nhm"), (2, 0, "x y"), (2, 1, "> one a\n> two b\nother"), (None, 0, "k l\nm n\no p"), (None, 1, "mid"), (None, 2, "> k l\n> m n\nend"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"], r["n_linked"]) for r in chat.link(df).collect()}
    assert got[1, 2] == (0, 2, 2) and got[1, 3] == (1, 1, 1) and got[1, 4] == (2, 1, 1)
    assert got[1, 5] == (4, 1, 0) and got[2, 1] == (0, 1, 0) and got[None, 2] == (0, 1, 1)


def test_chat_agrees_with_sql(spark):
    """The SQL of the query on partial quotes, gaps, repeated rows and nulls."""
    import duckdb
    import pandas as pd

    rows = [
        (1, 0, "one a\ntwo b\nthree c", "u"), (1, 1, "p q\n\nr s\n\nt u", "a"), (1, 2, "> one a\n> TWO  b\nyes\nindeed\n> three c\nno\nnever", "u"), (1, 3, "> r s\n>\n> t u\nok", "a"), (1, 9, "> yes\n> indeed\nsure", "u"),
        (1, 12, "> one a\n> three c\nhm", "a"), (1, 12, "> one a\n> three c\nhm", "a"), (2, 1500, "x y", None), (2, 2600, "plain", "u"), (2, None, "z", "u"), (2, None, "z", "u"), (3, 0, None, "u"), (None, 0, "k l\nm n\no p", "u"), (None, 4, "> k l\n> m n\nend", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    got = chat.messages_in_order(chat.conversations(chat.link(df)))
    c = duckdb.connect()
    c.register("raw", pd.DataFrame(rows, columns=["conv_id", "turn", "text", "role"], dtype=object))
    c.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(text AS VARCHAR) AS text, CAST(role AS VARCHAR) AS role FROM raw")
    cursor = c.execute(chat.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str(list(r)) for r in cursor.fetchall())


def test_chat_gaps_in_turns(spark):
    """A message without a linked quote answers the latest earlier one, near or far."""
    turns = [-5000, -3, 0, 1, 1023, 1024, 5000, 2_000_000, 2_000_001, 3_000_000_000]
    df = spark.createDataFrame([(c, t, f"m{t}", "u") for c in (1, None) for t in turns] + [(2, 7, "a", "u")], "conv_id long, turn long, text string, role string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["depth"]) for r in chat.link(df).collect()}
    want = {(c, t): (turns[i - 1] if i else None, i) for c in (1, None) for i, t in enumerate(turns)}
    assert got == want | {(2, 7): (None, 0)}


def test_chat_long_reply_chain(spark):
    df = spark.createDataFrame([(1, i, f"m{i}", "u") for i in range(300)], "conv_id long, turn long, text string, role string")
    assert {r["turn"]: r["depth"] for r in chat.link(df).collect()} == {i: i for i in range(300)}


def test_quality(spark, messy, empty):
    good = [(i, prose(80, i), 1) for i in range(150)]
    bad = [(1000 + i, "BUY!! " * (20 + i) + "$$$", 0) for i in range(60)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(5000, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 80
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(got[d]["predicted"] == q for d, _, q in good + bad)
    scored = quality.score(messy, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (4, 5)}) == 1
    assert quality.score(empty, model).count() == 0
    for few in (labels.where("false"), labels.where("quality = 1")):
        flat = quality.fit(docs, few)
        assert flat.rules == () and len({r["score"] for r in quality.score(docs, flat).collect()}) == 1


def test_quality_repeated_rows(spark):
    """Copies of one labelled document, one id with many texts or repeated labels leave both classes in the sample."""
    good = [(i, prose(80, i), 1) for i in range(60)]
    bad = [(1000 + i, "BUY!! " * (20 + i) + "$$$", 0) for i in range(60)]
    hot = [(1000, bad[0][1], 0)] * 300 + [(1001, f"SELL!! {i} $$$", 0) for i in range(150)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in good + bad + hot], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(1000, 0)] * 300, "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, quality.fit(docs, labels, sample_rows=150)).collect()}
    assert all(got[d] == q for d, _, q in good + bad)


def test_statistics_against_brute(spark, messy, messy_rows):
    stats = quality.statistics(F.col("text"))
    got = messy.select("text", *[c.alias(k) for k, c in stats.items()]).collect()
    assert all({k: r[k] for k in stats} == pytest.approx(brute.statistics(r["text"])) for r in got)


def test_first_split_and_lasso():
    """The first rule is the best of all splits; weights are at the minimum of the penalised loss."""
    r = np.random.default_rng(4)
    x = {"a": r.normal(size=400), "b": r.normal(size=400)}
    y = (x["a"] + 0.3 * r.normal(size=400) > 0.4).astype(float)
    first = quality.tree_rules(x, y, trees=1, depth=1)
    gain = {}
    for k, v in x.items():
        for t in np.unique(np.quantile(v, np.linspace(0.01, 0.99, 48), method="lower")):
            parts = [(0.5 - y)[m].sum() ** 2 / (0.25 * m.sum() + 1) for m in (v <= t, v > t) if m.sum() >= 5]
            gain[k, float(t)] = sum(parts) if len(parts) == 2 else -1.0
    assert [p[0] for p in first[0].parts] == [max(gain, key=gain.get)[0]] and first[0].parts[0][2] == max(gain, key=gain.get)[1]

    z = np.column_stack([v > q for v in x.values() for q in (-0.5, 0.0, 0.5)]).astype(float)
    w, bias = quality.lasso_logistic(z, y, 2e-3)
    scale = np.sqrt(np.maximum(z.mean(axis=0) * (1 - z.mean(axis=0)), 1e-4))

    def loss(w, bias):
        m = z @ w + bias
        return np.mean(np.logaddexp(0, m) - y * m) + 2e-3 * np.abs(w * scale).sum()

    best = loss(w, bias)
    assert all(loss(w + s * np.eye(6)[j] / scale[j], bias) >= best - 1e-7 for j in range(6) for s in (0.02, -0.02)) and min(loss(w, bias + s) for s in (0.02, -0.02)) >= best


def test_language_bound_and_nulls(spark):
    docs = spark.createDataFrame([(i, f"wort {i}", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, bits=24)
    model = langid.fit(docs, bits=10)
    want = brute.languages([(f"wort {i}", f"l{i}", True) for i in range(5)], bits=10)
    assert [(r["lang_pred"], round(r["score"], 4)) for r in langid.predict(docs, model).orderBy("doc_id").collect()] == [(x, round(p, 4)) for x, p in want]


def test_rules_agree_with_columns(spark):
    docs = spark.createDataFrame([(i, prose(3 + i, i) + "!" * (i % 5)) for i in range(40)], "doc_id long, text string")
    stats = quality.statistics(F.col("text"))
    table = docs.select(*[c.alias(k) for k, c in stats.items()]).toArrow()
    x = {k: table[k].to_numpy() for k in stats}
    y = (x["symbols"] > 0.01).astype(float)
    rules = quality.tree_rules(x, y, trees=3)
    got = docs.select(*[F.sum(r.column(stats).cast("int")).alias(str(i)) for i, r in enumerate(rules)]).first()
    assert list(got) == [int(r.holds(x).sum()) for r in rules]


def test_join_spread(spark, monkeypatch):
    """Frequent keys are broadcast, the others shuffled; keys that the table lacks go."""
    rows = [(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (4, 2)) for i in range(n)]
    df, table = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k long, x string")
    want = sorted((k, i, "abc"[k - 1]) for k, i in rows if k < 4)
    for frequent in (1, 2, 10_000):
        monkeypatch.setattr(runtime, "FREQUENT", frequent)
        assert sorted(tuple(r) for r in runtime.join_spread(df, table, ["k"], len(rows)).select("k", "i", "x").collect()) == want


def test_near_duplicates_repeated_rows(spark, monkeypatch):
    """A row that is repeated many times takes part in the comparison of its group once."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(5, " ".join(words))] * 200 + [(3, near), (8, "quite another text of six words"), (9, None), (9, "")]
    seen = []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(docs), "dropDuplicates", lambda self, c, plain=type(docs).dropDuplicates: seen.append(plain(self, c)) or seen[-1])
    got = near_dup.near_duplicates(docs)
    assert sorted(set((r["doc_id"], r["component_id"]) for r in got.collect())) == [(3, 3), (5, 3), (8, 8), (9, 9)]
    assert got.count() == len(rows) and seen[0].count() == 2
