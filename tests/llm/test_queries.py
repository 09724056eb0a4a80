"""The opN_ queries over the small tables, against DuckDB, brute force or held-out labels."""

import glob
import hashlib
import os
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from vecloom.llm import quality
from vecloom.llm import queries as q
from vecloom.llm.runtime import crc_mod

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else x


def crc(d, n):
    return zlib.crc32(str(d).encode()) % n


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    cursor = duck.execute(q.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(x) for x in r]) for r in cursor.fetchall())
    assert sorted(str([plain(r[n]) for n in names]) for r in df.collect()) == want


def test_near_duplicates(spark, docs):
    want = brute.components([(r["doc_id"], r["text"]) for r in docs])
    got = {r["doc_id"]: r for r in q.op1_near_duplicates(spark, SF).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_suffix_dedup(spark, docs):
    want = brute.without_repeats([r["text"] for r in docs])
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op3_suffix_dedup(spark, SF).collect()}
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n, runs, hashlib.sha256(k).hexdigest()) for r, (k, n, runs) in zip(docs, want, strict=True)}


def test_language(spark, docs):
    want = brute.languages([(r["text"], r["lang"], crc(r["doc_id"], 3) != 1) for r in docs])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in q.op4_language_id(spark, SF).collect()}
    assert all(got[r["doc_id"]][0] == lang and got[r["doc_id"]][1] == pytest.approx(p, rel=1e-3, abs=1e-4) for r, (lang, p) in zip(docs, want, strict=True))


def test_language_held_out(spark, docs):
    got = {r["doc_id"]: r for r in q.op4_language_id(spark, SF).collect()}
    held = [r for r in docs if crc(r["doc_id"], 3) == 1]
    assert all(got[r["doc_id"]]["held_out"] == (crc(r["doc_id"], 3) == 1) for r in docs)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.93 * len(held)


def test_ppm(spark, docs):
    want = brute.ppm([(r["doc_id"], r["text"], crc(r["doc_id"], 7) != 2) for r in docs])
    got = q.op6_ppm_score(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and (r["base_score"], r["score"]) == pytest.approx(w[3:])
        assert r["held_out"] == (crc(r["doc_id"], 7) == 2)


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels, where=crc_mod("doc_id", 5) != 0)
    assert model.rules
    got = {r["doc_id"]: r for r in q.op10_quality(spark, SF).collect()}
    for r in docs:
        p = brute.quality(r["text"], model)
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(p) and g["predicted"] == int(p >= 0.3) and g["held_out"] == (crc(r["doc_id"], 5) == 0)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = [r for r in q.op10_quality(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(got) > 40 and sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
