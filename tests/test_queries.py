"""Queries of the graph engine against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from vecloom.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    cursor = duck.execute(q.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(x) for x in r]) for r in cursor.fetchall())
    assert sorted(str([plain(r[n]) for n in names]) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 * q.vectors(spark, SF).where("id % 100 = 0").count()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_searches_ask_for_every_hundredth_id(spark, monkeypatch):
    """The query set isn't a fixed number of vectors."""
    ids = {r[0] for r in q.vectors(spark, SF).where("id % 100 = 0").select("id").collect()}
    assert len(ids) > 1 and {r["query_id"] for r in q.beam_search(spark, SF).collect()} == ids
    seen, nearest = [], q.knn.nearest
    monkeypatch.setattr(q.knn, "nearest", lambda asked, *a: seen.append({r["id"] for r in asked.collect()}) or nearest(asked, *a))
    assert all(0 < r["recall"] <= 1 for r in q.recall_by_width(spark, SF).collect()) and seen == [ids]


def test_search_of_more_vectors_and_near_copies(spark, tmp_path):
    """The least width doesn't find nine tenths here, and near copies lie about the medoid, where searches start."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 64))
    x[rng.permutation(6000)[:200]] = x[0] + rng.normal(size=(200, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(a) for a in v], i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in q.beam_search_sound(spark, str(tmp_path)).select("queries", "ordered", "recalled").collect()] == [(60, True, True)]
