import struct

import numpy as np
import pytest

from vecloom import cli
from vecloom.sources import binary
from vecloom.streaming.assign import assign_stream, sink


def write_fbin(path, x):
    path.write_bytes(struct.pack("<ii", *x.shape) + np.asarray(x, "<f4").tobytes())


def test_matrix_round_trip(spark, tmp_path):
    x = np.arange(1, 17, dtype=np.float32).reshape(2, 8)
    write_fbin(tmp_path / "a.fbin", x)
    df = binary.read_matrix(spark, str(tmp_path / "a.fbin"))
    assert [r["vec"] for r in df.orderBy("id").collect()] == x.tolist()
    assert binary.write_matrix(df, str(tmp_path / "b.fbin")) == 2
    assert (tmp_path / "b.fbin").read_bytes() == (tmp_path / "a.fbin").read_bytes()
    assert binary.append(df, spark, str(tmp_path / "b.fbin"), 1).count() == 3
    assert binary.read_matrix(spark, str(tmp_path / "a.fbin"), limit=1).count() == 1
    (tmp_path / "short.fbin").write_bytes((tmp_path / "a.fbin").read_bytes()[:-4])
    with pytest.raises(ValueError):
        binary.metadata(str(tmp_path / "short.fbin"))
    (tmp_path / "head.fbin").write_bytes(struct.pack("<ii", 200, 128) + bytes(200 * 128 * 4))
    assert binary.metadata(str(tmp_path / "head.fbin"))[:2] == (200, 128)


def test_layouts(spark, tmp_path):
    (tmp_path / "ids").write_bytes(struct.pack("<I", 3) + np.array([7, 9, 4294967295], "<u4").tobytes())
    assert sorted(r[0] for r in binary.read_ids(spark, str(tmp_path / "ids")).collect()) == [7, 9, 4294967295]
    (tmp_path / "raw").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert binary.read_matrix(spark, str(tmp_path / "raw"), layout="raw", columns=3).count() == 2
    (tmp_path / "sketch").write_bytes(struct.pack("<QQ", 1, 2) + np.array([1, 2], "<f4").tobytes())
    assert binary.read_matrix(spark, str(tmp_path / "sketch"), layout="sketch").first()["vec"] == [1.0, 2.0]
    (tmp_path / "gt").write_bytes(struct.pack("<ii", 2, 2) + np.array([1, 2, 3, 4], "<u4").tobytes())
    got = binary.read_truth(spark, str(tmp_path / "gt"), 2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1), (0, 2, 2), (1, 1, 3), (1, 2, 4)]
    with pytest.raises(ValueError):
        binary.read_truth(spark, str(tmp_path / "gt"), 3)
    assert binary.result_path("a/out.bin", 40, True) == "a/out.L40.bin" and binary.result_path("out.bin", 40, False) == "out.bin"


def test_graph_round_trip(spark, tmp_path):
    rows = [(0, [3, 4]), (1, [4]), (2, [1, 0, 4]), (3, [0]), (4, [2, 1])]
    df = spark.createDataFrame(rows, "id long, nbrs array<bigint>")
    path = str(tmp_path / "g.index")
    assert binary.write_graph(df, path, 4) == 5
    back, start = binary.read_graph(spark, path, 5)
    assert start == 4 and sorted((r["id"], r["nbrs"]) for r in back.collect()) == rows
    with pytest.raises(Exception, match="instead of 6"):
        binary.read_graph(spark, path, 6)[0].collect()
    raw = (tmp_path / "g.index").read_bytes()
    (tmp_path / "bad.index").write_bytes(raw[:-4])
    with pytest.raises(ValueError):
        binary.read_graph(spark, str(tmp_path / "bad.index"))
    with pytest.raises(ValueError):
        binary.write_graph(df, path, 9)


def test_command_lines(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(150, 8)).astype(np.float32)
    write_fbin(tmp_path / "x.fbin", x)
    write_fbin(tmp_path / "q.fbin", x[:10])
    d = ((x[:10, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    (tmp_path / "gt").write_bytes(struct.pack("<ii", 10, 5) + np.argsort(d, axis=1, kind="stable")[:, :5].astype("<u4").tobytes())
    t = lambda name: str(tmp_path / name)
    args = ["build", "--data", t("x.fbin"), "--output", t("g"), "--leaf-size-min", "8", "--leaf-size-max", "32", "--psamp-fraction", "0.1", "--leaf-knn", "6", "--max-degree", "16", "--profile-json", t("p.json")]
    assert cli.main(args, spark)["nodes"] == 150
    assert "skipped" in cli.main(args, spark)
    out = cli.main(["search", "--data", t("x.fbin"), "--graph", t("g"), "--queries", t("q.fbin"), "--truth", t("gt"), "--results", t("r.bin"), "--width", "20", "80", "-k", "5"], spark)
    assert out[80]["recall"] >= 0.9 and (tmp_path / "r.L80.bin").exists()
    for bad in (["--width", "0"], ["--medoids", t("gt")]):
        with pytest.raises(ValueError):
            cli.main(["search", "--data", t("x.fbin"), "--graph", t("g"), "--queries", t("q.fbin"), *bad], spark)


def test_stream(spark, tmp_path):
    rows = [(i, [float(i), 0.0]) for i in range(10)]
    spark.createDataFrame(rows, "id long, vec array<float>").write.parquet(str(tmp_path / "in"))
    leaders = spark.createDataFrame([(0, [0.0, 0.0]), (9, [9.0, 0.0])], "id long, vec array<float>")
    points = spark.readStream.schema("id long, vec array<float>").parquet(str(tmp_path / "in"))
    q = assign_stream(points, leaders, 1).writeStream.foreachBatch(sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["leader"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: 0 if i < 5 else 9 for i in range(10)}


def test_append_after_a_largest_id_of_zero(spark, tmp_path):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<float>")
    binary.write_matrix(one, str(tmp_path / "one.fbin"))
    assert sorted(r["id"] for r in binary.append(one, spark, str(tmp_path / "one.fbin")).collect()) == [0, 1]
    assert [r["id"] for r in binary.append(one.where("false"), spark, str(tmp_path / "one.fbin")).collect()] == [0]
