"""Command lines: `python -m vecloom.cli build ...` makes a graph file, `... search ...` measures recall on it."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import search, stats
from .params import BuildParams
from .plans.build import build
from .sources import binary


def _build(spark: SparkSession, a: argparse.Namespace) -> dict:
    if os.path.exists(a.output) and not a.overwrite:
        return {"skipped": a.output}
    p = BuildParams.production(
        c_min=a.leaf_size_min, c_max=a.leaf_size_max, psamp=a.psamp_fraction, max_leaders=a.max_leaders, fanout_top=a.fanout_top, fanout_second=a.fanout_second,
        leaf_knn=a.leaf_knn, max_degree=a.max_degree, l_max=a.max_degree, m_bits=a.m_hash_bits, seed=a.seed, final_prune=a.final_prune, start=a.start,
    )
    vectors = binary.read_matrix(spark, a.data, **({} if a.limit is None else {"limit": a.limit}))
    g = build(vectors, p)
    n = binary.write_graph(g.nodes, a.output, g.start or 0)
    if a.profile_json:
        with open(a.profile_json, "w") as f:
            f.write(g.profile_json())
    return {"nodes": n, "start": g.start, **g.profile}


def _search(spark: SparkSession, a: argparse.Namespace) -> dict:
    if (a.medoids is None) != (a.centroids is None):
        raise ValueError("medoids and centroids must be given together")
    if any(w <= 0 for w in a.width):
        raise ValueError("beam widths must be positive")
    shape, q_shape = binary.metadata(a.data), binary.metadata(a.queries)
    if shape[1] != q_shape[1]:
        raise ValueError("data and queries differ in dimensions")
    base = binary.read_matrix(spark, a.data)
    limit = {} if a.max_queries is None else {"limit": min(a.max_queries, q_shape[0])}
    queries = binary.read_matrix(spark, a.queries, **limit)
    graph, start = binary.read_graph(spark, a.graph, shape[0])
    centroids = None
    if a.medoids:
        ids = binary.read_matrix(spark, a.medoids, dtype="u32").select("id", F.col("vec")[0].alias("m"))
        centroids = binary.read_matrix(spark, a.centroids).join(ids, "id").select(F.col("m").alias("id"), "vec")
    out = {}
    for w in a.width:
        began = time.perf_counter()
        found = search.beam_search(queries, graph, base, [w], a.k, start, centroids).cache()
        n = found.select("query_id").distinct().count()
        row = {"seconds": round(time.perf_counter() - began, 3), "queries": n}
        row["qps"] = round(n / row["seconds"], 1) if row["seconds"] else None
        if a.truth:
            truth = binary.read_truth(spark, a.truth, a.k)
            if a.max_queries is not None:
                truth = truth.where(F.col("query_id") < a.max_queries)
            row["recall"] = stats.recall(found, truth, a.k).first()["recall"]
        if a.results:
            binary.write_results(found, binary.result_path(a.results, w, len(a.width) > 1), a.k, pad=a.pad)
        found.unpersist()
        out[w] = row
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecloom")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--data", required=True)
    b.add_argument("--output", required=True)
    for name, kind, default in (("leaf-size-min", int, 256), ("leaf-size-max", int, 1280), ("psamp-fraction", float, 0.0057), ("max-leaders", int, 5000), ("fanout-top", int, 8), ("fanout-second", int, 3), ("leaf-knn", int, 2), ("max-degree", int, 64), ("m-hash-bits", int, 12), ("seed", int, 42)):
        b.add_argument(f"--{name}", type=kind, default=default)
    b.add_argument("--final-prune", choices=("none", "robust", "spine", "lune"), default="none")
    b.add_argument("--start", type=int)
    b.add_argument("--limit", type=int)
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--profile-json")
    s = sub.add_parser("search")
    for name in ("data", "graph", "queries"):
        s.add_argument(f"--{name}", required=True)
    for name in ("truth", "results", "medoids", "centroids"):
        s.add_argument(f"--{name}")
    s.add_argument("--width", type=int, nargs="+", default=[100])
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--max-queries", type=int)
    s.add_argument("--pad", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vecloom").getOrCreate()
    out = {"build": _build, "search": _search}[a.command](spark, a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
