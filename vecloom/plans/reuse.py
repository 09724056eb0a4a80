"""Keep a partition for later builds: the leaves as Parquet beside a manifest that must match to be used again."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partition import partition
from ..params import BuildParams

#: Parameters that shape a partition; others may differ between builds that share one.
SHAPE = ("c_min", "c_max", "psamp", "max_leaders", "max_depth", "min_shrink_ratio", "fanout_top", "fanout_second", "leaf_cap", "seed", "metric")


def fingerprint(vectors: DataFrame) -> dict:
    """Size and content of a vector table, whatever its order."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim"), F.coalesce(F.bit_xor(F.xxhash64("id", "vec")), F.lit(0)).alias("content")).first()
    return row.asDict()


def manifest(vectors: DataFrame, p: BuildParams) -> dict:
    shape = {k: v for k, v in asdict(p).items() if k in SHAPE}
    return {"format": 1, "shape": shape, "data": fingerprint(vectors), "key": hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()}


def save(leaves: DataFrame, vectors: DataFrame, p: BuildParams, path: str) -> None:
    spark = vectors.sparkSession
    leaves.write.mode("overwrite").parquet(f"{path}/leaves")
    spark.createDataFrame([(json.dumps(manifest(vectors, p), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(vectors: DataFrame, p: BuildParams, path: str) -> DataFrame:
    """The kept leaves; any difference in parameters or data is refused."""
    spark = vectors.sparkSession
    have, want = json.loads(spark.read.text(f"{path}/manifest").first()[0]), manifest(vectors, p)
    wrong = [f"{part}.{k}" for part in ("shape", "data") for k in want[part] if have.get(part, {}).get(k) != want[part][k]]
    if wrong or have.get("format") != want["format"]:
        raise ValueError(f"the kept partition differs in {', '.join(wrong) or 'format'}")
    return spark.read.parquet(f"{path}/leaves")


def load_or_build(vectors: DataFrame, p: BuildParams, path: str) -> DataFrame:
    """The kept leaves; built and kept where there are none yet. What is there is never overwritten: a difference is refused."""
    spark = vectors.sparkSession
    kept = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(kept):
        save(partition(vectors, p), vectors, p, path)
    return load(vectors, p, path)


def trace(leaves: DataFrame, depth: int) -> DataFrame:
    """(node, n, places): sizes of the nodes that leaves of at least `depth` went through at that depth."""
    node = F.substring_index(F.substring_index("leaf", "/", 1), ".", depth + 1)
    return leaves.where(F.col("depth") >= depth).groupBy(node.alias("node")).agg(F.countDistinct("id").alias("n"), F.count(F.lit(1)).alias("places"))
