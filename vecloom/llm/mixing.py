"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

Every row gets a 60-bit hash of its id and text. Words are summed by source and by the
first 12 hash bits; running sums over those at most 4096 cells of a source show
in which cell its budget ends; only the rows of that boundary cell are summed
again by the next 12 bits. The result is one pair of thresholds for a source,
and rows are taken by comparing their own hash with it: nothing is sorted.
Thresholds are nested: a larger budget keeps all that a smaller one takes.

Null, empty, repeated: a null text has size 0; a null source is a source of its
own, ordered last; only rows with the same id and text share a hash and are taken together;
an empty table gives an empty result; further columns are carried along, but
for those named like the columns that are added, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

WHITE = r"\x20\x09-\x0D"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most a source may repeat.
SHARE, REPEAT = 1.5, 2
BITS = 12


def word_count(text: Column) -> Column:
    """Number of runs of non-white characters."""
    marks = F.regexp_replace(text, f"[{WHITE}]*[^{WHITE}]+[{WHITE}]*", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of an md5 of id and text, the same in any SQL engine."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text.cast("binary")), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, none above repeat x its size.

    The excess of capped sources goes to the others by weight until none is above its cap: with sources in
    order of cap / weight that is the first level L = (budget left) / (weight left) not above the next ratio.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_n", rank).withColumn("_w", pick).withColumn("_cap", F.col("source_size") * F.lit(float(repeat)))
    t = t.withColumn("_r", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_r", "_n").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    t = t.withColumn("_total", F.sum(F.col("source_size").cast("double")).over(every) * F.lit(float(share)))
    t = t.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), zero)) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), zero)))
    level = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_n", "_level"))).over(every)["_level"]
    capped = t.withColumn("_l", level)
    target = F.when(F.col("_l").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_l") * F.col("_w")))
    return capped.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes from the row, repeats counted).

    A source below its target is taken whole as often as fits and the rest is drawn by hash threshold. The
    last cell is taken if that brings the source nearer to its target.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "_h", "_ks", "_whole", "_edge", "_last")
    sized = docs.select("*", word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col), seed).alias("_h"))
    slim = stored(sized.select(F.col(source_col).alias("source"), "size", F.shiftright("_h", 60 - BITS).alias("_c1"), F.shiftright("_h", 60 - 2 * BITS).bitwiseAND(2**BITS - 1).alias("_c2")), "mix-sizes")
    cells = slim.groupBy("source", "_c1").agg(F.sum("size").alias("_s"))
    plan = source_targets(cells.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, share, repeat)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeat - 1))).otherwise(F.lit(0)).cast("long")
    plan = stored(plan.withColumn("_whole", whole).withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-plan")

    upto = lambda c: Window.partitionBy("source").orderBy(c)  # noqa: E731  at most 4096 cells of a source
    first = cells.withColumn("_cum", F.sum("_s").over(upto("_c1")))
    p = plan.select(F.col("source").alias("_ps"), "_budget")
    first = first.join(p, F.col("source").eqNullSafe(F.col("_ps"))).where(F.col("_cum") >= F.col("_budget"))
    edge = first.groupBy("source", "_budget").agg(F.min(F.struct("_c1", (F.col("_cum") - F.col("_s")).alias("_below"))).alias("_e")).select(F.col("source").alias("_es"), "_budget", F.col("_e._c1").alias("_edge"), F.col("_e._below").alias("_below"))
    edge = stored(edge, "mix-edge")
    fine = slim.join(edge, F.col("source").eqNullSafe(F.col("_es")) & (F.col("_c1") == F.col("_edge")))
    fine = fine.groupBy("_es", "_edge", "_budget", "_below", "_c2").agg(F.sum("size").alias("_s"))
    fine = fine.withColumn("_cum", F.col("_below") + F.sum("_s").over(Window.partitionBy("_es", "_edge").orderBy("_c2")))
    taken = F.when(F.col("_cum") - F.col("_s") / 2 <= F.col("_budget"), F.col("_c2"))
    cut = fine.groupBy("_es").agg(F.max("_edge").alias("_edge"), F.coalesce(F.max(taken), F.lit(-1)).alias("_last"))
    limits = plan.join(cut, F.col("source").eqNullSafe(F.col("_es")), "left").select(F.col("source").alias("_ks"), "source_size", "target", "_whole", F.coalesce("_edge", F.lit(-1)).alias("_edge"), F.coalesce("_last", F.lit(-1)).alias("_last"))
    limits = stored(limits, "mix-limits")

    out = sized.join(limits, F.col(source_col).eqNullSafe(F.col("_ks")))
    c1, c2 = F.shiftright("_h", 60 - BITS), F.shiftright("_h", 60 - 2 * BITS).bitwiseAND(2**BITS - 1)
    extra = ((c1 < F.col("_edge")) | ((c1 == F.col("_edge")) & (c2 <= F.col("_last")))).cast("long")
    return out.withColumn("taken", F.col("size") * (F.col("_whole") + extra)).drop("_h", "_ks", "_whole", "_edge", "_last")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '') || '|mix'), 1, 15) AS BIGINT) >> 36 AS cell FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
c AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM w),
r AS (SELECT *, cap / w AS r, sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS tw,
    coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc,
    coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw FROM c),
l AS (SELECT (total - pc) / (tw - pw) AS level FROM r WHERE (total - pc) / (tw - pw) <= r ORDER BY r, n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM r LEFT JOIN l ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 1) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, cell, sum(size) AS s FROM d GROUP BY source, cell),
h AS (SELECT source, cell, s, sum(s) OVER (PARTITION BY source ORDER BY cell) AS cum FROM g),
e AS (SELECT h.source, h.cell, (cum - s / 2.0::DOUBLE <= target - whole * source_size) AND NOT EXISTS (
    SELECT 1 FROM h AS x WHERE x.source IS NOT DISTINCT FROM h.source AND (x.cell >> 12) < (h.cell >> 12) AND x.cum >= target - whole * source_size) AS yes
    FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.whole + CASE WHEN e.yes THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.cell = e.cell
"""
