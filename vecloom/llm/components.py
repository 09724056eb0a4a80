"""Connected components of a link table, as rounds of joins: nothing is collected, no node's links meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import join_spread
from .runtime import stored as _stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a long, b long) -> (node, label): label is the smallest node reachable; nodes without links are absent.

    Each round hooks every current root to the smallest label seen across its links, then halves all paths by
    pointer jumping until they are flat. Links within one component are dropped, so rounds shrink; their
    number is logarithmic. Minima are pre-aggregated before shuffles and labels that many nodes carry are broadcast,
    so a component of a third of all nodes is no task's alone; joins of links by a node with many are left to
    adaptive execution to split.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = _stored(pairs, f"{name}-links")
    n = left.count()
    # every table below has at most a row for each end of a link
    stored = lambda df, table: _stored(df, table, 2 * n)
    label = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    label = stored(label, f"{name}-labels")
    while True:
        hooks = left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))  # a < b: no cycles
        if hooks.isEmpty():
            return label
        parent = stored(label.select("label").distinct().join(hooks, F.col("label") == F.col("root"), "left").select(F.col("label").alias("root"), F.coalesce("to", "label").alias("to")), f"{name}-parents")
        while True:
            jump = parent.select(F.col("root").alias("to"), F.col("to").alias("next"))
            parent = stored(parent.join(jump, "to"), f"{name}-parents")
            changed = not parent.where("next <> to").isEmpty()
            parent = parent.select("root", F.col("next").alias("to"))
            if not changed:
                break
        label = stored(join_spread(label, parent.withColumnRenamed("root", "label"), ["label"], 2 * n).select("node", F.col("to").alias("label")), f"{name}-labels")
        up = parent.select(F.col("root").alias("_r"), "to")
        left = left.join(up, F.col("a") == F.col("_r")).select(F.col("to").alias("a"), "b").join(up, F.col("b") == F.col("_r")).select("a", F.col("to").alias("b"))
        left = stored(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-links")
