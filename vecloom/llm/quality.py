"""Quality classifier: a sparse ensemble of rules compiled into Spark column expressions.

Boosted shallow trees are grown in numpy on a bounded sample of labelled rows
(SAMPLE_ROWS, those with the smallest hash of the id; rows that repeat id, text
and label count once); every path from a root is
a conjunctive rule over text statistics; a lasso logistic regression weighs the
rules, most get weight zero; what is left becomes one Spark expression. Scoring
is a plain projection over the whole table: no shuffle, no Python.

Null, empty, repeated: a null text scores as an empty one; repeated rows score
alike; with no labelled rows, or one class, the score is the (smoothed) share of
label 1. Further columns are carried along; those named like the added ones are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample that is brought to the driver.
SAMPLE_ROWS = 20_000
UPPER, DIGITS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*|!@^~<>{}[]=+_\\/"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, all JVM expressions; an empty text gives zeros."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    count = lambda chars: n - F.length(F.translate(t, chars, ""))
    words, lines = F.split(t, r"[\x20\x09-\x0D]+"), F.split(t, "\n")
    return {
        "chars": n.cast("double"),
        "upper": per(count(UPPER), n),
        "digits": per(count(DIGITS), n),
        "symbols": per(count(SYMBOLS), n),
        "bars": per(count("|"), n),
        "stops": per(count(".,;:?"), n),
        "lines": F.size(lines).cast("double"),
        "fresh_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "words": F.size(words).cast("double"),
        "fresh_words": per(F.size(F.array_distinct(words)), F.size(words)),
        "word_length": per(n, F.size(words)),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at most?, threshold) hold."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, low, x in self.parts:
            out = out & ((stats[name] <= x) if low else (stats[name] > x))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, low, t in self.parts:
            out &= (x[name] <= t) if low else (x[name] > t)
        return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, names: list[str], out: list, step: np.ndarray, least: int) -> None:
    value = -grad[rows].sum() / (hess[rows].sum() + 1.0)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = grad[rows].sum(), hess[rows].sum()
        for f in range(codes.shape[1]):
            size = len(edges[f]) + 1
            c = codes[rows, f]
            g, h, n = (np.cumsum(np.bincount(c, weights=w, minlength=size))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        step[rows] = value
        return
    f, at = best[1]
    for low in (True, False):
        part = (*path, (names[f], low, float(edges[f][at])))
        out.append(part)
        mine = rows[(codes[rows, f] <= at) == low]
        _grow(codes, edges, grad, hess, mine, depth - 1, part, names, out, step, least)


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Paths of boosted trees; deterministic."""
    names = list(x)
    edges = [np.unique(np.quantile(v, np.linspace(0.01, 0.99, 48), method="lower")) for v in x.values()]
    codes = np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x.values(), strict=True)])
    margin, paths = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(codes, edges, p - y, p * (1 - p), np.arange(len(y)), depth, (), names, paths, step, max(5, len(y) // 2000))
        margin += rate * step
    return [Rule(p) for p in dict.fromkeys(paths)]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the bias isn't penalised."""
    n, d = z.shape
    mean = z.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    q = np.column_stack([(z - mean) / scale, np.ones(n)])
    bound = np.linalg.norm(q.T @ q / n, 2) / 4
    w, v, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-q @ v))
        u = v - (q.T @ (p - y) / n) / bound
        new = np.sign(u) * np.maximum(np.abs(u) - penalty / bound, 0)
        new[-1] = u[-1]
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    weights = w[:-1] / scale
    return weights, float(w[-1] - mean @ weights)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, penalty: float = 2e-3) -> Ensemble:
    """`where` selects the rows of labels that may be learned from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if where is None else known.where(where)
    sample = known.select(id_col, F.col(label_col).cast("double").alias("_y")).distinct().orderBy(F.xxhash64(id_col), id_col, "_y").limit(sample_rows)
    stats = statistics(F.col("_t"))
    texts = docs.select(id_col, F.col(text_col).alias("_t")).join(F.broadcast(sample), id_col)  # at most sample_rows rows
    rows = texts.select(F.col(id_col).alias("_d"), F.xxhash64("_t").alias("_h"), "_y", *[c.alias(k) for k, c in stats.items()]).dropDuplicates(["_d", "_h", "_y"])
    # cut by hash, not by label: an id with many texts must not push out the other class
    got = rows.orderBy(F.xxhash64("_d", "_h"), "_d", "_h", "_y").limit(sample_rows).select("_y", *stats).toArrow()
    got = got.sort_by([(c, "ascending") for c in got.column_names])
    y = got["_y"].to_numpy()
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble((), (), float(np.log(share / (1 - share))))
    x = {k: got[k].to_numpy() for k in stats}
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble((), (), float(np.log(y.mean() / (1 - y.mean()))))
    z = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)
    weights, bias = lasso_logistic(z, y, penalty)
    kept = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4]
    return Ensemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), bias)


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold)."""
    docs = docs.drop("score", "predicted", "_stats")
    stats = statistics(F.col(text_col))
    # the row number is a barrier: a filter on the score must not be moved below, where each rule would compute its statistics anew
    with_stats = docs.withColumn("_stats", F.struct(*[c.alias(k) for k, c in stats.items()], F.monotonically_increasing_id().alias("row")))
    out = with_stats.withColumn("score", model.score({k: F.col(f"_stats.{k}") for k in stats})).drop("_stats")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

