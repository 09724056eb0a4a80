"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text in one pass; each task adds
up its own counts, so what is shuffled is bounded by languages x buckets per
task. The log-probability matrix (languages x buckets, a fixed size for a set
of languages) is broadcast, and texts are scored in blocks with numpy gathers.

Null, empty, repeated: a text that is null or has no letter is `und` with score
0; rows with null text or null language teach nothing; ties go to the language
first in order; without any training rows all is `und`. More languages than fit the bound
of the model (2,048 at 15 bits) are refused; fewer bits hold more. Further columns stay; those named like
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .runtime import bounded_batches, stored

#: The broadcast matrix may not be larger than this (languages x buckets x 4 bytes).
MAX_MODEL_BYTES = 256 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x buckets
    log_prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a block of UTF-8 and the offsets of its documents."""
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    text = V.LOWER[data].tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    upper = ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)) | ((points >= 0x391) & (points <= 0x3A9)) | ((points >= 0x410) & (points <= 0x42F))
    return points + np.uint32(32) * upper, lead[off]


def ngram_buckets(points: np.ndarray, off: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and offsets by document (n-grams never cross documents)."""
    n = len(points) - order + 1
    count = np.maximum(np.diff(off) - order + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    if n <= 0 or not first[-1]:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = np.full(n, np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF), dtype=np.uint32)
    for k in range(order):
        h = (h ^ points[k : n + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    buckets = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
    inside = np.zeros(n + order, dtype=bool)
    inside[:n] = True
    for k in range(1, order):
        cut = off[1:-1] - k
        inside[cut[cut >= 0]] = False
    return buckets[inside[:n]].astype(np.int64), first


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, orders=(1, 2, 3), bits: int = 15, alpha: float = 0.5) -> Model:
    """Count over all rows for which `where` holds, with text and language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = (rows if where is None else rows.where(where)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = 1 << bits
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            data, off = V.arrow_text(batch.column(1))
            for i, j, part, o in V.blocks(data, off):
                points, at = code_points(part, o)
                ids, of = np.unique(langs[i:j].astype(str), return_inverse=True)
                for lang, k in zip(ids, np.bincount(of), strict=True):
                    total.setdefault(lang, np.zeros(size + 1, np.int64))[size] += k
                for order in orders:
                    buckets, first = ngram_buckets(points, at, order, bits)
                    each = np.repeat(of, np.diff(first))
                    sums = np.bincount(each * size + buckets, minlength=len(ids) * size).reshape(len(ids), size)
                    for lang, row in zip(ids, sums, strict=True):
                        total[lang][:size] += row
        for lang, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    got = stored(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid-counts")
    languages = tuple(sorted(r[0] for r in got.where(F.col("bucket") == size).select("lang").collect()))
    if len(languages) * size * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages x {size} buckets exceed the bound of the broadcast model; use fewer bits")
    counts = np.zeros((len(languages), size + 1))
    table = got.toArrow()
    index = {lang: i for i, lang in enumerate(languages)}
    if len(table):
        counts[[index[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    grams, priors = counts[:, :size] + alpha, counts[:, size]
    return Model(languages, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), np.log(priors / max(priors.sum(), 1)), tuple(orders), bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (posterior probability of that language)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "_letter")
    kept = docs.columns
    flagged = docs.withColumn("_letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if not model.languages:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            data, off = V.arrow_text(batch.column(batch.schema.get_field_index(text_col)))
            n = len(off) - 1
            sums = np.tile(m.log_prior, (n, 1))
            for i, j, part, o in V.blocks(data, off):
                points, at = code_points(part, o)
                for order in m.orders:
                    buckets, first = ngram_buckets(points, at, order, m.bits)
                    some = np.flatnonzero(np.diff(first))
                    if len(some):
                        for k in range(len(m.languages)):
                            sums[i + some, k] += np.add.reduceat(m.log_prob[k][buckets], first[some], dtype=np.float64)
            best = np.argmax(sums, axis=1) if n else np.zeros(0, np.int64)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1) if n else np.zeros(0)
            letter = batch.column(batch.schema.get_field_index("_letter")).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letter, best, len(m.languages))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(kept))), pa.array(names[best], pa.string()), pa.array(np.where(letter, share, 0.0))], [*kept, "lang_pred", "score"])

    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return flagged.mapInArrow(score, schema)
