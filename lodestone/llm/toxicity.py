"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (``SIZE`` code points; A-Z lower-cased, all other ASCII but letters and
digits made spaces, and a space put before and after the text, so that n-grams see where words begin), hashed to ``2**BITS``
buckets. Its value is the log-count ratio of toxic and other documents that hold it, counted over all training rows on the
executors: log((n1 + SMOOTHING) / (e1 + SMOOTHING)) - log((n0 + SMOOTHING) / (e0 + SMOOTHING)), where n1 and n0 documents of
the classes hold it and e1 and e0 would if it told nothing; so a rare n-gram weighs little, and none is left out. A logistic
regression on these values is fitted on the driver by accelerated gradient descent, on a bounded sample of the labelled
rows: of each class those of the smallest hashes of their ids, at most ``MAX_FIT_ROWS``, as long as their texts add up to
``MAX_FIT_BYTES`` or less (texts beyond a sixteenth of that count, but are not in the sample), weighted to the true class
sizes. Nothing but the text is an input of a score.

Nulls and empty texts: n-grams of spaces at most, so the intercept makes the score. Without training rows of both classes,
the score is the smoothed share of toxic rows. Labels that are null are ignored; of repeated labels of a document the
largest counts. Repeated documents are scored each, and count each in training; ties of hashes go to the smaller id. Texts
are scored whole, however long. Empty tables: no rows, and a model of the share alone. An input column whose name (in any
case) is that of the score is replaced by it; ``drop_toxic`` returns the documents' own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import textbuf

SIZE = 5
BITS = 18
#: Rows of each class on which the regression is fitted, at most, and bytes of their texts.
MAX_FIT_ROWS = 1500
MAX_FIT_BYTES = 8 << 20
#: Documents by which counts are drawn towards what a feature that tells nothing would have.
SMOOTHING = 20.0
STEPS = 150
#: Weight of the squared coefficients.
PENALTY = 1e-4


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of all texts, normalised, with a space before and after each."""
    data, offsets = textbuf.flat(column)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(column)), np.diff(lead))
    out = np.full(len(points) + 2 * len(column), 32, dtype=np.uint64)
    low = np.minimum(points, 127).astype(np.uint8)
    folded = textbuf.lower_table()[low]
    word = textbuf.word_table()[folded] | (points > 127)
    out[np.arange(len(points)) + 2 * row + 1] = np.where(points > 127, points, np.where(word, folded, 32))
    return out, lead + 2 * np.arange(len(lead))


def present(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, by row."""
    points, offsets = characters(column)
    n = max(0, len(points) - SIZE + 1)
    h = np.full(n, SIZE, dtype=np.uint64)
    for k in range(SIZE):
        h = (h ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bucket = ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))[:n]
    inside = np.arange(n) + SIZE <= offsets[row + 1]
    key = np.sort((row[inside] << BITS) | bucket[inside])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of class 0 and 1 (a 2-vector), and those that hold each bucket; labelled: toxic, text."""

    def run(batches):
        held, total = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for part in textbuf.slices(batch, 1):
                label = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total += np.bincount(label, minlength=2)
                row, b = present(part.column(1))
                for y in (0, 1):
                    held[y] += np.bincount(b[label[row] == y], minlength=1 << BITS)
        some = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(held[0][some], total[0])), pa.array(np.append(held[1][some], total[1]))], names=["bucket", "n0", "n1"])

    rows = labelled.select("toxic", "text").mapInArrow(run, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0"), F.sum("n1")).toArrow()
    bucket, n0, n1 = (c.to_numpy() for c in rows.columns)
    held, total = np.zeros((2, 1 << BITS)), np.zeros(2)
    at = bucket >= 0
    held[:, bucket[at]] = n0[at], n1[at]
    if len(bucket):
        total[:] = n0[~at][0], n1[~at][0]
    return total, held


def log_count_ratios(total: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of each bucket, from the documents of each class and those of them that hold it."""
    told = np.log(held + SMOOTHING) - np.log(total[:, None] * held.sum(axis=0) / total.sum() + SMOOTHING)
    return told[1] - told[0]


def regress(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a weighted, penalised logistic regression; row and feature: of the values that aren't 0."""
    n, d = len(label), len(value)
    weight = weight / weight.sum()
    share = float((weight * label).sum())
    forward = lambda v: np.bincount(row, weights=(v * value)[feature], minlength=n)
    back = lambda g: np.bincount(feature, weights=g[row], minlength=d) * value
    u, top = value.copy(), 1.0
    for _ in range(8):  # the steepest curvature, which sets the step
        u = back(weight * forward(u))
        top = max(float(np.linalg.norm(u)), 1e-12)
        u /= top
    step = 1 / (top / 4 + PENALTY)
    v, bias = np.zeros(d), float(np.log(share / (1 - share)))
    ahead, bias_ahead = v, bias
    for t in range(1, STEPS + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(forward(ahead) + bias_ahead, -40, 40))) - label)
        new, bias_new = ahead - step * (back(g) + PENALTY * ahead), bias_ahead - 2 * float(g.sum())
        k = (t - 1) / (t + 2)
        ahead, bias_ahead = new + k * (new - v), bias_new + k * (bias_new - bias)
        v, bias = new, bias_new
    return v, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS, max_fit_bytes: int = MAX_FIT_BYTES) -> Model:
    """Learns from the documents that labels names; give only the labels that may be learnt from."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total, held = class_counts(texts.join(marks.hint("shuffle_hash"), "id"))
    prior = (total[1] + 1) / (total.sum() + 2)
    share = Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(prior / (1 - prior))))
    if not total.all():
        return share
    some = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(max_fit_rows) for y in (0, 1)]
    sample = texts.join(F.broadcast(some[0].unionAll(some[1])), "id").withColumn("hash", F.xxhash64("id")).withColumn("bytes", F.octet_length("text").cast("long"))
    sample = sample.where(F.col("bytes") <= max_fit_bytes // 16).withColumn("upto", F.expr("sum(bytes) OVER (PARTITION BY toxic ORDER BY hash, id, text)"))
    rows = sample.where(F.col("upto") <= max_fit_bytes).orderBy("toxic", "hash", "id", "text").select("toxic", "text").toArrow()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return share
    parts, at = [], 0
    for batch in rows.to_batches():
        for part in textbuf.slices(batch, 1):  # the n-grams of a slice at a time
            row, feature = present(part.column(1))
            parts.append((row.astype(np.int32) + at, feature.astype(np.int32)))
            at += part.num_rows
    row, feature = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    ratio = log_count_ratios(total, held)
    v, bias = regress(row, feature, ratio, y, np.where(y > 0, total[1] / y.sum(), total[0] / (1 - y).sum()))
    return Model((v * ratio).astype(np.float32), bias)


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of docs with the probability of toxicity."""
    def kernel(column: pa.Array) -> list[pa.Array]:
        row, b = present(column)
        z = np.bincount(row, weights=model.weights[b].astype(np.float64), minlength=len(column)) + model.bias
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]

    return textbuf.annotate(docs, text, T.StructType([T.StructField(output, T.DoubleType())]), kernel, keep)


def may_learn(doc_id: str = "doc_id"):
    """The rows outside the held-out fifth: crc32 of the id as text, modulo 5, isn't 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 != 0


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score is below least, with their own columns only."""
    names = docs.columns
    aside = docs.toDF(*[f"__in{k}" for k in range(len(names))])
    at = {n.lower(): f"__in{k}" for k, n in enumerate(names)}
    kept = score(aside, model, at[text.lower()], "__score").where(F.col("__score") < least)
    return kept.select(*[F.col(f"__in{k}").alias(n) for k, n in enumerate(names)])
