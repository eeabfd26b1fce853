"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are the character 4-, 5- and 6-grams it holds, in lower case
and with white space as single spaces, hashed to ``BUCKETS``. Each feature is
scaled by the log ratio of its smoothed rates in toxic and other texts; logistic
regression weighs the scaled features. All features take part; an absolute-value
penalty leaves most weights at exactly 0, so scoring a text is one hash and
one table look-up a character and n-gram length, over whole texts.

The model is fitted on a bounded sample of labelled rows: of each label at most
``PER_CLASS`` rows, those with the smallest hash of doc_id, and of these as many as
hold ``SAMPLE_BYTES`` of text; class weights restore the labels' shares among
all labelled rows. Scoring covers every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, importable, written
from tessera.llm.simple8b import text_batches

SIZES = (4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
#: Labelled rows of each label that the model may be fitted on, and the bytes of their texts (the last one may go beyond).
PER_CLASS = 4000
SAMPLE_BYTES = 4_000_000
SMOOTHING = 1.0
#: Weight of the absolute values of the weights, beside a mean loss.
PENALTY = 3e-4
#: Steps of one fit of the features in use, and features that may come into use at once: a matter of speed only.
STEPS = 300
AT_ONCE = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Model(NamedTuple):
    weights: np.ndarray  # by bucket, 0 if not in the model
    intercept: float


def hits(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each feature that a text holds, once each; only those in ``wanted``."""
    joined = "\0".join(texts).lower()
    if len(joined) != sum(map(len, texts)) + len(texts) - 1:  # some letters have longer lower-case forms
        joined = "\0".join(t.lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = joined.split("\0") if joined.count("\0") == len(texts) - 1 else [t.lower() for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in parts])[: len(code)]
    space = (code <= 32) & (code > 0) | (code == 0xA0)
    code = np.where(space, np.uint32(32), code)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    code, text = code[keep].astype(np.uint64), text[keep]
    rows, buckets = [], []
    h = code.copy()
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * _STEP + code[n - 1 :]
        if n not in SIZES:
            continue
        mixed = h ^ (h >> np.uint64(31))
        bucket = ((mixed * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
        at = at[(text[at] == text[at + n - 1]) & (code[at + n - 1] != 0)]  # not across two texts
        rows.append(text[at])
        buckets.append(bucket[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    return pairs >> BITS, pairs & (BUCKETS - 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a row without an id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, sample_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts (doc_id, text, toxic) of the sample, one a doc_id, and the number of all labelled rows by label.

    A doc_id labelled twice counts as toxic if any label says so; null labels are none.
    Of several texts under one doc_id the shortest counts.
    """
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(~held_out(F.col("doc_id")))
    totals = {r.toxic: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by_hash = F.xxhash64("doc_id").alias("hash")
    parts = [marked.filter(F.col("toxic") == label).select("doc_id", "toxic", by_hash).orderBy("hash", "doc_id").limit(per_class) for label in (0, 1)]
    ids = written(parts[0].unionByName(parts[1]), "toxicity-sample")  # at most two times per_class rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "hash").agg(F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("tag"))).alias("one"))
    before = F.sum("one.size").over(Window.partitionBy("toxic").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    chosen = sizes.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample_bytes).select("doc_id", "toxic", "one.tag")
    chosen = written(chosen, "toxicity-chosen").withColumnRenamed("doc_id", "c_id")
    found = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_id")) & (F.xxhash64("text") == F.col("tag")))
    return written(found.select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]), "toxicity-texts"), totals


def log_ratios(ends: np.ndarray, column: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket's smoothed rates in toxic and other texts; 0 for buckets in no text."""
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for start, end, label in zip(np.append(0, ends), ends, y, strict=False):
        np.add.at(counts[0 if label == 1 else 1], column[start:end], 1)
    rate = [np.log((c + SMOOTHING) / (n + 2 * SMOOTHING)) for c, n in zip(counts, ((y == 1).sum(), (y == 0).sum()), strict=True)]
    return np.where(counts[0] + counts[1] > 0, rate[0] - rate[1], 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn the model; see the module's text. Without rows of both labels all texts get the share of toxic rows."""
    importable(docs.sparkSession)
    texts, totals = training_rows(docs, labels, per_class, sample_bytes)

    def features(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            toxic = batch.column(2).to_pylist()
            at = 0
            for ids, held in text_batches([batch.select([0, 1])], 1_000_000):
                row, bucket = hits(held, None)
                ends = np.searchsorted(row, np.arange(len(held) + 1))
                own = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic[at : at + len(held)], pa.int32()), pa.array(own, pa.binary())], names=["doc_id", "toxic", "features"])
                at += len(held)

    spread = texts.repartition(16, "doc_id").select("doc_id", "text", "toxic")
    rows = written(spread.mapInArrow(features, "doc_id long, toxic int, features binary"), "toxicity-features")
    # the bounded sample, about three features of four bytes each a byte of text at most, one partition after the other
    sample = sorted(((r.doc_id, r.toxic, np.frombuffer(r.features, "<u4").astype(np.int32)) for r in rows.toLocalIterator()), key=lambda r: r[0])
    return learn([f for *_, f in sample], np.array([t for _, t, _ in sample], float), totals)


def learn(features: list[np.ndarray], y: np.ndarray, totals: dict[int, int]) -> Model:
    """The model of texts with these buckets and labels; ``totals``: rows of each label that they stand for."""
    sizes = {k: int((y == k).sum()) for k in (0, 1)}
    if not sizes[0] or not sizes[1]:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))))
    ends = np.cumsum([len(f) for f in features])
    column = np.concatenate(features).astype(np.int32, copy=False)
    scale = log_ratios(ends, column, y)
    weight = np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    w, b = sparse_logistic(ends, column, scale, y, weight / weight.sum())
    return Model((w * scale).astype(np.float32), b)


def _error(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)


def sparse_logistic(ends: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of the scaled features, most of them 0, and the intercept, which minimise the weighted loss plus the penalty.

    Features come into use while their slope is over the penalty; the others' weights
    are 0 at the minimum, so they need not be fitted, but every round looks at all.
    """
    counts = np.diff(ends, prepend=0)
    w, used = np.zeros(len(scale)), np.zeros(len(scale), bool)
    b = float(np.log((weight @ y + 1e-9) / (weight @ (1 - y) + 1e-9)))
    z = np.full(len(y), b)
    while True:
        error, slope = _error(z, y, weight), np.zeros(len(scale))
        for lo in range(0, len(y), 100):
            part = slice(ends[lo] - counts[lo], ends[min(lo + 100, len(y)) - 1])
            slope += np.bincount(column[part], weights=np.repeat(error[lo : lo + 100], counts[lo : lo + 100]), minlength=len(scale))
        over = np.where(used, 0.0, np.abs(slope * scale)) - penalty * 1.02
        new = np.flatnonzero(over > 0)
        if not len(new):
            return w, b
        used[new[np.argsort(-over[new], kind="stable")[:AT_ONCE]]] = True
        at = np.flatnonzero(used)
        place = np.flatnonzero(used[column])
        own, b = _fitted(np.searchsorted(ends, place, side="right"), np.searchsorted(at, column[place]), scale[at], y, weight, w[at], b, penalty)
        w[at] = own
        z = b + np.bincount(np.searchsorted(ends, place, side="right"), weights=(w * scale)[column[place]], minlength=len(y))


def _fitted(row: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float, penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps for few features, from the given weights on."""
    values = scale[column]
    forward = lambda w: np.bincount(row, weights=values * w[column], minlength=len(y))
    back = lambda e: np.bincount(column, weights=values * e[row], minlength=len(scale))
    v = np.ones(len(scale))
    for _ in range(12):  # the largest curvature, by powers
        v = back(weight * forward(v / np.linalg.norm(v)))
    steep = 0.3 * np.linalg.norm(v) + 1e-12
    at, at_b, turn = w, b, 1.0
    for _ in range(STEPS):
        error = _error(forward(at) + at_b, y, weight)
        slope, slope_b = back(error), float(error.sum())
        moved = at - slope / steep
        moved = np.sign(moved) * np.maximum(np.abs(moved) - penalty / steep, 0)
        moved_b = at_b - slope_b / 0.3
        again = 1.0 if slope @ (moved - w) + slope_b * (moved_b - b) > 0 else (1 + math.sqrt(1 + 4 * turn * turn)) / 2  # start anew where it would go uphill
        push = 0.0 if again == 1.0 else (turn - 1) / again
        change = np.abs(moved - w).max() + abs(moved_b - b)
        at, at_b = moved + push * (moved - w), moved_b + push * (moved_b - b)
        w, b, turn = moved, moved_b, again
        if change < 1e-5:
            break
    return w, b


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    row, bucket = hits(texts, model.weights != 0)
    z = np.bincount(row, weights=model.weights[bucket], minlength=len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, and the score of its text."""
    importable(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        texts, out, lo, held = [t or "" for t in text], [], 0, 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= 2_000_000 or k == len(texts) - 1:
                out.append(score_texts(model, texts[lo : k + 1]))
                lo, held = k + 1, 0
                give_back()
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("score", score("doc.text"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null text scores as empty text. A row without a doc_id is held out; repeated
    rows are scored alike. A text of any length is scored as a whole. An empty table gives
    no rows. Of ``docs`` only doc_id and text are read, and only the text is scored.
    """
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, per_class, sample_bytes))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns as they were.

    Null text is judged as empty text and stays null; rows without a doc_id and repeated
    rows are judged each by its text, of any length. An empty table stays empty; without
    labels of both kinds all rows get the share of toxic labels. No column but doc_id and text is read.
    """
    return scored(docs, fit(docs, labels, per_class, sample_bytes)).filter("score < 0.5").select([F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
