"""Toxicity as severity grades by cumulative-link ordinal regression.

Labels say toxic or not. For training every labelled text is dealt word by word into two halves: what the regression reads
is one half, what grades a toxic text (mild, marked, severe: the tertiles of marking words in a hundred) is the other, so
no grade is made of the words it is predicted from. One weight for each sparse text feature is shared by all thresholds:
P(grade > k) = sigmoid(w.x - theta_k), theta ascending. The expected grade is the severity. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm import wordbytes
from gridindex.llm.ranges import checkpointed

#: Words and word beginnings of these many bytes, hashed into SPACE cells: there are never more features than that (8 MB).
PREFIXES, SPACE = (5, 6, 7, 8), 1 << 20
#: Features kept: LIFT times as common in toxic texts as in clean ones, where chance makes them so with LEVEL at most: a
#: test that means the same for a table of any size.
LIFT, LEVEL = 6.0, 0.02
#: Features are chosen on about so many labelled texts at most and the regression is fitted on so many at most, by the hash of
#: id and text. What is broadcast is a row a labelled text (32 bytes), so that no text is shuffled; the first bound is its.
MAX_LABELS, MAX_ROWS = 500_000, 40_000
GRADES = 3
#: A text is called toxic from this probability of any grade on: labels miss more toxic texts than they invent.
THRESHOLD = 0.25


class Model(NamedTuple):
    features: np.ndarray  # sorted cells
    weights: np.ndarray
    thresholds: np.ndarray  # GRADES, ascending


def cells(w: wordbytes.Words, halves: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature cells of a chunk's words and which text each belongs to (0-based in the chunk); with halves, which half of a text: 2 k or 2 k + 1."""
    doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
    if halves:
        doc = 2 * doc + (np.arange(len(doc)) - w.first[doc]) % 2
    out, docs = [w.hash % np.uint64(SPACE)], [doc]
    for length in PREFIXES:
        at, h = w.prefix(length)
        out.append(wordbytes.mix(h + np.uint64(length)) % np.uint64(SPACE))
        docs.append(doc[at])
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


def _rows(column: pa.Array, model_features: np.ndarray, halves: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks as (first text, words of each, and the kept features as text, feature index, count); with halves, each text as two."""
    for w in wordbytes.words(column, wordbytes.ALNUM):
        cell, doc = cells(w, halves)
        at = np.minimum(np.searchsorted(model_features, cell), max(len(model_features) - 1, 0))
        hit = model_features[at] == cell if len(model_features) else np.zeros(len(cell), bool)
        key, n = np.unique(doc[hit] * max(len(model_features), 1) + at[hit], return_counts=True)
        sizes = np.diff(w.first)
        yield w.lo, np.stack([(sizes + 1) // 2, sizes // 2], 1).ravel() if halves else sizes, key // max(len(model_features), 1), key % max(len(model_features), 1), n


def _value(count: np.ndarray, words: np.ndarray, least: float = 25) -> np.ndarray:
    """A feature's value: its count in a hundred words (of 25 at least; half as many in half a text), dampened."""
    return np.log1p(100 * count / np.maximum(words, least))


def marking(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Which features mark toxic texts, from the number of toxic and clean texts that have each.

    The chance that so many of a feature's texts are toxic, when each is so with the share of all, is at most LEVEL (by
    Chernoff's bound, which is exact where no clean text has it).
    """
    n, share = toxic + clean, all_toxic / (all_toxic + all_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda seen, want: np.where(seen > 0, seen * np.log(seen / want), 0.0)
        chance = np.exp(-(term(toxic, n * share) + term(clean, n * (1 - share))))
    return (toxic / all_toxic >= LIFT * (clean + 0.5) / all_clean) & (chance <= LEVEL)


def select(labelled: DataFrame) -> np.ndarray:
    """The feature cells that mark toxic texts, from document counts over the labelled rows (text, y, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros((2, SPACE)), np.zeros(2)
        for batch in batches:
            y, weight = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for w in wordbytes.words(batch.column(0), wordbytes.ALNUM):
                cell, doc = cells(w)
                once = np.unique(doc * SPACE + cell)
                row = w.lo + once // SPACE
                for c in (0, 1):
                    own = y[row] == c
                    found[c] += np.bincount(once[own] % SPACE, weights=weight[row[own]], minlength=SPACE)
            total += np.bincount(y, weights=weight, minlength=2)
        at = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[0][at], total[0])), pa.array(np.append(found[1][at], total[1]))], ["cell", "clean", "toxic"])

    counts = labelled.select("text", "y", "weight").mapInArrow(run, "cell long, clean double, toxic double").groupBy("cell").agg(F.round(F.sum("clean"), 3).alias("clean"), F.round(F.sum("toxic"), 3).alias("toxic"))
    table = counts.toArrow()  # at most SPACE rows and one
    cell, clean, toxic = (table.column(c).to_numpy() for c in ("cell", "clean", "toxic"))
    total = np.flatnonzero(cell == -1)
    if not len(total) or not toxic[total[0]] or not clean[total[0]]:
        return np.zeros(0, np.int64)
    kept = marking(toxic[cell >= 0], clean[cell >= 0], toxic[total[0]], clean[total[0]])
    return np.sort(cell[cell >= 0][kept]).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def regress(text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood (Adam), all cumulative links at once."""
    n = len(grade)
    above = (grade[:, None] > np.arange(GRADES)).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    theta = np.log((1 - share) / share)
    x = np.concatenate([np.zeros(n_features), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        theta = x[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(text, weights=w[feature] * value, minlength=n)
        up = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - theta), np.zeros((n, 1))], 1)  # P(grade >= k), k = 0 .. GRADES + 1
        here, above_ = up[np.arange(n), grade], up[np.arange(n), grade + 1]
        p = np.maximum(here - above_, 1e-12)
        slope = lambda u: u * (1 - u)
        by_score = (slope(here) - slope(above_)) / p / n
        g_theta = np.zeros(GRADES)
        for k in range(GRADES):
            g_theta[k] = (np.where(grade == k + 1, -slope(here), 0.0) + np.where(grade == k, slope(above_), 0.0)).__truediv__(p).sum() / n
        g = np.zeros_like(x)
        g[:n_features] = -np.bincount(feature, weights=by_score[text] * value, minlength=n_features) + decay * w
        g[n_features] = -g_theta.sum()
        for k in range(GRADES - 1):
            g[n_features + 1 + k] = -g_theta[k + 1 :].sum() * gaps[k]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Choose features, grade and fit, on bounded samples of the labelled rows. Without labels of both kinds nothing is toxic."""
    spark = docs.sparkSession
    one = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    # each text of an id once, with its number of rows: ids and hashes alone are shuffled
    once = checkpointed(spark, texts.select("id", "h").join(one, "id").groupBy("id", "h", "y").agg(F.count("*").alias("copies")), "toxicity")
    n = once.count()
    share = lambda most: F.pmod("h", F.lit(1 << 30)) < F.lit((1 << 30) * min(most, n) // max(n, 1))
    some = once.filter(share(MAX_LABELS)).select("id", "h", "y", (1 / F.col("copies")).alias("weight"))
    rows = texts.join(F.broadcast(some), ["id", "h"])
    features = select(rows)
    clean = Model(features[:0], np.zeros(0), np.array([1.0, 2.0, 3.0]) * 40)
    if not len(features):
        return clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words, doc, feature, n in _rows(batch.column(1), features, halves=True):
                cuts = np.searchsorted(doc, np.arange(len(words) + 1))
                offsets = pa.array(cuts.astype(np.int32))
                h, y = (np.repeat(batch.column(c).slice(lo, len(words) // 2).to_numpy(), 2) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(y), pa.ListArray.from_arrays(offsets, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(_value(n, words[doc], 12.5), pa.float32())), pa.array(np.arange(len(words)) % 2, pa.int32())], ["h", "y", "feature", "value", "half"])

    # the halves of a text stand side by side
    half = F.struct("feature", "value")
    sample = rows.filter(share(max_rows)).select("h", "text", "y").mapInArrow(run, "h long, y int, feature array<int>, value array<float>, half int")
    pairs = sample.groupBy("h").agg(F.max("y").alias("y"), *(F.max(F.when(F.col("half") == k, half)).alias(f"half{k}") for k in (0, 1)))
    taken = pairs.orderBy("h").limit(max_rows)
    sample = taken.select("y", F.explode(F.array("half0", "half1")).alias("s")).select("y", "s.*").toArrow()  # two rows a text
    y = sample.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return clean
    lists, values = (c.chunk(0) if isinstance(c := sample.column(k).combine_chunks(), pa.ChunkedArray) else c for k in ("feature", "value"))
    text = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    feature, value = lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float)
    other = np.bincount(text, weights=value, minlength=len(y)).reshape(-1, 2)[:, ::-1].ravel()
    cuts = np.quantile(other[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (other > cuts[0]).astype(int) + (other > cuts[1]), 0)
    weights, thresholds = regress(text, feature, value, grade, len(features))
    return Model(features, weights, thresholds)


def probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """Per text: P(grade >= 1 .. GRADES)."""
    score = np.zeros(len(column))
    for lo, words, doc, feature, n in _rows(column, model.features):
        if len(doc):
            score[lo : lo + len(words)] = np.bincount(doc, weights=model.weights[feature] * _value(n, words[doc]), minlength=len(words))
    return _sigmoid(score[:, None] - model.thresholds)


def scored(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, toxic (p_toxic >= threshold) and grade (0 unless toxic, else the likeliest beyond 0) for every row.

    A null or empty text has no features: its severity is that of a text without toxic wording. Repeated rows stay
    repeated; a null doc_id stays null; other columns are ignored. Rows are scored on their own.
    """
    shared = spark.sparkContext.broadcast(model)  # at most SPACE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(batch.column(1), shared.value)
            each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(np.where(p[:, 0] >= threshold, each[:, 1:].argmax(1) + 1, 0), pa.int64()), pa.array(p[:, 0] >= threshold)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade long, toxic boolean")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """scored() with a model fitted on docs and labels (doc_id, toxic 0/1; a document labelled both ways counts as toxic)."""
    return scored(spark, docs, fit(docs, labels))
