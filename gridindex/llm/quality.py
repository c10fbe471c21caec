"""Quality by co-training: a text-content view and a page-metadata view label documents for each other.

The text view reads the text alone: word shapes (letters, digits and signs, repeats collapsed), and whether a word repeats
the one before, as a multinomial model, with layout figures in fixed steps. The metadata view reads what stands beside the
text: language, source and the declared length, as a categorical model; it never sees the text. Both models
are counts, so every round is one pass over all documents: what one view is sure of, with the given labels, trains the
other. Labels of a fifth of the labelled documents are kept out of training; on them each view's score is calibrated before it
labels for the other. The views are independent given the class, so their calibrated evidence beyond the prior adds up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm import wordbytes
from gridindex.llm.ranges import checkpointed, free

SHAPES, STEPS, FIGURES = 4096, 16, 9
#: Text features: shapes, then the figures' steps. Metadata features: so many cells for each of FIELDS fields.
TEXT = SHAPES + FIGURES * STEPS
CATEGORIES, FIELDS = 512, 3
META = CATEGORIES * FIELDS
#: A text counts as so many words at most, so that long texts are no surer than their mix of shapes makes them.
EFFECTIVE_WORDS = 30.0
#: A view labels what its calibrated score holds this likely, in logits (0.98).
CONFIDENT = math.log(0.98 / 0.02)
ROUNDS = 3
#: Labels of one document in HELD_OUT, by the hash of its id, calibrate and do not train.
HELD_OUT = 5
#: Scores are calibrated from counts in so many equal steps of +-RANGE logits.
BINS, RANGE = 240, 60.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("a")


class Features(NamedTuple):
    """Per text: text features and their weights (as lists by offset), and FIELDS metadata features."""

    offsets: np.ndarray
    text: np.ndarray
    weights: np.ndarray
    meta: np.ndarray


def _step(x: np.ndarray) -> np.ndarray:
    return np.clip((x * STEPS).astype(np.int64), 0, STEPS - 1)


def features(text: pa.Array, lang: pa.Array, source: pa.Array, declared: pa.Array) -> Features:
    """A text without words has no text features."""
    offsets, body = wordbytes.utf8(text)
    start0 = offsets[0] if len(offsets) else 0
    data, bounds = body[start0 : offsets[-1]], offsets - start0
    kind = _SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    cuts = bounds[:-1]
    keep[cuts[cuts < len(kind)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    shaped = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(kept[bounds].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kind[keep])))
    n = len(text)
    # per text: bytes, words, share of capitals, signs, digits, breaks, words that repeat the one before, how the distinct words grow with all words, mean word length
    size = np.maximum(np.diff(bounds), 0)
    # shares of a short text are drawn toward a usual text's, else one capital in five letters would be shouting
    share = lambda mask: (np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds]) + 1) / (size + 60)
    capital, digit = share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57))
    breaks = share(data == 10)
    sign = share((data > 32) & (data < 127) & (kind != 97) & (kind != 65) & (kind != 48))
    lists: list[tuple[np.ndarray, np.ndarray]] = []
    count, distinct, repeat, letters = (np.zeros(n) for _ in range(4))
    plain = wordbytes.words(text.cast(pa.large_string()))
    for a, b in zip(plain, _aligned(shaped, text), strict=True):
        same = np.zeros(len(a.hash), bool)
        same[1:] = a.hash[1:] == a.hash[:-1]
        first = a.first.tolist()
        length = a.end - a.start
        for k in range(a.hi - a.lo):
            lo, hi = first[k], first[k + 1]
            if hi == lo:
                lists.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            same[lo] = False
            shape = (b.hash[lo:hi] % np.uint64(SHAPES // 2)).astype(np.int64) * 2 + same[lo:hi]
            ids, counts = np.unique(shape, return_counts=True)
            lists.append((ids, counts * (min(hi - lo, EFFECTIVE_WORDS) / (hi - lo))))
            i = a.lo + k
            count[i], distinct[i], repeat[i], letters[i] = hi - lo, len(np.unique(a.hash[lo:hi])), same[lo:hi].sum(), length[lo:hi].sum()
    words = np.maximum(count, 1)
    figures = [np.log1p(size) / 16, np.log1p(count) / 14, capital, sign * 2, digit * 2, breaks * 20, repeat / (words + 5), np.log1p(distinct) / np.log1p(words) - 0.01, np.minimum(letters / words / 16, 1)]
    steps = np.stack([SHAPES + k * STEPS + _step(x) for k, x in enumerate(figures)], 1).reshape(n, FIGURES)
    lists = [(np.append(ids, step), np.append(w, np.ones(FIGURES))) if len(ids) else (ids, w) for (ids, w), step in zip(lists, steps, strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in lists])]).astype(np.int64)
    return Features(starts, np.concatenate([i for i, _ in lists]) if lists else np.zeros(0, np.int64), np.concatenate([w for _, w in lists]) if lists else np.zeros(0), metadata(lang, source, declared))


def metadata(lang: pa.Array, source: pa.Array, length: pa.Array) -> np.ndarray:
    """Texts x FIELDS: cells of the language, the source and the declared length in half powers of two; missing is a value of its own."""
    lang, source = lang.to_pylist(), source.to_pylist()
    size = [None if x is None or not math.isfinite(x) else int(2 * math.log2(1 + max(x, 0))) for x in length.to_pylist()]
    cells = [[k * CATEGORIES + hash_name(v, str(k)) for v in column] for k, column in enumerate((lang, source, size))]
    return np.array(cells, np.int64).reshape(FIELDS, len(lang)).T


def _aligned(shaped: pa.Array, text: pa.Array) -> Iterator[wordbytes.Words]:
    """The shapes' words in the same chunks as the text's."""
    offsets, _ = wordbytes.utf8(text)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + wordbytes._CHUNK, side="right")) - 1)
        yield next(wordbytes.words(shaped.slice(lo, hi - lo)))
        lo = hi


_NAMES: dict[tuple[str, str], int] = {}


def hash_name(value: object, salt: str) -> int:
    key = (salt, str(value))
    if key not in _NAMES:
        if len(_NAMES) > 100_000:
            _NAMES.clear()
        _NAMES[key] = wordbytes.hash_word(f"{salt}\x00{value}") % CATEGORIES
    return _NAMES[key]


class Model(NamedTuple):
    text: np.ndarray  # logits a feature
    meta: np.ndarray
    prior: float
    text_line: tuple[float, float]  # calibrated logit = a * score + b
    meta_line: tuple[float, float]


def scores(f: Features, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Both views' logits."""
    n = len(f.meta)
    each = np.add.reduceat(np.append(f.weights * m.text[f.text], 0.0), np.minimum(f.offsets[:-1], len(f.text))) if n else np.zeros(0)
    each = np.where(np.diff(f.offsets) > 0, each, 0.0)
    return m.prior + each, m.prior + m.meta[f.meta].sum(1)


def calibrated(f: Features, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Both views' calibrated logits."""
    return tuple(a * s + b for s, (a, b) in zip(scores(f, m), (m.text_line, m.meta_line), strict=True))


def combined(f: Features, m: Model) -> np.ndarray:
    """The prior and what each calibrated view knows beyond it, as a probability."""
    text, meta = calibrated(f, m)
    logit = text + meta - m.prior
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _ratios(counts: np.ndarray, smooth: float) -> np.ndarray:
    """Logits of each feature, from good and bad counts."""
    good, bad = counts[1] + smooth, counts[0] + smooth
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def _line(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Logistic calibration a * score + b, a >= 0, from counts in score bins, with smoothed targets."""
    n1, n0 = good.sum(), bad.sum()
    if not n1 or not n0:
        return 0.0, 0.0
    x = (np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE
    weight = good + bad
    target = (good * (n1 + 1) / (n1 + 2) + bad / (n0 + 2)) / np.maximum(weight, 1)
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        j = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(j, [(g * x).sum(), g.sum()])
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -5, 5)
    return max(float(a), 0.0), float(b)


STORED = "doc_id long, text array<int>, weights array<float>, meta array<int>"
COLUMNS = ("text", "lang", "source", "n_chars")


def _read(docs: DataFrame) -> list[Column]:
    """text, lang, source and n_chars of docs; a column that is not there is missing in every row."""
    kinds = dict(zip(COLUMNS, ("string", "string", "string", "double"), strict=True))
    plain = [(F.col(c) if c in docs.columns else F.lit(None)).try_cast(kinds[c]) for c in COLUMNS]
    return [F.coalesce(plain[0], F.lit("")), *plain[1:]]


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                f = features(*(part.column(k) for k in (1, 2, 3, 4)))
                offsets = pa.array(f.offsets.astype(np.int32))
                meta = pa.ListArray.from_arrays(np.arange(0, FIELDS * part.num_rows + 1, FIELDS, dtype=np.int32), pa.array(f.meta.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(f.text, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(f.weights, pa.float32())), meta], ["doc_id", "text", "weights", "meta"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(name) for c, name in zip(_read(docs), COLUMNS, strict=True))).mapInArrow(run, STORED)


def _stored(batch: pa.RecordBatch) -> Features:
    """The features of stored rows."""
    text, meta = batch.column("text"), batch.column("meta")
    starts = np.concatenate([[0], np.cumsum(np.diff(text.offsets.to_numpy()))])
    return Features(starts, text.flatten().to_numpy(), batch.column("weights").flatten().to_numpy().astype(float), meta.flatten().to_numpy().reshape(-1, FIELDS))


def with_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of every row of docs with y (1, 0, or missing), written once to the shared folder.

    A document labelled both ways equally often counts as unlabelled.
    """
    one = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q"))
    one = one.select("doc_id", F.when(F.col("q") > 0.5, 1).when(F.col("q") < 0.5, 0).cast("int").alias("y"))
    return checkpointed(spark, extracted(docs).join(one, "doc_id", "left"), "quality")


def train(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """Co-train on the rows of with_labels(); what comes back from a round is one count a feature and class.

    Without labels of both classes every score is 0.5. Where the labels kept out lack a class (few labels), all labels both
    train and calibrate.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    both = {(r.held, r.y): r.n for r in table.filter("y IS NOT NULL").groupBy(held.alias("held"), "y").agg(F.count("*").alias("n")).collect()}  # four rows
    apart = all((h, y) in both for h in (True, False) for y in (0, 1))
    table = table.select(F.when(~held, F.col("y")).alias("y") if apart else "y", F.when(held, F.col("y")).alias("check") if apart else F.col("y").alias("check"), "text", "weights", "meta")

    def counted(model: Model | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature counts by class: each view is trained on the given labels and on what the other view is sure of."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text, meta = np.zeros((2, TEXT + 1)), np.zeros((2, META + 1))
            for batch in batches:
                y, check, f = *(batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("y", "check")), _stored(batch)
                for_text, for_meta = y.copy(), y.copy()
                if model is not None:
                    by_text, by_meta = calibrated(f, model)
                    sure = lambda s: np.where(s > CONFIDENT, 1, np.where(s < -CONFIDENT, 0, -1))
                    open_ = (y < 0) & (check < 0)  # rows that calibrate are not labelled either
                    for_text, for_meta = np.where(open_, sure(by_meta), y), np.where(open_, sure(by_text), y)
                row = np.repeat(np.arange(len(y)), np.diff(f.offsets))
                for c in (0, 1):
                    mine = for_text[row] == c
                    text[c] += np.bincount(f.text[mine], weights=f.weights[mine], minlength=TEXT + 1)
                    text[c, TEXT] += (for_text == c).sum()
                    meta[c] += np.bincount(f.meta[for_meta == c].ravel(), minlength=META + 1)
                    meta[c, META] += (for_meta == c).sum()
            out = [(view, c, k, x[c, k]) for view, x in ((0, text), (1, meta)) for c in (0, 1) for k in np.flatnonzero(x[c]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["view", "c", "k", "n"])

        sums = table.mapInArrow(run, "view int, c int, k int, n double").groupBy("view", "c", "k").agg(F.sum("n").alias("n")).collect()  # features x classes at most
        out = np.zeros((2, TEXT + 1)), np.zeros((2, META + 1))
        for r in sums:
            out[r.view][r.c, r.k] = r.n
        return out

    flat = (1.0, 0.0)
    text, meta = counted(None)
    if not (text[:, TEXT] > 0).all():
        return Model(np.zeros(TEXT), np.zeros(META), 0.0, flat, flat)
    prior = math.log(text[1, TEXT] / text[0, TEXT])
    check = table.filter("check IS NOT NULL")

    def built(text: np.ndarray, meta: np.ndarray) -> Model:
        """The model of these counts, calibrated on the labels kept out."""
        model = Model(_text_ratios(text), _meta_ratios(meta), prior, flat, flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, 2, BINS), np.int64)
            for batch in batches:
                y = batch.column("check").to_numpy()
                for view, s in enumerate(scores(_stored(batch), model)):
                    at = np.clip(((s + RANGE) / (2 * RANGE) * BINS).astype(np.int64), 0, BINS - 1)
                    for c in (0, 1):
                        found[view, c] += np.bincount(at[y == c], minlength=BINS)
            v, c, k = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(found[v, c, k])], ["view", "c", "k", "n"])

        found = np.zeros((2, 2, BINS))
        for r in check.mapInArrow(run, "view int, c int, k int, n long").groupBy("view", "c", "k").agg(F.sum("n").alias("n")).collect():  # bins x classes
            found[r.view, r.c, r.k] = r.n
        return model._replace(text_line=_line(found[0, 1], found[0, 0]), meta_line=_line(found[1, 1], found[1, 0]))

    model = built(text, meta)
    for _ in range(rounds):
        model = built(*counted(model))
    return model


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """Co-train on all of docs with labels (doc_id, quality 0/1)."""
    return train(with_labels(spark, docs, labels), rounds)


def _text_ratios(counts: np.ndarray) -> np.ndarray:
    """Shapes are one distribution, each figure one of its own."""
    out = np.zeros(TEXT)
    for lo, hi, smooth in [(0, SHAPES, 0.5), *((SHAPES + k * STEPS, SHAPES + (k + 1) * STEPS, 1.0) for k in range(FIGURES))]:
        out[lo:hi] = _ratios(counts[:, lo:hi], smooth)
    return out


def _meta_ratios(counts: np.ndarray) -> np.ndarray:
    """Each field is a distribution of its own."""
    return np.concatenate([_ratios(counts[:, k * CATEGORIES : (k + 1) * CATEGORIES], 1.0) for k in range(FIELDS)])


SCORE = "struct<score: double, text_score: double, meta_score: double>"


def _scored(f: Features, model: Model) -> list[pa.Array]:
    return [pa.array(combined(f, model)), *map(pa.array, scores(f, model))]


def scored(spark: SparkSession, docs: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """docs with one more column (replacing one of that name): the combined probability of good quality and both views' logits.

    Every row is scored on its own; null texts, languages and sources are values like any other.
    """
    shared = spark.sparkContext.broadcast(model)  # its size is fixed
    kind = pa.struct([("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64())])

    @F.arrow_udf(SCORE)
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, length: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(_scored(features(*(x.slice(at, 512) for x in (text, lang, source, length))), shared.value), ["score", "text_score", "meta_score"]) for at in range(0, len(text), 512)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return docs.withColumn(name, score(*_read(docs)))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept (score >= threshold) for every row of docs; texts are read once.

    Null and empty texts, languages and sources are values like any other; repeated rows stay repeated; a null doc_id stays
    null and is never labelled; an empty table gives none; other columns are ignored. Without labels of both classes every
    score is 0.5 and every row kept.
    """
    table = with_labels(spark, docs, labels)
    shared = spark.sparkContext.broadcast(train(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_scored(_stored(batch), shared.value)], ["doc_id", "score", "text_score", "meta_score"])

    return table.select("doc_id", "text", "weights", "meta").mapInArrow(run, "doc_id long, score double, text_score double, meta_score double").withColumn("kept", F.col("score") >= threshold)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay, whatever their names.

    Nulls, repeated rows and empty tables as in classify(). Texts are read a second time here, so that they need not be
    written beside their features.
    """
    name = free(docs, "quality")
    return scored(spark, docs, fit(spark, docs, labels), name).filter(F.col(name)["score"] >= threshold).drop(name)
