"""Held-out accuracy, the gradient, and edge cases."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from gridindex.llm import toxicity, wordbytes


def test_regression_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)) * (rng.random((3000, 6)) < 0.5)
    true = np.array([3.0, -2.0, 1.0, 0.0, 4.0, 2.0])
    latent = x @ true + rng.logistic(size=3000)
    grade = (latent[:, None] > np.array([2.0, 3.5, 5.0])).sum(1)
    text, feature = np.nonzero(x)
    w, theta = toxicity.regress(text, feature, x[text, feature], grade, 6, steps=1500)
    assert np.abs(w - true).max() < 0.6 and np.abs(theta - [2.0, 3.5, 5.0]).max() < 0.4


def test_held_out_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    vocabulary, bad = [word() for _ in range(3000)], ["gribble", "snorf", "vlurk", "zundrel"]
    rows, truth, hits = [], {}, {}
    for k in range(900):
        n, toxic = rng.randint(20, 150), k % 5 == 0
        body = [rng.choice(vocabulary) for _ in range(n)]
        count = rng.randint(2, 6) if toxic else 0
        for _ in range(count):
            body[rng.randrange(n)] = rng.choice(bad).capitalize() + rng.choice(["", ",", "."])
        rows.append((k, " ".join(body), "x"))
        truth[k], hits[k] = toxic, count / n
    rows += [(2000, None, "x"), (2001, "", "x"), (None, "gribble " * 30, "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in truth.items() if k % 3 == 0] + [(None, 1), (1, None)], "doc_id long, toxic int")
    out = toxicity.classify(spark, df, labels).collect()
    held = [r for r in out if r.doc_id is not None and r.doc_id % 3 and r.doc_id < 900]
    assert sum(r.toxic == truth[r.doc_id] for r in held) / len(held) > 0.97
    toxic = [r for r in held if r.toxic]
    assert np.corrcoef([r.severity for r in toxic], [hits[r.doc_id] for r in toxic])[0, 1] > 0.5
    less = toxicity.fit(df, labels, max_rows=150)
    assert len(less.features) and less.thresholds[0] < less.thresholds[1] < less.thresholds[2]
    assert len(out) == len(rows) and all(0 <= r.severity <= 3 for r in out)
    assert not any(r.toxic for r in out if r.doc_id in (2000, 2001)) and [r.toxic for r in out if r.doc_id is None] == [True]
    assert toxicity.classify(spark, df, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.classify(spark, df.limit(0), labels).count() == 0


def plain_cells(text):
    """The feature cells of a text, word by word, and its number of words."""

    def hashed(part):
        return int(wordbytes.mix(np.array([sum((b + 1) * pow(wordbytes._STEP, k, 1 << 64) for k, b in enumerate(part)) % (1 << 64)], np.uint64))[0])

    out, words = [], re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    for w in words:
        out.append(hashed(w) % toxicity.SPACE)
        for n in toxicity.PREFIXES:
            if len(w) > n:
                out.append(int(wordbytes.mix(np.array([(hashed(w[:n]) + n) % (1 << 64)], np.uint64))[0]) % toxicity.SPACE)
    return out, len(words)


def plain_marking(counts, toxic, clean):
    """The cells of counts (cell -> clean, toxic) that mark toxic texts, one by one."""
    p, whole = {}, toxic / (toxic + clean)
    for cell, (c, t) in counts.items():
        n = c + t
        bound = math.exp(-((t * math.log(t / n / whole) if t else 0) + (c * math.log(c / n / (1 - whole)) if c else 0)))
        p[cell] = bound if t / toxic >= toxicity.LIFT * (c + 0.5) / clean else 1.0
    return {cell for cell, x in p.items() if x <= toxicity.LEVEL}


def test_features_at_any_size():
    """The same shares in a small and a large table; chance alone gives few features in either."""
    for n in (1, 20, 400):
        toxic, clean = np.array([10.0 * n, 4 * n, 1 * n]), np.array([0.0, 0.0, 8 * n])
        assert toxicity.marking(toxic, clean, 50 * n, 400 * n).tolist() == [True, True, False]
    rng = np.random.default_rng(3)
    seen = rng.integers(1, 60, 20_000)  # features that fall on toxic texts by chance alone
    t = rng.binomial(seen, 0.1).astype(float)
    assert toxicity.marking(t, seen - t, 100, 900).mean() <= toxicity.LEVEL


def test_one_id_on_many_rows(spark):
    """30,000 copies of one labelled text count once, and a bound in rows is kept."""
    rows = [(1, "gribble words of one text")] * 3000 + [(2, f"plain text number {k}") for k in range(3000)] + [(k, f"some other words {k % 7} here") for k in range(3, 200)] + [(k, f"gribble again {k}") for k in range(200, 240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k == 1 or k >= 200)) for k in range(1, 240)], "doc_id long, toxic int")
    brought = []
    real = toxicity.regress

    def regress(text, feature, value, grade, n_features):
        brought.append(len(grade))
        return real(text, feature, value, grade, n_features, steps=20)

    toxicity.regress = regress
    try:
        toxicity.fit(df, labels)
        toxicity.fit(df, labels, max_rows=60)
    finally:
        toxicity.regress = real
    assert brought[0] == 2 * (1 + 3000 + 197 + 40)
    assert all(n <= 2 * 60 for n in brought[1:])


def test_plain_version(spark):
    """Features and scores against dictionaries; a text of 300,000 words is one text."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("aeinorstéß") for _ in range(rng.randint(1, 11))) for _ in range(300)] + ["Grümblefax", "snorfl", "X9"]
    texts = [" ".join(rng.choice(vocabulary[:300] if k % 4 else vocabulary) for _ in range(rng.randint(0, 80))) for k in range(200)]
    texts = [t + " grümblefax, snorfl" if k % 4 == 0 else t for k, t in enumerate(texts)] + ["word snorfl " * 150_000]
    y = [int(k % 4 == 0) for k in range(len(texts))]
    # the last toxic text stands twice, at half the weight
    rows = [(t, label, 1.0) for t, label in zip(texts, y)]
    last = max(k for k, label in enumerate(y) if label)
    rows[last : last + 1] = [(texts[last], 1, 0.5)] * 2
    found = toxicity.select(spark.createDataFrame(rows, "text string, y int, weight double").repartition(3))
    counts = {}
    for t, label in zip(texts, y):
        for c in set(plain_cells(t)[0]):
            counts.setdefault(c, [0, 0])[label] += 1
    assert set(found.tolist()) == plain_marking(counts, sum(y), len(y) - sum(y)) and len(found)
    model = toxicity.Model(found, np.linspace(-1, 2, len(found)), np.array([0.5, 1.0, 3.0]))
    weight = dict(zip(found.tolist(), model.weights))
    got = toxicity.probabilities(pa.array([*texts, None, ""]), model)
    for row, t in zip(got, [*texts, None, ""]):
        cells, n = plain_cells(t)
        score = sum(weight[c] * math.log1p(100 * cells.count(c) / max(n, 25)) for c in set(cells) if c in weight)
        assert np.allclose(row, [1 / (1 + math.exp(th - score)) for th in model.thresholds], atol=1e-6)


def test_halves():
    """Every other word, whatever chunk a text is in."""
    texts = ["a b c d e", "", "f", "g h"]
    features = np.array(sorted(plain_cells(w)[0][0] for w in "abcdefgh"))
    name = {plain_cells(w)[0][0]: w for w in "abcdefgh"}
    (lo, sizes, doc, feature, n) = next(toxicity._rows(pa.array(texts), features, halves=True))
    assert lo == 0 and sizes.tolist() == [3, 2, 0, 0, 1, 0, 1, 1] and set(n.tolist()) == {1}
    assert sorted((int(d), name[int(features[f])]) for d, f in zip(doc, feature)) == [(0, "a"), (0, "c"), (0, "e"), (1, "b"), (1, "d"), (4, "f"), (6, "g"), (7, "h")]
