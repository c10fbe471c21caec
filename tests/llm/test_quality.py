"""Held-out accuracy, a plain count model, what the views teach each other, and edge cases."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridindex.llm import quality, wordbytes


def corpus(n=900):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda m: " ".join(word() for _ in range(m)).capitalize() + "."
    rows, truth = [], {}
    for k in range(n):
        good = k % 4 != 0
        m = rng.randint(20, 200)
        if good:
            text = " ".join(prose(rng.randint(5, 15)) for _ in range(m // 10))
        else:
            text = rng.choice([" ".join(f"{word()}***" for _ in range(m)), " ".join(f"{word().upper()}!!" for _ in range(m)), " | ".join(word() for _ in range(m)), " ".join([word()] * m)])
        rows.append((k, text, "en", f"s{k % 7}", len(text)))
        truth[k] = good
    return rows, truth


def test_held_out(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(truth[k])) for k in truth if k % 5 == 0 or k % 7 == 0], "doc_id long, quality int")
    out = quality.classify(spark, df, labels).collect()
    held = [r for r in out if r.doc_id % 5 and r.doc_id % 7]
    assert sum(r.kept == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)


def test_edges(spark):
    rows, truth = corpus(120)
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (None, rows[1][1], "en", "s1", 5), (1, rows[1][1], "en", "s1", 5)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, y string, score double")
    labels = spark.createDataFrame([(k, int(v)) for k, v in truth.items()] + [(None, 1), (5, None), (1, 1), (77777, 1)], "doc_id long, quality int")
    kept = quality.keep_good(spark, df, labels)
    assert kept.columns == df.columns and kept.filter("doc_id IS NULL").count() == 1 and kept.filter("doc_id = 1").count() == 2
    assert quality.classify(spark, df, labels.limit(0)).filter("kept").count() == len(rows)
    assert quality.classify(spark, df.limit(0), labels).count() == 0


def plain_features(text, lang, source, length):
    """The text features with weights, and the metadata features, of one row, word by word."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    counts, lower = {}, [w.lower() for w in words]
    for k, w in enumerate(words):
        kinds = ["0" if 48 <= b < 58 else "A" if 65 <= b < 91 else "a" if 97 <= b < 123 or b > 127 else chr(b) for b in w]
        shape = "".join(x for x, before in zip(kinds, [None, *kinds]) if x != before).lower()
        cell = wordbytes.hash_word(shape) % (quality.SHAPES // 2) * 2 + (k > 0 and lower[k] == lower[k - 1])
        counts[cell] = counts.get(cell, 0) + 1
    n, size = len(words), len(data)
    out = {c: m * min(n, quality.EFFECTIVE_WORDS) / n for c, m in counts.items()}
    share = lambda f: (sum(map(f, data)) + 1) / (size + 60)
    sign = lambda b: 32 < b < 127 and not chr(b).isalnum()
    repeats = sum(a == b for a, b in zip(lower, lower[1:]))
    figures = [
        math.log1p(size) / 16, math.log1p(n) / 14, share(lambda b: 65 <= b <= 90), 2 * share(sign), 2 * share(lambda b: 48 <= b < 58), 20 * share(lambda b: b == 10),
        repeats / (max(n, 1) + 5), math.log1p(len(set(lower))) / math.log1p(max(n, 1)) - 0.01, min(sum(map(len, words)) / max(n, 1) / 16, 1),
    ]
    if n:
        out |= {quality.SHAPES + k * quality.STEPS + min(max(int(x * quality.STEPS), 0), quality.STEPS - 1): 1.0 for k, x in enumerate(figures)}
    fields = [lang, source, None if length is None else int(2 * math.log2(1 + length))]
    return out, [k * quality.CATEGORIES + wordbytes.hash_word(f"{k}\x00{v}") % quality.CATEGORIES for k, v in enumerate(fields)]


def plain_cotraining(rows, given, held, rounds):
    """doc_id -> score, by dictionaries of counts."""
    every = {r[0]: plain_features(*r[1:]) for r in rows}
    train, check = {d: y for d, y in given.items() if d not in held}, {d: y for d, y in given.items() if d in held}
    groups = [range(quality.SHAPES), *(range(quality.SHAPES + k * 16, quality.SHAPES + k * 16 + 16) for k in range(quality.FIGURES))]
    fields = [range(k * quality.CATEGORIES, (k + 1) * quality.CATEGORIES) for k in range(quality.FIELDS)]
    prior = math.log(sum(train.values()) / sum(1 - y for y in train.values()))

    def ratios(labels, view, parts, smooth):
        sums = ({}, {})
        for d, y in labels.items():
            for c, w in every[d][0].items() if view == 0 else ((c, 1.0) for c in every[d][1]):
                sums[y][c] = sums[y].get(c, 0.0) + w
        out = {}
        for part, s in zip(parts, smooth):
            total = [sum(sums[y].get(c, 0.0) + s for c in part) for y in (0, 1)]
            out |= {c: math.log((sums[1].get(c, 0.0) + s) / total[1] / ((sums[0].get(c, 0.0) + s) / total[0])) for c in part}
        return out

    def both(text, meta):
        return {d: (prior + sum(w * text[c] for c, w in t.items()), prior + sum(meta[c] for c in m)) for d, (t, m) in every.items()}

    def line(score, view):
        bins = np.zeros((2, quality.BINS))
        for d, y in check.items():
            bins[y, min(max(int((score[d][view] + quality.RANGE) / (2 * quality.RANGE) * quality.BINS), 0), quality.BINS - 1)] += 1
        return quality._line(bins[1], bins[0])

    by = (train, train)
    for k in range(rounds + 1):
        raw = both(ratios(by[0], 0, groups, [0.5] + [1.0] * quality.FIGURES), ratios(by[1], 1, fields, [1.0] * quality.FIELDS))
        lines = [line(raw, view) for view in (0, 1)]
        score = {d: [a * x + b for x, (a, b) in zip(s, lines)] for d, s in raw.items()}
        if k < rounds:
            sure = lambda view: {d: int(s[view] > 0) for d, s in score.items() if abs(s[view]) > quality.CONFIDENT and d not in check} | train  # noqa: E731, B023
            by = sure(1), sure(0)
    return {d: 1 / (1 + math.exp(-max(min(sum(s) - prior, 50), -50))) for d, s in score.items()}


def test_plain_version(spark):
    rows, truth = corpus(300)
    rng = random.Random(5)
    rows = [(k, t if k % 9 else t + "\n\nÉté 😀 " + t.upper(), rng.choice(["en", "fr", None]), s, n if k % 11 else None) for k, t, _, s, n in rows] + [(900, "", "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = {k: int(truth[k]) for k in truth if k % 2 == 0}
    held = {r.id for r in spark.range(1000).filter(F.pmod(F.xxhash64("id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    want = plain_cotraining(rows, given, held, quality.ROUNDS)
    out = {r.doc_id: r for r in quality.classify(spark, df.repartition(3), spark.createDataFrame(list(given.items()), "doc_id long, quality int")).collect()}
    assert max(abs(out[d].score - want[d]) for d in want) < 1e-3 and all(out[d].kept == (want[d] >= 0.5) for d in want)
    again = {r.doc_id: r.quality.score for r in quality.scored(spark, df, quality.fit(spark, df, spark.createDataFrame(list(given.items()), "doc_id long, quality int"))).collect()}
    assert all(abs(again[d] - out[d].score) < 1e-3 for d in again)


def test_views_teach_each_other(spark):
    """Sources are all good or all bad; the labelled bad texts are of one style, the rest of the bad sources' of another."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for k in range(1200):
        good, style = k % 2, k // 2 % 2
        body = [word() for _ in range(40)]
        text = ". ".join(" ".join(body[i : i + 8]).capitalize() for i in range(0, 40, 8)) if good else " ".join(w + "***" for w in body) if style else " | ".join(w + "%" for w in body)
        rows.append((k, text, "en", f"site{k % 20}", len(text)))
        if good or style:
            labels += [(k, good)] if k % 3 == 0 else []
    df, given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")
    table = quality.with_labels(spark, df, given).cache()
    unseen = [k for k in range(1200) if k % 2 == 0 and k // 2 % 2 == 0]

    def text_scores(rounds):
        model = quality.train(table, rounds)
        return np.mean([r.quality.text_score for r in quality.scored(spark, df.filter(F.col("doc_id").isin(unseen)), model).collect()])

    assert text_scores(2) < text_scores(0) - 5  # the metadata view has labelled the second style for the text view
    assert all(not r.kept for r in quality.classify(spark, df, given).collect() if r.doc_id in unseen)


def test_long_text_and_clashing_names(spark):
    text = " ".join(f"word{k % 977} and" for k in range(400_000))
    df = spark.createDataFrame([(1, text, "a", 1.0), (2, "short", "b", 2.0)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = quality.keep_good(spark, df, labels)
    assert kept.columns == df.columns and {r.quality for r in kept.collect()} <= {"a", "b"}
    assert quality.classify(spark, df, labels).count() == 2
