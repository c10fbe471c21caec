"""Phrase places against a plain search; matching statistics against brute force."""

import random
import re

import pyarrow as pa

from gridindex.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(k, i) for k, p in enumerate(licenses.PHRASES) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels = list(licenses.PHRASES.values())
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({labels[k] for k, _ in places}))


def test_base_places():
    rng = random.Random(5)
    vocabulary = ["GNU", "general", "public", "license", "apache", "CC", "by", "mit", "under", "the", "é", "x", "."]
    texts = ["", "cc by-nc", "mit license mit license", None] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    rows = licenses.Scanner().batch(pa.array(texts, pa.string()))
    assert [r[:5] for r in rows] == [brute(t or "") for t in texts]


def test_matching_statistics():
    rng = random.Random(6)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = licenses.SuffixAutomaton(sequences)
    inside = lambda s: any(s == q[i : i + len(s)] for q in sequences for i in range(len(q)))
    for _ in range(50):
        text = [rng.randint(0, 4) for _ in range(40)]
        state = length = 0
        for i, token in enumerate(text):
            state, length = automaton.walk(state, length, token)
            best = max((n for n in range(1, i + 2) if inside(text[i + 1 - n : i + 1])), default=0)
            assert length == best
            if length:
                want = {(k, i2) for k, q in enumerate(sequences) for i2 in range(len(q)) if q[max(0, i2 + 1 - length) : i2 + 1] == text[i + 1 - length : i + 1]}
                assert set(automaton.ends[state]) == want


def test_templates_and_edges(spark):
    changed = "Permission is hereby granted free of charge to any person obtaining a copy of this software and the associated documentation files to deal in the software without any restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"
    rows = [(1, changed, 7.0), (2, "plain words of the work under the sea", 0.0), (3, None, 0.0), (4, "", 0.0), (None, "MIT License " * 5000, 1.0)]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()}
    assert out[1].labels == "mit" and out[1].n_base == 0 and out[1].score > 0.6
    assert out[2].labels == "" and out[2].score == 0 and out[3].n_words == 0 and out[4].first_word is None
    assert out[None].n_base == 5000 and out[None].last_word == 9998
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labels_of(*texts):
    return [r[5] for r in licenses.Scanner().batch(pa.array(texts, pa.string()))]


def test_relatives_are_told_apart():
    """Every template gives its own label alone, beside those of name phrases in it, alone and inside other text."""
    scanner = licenses.Scanner()
    filler = " ".join(f"filler{k}" for k in range(20))
    for label, text in licenses.TEMPLATES:
        for whole in (text, f"{filler} {text.upper()} {filler}"):
            row = scanner.batch(pa.array([whole]))[0]
            assert set(row[5].split(",")) == {label, *filter(None, row[4].split(","))} and row[6] == 1.0, (label, row)
    assert labels_of("Licensed under CC BY-SA 4.0.", "licensed under cc by-nd 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.") == ["cc-by,cc-by-sa", "cc-by,cc-by-nd", "cc-by-nc-nd"]
    notice = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    assert labels_of(notice, notice.replace("Lesser", "Affero"), notice.replace("Lesser ", "")) == ["lgpl", "agpl", "gpl"]


def test_scores_fall_with_changes():
    rng = random.Random(9)
    scanner = licenses.Scanner()
    words = dict(licenses.TEMPLATES)["isc"].split()
    score = lambda w: scanner.batch(pa.array([" ".join(w)]))[0][6]
    assert score(words) == 1.0
    added = words[:10] + ["quite", "another", "word"] + words[10:]
    n = len(licenses._tokens(" ".join(words)))
    assert score(added) == n / (n + 3)
    assert score(words[: len(words) // 2]) == 0 and labels_of(" ".join(rng.sample(words, len(words)))) == [""]
    two = " ".join(words) + " and then " + " ".join(words)
    row = scanner.batch(pa.array([two]))[0]
    assert row[7].count("isc:") == 2


def test_long_text(spark):
    text = ("plain words of the work " * 50_000) + dict(licenses.TEMPLATES)["mpl"] + (" the of and" * 100_000)
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert row.labels == "mpl" and row.score == 1.0
