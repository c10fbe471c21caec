"""Planted passages, changed passages and clean documents; the subsequence against brute force."""

import random

import numpy as np
import pytest

from gridindex.llm import decontaminate


def words(rng, n):
    return ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(decontaminate._masks(a), len(a), b) == table[-1][-1]


def test_planted(spark):
    rng = random.Random(2)
    vocabulary = words(rng, 4000)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(40)]
    docs, want = [], set()
    for d in range(600):
        body = text(rng.randint(1, 400))
        if d % 10 == 0:
            k = rng.randrange(40)
            piece = list(items[k])
            if d % 20 == 0:  # a changed copy: a fifth of the words replaced, some dropped
                piece = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in piece if rng.random() > 0.08]
            at = rng.randint(0, len(body))
            body[at:at] = piece
            want.add((d, k))
        docs.append((d, " ".join(body), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, " ".join(items[0]), "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    out = decontaminate.contaminated(spark, df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in out if r.doc_id is not None}
    assert found == want and sum(r.doc_id == 0 for r in out) == 2 and any(r.doc_id is None for r in out)
    left = decontaminate.without_leaks(spark, df, bench)
    assert left.columns == df.columns and left.count() == len(docs) - len(want) - 2


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark, df, none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.contaminated(spark, df.limit(0), some).count() == 0


def test_long_items(spark):
    """Copies and changed copies of items of 200 to 1,000 words."""
    rng = random.Random(3)
    vocabulary = words(rng, 6000)
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (200, 300, 500, 1000)]
    docs = []
    for k, item in enumerate(items):
        changed = [rng.choice(vocabulary) if rng.random() < 0.3 else w for w in item]
        for piece in (item, changed):
            docs.append((len(docs), " ".join([*(rng.choice(vocabulary) for _ in range(150)), *piece, *(rng.choice(vocabulary) for _ in range(90))]), k))
    docs += [(100 + d, " ".join(rng.choice(vocabulary) for _ in range(1500)), None) for d in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, k int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    out = decontaminate.contaminated(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(d, k) for d, _, k in docs if k is not None}


def test_widespread_item(spark):
    """A third of the rows of a table of short texts hold one item."""
    rng = random.Random(4)
    vocabulary = words(rng, 3000)
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(5)]
    body = lambda d: [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + (items[0] if d % 3 == 0 else [])
    df = spark.createDataFrame([(d, " ".join(body(d))) for d in range(900)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    out = decontaminate.contaminated(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(d, 0) for d in range(0, 900, 3)}


def test_many_items_in_little_memory(spark):
    """Items x words is never held: 8,000 items of 20,000 words would be 640 MB an array of 32-bit numbers."""
    import tracemalloc

    rng = random.Random(5)
    vocabulary = sorted({"".join(rng.choice("aeioulnrst") for _ in range(7)) for _ in range(20000)})
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(8000)]
    df = spark.createDataFrame([(k, " ".join(items[k])) for k in range(0, 8000, 400)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    tracemalloc.start()
    try:
        model = next(decontaminate.models(spark, df, bench))
        assert tracemalloc.get_traced_memory()[1] < 300e6
        import pyarrow as pa

        tracemalloc.reset_peak()
        found = decontaminate.search(pa.array([" ".join(sum(items[:3000], []))]), model)
        assert {k for k, *_ in found[0]} >= set(range(3000)) and tracemalloc.get_traced_memory()[1] < 500e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n_items", [40, 400, 2500])
def test_recall(spark, n_items):
    """Paraphrases (words replaced, left out, or swapped with their neighbours) at three sizes of the benchmark; no clean document is touched."""
    rng = random.Random(n_items)
    vocabulary = words(rng, 5000)
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(n_items)]

    def changed(item, how):
        if how == 0:
            return [rng.choice(vocabulary) if rng.random() < 0.2 else w for w in item]
        if how == 1:
            return [w for w in item if rng.random() > 0.2]
        out = list(item)
        for k in range(0, len(out) - 1, 6):
            out[k], out[k + 1] = out[k + 1], out[k]
        return out

    docs, want = [], set()
    for d in range(600):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        if d % 2:
            k = rng.randrange(n_items)
            piece = changed(items[k], d // 2 % 3)
            at = rng.randint(0, len(body))
            body[at:at] = piece
            table = decontaminate.lcs(decontaminate._masks(items[k]), len(items[k]), piece)
            if table >= decontaminate.LCS * len(items[k]):  # the decision itself, by brute force
                want.add((d, k))
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, df, bench).collect()}
    assert len(found & want) >= 0.97 * len(want) and not {d for d, _ in found if d % 2 == 0}


def test_parts_types_and_long_texts(spark, monkeypatch):
    """A benchmark in several parts, ids that are texts, a text of 200,000 words, columns named like the operator's own."""
    rng = random.Random(6)
    vocabulary = words(rng, 3000)
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(60)]
    long = [rng.choice(vocabulary) for _ in range(200_000)]
    long[150_000:150_000] = items[7]
    docs = [(1, " ".join(long), "a", 0), (2, " ".join(items[3]), "b", 1), (3, " ".join(rng.choice(vocabulary) for _ in range(200)), "c", 2), (None, None, "d", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leak string, item_id int")
    bench = spark.createDataFrame([(f"item-{k}", " ".join(w)) for k, w in enumerate(items)] + [(None, "x")], "item_id string, text string")
    whole = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, df, bench).collect())
    assert whole == [(1, "item-7"), (2, "item-3")]
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 25)
    assert len(decontaminate.parts(bench)) == 3
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, df, bench).collect()) == whole
    shared = list(decontaminate.models(spark, df, bench))
    assert len(shared) == 3 and all(len(m.items.vocabulary) == len(m.idf) == len(m.basis) for m in shared)
    left = decontaminate.without_leaks(spark, df, bench)
    assert left.columns == df.columns and sorted(r.leak for r in left.collect()) == ["c", "d"]


def test_a_large_vocabulary_in_little_memory(spark):
    """300,000 words: the driver holds words x columns in 32 bits, a few times. Parts of them share one fit."""
    import tracemalloc

    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k * 300, k * 300 + 400))) for k in range(1000)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k * 60, k * 60 + 60))) for k in range(5000)], "item_id long, text string")
    words = np.sort(decontaminate.vocabulary(bench).toArrow().column(0).to_numpy().view(np.uint64))
    assert len(words) == 300_000
    tracemalloc.start()
    try:
        space = decontaminate.fit_space(spark, df, words)
        assert tracemalloc.get_traced_memory()[1] < 500e6 and space.basis.dtype == np.float32
    finally:
        tracemalloc.stop()


def test_words_beyond_one_fit(spark, monkeypatch):
    """A benchmark of more words than a fit may hold is halved until it fits; the same leaks are found."""
    rng = random.Random(9)
    vocabulary = words(rng, 2000)
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(40)]
    df = spark.createDataFrame([(d, " ".join([rng.choice(vocabulary) for _ in range(80)] + (items[d] if d < 40 else []))) for d in range(80)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 400)
    assert len(list(decontaminate.models(spark, df, bench))) > 1
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, df, bench).collect()} == {(k, k) for k in range(40)}


def test_rows_are_added_by_group():
    rng = np.random.default_rng(3)
    group = np.sort(np.concatenate([rng.integers(0, 50, 400), np.full(200, 7), np.full(64, 60), np.full(65, 61)]))
    source, at = rng.standard_normal((30, 5)).astype(np.float32), rng.integers(0, 30, len(group))
    out, want = np.ones((70, 5), np.float32), np.ones((70, 5))
    np.add.at(want, group, source[at])
    decontaminate._add_rows(out, group, source, at)
    assert np.allclose(out, want, atol=1e-4)
    decontaminate._add_rows(out, group[:0], source, at[:0])
    assert np.allclose(out, want, atol=1e-4)


def test_texts_are_read_once(spark):
    """The search takes the words that the fit has kept; texts are not cut into words again. Repeated and missing ids stay."""
    rng = random.Random(4)
    vocabulary = words(rng, 500)
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(10)]
    seen = spark.sparkContext.accumulator(0)
    docs = [(1, " ".join(items[2])), (1, " ".join(items[2])), (None, " ".join(items[5])), (3, None), (4, "")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 2).map(lambda r: (seen.add(1), r)[1]), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(spark, df, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.lcs, r.first_word, r.last_word) for r in rows) == [(0, 5, 1.0, 0, 30), (1, 2, 1.0, 0, 30), (1, 2, 1.0, 0, 30)]
    assert seen.value == 5
