"""Classes against brute force over all pairs."""

import random

import numpy as np
import pytest

from gridindex.llm import components, minhash


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets.items())


@pytest.mark.parametrize("large", [64, 1])
def test_classes(spark, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "BLOCK", 1024 if large > 1 else 2)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(k, t) for k, t in enumerate([None, "", "one", "One", "one two", "one two three", "ONE two three", " \t\n"])]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 9, 20, 60, 200]))]
        rows += [(len(rows), " ".join(base))]
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(base) // 30)])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    for size in (4, 5):
        assert sorted(map(tuple, minhash.near_duplicates(spark, df, size).collect())) == brute(rows, size)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    out = sorted(map(tuple, minhash.near_duplicates(spark, df).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(spark, df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 200)]
    out = dict(map(tuple, components.connected(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


def test_linked_members_are_not_copied(spark, monkeypatch):
    """Of one bucket, 4,000 members in one component, 30 in another and 20 alone: every pair of different components meets, once, and few rows are copied."""
    monkeypatch.setattr(minhash, "BLOCK", 40)
    comp = {k: 0 if k < 4000 else 4000 if k < 4030 else k for k in range(4050)}
    members = spark.createDataFrame([(7, 1, k, c) for k, c in comp.items()], "key long, band int, node long, comp long")
    rows = minhash._dealt(members).collect()
    assert len(rows) <= 4000 * 2 + 50 * (2 + 100)
    blocks, met = {}, {}
    for r in rows:
        blocks.setdefault(r.block, []).append(r)
    for block in blocks.values():
        few = [r for r in block if r.comp]
        for x in few:
            for y in block:
                if x.node != y.node and x.comp != y.comp and (x.self or x.own != y.own) and (x.node < y.node or not y.comp):
                    met[x.node, y.node] = met.get((x.node, y.node), 0) + 1
    want = {(x, y) for x in range(4000, 4050) for y in range(4050) if comp[x] != comp[y] and (y < 4000 or x < y)}
    assert met == dict.fromkeys(want, 1)


def test_ids_that_repeat_with_other_texts(spark):
    """Texts under one id are documents of their own: linked or not, each by its own words."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, a), (5, a + " x"), (5, b), (5, b), (7, b + " y"), (9, c), (9, c + " z"), (9, None), (None, c), (3, "u v w")]
    df = spark.createDataFrame([(i, t, "k", {"m": 1}) for i, t in rows], "doc_id long, text string, near_key string, __near_rank map<string,int>")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, df).collect()), key=str)
    assert out == sorted([(1, 36, 1, True), (5, 37, 1, False), (5, 36, 5, True), (5, 36, 5, True), (7, 37, 5, False), (9, 36, 9, True), (9, 37, 9, True), (9, 0, 9, True), (None, 36, None, True), (3, 1, 3, True)], key=str)
    left = minhash.deduplicated(spark, df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (5, b), (9, c), (9, c + " z"), (9, None), (None, c), (3, "u v w")], key=str)


def test_long_text(spark):
    text = " ".join(f"word{k % 60_000}" for k in range(300_000))
    out = minhash.near_duplicates(spark, spark.createDataFrame([(1, text), (2, text + " more"), (3, "other")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 3)}


def test_loss_at_the_threshold():
    """Pairs at and just above the threshold, of many sizes: the estimate lets all of them through, and some band agrees."""
    rng = np.random.default_rng(8)
    banded = lambda h: minhash.registers(h).view(np.int64)
    for n in (5, 10, 40, 150, 600, 3000, 20_000):
        for _ in range(120 if n < 3000 else 12):
            shared = int(np.ceil(0.8 * n))
            pool = np.unique(rng.integers(0, 1 << 63, n + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:n]
            rng.shuffle(pool)
            cut = shared + (n - shared) // 2
            a, b = np.sort(pool[:cut]), np.sort(np.concatenate([pool[:shared], pool[cut:]]))
            assert 100 * shared >= 80 * n
            assert minhash.plausible(minhash.sketch(a), minhash.sketch(b), np.array(len(a)), np.array(len(b)), 80)
            x, y = banded(a), banded(b)
            assert ((x == y) & (x != -1)).any()


def test_blocks_bounded_by_set_members(spark, monkeypatch):
    """A bucket of few rows with very large sets is cut by the sets' members, every pair still meets, and links are the same."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 10_000)
    sizes = {k: 4000 if k % 3 else 10 for k in range(60)}
    members = spark.createDataFrame([(7, 1, k, k, n) for k, n in sizes.items()], "key long, band int, node long, comp long, n_shingles long")
    blocks, met = {}, set()
    for r in minhash._dealt(members).collect():
        blocks.setdefault(r.block, []).append(r)
    for block in blocks.values():
        assert sum(sizes[r.node] for r in block) < 8 * 10_000  # two chunks of a mean of 10,000, dealt by hash
        met |= {(x.node, y.node) for x in block for y in block if x.node < y.node and (x.self or x.own != y.own)}
    assert met == {(x, y) for x in sizes for y in sizes if x < y}
    rng = np.random.default_rng(4)
    base = rng.integers(0, 5000, 400).tolist()
    docs = [(d, " ".join(str(w + (k == d) * 9000) for k, w in enumerate(base))) for d in range(100)]
    df = spark.createDataFrame([*docs, (500, "a b c d e f"), (501, None)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "LARGE", 2)
    monkeypatch.setattr(minhash, "BLOCK", 7)  # partners of a first node are many shares
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark, df).collect()}
    assert out == {d: (0, d == 0) for d in range(100)} | {500: (500, True), 501: (501, True)}


def test_shared_counts_in_pieces():
    rng = np.random.default_rng(6)
    of = np.unique(rng.integers(0, 3_000_000, 700_000)).astype(np.uint64)
    others = [np.unique(rng.integers(0, 3_000_000, n)).astype(np.uint64) for n in (1, 5, 900_000, 1_200_000, 3, 800_000, 2)]
    assert minhash._shared(of, others).tolist() == [len(np.intersect1d(of, x)) for x in others]
