"""Fingerprints, edited texts and block tables against brute force."""

import hashlib
import random

import pyarrow as pa

from gridindex.llm import simhash


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited(spark):
    rng = random.Random(2)
    for rows in (
        [(k * 3 % 101, " ".join(rng.choice("ab cdé fg h".split()) for _ in range(rng.randint(0, 30)))) for k in range(101)],
        [(1, "x")], [], [(5, None), (5, None), (7, ""), (None, "n")], [(2, "a b"), (2, "a c"), (1, "d")],
    ):
        out = simhash.edited(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=str) == brute(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_fingerprints_follow_likeness():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a = [word() for _ in range(300)]
    near, far = a[:290] + [word() for _ in range(10)], [word() for _ in range(300)]
    x = simhash.fingerprints(pa.array([" ".join(a), " ".join(near), " ".join(far), " ".join(a).upper(), ""]))
    assert simhash.likeness(x[0], x[1]) > 0.85 and simhash.likeness(x[0], x[2]) < 0.75 and x[0] == x[3] and x[4] == 0


def hard_values(rng):
    values = [rng.getrandbits(64) for _ in range(60)]
    return values + [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for v in values for _ in range(3)] + [0, 2**64 - 1]


def test_block_tables_find_every_pair(spark):
    rows = [(f"{v:016x}",) for v in hard_values(random.Random(4))]
    df = spark.createDataFrame([*rows, rows[0], (None,)], "fingerprint string")
    found = {(r.fingerprint, r.near): r.distance for r in simhash.neighbours(df, df.filter("fingerprint < '8'")).collect()}
    keys = sorted({r for (r,) in rows})
    assert found == {(a, b): d for a in keys if a < "8" for b in keys if 0 < (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3} and found


def test_counts(spark):
    """Groups of every size, in one block or many: a narrow family of near fingerprints, copies, strangers, nulls."""
    rng = random.Random(5)
    middle = rng.getrandbits(64)
    family = [middle ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(700)]  # in most tables one group
    values = hard_values(rng) + family + [middle] * 40
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] + [(None,)], "bits long").repartition(5)
    want = {v: sum((a ^ b).bit_count() <= 3 for b in values) - 1 for v, a in zip(signed, values)}
    for chunk in (4096, 50, 7):
        assert {r.bits: r.n_near for r in simhash.near_counts(spark, df, chunk=chunk).collect()} == want
    assert simhash.near_counts(spark, df.limit(0)).count() == 0


def test_long_text_and_extra_columns(spark):
    long = "one two three " * 200_000
    out = {r.doc_id: r for r in simhash.edited(spark, spark.createDataFrame([(1, long, "a"), (2, long, "b"), (3, "x", "c")], "doc_id long, text string, bits string")).collect()}
    assert out[1].n_near == 1 and out[3].n_near == 0 and out[1].fingerprint == out[2].fingerprint and out[2].n_chars == len(long)
