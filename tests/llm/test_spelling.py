import random
import re
import zlib
from collections import Counter

import pytest

from gridindex.llm import spelling


def near(a, b):
    """Whether exactly one symbol is put in, taken out or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[k:] == long[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def plain(docs, least=5, count=3, modulus=97, ratio=2):
    """Rows of variants() by comparing all words."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out)


def rows(spark, docs, **kw):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, spelling.variants(spark, frame, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def corpus(seed, alphabet, sizes, words=60, docs=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(words)]
    vocab = []
    for w in base:
        vocab.append(w)
        for _ in range(6):
            k, c = rng.randrange(len(w)), rng.choice(alphabet)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]) or c
            vocab.append(w)
    return [(i, " ".join(vocab[min(int(rng.expovariate(0.01)), len(vocab) - 1)] for _ in range(120))) for i in range(docs)]


@pytest.mark.parametrize("group,stretch,alphabet,sizes", [(20_000, 48, "ab", (5, 8)), (3, 48, "abcé×", (5, 14)), (20_000, 2, "abcdefgh", (4, 7)), (1, 1, "ab", (5, 8)), (1, 1, "abcé×", (5, 14))])
def test_equals_plain(spark, group, stretch, alphabet, sizes):
    docs = corpus(group + len(alphabet), alphabet, sizes)
    assert rows(spark, docs, group=group, stretch=stretch) == plain(docs)


def test_short_words_too(spark):
    docs = corpus(7, "ab", (1, 5))
    assert rows(spark, docs, least=1, modulus=5) == plain(docs, least=1, modulus=5)


def test_no_pair_twice():
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(5 + i % 2)) for i in range(200)})
    machine = spelling.Acceptor()
    found = list(machine.pairs(machine.add(words), 5, False))
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if near(a, b) and min(len(a), len(b)) == 5}


def test_acceptor_is_minimal():
    machine = spelling.Acceptor()
    machine.add(sorted(a + b for a in ("top", "tap", "stop") for b in ("", "s", "ping")))
    machine.add(sorted(a + b for a in ("flop", "chap") for b in ("", "s", "ping")))
    # after any stem the same futures: one state; the stems' own states beside it
    assert sum(arcs.keys() == {"s", "p"} for arcs in machine.arcs) == 1


def test_edges(spark):
    long_word = "abcdefghij" * 40_000
    twin = long_word[:200_000] + "z" + long_word[200_000:]
    docs = [(None, "Stone stone STONE stons"), (1, None), (2, ""), (3, "stons stons " * 2), (3, "stons stons " * 2), (4, f"{long_word} {twin}"), (5, f"{long_word} {twin}"), (6, f"{long_word} {twin} \U0001f600Łódź\x00stone")]
    assert rows(spark, docs) == plain(docs)
    assert rows(spark, []) == []
    wide = spark.createDataFrame([(1, "stone stone stone", 3, "a", 5)], "doc_id int, text string, n int, word string, head int")
    assert spelling.variants(spark, wide).count() == 1


def test_a_chain_is_followed_to_its_end(spark):
    words = ["aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    docs = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)]
    got = {r[0]: r[2] for r in rows(spark, docs, modulus=1 << 40)}
    assert set(got.values()) == {"bbbbbb"} and got == {r[0]: r[2] for r in plain(docs, modulus=1 << 40)}
