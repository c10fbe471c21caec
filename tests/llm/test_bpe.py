"""Ids and decoded texts against the tokenizers library, and the automaton against merging by rank."""

import hashlib
import random

import numpy as np
import pytest

from gridindex.llm import bpe

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def hard_texts(rng, n):
    letters = "aeiourstln" * 4 + "ABCZ019'  \n\t.,!?-_é ß  ́日本語😀‍\u0085\x00﻿"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["'s't're've'm'll'd 'S don't", "  two  spaces \n\n ", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftex", "<", "\r\n\r\n x"]


def test_against_the_library(spark, library):
    rng = random.Random(1)
    texts = [None, "", *hard_texts(rng, 600), "x" * 5000, "ab" * 3000 + "é" * 2000, " ".join("word%d" % k for k in range(30_000))]
    rows = [(k, t, "own") for k, t in enumerate(texts)] + [(None, "no id", "own"), (3, texts[3], "own")]
    out = bpe.encode_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), PATH, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            continue
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id] or ""), texts[r.doc_id]
        assert len(r.ids) == 4 * r.n_tokens and r.round_trip
    assert bpe.encode_documents(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_table_reset_and_long_words(library, automaton):
    rng = random.Random(2)
    texts = hard_texts(rng, 300) + ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (47, 48, 49, 50, 200, 3000)]
    tiny = bpe.Codec(automaton, cache_words=5)  # emptied at nearly every call
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for text, ids in zip(part, tiny.encode_all(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            assert tiny.decode(ids) == text
    words = [w.encode() for w in ("".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 80))) for _ in range(200))]
    assert automaton.encode_words(words) == [automaton._encode_long(w) for w in words]
    assert automaton.encode_words([]) == []


def by_rank(word, ranks):
    """Merging by rank, pair by pair."""
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get((parts[k], parts[k + 1]), 1 << 30))
        pair = parts[best], parts[best + 1]
        if pair not in ranks:
            break
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


def test_random_merges():
    """Small random vocabularies, where every kind of gadget meets every other."""
    rng = random.Random(3)
    for _ in range(60):
        vocab = {c: k for k, c in enumerate(bpe.byte_alphabet())}
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 25)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in vocab and len(u + v) < 12:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                tokens.append(u + v)
        machine, ranks = bpe.Automaton(vocab, merges, {}), {m: k for k, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
            got = np.frombuffer(machine.encode_words([word.encode()])[0], "<u4").tolist()
            assert got == [vocab[t] for t in by_rank(word, ranks)], (merges, word)
