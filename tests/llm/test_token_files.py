"""Blocks round trip; files against the library."""

import random
import zlib

import numpy as np
import pytest

from gridindex.llm import ranges, token_files


def test_blocks():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([7]), np.full(5000, 9), rng.integers(0, 50_000, 10_000), np.where(rng.random(9000) < 0.05, 2**32 - 1, rng.integers(100, 200, 9000)), np.arange(4097)):
        ids = ids.astype(np.uint32)
        payload, starts = token_files.pack(ids)
        assert (token_files.unpack(payload, starts) == ids).all() and len(starts) == -(-len(ids) // token_files.BLOCK)
    skewed = np.where(rng.random(4096) < 0.02, 40_000, rng.integers(0, 16, 4096)).astype(np.uint32)
    assert len(token_files.pack_block(skewed)) < 4096


def test_files(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    name = tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(name), random.Random(3)
    pieces = ["Hello", " ", "it's", "ÀÉ", "x2²", "\x85", "\xa0", "\x1c", "日本", "é", "<|endoftext|>", "<|", "!", " ! ", "--", "\n", "İ", "ª", "'ll", "don't"]
    rows = [(k * 7 % 211, "".join(rng.choice(pieces[: 8 if k % 2 else None]) for _ in range(rng.randint(0, 30)))) for k in range(211)] + [(None, None), (3, ""), (3, "a"), (500, "word " * 60_000)]
    path = ranges.scratch(spark, "test")
    token_files.write(spark, spark.createDataFrame(rows, "doc_id long, text string"), path, name)
    out = token_files.read(spark, path, "ids_crc32 long", token_files.crc32).collect()
    start, want = 0, []
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_empty(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = ranges.scratch(spark, "test")
    token_files.write(spark, spark.createDataFrame([], "doc_id long, text string, shard int"), path, tokenizers.path("word_bpe_49k.json"))
    assert token_files.read(spark, path, "ids_crc32 long", token_files.crc32).count() == 0
