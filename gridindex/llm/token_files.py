"""Token ids in patched frame-of-reference blocks.

A block stores its minimum and, for each id, the low bits of the difference, as wide as a chosen share of the differences
need; ids that need more leave their high bits in an exception list. A chunk is a run of whole documents: its blocks one
after another, an index of block starts and the place of each document. Chunks are the rows of a Parquet data set, so
Spark's own commit protocol makes the files and a lost executor leaves none half written.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridindex.llm.bpe import byte_alphabet
from gridindex.llm.ranges import bounds, range_of

BLOCK, SHARE, CHUNK_IDS = 4096, 0.9, 1 << 17
CACHE_WORDS = 250_000
END_ID = 1
_HEAD = np.dtype([("base", "<u4"), ("n", "<u4"), ("exceptions", "<u4"), ("width", "<u4")])
CHUNK_SCHEMA = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_sizes array<long>, block_starts array<int>, payload binary"


def pack_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block; the width is the bits of the share-quantile of the differences from the minimum."""
    if not len(ids):
        return np.array((0, 0, 0, 0), _HEAD).tobytes()
    base = int(ids.min())
    delta = ids.astype(np.uint32) - np.uint32(base)
    at = min(len(delta) - 1, int(share * len(delta)))
    width = int(np.partition(delta, at)[at]).bit_length()
    bits = np.unpackbits(delta.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else np.zeros(0, np.uint8)
    high = delta >> np.uint32(width) if width < 32 else np.zeros(len(delta), np.uint32)
    where = np.flatnonzero(high).astype("<u4")
    return np.array((base, len(ids), len(where), width), _HEAD).tobytes() + np.packbits(bits, bitorder="little").tobytes() + where.tobytes() + high[where].astype("<u4").tobytes()


def unpack_block(payload: bytes | memoryview, at: int) -> np.ndarray:
    """The ids of the block that starts at this offset."""
    head = np.frombuffer(payload, _HEAD, 1, at)[0]
    n, width, exceptions = int(head["n"]), int(head["width"]), int(head["exceptions"])
    at += _HEAD.itemsize
    size = (n * width + 7) // 8
    wide = np.zeros((n, 32), np.uint8)
    if width:
        wide[:, :width] = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
    delta = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    where = np.frombuffer(payload, "<u4", exceptions, at + size)
    delta[where] |= np.frombuffer(payload, "<u4", exceptions, at + size + 4 * exceptions) << np.uint32(width)
    return delta + head["base"]


def pack(ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> tuple[bytes, list[int]]:
    """All blocks and where each starts."""
    parts, starts, at = [], [], 0
    for k in range(0, len(ids), block):
        parts.append(pack_block(ids[k : k + block], share))
        starts.append(at)
        at += len(parts[-1])
    return b"".join(parts), starts


def unpack(payload: bytes | memoryview, starts: list[int]) -> np.ndarray:
    return np.concatenate([unpack_block(payload, s) for s in starts]) if starts else np.zeros(0, np.uint32)


#: What byte-level vocabularies write for each byte.
_STAND_INS = {b: c for c, b in byte_alphabet().items()}


class WordEncoder:
    """The tokenizers library over whole texts, with words it has met kept (bounded), since its pieces never cross words.

    Texts below U+0100 are split here as the vocabulary's own rules split them, and the library's model merges each new word
    once; any other text, or one that may hold a special token, goes to the library whole.
    """

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_str(spec), cache_words
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t["content"][:2] for t in json.loads(spec)["added_tokens"]]
        kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        letter, number = kinds["L"], kinds["N"]
        self.split = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{number}]|[^\t-\r \x85\xa0{letter}{number}]+").findall
        self.known: dict[str, bytes] = {}
        probe = "It's ÀÉ2x²½ it'll--go\x85\xa0\x1cend ÿ\tª!?9"
        self.fast = False  # the whole text, by the library alone
        whole = self.encode_all([probe])
        self.fast = True
        self.fast = self.encode_all([probe]) == whole  # only where the file normalises and splits as split() does

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, lists: list[list[str]]) -> None:
        new = set().union(*lists).difference(self.known)
        if len(self.known) + len(new) > self.cache_words:
            self.known.clear()
            new = set().union(*lists)
        merge = self.tokenizer.model.tokenize
        for w in new:
            letters = w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(_STAND_INS)
            self.known[w] = array("I", [t.id for t in merge(letters)]).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        words: list[list[str] | None] = []
        for text in texts:
            plain = self.fast and not any(s in text for s in self.specials)
            if plain and not text.isascii():
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    plain = False
            words.append(self.split(text.lower()) if plain else None)
        self._learn([w for w in words if w is not None])
        get = self.known.__getitem__
        return [np.array(self._ids(t), "<u4").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of every document, each followed by END_ID, in ascending doc_id order (shard, then place in it).

    Null texts are empty; null ids come first, equal ids in the order of their texts. A document never spans chunks, so one
    text's ids must fit a task's memory, as the text does.
    """
    spec = spark.sparkContext.broadcast(Path(tokenizer).read_text())  # its size is the vocabulary's
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = bounds(spark, rows)
    dealt = rows.withColumn("shard", range_of(cuts, F.col("doc_id")).cast("int")).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(spec.value)
        shard, chunk, first, held = 0, 0, 0, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal chunk, first, held, ids, doc_ids
            flat = np.frombuffer(b"".join(ids), "<u4")
            payload, starts = pack(flat)
            values = (shard, chunk, first, len(flat), doc_ids, [len(x) // 4 for x in ids], starts, payload)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            chunk, first, held, ids, doc_ids = chunk + 1, first + len(flat), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shard = part.column(2)[0].as_py()
                for doc_id, own in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(own + end)
                    held += len(ids[-1]) // 4
                    if held >= CHUNK_IDS:
                        yield flush()
        if ids:
            yield flush()

    dealt.select("doc_id", "text", "shard").mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, columns: str, each: Callable[[np.ndarray], tuple]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the columns that each(ids) gives (a DDL list, like "ids_crc32 long")."""
    chunks = spark.read.parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = f"doc_id long, shard int, place long, n_tokens long, {columns}"
    fields = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                ids = unpack(row["payload"].as_buffer(), row["block_starts"].as_py())
                sizes = row["doc_sizes"].as_py()
                ends = np.cumsum(sizes)
                places = (ends - sizes + row["first"].as_py()).tolist()
                made = [each(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes, strict=True)]
                columns_ = [pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array([row["shard"].as_py()] * len(sizes), pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), *columns_], ["doc_id", "shard", "place", "n_tokens", *fields.names])

    docs = chunks.select("shard", "first", "doc_ids", "doc_sizes", "block_starts", "payload").mapInArrow(run, schema)
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", *fields.names)


def crc32(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
