"""Token counts of whole texts from counts of their pre-tokens: ids are never made for a document.

A pre-token is a stretch of the normalised text that no merge of the model can leave: pieces hold the space mark at their
start only, so a new pre-token starts with every run of marks, and a sign that no piece joins to another stands alone.

Documents are gathered in blocks of some tens of megabytes. A block keeps its distinct pre-tokens once, sorted and packed by
the bucket of their hash, and how often each document has each. The packets of one bucket meet in one task, where each
distinct pre-token is counted once by the library's own model; the counts go back packed as they came, and are joined to the
blocks' frequencies. What moves are packets, about five bytes for each pre-token of a block, so a word that every document has
costs as often as there are blocks.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm.ranges import checkpointed

MARK = "▁"
BLOCK_CHARS = 32 << 20
LIMIT = 4096
#: Pre-tokens whose counts a task keeps; the table is emptied when full.
KNOWN = 2_000_000

BLOCKS = "block long, packets array<binary>, docs binary"
_COUNTS = "doc_id long, n_bytes long, n_tokens long"


class PreTokens:
    """How a sentencepiece BPE model's texts fall into pre-tokens, and how many pieces each has.

    A model whose pieces hold the space mark elsewhere than at their start raises ValueError, as does one that joins every
    ASCII control sign to others, since a sign that stands alone is needed to hold back the mark put before every text.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        ids = range(self.library.get_piece_size())
        joined = [p for k in ids if not (self.library.is_byte(k) or self.library.is_control(k) or self.library.is_unknown(k)) if len(p := self.library.id_to_piece(k)) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("pieces of this model go across the starts of words")
        signs = set().union(*joined)
        self.alone = "".join(c for c in map(chr, range(1, 128)) if c not in signs and c != " ")
        if not self.alone:
            raise ValueError("no sign of this model stands alone")
        own = re.escape(self.alone)
        self.split: Callable[[str], list[str]] = re.compile(f"{MARK}+[^{MARK}{own}]*|[^{MARK}{own}]+|[{own}]").findall
        self.before = len(self.library.encode(self.alone[0]))

    def of(self, text: str) -> list[str]:
        return self.split(self.library.normalize(text)) if text else []

    def sizes(self, tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token, which follows a sign that nothing joins."""
        return [len(ids) - self.before for ids in self.library.encode([self.alone[0] + t for t in tokens])]


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers under 2**32, low bytes beside low bytes (the high ones are mostly zero), compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 4 * n, "zstd"), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_SIZES = np.dtype([("n", "<u4"), ("lengths", "<u4"), ("bytes", "<u4")])


def pack_tokens(tokens: list[bytes]) -> bytes:
    """The number of tokens, their lengths, and all of them, one after another."""
    lengths, body = _planes(np.array([len(t) for t in tokens], np.int64)), b"".join(tokens)
    return np.array((len(tokens), len(lengths), len(body)), _SIZES).tobytes() + lengths + pa.compress(body, "zstd", asbytes=True)


def unpack_tokens(packet: bytes) -> list[bytes]:
    n, size, whole = (int(x) for x in np.frombuffer(packet, _SIZES, 1)[0])
    at = _SIZES.itemsize
    ends = np.cumsum(_numbers(packet[at : at + size], n)).tolist()
    body = pa.decompress(packet[at + size :], whole, "zstd", asbytes=True)
    return [body[i:k] for i, k in zip([0, *ends], ends)]


def pack(ids: list[int | None], sizes: list[int], entries: list[int], places: np.ndarray, counts: np.ndarray) -> bytes:
    """A block's documents: ids, sizes and entries a document, then place (ascending in a document, as gaps) and count of each entry."""
    doc = np.repeat(np.arange(len(entries), dtype=np.int64), entries)
    order = np.argsort(doc << 32 | places)
    place = places[order].astype(np.int64)
    gaps = np.diff(place, prepend=0)
    first = (np.cumsum(entries) - entries)[np.array(entries, np.int64) > 0]
    gaps[first] = place[first]
    columns = {"doc_id": pa.array(ids, pa.int64()), "size": pa.array(sizes, pa.int64()), "entries": pa.array(entries, pa.int64())}
    columns |= {n: pa.array([_planes(x)] + [None] * (len(ids) - 1), pa.binary()) for n, x in (("gaps", gaps), ("counts", counts[order]))}
    sink = pa.BufferOutputStream()
    batch = pa.record_batch(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def totals(docs: bytes | pa.Buffer, pieces: np.ndarray) -> pa.RecordBatch:
    """doc_id, n_bytes, n_tokens of a block's documents: the sum of pieces by place times count."""
    batch = pa.ipc.open_stream(docs).read_next_batch()
    entries = batch.column("entries").to_numpy()
    gaps, count = (_numbers(batch.column(n)[0].as_py(), int(entries.sum())) for n in ("gaps", "counts"))
    ends = np.cumsum(entries)
    run = np.cumsum(gaps.astype(np.uint32).view(np.int32), dtype=np.int64)  # only a document's own gaps are ascending
    before = np.concatenate([[0], run])[ends - entries]  # a document's first gap is a place: what was summed up before goes off
    each = pieces[run - np.repeat(before, entries)] * count
    total = np.concatenate([[0], np.cumsum(each)])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), pa.array(total[ends] - total[ends - entries])], ["doc_id", "n_bytes", "n_tokens"])


def blocks(spark: SparkSession, docs: DataFrame, model: str, buckets: int, chars: int = BLOCK_CHARS) -> DataFrame:
    """Pre-token frequencies of every document, a row for each block of about so many characters (a longer text comes alone)."""
    spec = spark.sparkContext.broadcast(Path(model).read_bytes())  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(spec.value)
        made, held = 0, 0
        place: dict[str, int] = {}
        ids: list[int | None] = []
        sizes: list[int] = []
        entries: list[int] = []
        places, counts = array("i"), array("i")

        def flush() -> pa.RecordBatch:
            nonlocal made, held, place, ids, sizes, entries, places, counts
            tokens = [t.encode() for t in place]
            bucket = np.array([crc32(t) % buckets for t in tokens], np.int64)
            order = sorted(range(len(tokens)), key=tokens.__getitem__)
            order = np.array(order, np.int64)[np.argsort(bucket[order], kind="stable")] if order else np.zeros(0, np.int64)
            moved = np.empty(len(order), np.int64)
            moved[order] = np.arange(len(order))  # a pre-token's place is that in its packet, after the packets before
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packets = [pack_tokens([tokens[k] for k in order[i:j].tolist()]) if i < j else None for i, j in zip(ends[:-1], ends[1:])]
            packed = pack(ids, sizes, entries, moved[np.frombuffer(places, np.int32)] if len(places) else moved, np.frombuffer(counts, np.int32))
            number = (TaskContext.get().partitionId() << 32) + made
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packets], pa.list_(pa.binary())), pa.array([packed], pa.binary())], ["block", "packets", "docs"])
            made, held, place, ids, sizes, entries, places, counts = made + 1, 0, {}, [], [], [], array("i"), array("i")
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                found = Counter(pre.of(text))
                ids.append(doc_id.as_py())
                sizes.append(len(text.encode()))
                entries.append(len(found))
                places.extend([place.setdefault(t, len(place)) for t in found])
                counts.extend(found.values())
                held += len(text)
                if held >= chars:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, BLOCKS)


def counted(packets: Iterator[bytes], sizes: Callable[[list[str]], list[int]], most: int = KNOWN) -> Iterator[np.ndarray]:
    """The pieces of each token of each packet. sizes() sees each distinct token once, as long as there are not more than most."""
    known: dict[bytes, int] = {}
    for packet in packets:
        tokens = unpack_tokens(packet)
        new = [t for t in tokens if t not in known]
        if len(known) + len(new) > most:
            known.clear()
            new = tokens
        known.update(zip(new, sizes([t.decode() for t in new]) if new else [], strict=True))
        yield np.array([known[t] for t in tokens], np.int64)


def piece_counts(spark: SparkSession, packets: DataFrame, model: str, buckets: int) -> DataFrame:
    """block, bucket, n, pieces (packed) for each row of packets (bucket, block, packet)."""
    spec = spark.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(spec.value)
        rows = ((b.column(1).slice(k, 1), b.column(0).slice(k, 1), b.column(2)[k].as_py()) for b in batches for k in range(b.num_rows))
        keys: list[tuple[pa.Array, pa.Array]] = []

        def each() -> Iterator[bytes]:
            for block, bucket, packet in rows:
                keys.append((block, bucket))
                yield packet

        for pieces in counted(each(), pre.sizes):
            yield pa.RecordBatch.from_arrays([*keys.pop(), pa.array([len(pieces)], pa.int32()), pa.array([_planes(pieces)], pa.binary())], ["block", "bucket", "n", "pieces"])

    return packets.select("bucket", "block", "packet").repartitionById(buckets, F.col("bucket")).mapInArrow(run, "block long, bucket int, n int, pieces binary")


def count_tokens(spark: SparkSession, docs: DataFrame, model: str, limit: int = LIMIT, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    A null text is an empty text and has no tokens; a null doc_id stays null; repeated rows stay repeated; an empty table
    gives no rows; other columns are ignored. A task holds one block, or one text where that is longer. Blocks are written
    to the shared folder once, since the join reads them twice.
    """
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    freq = checkpointed(spark, blocks(spark, docs, model, buckets, chars), "token_counts")
    packets = freq.select("block", F.posexplode("packets").alias("bucket", "packet")).filter("packet IS NOT NULL")
    # one row a bucket, of which there are as many as shuffle partitions
    back = piece_counts(spark, packets, model, buckets).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "pieces"))).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, counts in zip(batch.column(0), batch.column(1)):
                parts = [_numbers(c["pieces"], c["n"]) for c in counts.as_py() or []]
                yield totals(packed.as_buffer(), np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return freq.select("block", "docs").join(back, "block", "left").select("docs", "counts").mapInArrow(run, _COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
