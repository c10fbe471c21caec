"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find neighbours within a Hamming radius.

The bits are dealt into BLOCKS blocks. Two fingerprints within the radius agree on some choice of BLOCKS - radius whole blocks,
so each choice makes one table keyed by those blocks, and every pair meets in some table; it counts in the first one only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridindex.llm import wordbytes
from gridindex.llm.ranges import checkpointed

BITS = 64
RADIUS, BLOCKS = 3, 5
#: Fingerprints of one table key that are compared at once; larger groups are cut into chunks that meet in pairs.
CHUNK = 4096
EDIT_SCHEMA = "doc_id long, n_chars long, edited binary, bits long, edited_bits long, near_edited double, near_next double"


def fingerprints(column: pa.Array) -> np.ndarray:
    """One 64-bit fingerprint per text. Terms are pairs of neighbouring words (a lone word by itself), weighted 1 + ln(count); no terms: 0."""
    out = np.zeros(len(column), np.uint64)
    for w in wordbytes.words(column):
        pairs = wordbytes.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) if len(w.hash) > 1 else w.hash[:0]
        first = w.first.tolist()
        for k in range(w.hi - w.lo):
            a, b = first[k], first[k + 1]
            terms = pairs[a : b - 1] if b - a > 1 else w.hash[a:b]
            if not len(terms):
                continue
            terms, counts = np.unique(terms, return_counts=True)
            bits = np.unpackbits(terms.view(np.uint8)).reshape(-1, BITS)
            weight = (1 + np.log(counts)).astype(np.float32)
            vote = 2 * (weight @ bits.astype(np.float32)) > weight.sum()
            out[w.lo + k] = np.packbits(vote).view(np.uint64)[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits). Null and empty texts have the fingerprint 0; equal texts have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{x:016x}" for x in fingerprints(batch.column(1)).tolist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits that make each table's key, as signed 64-bit integers."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be at least 0 and less than blocks")
    cuts = [k * BITS // blocks for k in range(blocks + 1)]
    masks = [sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bits(fingerprint: str) -> Column:
    return F.conv(fingerprint, 16, -10).cast("long")


def neighbours(prints: DataFrame, of: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint (asked for in of), near, distance: the distinct fingerprints (hex) of prints at most radius bits from each one asked for.

    Equal fingerprints are not listed; null ones have no neighbours. Every table's key is an equi-join, and the distance is
    part of the condition, so what is further is never a row. To count the neighbours of every fingerprint take near_counts.
    """
    masks = _masks(radius, blocks)
    keyed = lambda d, name: d.filter(F.col("fingerprint").isNotNull()).select("fingerprint").distinct().select(F.col("fingerprint").alias(name), _bits("fingerprint").alias(f"{name}_bits"), F.posexplode(F.array(*(_bits("fingerprint").bitwiseAND(F.lit(m)) for m in masks))).alias("table", "key"))
    differ = F.col("fingerprint_bits").bitwiseXOR(F.col("near_bits"))
    agree = F.array(*(differ.bitwiseAND(F.lit(m)) == 0 for m in masks))
    met = keyed(of, "fingerprint").join(keyed(prints, "near"), ["table", "key"])
    near = met.filter((F.bit_count(differ) <= radius) & (differ != 0) & (F.array_position(agree, True) == F.col("table") + 1))
    return near.select("fingerprint", "near", F.bit_count(differ).alias("distance"))


def _tally(bits: np.ndarray, copies: np.ndarray, own: np.ndarray, other: np.ndarray, masks: np.ndarray, table: int, radius: int) -> np.ndarray:
    """For each of the rows own, the copies of those of the rows other that are near it and meet it in this table first."""
    found = np.zeros(len(own), np.int64)
    step = max(1, (1 << 20) // max(len(other), 1))
    for lo in range(0, len(own), step):
        differ = bits[own[lo : lo + step], None] ^ bits[other]
        i, j = np.nonzero((np.bitwise_count(differ.view(np.uint64)) <= radius) & (differ != 0))
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= (differ[i, j] & masks[t]) != 0
        np.add.at(found, lo + i[new], copies[other[j[new]]])
    return found


PARTIAL = "bits long, n long, table int, copies long, chunk int, key long"


def near_counts(spark: SparkSession, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """bits, n_near for each distinct fingerprint (bits: long) of prints: how many other rows are at most radius bits from it, equal ones included.

    No pair is ever a row. Fingerprints are dealt by the tables' keys; a key's fingerprints are compared where they meet, up to
    chunk of them. Those of a larger group leave in chunks, as they stream past, and each two chunks meet in a block of
    their own, so one very common key is spread over tasks. Null bits have no neighbours.
    """
    masks = _masks(radius, blocks)
    array, table_masks = np.array(masks, np.int64), F.array(*map(F.lit, masks))
    distinct = checkpointed(spark, prints.filter(F.col("bits").isNotNull()).groupBy("bits").agg(F.count("*").alias("copies")), "fingerprints")
    keyed = distinct.select("bits", "copies", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("table"))
    key = F.col("bits").bitwiseAND(F.get(table_masks, F.col("table")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by table and key: counts of groups of up to chunk rows; larger ones come out as they are, in chunks."""
        held, chunks = np.zeros((0, 3), np.int64), 0  # rows of the open group (bits, copies, table), and its chunks that have left

        def leave(rows: np.ndarray) -> pa.RecordBatch:
            table = int(rows[0, 2])
            return _partial(rows[:, 0], table=table, copies=rows[:, 1], chunk=chunks, key=int(rows[0, 0] & array[table]))

        def closed() -> Iterator[pa.RecordBatch]:
            if chunks and len(held):
                yield leave(held)
            elif len(held) > 1:
                every = np.arange(len(held))
                found = _tally(held[:, 0], held[:, 1], every, every, array, int(held[0, 2]), radius)
                if found.any():
                    yield _partial(held[found > 0, 0], n=found[found > 0])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bits", "copies", "table")], 1)
            part = rows[:, 0] & array[rows[:, 2]]
            starts = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(rows[:, 2]) != 0)))
            ends = np.append(starts[1:], len(rows))
            wanted = np.flatnonzero(ends - starts > 1)
            for k in np.unique(np.concatenate([[0], wanted, [len(starts) - 1]])).tolist():  # groups of one row end where they begin
                group = rows[starts[k] : ends[k]]
                same = k == 0 and len(held) and held[0, 2] == group[0, 2] and held[0, 0] & array[held[0, 2]] == part[0]
                if not same:
                    yield from closed()
                    chunks = 0
                held = np.concatenate([held, group]) if same else group
                while len(held) > chunk:
                    yield leave(held[:chunk])
                    held, chunks = held[chunk:], chunks + 1
        yield from closed()

    done = checkpointed(spark, keyed.repartition(n, "table", key).sortWithinPartitions("table", key).select("bits", "copies", "table").mapInArrow(first, PARTIAL), "fingerprints")
    large = done.filter("chunk IS NOT NULL").select("table", "key", "chunk", "bits", "copies")
    chunks = large.groupBy("table", "key").agg(F.max("chunk").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    blocks_ = large.join(chunks, ["table", "key"]).select("*", other).select("table", "bits", "copies", "chunk", F.xxhash64("table", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"), (F.col("chunk") == F.col("other")).alias("alone"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block: two chunks, of which each row counts those of the other, or one chunk with itself."""
        for block in _by_block(batches):
            bits, copies, chunk = (block.column(c).to_numpy().astype(np.int64) for c in ("bits", "copies", "chunk"))
            table, alone = block.column("table")[0].as_py(), block.column("alone")[0].as_py()
            sides = [(np.arange(len(bits)),) * 2] if alone else [(own, rest) for c in np.unique(chunk) for own, rest in [(np.flatnonzero(chunk == c), np.flatnonzero(chunk != c))]]
            for own, rest in sides:
                found = _tally(bits, copies, own, rest, array, table, radius)
                if found.any():
                    yield _partial(bits[own[found > 0]], n=found[found > 0])

    across = blocks_.repartition(n, "block").sortWithinPartitions("block").mapInArrow(second, PARTIAL)
    sums = done.filter("n IS NOT NULL").select("bits", "n").unionAll(across.select("bits", "n")).groupBy("bits").agg(F.sum("n").alias("n"))
    return distinct.join(sums, "bits", "left").select("bits", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"))


def _partial(bits: np.ndarray, n: np.ndarray | None = None, table: int = 0, copies: np.ndarray | None = None, chunk: int = 0, key: int = 0) -> pa.RecordBatch:
    """Counts of some fingerprints, or (without n) the rows of one chunk of a large group."""
    of = lambda x, kind: pa.nulls(len(bits), kind) if x is None else pa.array(np.broadcast_to(x, len(bits)), kind)
    columns = [of(bits, pa.int64()), of(n, pa.int64()), of(table, pa.int32()), of(copies, pa.int64()), of(chunk if n is None else None, pa.int32()), of(key, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARTIAL.split(", ")])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block (at most two chunks) of batches that are sorted by block."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cuts = [0, *(np.flatnonzero(np.diff(table.column("block").to_numpy())) + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(lo, hi - lo)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending doc_id order, and
    n_near: how many other documents' fingerprints are at most RADIUS bits from its own, by block tables (near_counts).

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document;
    after the last document comes the first. Null texts are empty; equal doc_ids are ordered by text, null ids come last.
    Texts cross the network once: ranges of doc_id are sorted where they land, and each range also gets the first row of
    the next one. Only the ranges' bounds and first ids (one per range) are gathered.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / n) for k in range(1, n))) if n > 1 else F.array(F.lit(0.5)), 20 * n)).head()[0] or []
    bounds = sorted(set(bounds))
    bucket = F.lit(len(bounds)) - F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", F.coalesce(bucket, F.lit(len(bounds) + (not bounds))).cast("int"))
    # the first row of each range: the largest doc_id in it, and of those the first text
    heads = rows.select("doc_id", "bucket").groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).select("bucket", "doc_id")
    order = Window.orderBy("bucket")
    previous = heads.select("doc_id", F.col("bucket").alias("own"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"))
    link = F.broadcast(previous.select(F.col("own"), F.col("doc_id").alias("head_id"), F.col("bucket").alias("to")))
    guests = (
        rows.join(link, (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
        .groupBy("own", "to").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    )
    dealt = (
        rows.withColumn("guest", F.lit(0)).unionByName(guests)
        .repartitionById(len(bounds) + 2, F.col("bucket"))
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]
        ids: list[int | None] = []
        texts: list[str] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                guest = bool(part.num_rows) and part.column(3)[part.num_rows - 1].as_py() == 1
                if len(texts) < 2:
                    continue
                own, new = texts[:-1], []
                for text, after in zip(own, texts[1:], strict=True):
                    half = len(text) // 2
                    new.append(text[: len(text) - half] + after[:half])
                every = fingerprints(pa.array(texts, pa.large_string()))
                edit = fingerprints(pa.array(new, pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in new], pa.binary()),
                        pa.array(every[:-1].view(np.int64)), pa.array(edit.view(np.int64)),
                        pa.array(likeness(every[:-1], edit)), pa.array(likeness(every[:-1], every[1:])),
                    ], names)
                ids, texts = ([], []) if guest else (ids[-1:], texts[-1:])

    found = checkpointed(spark, dealt.select("doc_id", "text", "bucket", "guest").mapInArrow(run, EDIT_SCHEMA), "edited")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return found.join(near_counts(spark, found), "bits", "left").select(
        "doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), hexed("bits").alias("fingerprint"), hexed("edited_bits").alias("edited_fingerprint"), "near_edited", "near_next", "n_near"
    )
