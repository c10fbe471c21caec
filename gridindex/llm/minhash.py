"""HyperMinHash near-duplicates.

A document's distinct word shingles are dealt into buckets by their hashes' leading bits; each bucket keeps the
leading-zero count and a few mantissa bits of its least hash. Bands of these registers propose pairs, a second, finer
sketch estimates their Jaccard similarity with chance collisions taken out, and the full sets decide.

Documents with equal sets are one class from the start. A band's bucket of any size is never expanded into its pairs: all
members are compared with its first one, components are formed, and only members of different components still meet, in
blocks of bounded size that emit nothing but what the estimate lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm import wordbytes
from gridindex.llm.components import connected
from gridindex.llm.ranges import checkpointed, free

#: Band registers: at a similarity of 0.8 a pair misses all 32 bands of 4 with probability (1 - 0.8**4)**32, about 5e-8.
REGISTERS, BAND, MANTISSA, EMPTY = 128, 4, 10, 0xFFFF
#: Estimate registers: 512 of 8 bits (3 of leading zeros, 5 of mantissa), and how often two different ones agree by chance.
FINE, FINE_MANTISSA, FINE_EMPTY, CHANCE = 512, 5, 0xFF, 0.015
#: A pair goes to verification unless its estimate lies so many standard errors below the threshold.
SLACK = 4.5
BLOCK = 1024
#: Where full sets go along, a chunk holds about so many of their members at most (8 bytes each): a block is two chunks.
BLOCK_MEMBERS = 8 << 20
#: Buckets of more members than this are settled where they meet, on full sets; smaller ones only propose pairs.
LARGE = 64
#: Ids are broadcast to pick texts only up to this many (8 bytes each); beyond it the join is left to Spark.
BROADCAST_IDS = 1_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


def shingles(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    nothing = np.zeros(0, np.uint64)
    for w in wordbytes.words(column):
        n = len(w.hash) - size + 1
        full = np.zeros(max(n, 0), np.uint64)
        for k in range(size if n > 0 else 0):
            full += w.hash[k : k + n] * (_MULTIPLIERS[k % 8] + np.uint64(2 * (k // 8)))
        full = wordbytes.mix(full)
        first = w.first.tolist()
        for k in range(w.hi - w.lo):
            a, b = first[k], first[k + 1]
            if b - a >= size:
                out.append(np.unique(full[a : b - size + 1]))
            elif b > a:
                few = np.uint64(b - a) + (w.hash[a:b] * _MULTIPLIERS[np.arange(b - a) % 8]).sum(dtype=np.uint64)
                out.append(wordbytes.mix(np.array([few], np.uint64)))
            else:
                out.append(nothing)
    return out


def _least(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with a member, and their least rest as leading-zero count and 52 bits after the leading one."""
    width = buckets.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - width)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] & np.uint64((1 << (64 - width)) - 1)).astype(np.float64) + 1.0
    bits = rest.view(np.uint64)  # a float's exponent gives the leading zeros, its fraction the bits after the leading one
    return bucket[first], np.uint64(1023 + 64 - width) - (bits >> np.uint64(52)), bits & np.uint64((1 << 52) - 1)


def registers(hashes: np.ndarray) -> np.ndarray:
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        bucket, zeros, fraction = _least(hashes, REGISTERS)
        out[bucket] = (zeros << np.uint64(MANTISSA)) | (fraction >> np.uint64(52 - MANTISSA))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    out = np.full(FINE, FINE_EMPTY, np.uint8)
    if len(hashes):
        bucket, zeros, fraction = _least(hashes, FINE)
        out[bucket] = np.minimum((np.minimum(zeros, np.uint64(7)) << np.uint64(FINE_MANTISSA)) | (fraction >> np.uint64(52 - FINE_MANTISSA)), np.uint64(FINE_EMPTY - 1))
    return out


def plausible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (rows, broadcast against each other) may reach the threshold."""
    in_a, in_b = a != FINE_EMPTY, b != FINE_EMPTY
    either, both_equal = (in_a | in_b).sum(-1), ((a == b) & in_a).sum(-1)
    seen = np.maximum(either, 1)
    corrected = (both_equal / seen - CHANCE) / (1 - CHANCE)
    least = percent / 100
    union = np.maximum((size_a + size_b) / (1 + least), 1)
    # seen of the union's members are observed, without replacement
    error = np.sqrt(least * (1 - least) / seen * np.maximum(1 - seen / union, 0.0)) + 0.5 / seen
    near = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return near & (corrected + SLACK * error + CHANCE >= least)


SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, two digests of its set, band values, the estimate sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingles(part.column(1), size)
                bands = np.concatenate([registers(s) for s in sets]).view(np.int64)
                per = REGISTERS // BAND
                digest = _digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[0], pa.int64()), pa.array(digest[1], pa.int64()),
                        pa.ListArray.from_arrays(np.arange(0, per * len(sets) + 1, per, dtype=np.int32), pa.array(bands)), pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                    ], [x.split()[0] for x in SIGNATURE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches (node, n_shingles, sketch) let through."""
    named = lambda x: sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                size_a, size_b = (part.column(k).to_numpy() for k in (2, 3))
                a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, FINE) for k in (4, 5))
                yield part.select([0, 1]).filter(pa.array(plausible(a, b, size_a, size_b, percent)))

    return both.mapInArrow(run, "a long, b long")


def _digests(sets: list[np.ndarray]) -> list[list[int]]:
    """Two 64-bit digests of each set."""
    return [[int((wordbytes.mix(s ^ np.uint64(salt))).sum(dtype=np.uint64).view(np.int64)) for s in sets] for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _sets(docs: DataFrame, ids: DataFrame, size: int, places: DataFrame | None = None) -> DataFrame:
    """node, set (sorted 64-bit hashes) of the documents with these ids (node).

    places (node, doc, h1, h2) says which document, and of its texts which, a node is that is not its own document's id.
    """
    wanted = ids.select("node", F.col("node").alias("doc"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"))
    if places is not None:
        wanted = ids.join(places, "node", "left").select("node", F.coalesce("doc", "node").alias("doc"), "h1", "h2")
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(wanted, "doc").select("node", "text", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingles(part.column(1), size)
                if part.column(2).null_count < part.num_rows:
                    mine = [w is None or (w, v) == (x, y) for w, v, x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), *_digests(sets), strict=True)]
                    part, sets = part.filter(pa.array(mine, pa.bool_())), [s for s, m in zip(sets, mine, strict=True) if m]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, size: int, percent: int, places: DataFrame | None) -> DataFrame:
    """The pairs whose full sets reach the threshold. Only texts of documents in the pairs are read into sets.

    A first node's set goes once to each BLOCK of its partners, which follow it one after the other; it is not copied a pair.
    """
    sets = _sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), size, places)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"))
    firsts = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(sets.withColumnRenamed("node", "a"), "a")
    partners = pairs.join(shares, "a").select("a", "b", F.pmod(F.hash("b"), F.col("shares")).alias("share")).join(sets.withColumnRenamed("node", "b"), "b")
    rows = firsts.select("a", "share", F.lit(None).cast("long").alias("b"), "set").union(partners.select("a", "share", "b", "set"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = rows.repartition(n, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).select("a", "b", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(v.as_buffer(), np.uint64)
                if b is None:
                    of = x.copy()  # a batch's memory goes with it
                shared = 0 if b is None else len(np.intersect1d(of, x, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(of) + len(x) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return sorted_.mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame) -> DataFrame:
    """node, comp, own (chunk), band, block, self (one chunk with itself): the rows of every block of the buckets (key, band, node, comp).

    A bucket's members outside its largest component are cut into chunks of about BLOCK by hash; each two chunks (and each
    with itself) meet in one block. Members of the largest component, cut likewise into chunks numbered from below zero,
    meet only the others' chunks: a bucket whose members are nearly all linked already copies its rows once for each
    BLOCK of the few that are not. Where members have n_shingles, chunks are cut finer, to BLOCK_MEMBERS shingles.
    """
    weight = F.lit(1 / BLOCK)
    if "n_shingles" in members.columns:
        weight = F.greatest(weight, F.col("n_shingles") / BLOCK_MEMBERS)
    by = members.groupBy("key", "comp").agg(F.sum(weight).alias("m"))
    tops = by.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.max("m").alias("n_top"), F.sum("m").alias("n_all"))
    chunks = lambda n: F.ceil(n - 1e-6).cast("int")
    own = members.join(tops.select("key", "top", chunks(F.col("n_top")).alias("c_top"), chunks(F.col("n_all") - F.col("n_top")).alias("c_rest")), "key")
    in_top, h = F.col("comp") == F.col("top"), F.hash("node")
    own = own.withColumn("own", F.when(in_top, -1 - F.pmod(h, F.col("c_top"))).otherwise(F.pmod(h, F.greatest("c_rest", F.lit(1)))))
    others = F.sequence(F.when(in_top, F.lit(0)).otherwise(-F.col("c_top")), F.col("c_rest") - 1)
    dealt = own.filter("c_rest > 0").select("key", "band", "node", "comp", "own", F.explode(others).alias("other"))
    return dealt.select("node", "comp", "own", "band", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block"), (F.col("own") == F.col("other")).alias("self"))


def _shared(of: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the other sets (none empty) has in common with a set; looked up some 2**20 members at a time."""
    sizes = np.array([len(x) for x in others])
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) >> 20)) + 1).tolist(), len(others)]
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        other = np.concatenate(others[lo:hi])
        same = of[np.minimum(np.searchsorted(of, other), len(of) - 1)] == other
        out.append(np.add.reduceat(same.astype(np.int64), np.cumsum(sizes[lo:hi]) - sizes[lo:hi]))
    return np.concatenate(out)


def _across(members: DataFrame, more: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket (key, band, node, comp) whose components differ.

    more: node, n_shingles, sketch and, where pairs are to be settled here, bands and set. Without sets the pairs are what
    the sketches let through; with sets they are links, each looked at in the first band in which the two agree. Blocks
    (_dealt) are bounded and emit nothing else.
    """
    settle = "set" in more.columns
    weighed = members.join(more.select("node", "n_shingles"), "node") if settle else members
    rows = _dealt(weighed).join(more, "node").select("block", "node", "comp", "own", "band", "self", *[c for c in more.columns if c != "node"])
    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = rows.repartition(n, "block").sortWithinPartitions("block")

    def pairs(block: pa.Table) -> pa.RecordBatch | None:
        order = np.argsort(block.column("node").to_numpy(), kind="stable")
        block = block.take(pa.array(order))
        node, comp, own, size = (block.column(c).to_numpy() for c in ("node", "comp", "own", "n_shingles"))
        alone, band = bool(block.column("self")[0].as_py()), block.column("band")[0].as_py()
        prints = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, FINE)
        if settle:
            bands = np.stack([np.array(x, np.int64) for x in block.column("bands").to_pylist()])
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("set")]
            size = np.array([len(x) for x in sets])
        out_a, out_b = [], []
        for i in range(len(node) - 1):
            far = (comp[i + 1 :] != comp[i]) & (alone | (own[i + 1 :] != own[i])) & (node[i + 1 :] != node[i])
            near = far & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
            j = np.flatnonzero(near) + i + 1
            if settle and len(j):
                j = j[((bands[j] == bands[i]) & (bands[j] != -1)).argmax(1) == band]
            if len(j):
                j = j[plausible(prints[i], prints[j], size[i], size[j], percent)]
            if settle and len(j):
                shared = _shared(sets[i], [sets[k] for k in j])
                j = j[100 * shared >= percent * (size[i] + size[j] - shared)]
            out_a += [node[i]] * len(j)
            out_b += node[j].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"]) if out_a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = table.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1 and (found := pairs(table.slice(lo, hi - lo))):
                    yield found
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows > 1 and (found := pairs(held)):
            yield found

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _classified(spark: SparkSession, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2, component_id, kept of every row.

    A class is a set of shingles; its node is the least doc_id that has it or, where that one has other sets too (rows
    that share an id but not a text), a hash of id and set.
    """
    all_ = checkpointed(spark, signatures(docs, size), "signatures")
    some = all_.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["h1", "h2", "n_shingles"]
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    shared = classes.groupBy("rep").agg(F.count("*").alias("sets")).filter("sets > 1")
    odd = checkpointed(spark, classes.join(shared, "rep", "left_semi").select(*key, F.col("rep").alias("doc"), (-1 - F.shiftrightunsigned(F.xxhash64("rep", "h1", "h2"), 1)).alias("node")), "classes")
    plain = odd.isEmpty()
    classes = classes.withColumn("node", F.col("rep")) if plain else classes.join(odd.drop("doc"), key, "left").withColumn("node", F.coalesce("node", "rep"))
    places = None if plain else odd.select("node", "doc", "h1", "h2")
    reps = some.join(classes, key).filter("doc_id = rep").select("node", "n_shingles", "h1", "h2", "bands", "sketch").dropDuplicates(key)
    reps = checkpointed(spark, reps.drop("h1", "h2"), "classes")
    sketches = reps.select("node", "n_shingles", "sketch")

    banded = reps.select("node", F.posexplode("bands").alias("band", "value")).filter(F.col("value") != -1).select("node", "band", F.xxhash64("band", "value").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(spark, banded.join(buckets, "key").select("key", "band", "node", "pivot", "n"), "members")
    star = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    likely = checkpointed(spark, _estimated(star, sketches, percent), "likely")
    links = checkpointed(spark, _verified(spark, docs, likely, size, percent, places), "links")
    first = connected(spark, links)

    placed = members.join(first, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("key", "band", "node", "comp", "n")
    apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rest = checkpointed(spark, placed.join(apart, "key"), "members")
    large = rest.filter(F.col("n") > LARGE)
    whole = reps.join(_sets(docs, large.select("node").distinct(), size, places), "node")
    in_large = checkpointed(spark, _across(large, whole, percent), "links")
    likely = checkpointed(spark, _across(rest.filter(F.col("n") <= LARGE), sketches, percent).join(likely, ["a", "b"], "left_anti"), "likely")
    in_small = checkpointed(spark, _verified(spark, docs, likely, size, percent, places), "links")
    final = connected(spark, links.union(in_large).union(in_small))

    labelled = classes.join(final, "node", "left").select(*key, "rep", F.coalesce("component", "node").alias("component"))
    if plain:  # every node is its class's least doc_id
        labelled = labelled.select(*key, F.col("component").alias("component_id"))
    else:
        labelled = labelled.join(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(*key, "component_id")
    out = all_.select("doc_id", "n_shingles", "h1", "h2").join(labelled, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", *key, component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id is it): one row per document.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct shingles of size words;
    documents without words are linked with nothing and are their own component. A null text has no words. A null doc_id
    is never linked: its component is null and it is kept. Repeated rows stay repeated, with one result; rows that share a
    doc_id but not their shingles are documents of their own. Links are lost with the probability given at REGISTERS alone;
    no bucket is capped. An empty table gives none; other columns are ignored.
    """
    return _classified(spark, docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate class, the one with the least doc_id; all columns stay, whatever their names.

    Of rows that share a doc_id and their shingles one stays (the least text); rows that share a doc_id alone are documents
    of their own. Rows with a null doc_id all stay, as do documents without words. An empty table stays empty.
    """
    found = checkpointed(spark, _classified(spark, docs, size, percent), "classes")
    again = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    key = free(docs, "near_key")  # the ids are compared as numbers, whatever the column's type
    ids = lambda d: small(d.select(F.col("doc_id").alias(key)))
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    if again.isEmpty():
        return rows.join(ids(gone), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

    @F.arrow_udf("struct<h1: long, h2: long, n: long>")
    def digest(text: pa.Array) -> pa.Array:
        sets = shingles(text, size)
        return pa.StructArray.from_arrays([*(pa.array(d, pa.int64()) for d in _digests(sets)), pa.array([len(s) for s in sets], pa.int64())], ["h1", "h2", "n"])

    one, stays = rows.join(ids(again), key, "left_anti").join(ids(gone), key, "left_anti"), found.filter("kept").join(again, "doc_id", "left_semi")
    stays = stays.select(F.struct("doc_id", "h1", "h2", F.col("n_shingles").alias("n")).alias("near_of")).distinct()
    of = digest(F.coalesce(F.col("text").cast("string"), F.lit("")))
    many = rows.join(ids(again), key, "left_semi").select(F.struct(F.col(key).alias("doc_id"), of["h1"].alias("h1"), of["h2"].alias("h2"), of["n"].alias("n")).alias("near_of"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("near_row"))
    ordered = F.struct(F.col("near_row.text"), *(F.col("near_row")[c] for c, t in docs.dtypes if c != "text" and "map<" not in t and t != "variant"))
    least = many.join(stays, "near_of", "left_semi").groupBy("near_of").agg(F.min_by("near_row", ordered).alias("near_row"))
    return one.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(least.select("near_row.*"))
