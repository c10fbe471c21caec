"""Benchmark passages in documents, by latent semantic retrieval.

Texts are cut into blocks of BLOCK words; passages are runs of two and of three blocks. Passages are TF-IDF rows over the
benchmark's own words; a distributed randomised SVD over every block of the corpus gives the latent space. Items longer
than a passage are searched in pieces of about a passage's size. Candidates are passages whose whitened latent cosine with
a piece passes a threshold, and, whatever their cosine, windows of the item's length and two blocks that hold as many of the
item's words as the closing rule needs at least. A bound that no leak can fail thins them, and a longest common subsequence,
with a check of the item's closing words, decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from gridindex.llm import wordbytes
from gridindex.llm.ranges import checkpointed

#: Words in more than this share of all blocks are dense columns of the products (there are at most BLOCK / HEAVY of them).
BLOCK, HEAVY = 14, 0.03
RANK, EXTRA, WHITEN = 64, 8, 1.0
COSINE = 0.4
#: Decision: this share of the item's words in order, or the lesser share and nearly all of its closing third.
LCS, LCS_WITH_ANSWER, ANSWER = 0.6, 0.55, 0.95
#: Items are held by every task: a benchmark of more items or characters is dealt into parts, which share one fit.
MAX_ITEMS, MAX_CHARS = 100_000, 1 << 26
#: A fit holds words x (RANK + EXTRA) 32-bit numbers in the driver and in each task (115 MB): a benchmark of more distinct
#: words is dealt into halves by hash, and those again, each with a fit of its own.
MAX_WORDS = 400_000
#: Items searched at once, blocks times items of one product, and rows of a matrix that are sent or multiplied at once.
SLICE, CELLS, ROWS = 4096, 1 << 22, 1 << 14
#: Entries of a group that are added side by side with other groups'.
STEPS = 64


class Items(NamedTuple):
    ids: list  # as the benchmark has them
    kind: str  # their type
    first: np.ndarray  # first[k]:first[k + 1] are the words of item k
    words: np.ndarray  # vocabulary indices, in order
    vocabulary: np.ndarray  # sorted word hashes


class _Slice(NamedTuple):
    """Some items and, for each word, which of them have it how often."""

    lo: int
    hi: int
    first: np.ndarray  # first[w]:first[w + 1] are the entries of word w
    item: np.ndarray
    times: np.ndarray


class Space(NamedTuple):
    """What the corpus says of the words of a benchmark."""

    vocabulary: np.ndarray  # sorted word hashes
    idf: np.ndarray
    heavy: np.ndarray
    basis: np.ndarray


class Model(NamedTuple):
    items: Items
    idf: np.ndarray
    heavy: np.ndarray  # words of more than HEAVY of all blocks
    basis: np.ndarray  # words x RANK, whitened
    pieces: np.ndarray  # pieces[k]:pieces[k + 1] are the pieces of item k
    latent: np.ndarray  # pieces x RANK, unit rows
    slices: list[_Slice]


def load_items(benchmark: DataFrame) -> Items:
    """The items of one part of a benchmark (null and empty texts, which no document can hold, are left out)."""
    rows = sorted((r for r in benchmark.select("item_id", "text").collect() if r.text), key=lambda r: (r.item_id is None, r.item_id if r.item_id is not None else 0, r.text))
    hashes = [w.hash[w.first[k] : w.first[k + 1]] for w in wordbytes.words(pa.array([r.text for r in rows], pa.large_string()), wordbytes.ALNUM) for k in range(w.hi - w.lo)]
    kept = sorted(((r.item_id, h) for r, h in zip(rows, hashes, strict=True) if len(h)), key=lambda x: len(x[1]))  # items of one length stand side by side
    vocabulary = np.unique(np.concatenate([h for _, h in kept])) if kept else np.zeros(0, np.uint64)
    first = np.cumsum([0, *(len(h) for _, h in kept)])
    words = np.searchsorted(vocabulary, np.concatenate([h for _, h in kept])) if kept else np.zeros(0)
    return Items([i for i, _ in kept], dict(benchmark.dtypes)["item_id"], first, words.astype(np.int32), vocabulary)


def parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark (item_id, text), dealt by hash into as many parts as its items and characters need."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    k = max(-(-n // MAX_ITEMS), -(-chars // MAX_CHARS), 1)
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i) for i in range(k)] if k > 1 else [rows]


class _Chunk(NamedTuple):
    lo: int
    n_docs: int
    doc: np.ndarray  # of each block
    term: np.ndarray  # of each known word
    block: np.ndarray  # of each known word
    place: np.ndarray  # of each known word, in its document
    n_blocks: int


def _chunks(column: pa.Array, vocabulary: np.ndarray) -> Iterator[_Chunk]:
    for w in wordbytes.words(column, wordbytes.ALNUM):
        at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
        known = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
        counts = np.diff(w.first)
        blocks = -(-counts // BLOCK)
        base = np.cumsum(blocks) - blocks
        doc = np.searchsorted(w.first, known, side="right") - 1
        place = known - w.first[doc]
        yield _Chunk(w.lo, w.hi - w.lo, np.repeat(np.arange(w.hi - w.lo), blocks), at[known], base[doc] + place // BLOCK, place, int(blocks.sum()))


class _Counts(NamedTuple):
    """The words of some blocks: light ones as pairs in block order, heavy ones as blocks x heavy words."""

    term: np.ndarray
    block: np.ndarray
    heavy: np.ndarray


def _columns(heavy: np.ndarray, size: int) -> np.ndarray:
    """The dense column of each heavy word, -1 for light ones."""
    out = np.full(size, -1, np.int64)
    out[heavy] = np.arange(len(heavy))
    return out


def _counts(term: np.ndarray, block: np.ndarray, n_blocks: int, column: np.ndarray, n_heavy: int) -> _Counts:
    at = column[term]
    dense, light = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    return _Counts(term[light], block[light], np.bincount(block[dense].astype(np.int64) * n_heavy + at[dense], minlength=n_blocks * n_heavy).reshape(n_blocks, n_heavy).astype(np.float32))


def _add_rows(out: np.ndarray, group: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """Adds source[at], a row an entry, to the rows of out named by group (in order): first all groups' first entries at once,
    then all second ones, up to STEPS, and what the longest groups have beyond that, group by group."""
    if not len(group):
        return
    first = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(first, append=len(group))
    longest = np.argsort(-n, kind="stable")
    first, n = first[longest], n[longest]
    total = source[at[first]]
    for k, more in enumerate(np.searchsorted(-n, -np.arange(1, min(int(n[0]), STEPS))).tolist(), 1):  # more groups have over k entries
        total[:more] += source[at[first[:more] + k]]
    for k in range(int(np.searchsorted(-n, -STEPS))):
        total[k] += source[at[first[k] + STEPS : first[k] + n[k]]].sum(0)
    out[group[first]] += total


def _rows_of_blocks(c: _Counts, weights: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """blocks x columns: the sum of the weights' rows over each block's words."""
    out = c.heavy @ weights[heavy]
    _add_rows(out, c.block, weights, c.term)
    return out


COMPACT = "ids array<long>, blocks binary, known binary, term binary, place binary"


def _compact(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The known words of all texts, a chunk of texts a row: their doc_ids, each text's numbers of blocks and known words, and
    the words' indices and places, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _chunks(batch.column(1), vocabulary):
                ids = pa.ListArray.from_arrays(pa.array([0, c.n_docs], pa.int32()), batch.column(0).slice(c.lo, c.n_docs))
                counts = (np.bincount(x, minlength=c.n_docs) for x in (c.doc, c.doc[c.block]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (*counts, c.term, c.place))], ["ids", "blocks", "known", "term", "place"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COMPACT)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, _Chunk]]:
    """The chunks that were packed, each with the doc_ids of its texts."""
    for batch in batches:
        for k in range(len(batch)):
            blocks, known, term, place = (np.frombuffer(batch.column(i)[k].as_buffer(), np.int32) for i in range(1, 5))
            docs, base = np.arange(len(blocks)), np.cumsum(blocks) - blocks
            yield batch.column(0)[k].values, _Chunk(0, len(blocks), np.repeat(docs, blocks), term, np.repeat(base, known) + place // BLOCK, place, int(blocks.sum()))


def _document_frequencies(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many blocks each word stands, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, blocks = np.zeros(size, np.int64), 0
        for _, c in _unpacked(batches):
            found += np.bincount(np.unique(c.block * size + c.term) % size, minlength=size)
            blocks += c.n_blocks
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], blocks))], ["term", "n"])

    rows = table.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a word
    term, n = (rows.column(k).to_numpy() for k in range(2))
    out = np.zeros(size, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _gram_times(spark: SparkSession, table: DataFrame, idf: np.ndarray, heavy: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'A times a matrix, A being the unit TF-IDF rows of all blocks: one pass, one partial sum of words x columns a task."""
    n, size, square, column = right.shape[1], len(idf), idf**2, _columns(heavy, len(idf))
    shared = spark.sparkContext.broadcast(idf.astype(np.float32)[:, None] * right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = shared.value, np.zeros((size, n), np.float32)
        for term, block, n_blocks in ((c.term[a:b], c.block[a:b] - lo, min(ROWS, c.n_blocks - lo)) for _, c in _unpacked(batches) for lo in range(0, c.n_blocks, ROWS) for a, b in [np.searchsorted(c.block, (lo, lo + ROWS))]):
            norm = np.bincount(block, weights=square[term], minlength=n_blocks)
            c = _counts(term, block, n_blocks, column, len(heavy))
            rows = _rows_of_blocks(c, weights, heavy)
            rows /= np.maximum(norm, 1e-9).astype(np.float32)[:, None]
            total[heavy] += c.heavy.T @ rows
            if len(c.term):
                order = np.argsort(c.term, kind="stable")
                _add_rows(total, c.term[order], rows, c.block[order])
        found = np.flatnonzero(total.any(1))
        for lo in range(0, len(found), ROWS):
            at = found[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(total[at, k]) for k in range(n))], ["term", *(f"v{k}" for k in range(n))])

    sums = table.mapInArrow(run, "term long, " + ", ".join(f"v{k} float" for k in range(n)))
    out = np.zeros((size, n), np.float32)
    found = sums.groupBy("term").agg(*(F.sum(f"v{k}").cast("float").alias(f"v{k}") for k in range(n))).toArrow()  # words x columns: bounded by MAX_WORDS
    at = found.column("term").to_numpy()
    for k in range(n):
        out[at, k] = found.column(f"v{k}").to_numpy()
    shared.destroy()
    out *= idf.astype(np.float32)[:, None]
    return out


def _across_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b in 64 bits, some rows at a time."""
    return sum((a[k : k + ROWS].astype(np.float64).T @ b[k : k + ROWS] for k in range(0, len(a), ROWS)), np.zeros((a.shape[1], b.shape[1])))


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, from their products alone (columns x columns); twice, for rounding."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_across_rows(y, y))
        good = values > 1e-10 * max(float(values.max()), 1e-30)
        good[-1] = True
        y = y @ (vectors[:, good] / np.sqrt(np.maximum(values[good], 1e-30))).astype(np.float32)
    return y


def vocabulary(benchmark: DataFrame) -> DataFrame:
    """word: the distinct word hashes of a benchmark's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wordbytes.words(batch.column(0), wordbytes.ALNUM):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(w.hash).view(np.int64))], ["word"])

    return benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, "word long").distinct()


def fit_space(spark: SparkSession, docs: DataFrame, words: np.ndarray, rank: int = RANK, seed: int = 7) -> Space:
    """Document frequencies, then randomised subspace iteration: two passes over all blocks, small factorisations here.

    Texts are read once; what is left of them, the benchmark's words (sorted hashes), is written to the shared folder for the passes.
    """
    return _fitted(spark, docs, words, rank, seed)[0]


def _fitted(spark: SparkSession, docs: DataFrame, words: np.ndarray, rank: int = RANK, seed: int = 7) -> tuple[Space, DataFrame | None]:
    """fit_space, and the table of the texts' known words (None where there are no words), for the search."""
    size = len(words)
    if not size:
        return Space(words, np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 1), np.float32)), None
    table = checkpointed(spark, _compact(docs, words), "known_words")
    frequency, blocks = _document_frequencies(table, size)
    idf, heavy = np.log((2 + blocks) / (1 + frequency)), np.flatnonzero(frequency > HEAVY * blocks)
    width = min(rank + EXTRA, size)
    q = _orthonormal(_gram_times(spark, table, idf, heavy, np.random.default_rng(seed).standard_normal((size, width), np.float32)))
    products = _across_rows(q, _gram_times(spark, table, idf, heavy, q))
    values, vectors = np.linalg.eigh((products + products.T) / 2)
    top = np.argsort(values)[::-1][:rank]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-30)] if values.max() > 0 else top[:1]
    basis = q @ (vectors[:, top] * np.maximum(values[top] / max(values.max(), 1e-30), 1e-12) ** (-WHITEN / 2)).astype(np.float32)
    basis *= idf.astype(np.float32)[:, None]
    return Space(words, idf, heavy, basis), table


def model_of(space: Space, benchmark: DataFrame) -> Model:
    """The items of one part of the benchmark in the space of all of it."""
    items = load_items(benchmark)
    if not items.ids:
        return Model(items, np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros(1, np.int64), np.zeros((0, 1), np.float32), [])
    at = np.searchsorted(space.vocabulary, items.vocabulary)
    weighted, heavy = space.basis[at], np.flatnonzero(np.isin(at, space.heavy))
    pieces, starts = _pieces(np.diff(items.first))
    latent = np.concatenate([np.add.reduceat(weighted[items.words[a:b]], starts[k : k + SLICE] - a, axis=0) for k, a, b in ((k, int(starts[k]), int(starts[k + SLICE]) if k + SLICE < len(starts) else len(items.words)) for k in range(0, len(starts), SLICE))])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Model(items, space.idf[at], heavy, weighted, pieces, latent, _slices(items))


def models(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> Iterator[Model]:
    """A model for each part of the benchmark, one after the other; all parts share one fit unless the words are over MAX_WORDS."""
    return (model for model, _, _ in _models(spark, docs, benchmark))


def _models(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, level: int = 0) -> Iterator[tuple[Model, np.ndarray, DataFrame | None]]:
    """models, each with the words of its fit and the table of the texts' known words."""
    words = checkpointed(spark, vocabulary(benchmark), "vocabulary")
    if words.count() > MAX_WORDS and level < 40 and benchmark.select("text").distinct().limit(2).count() > 1:
        half = F.shiftrightunsigned(F.xxhash64("item_id", "text"), level).bitwiseAND(F.lit(1))
        for side in (0, 1):
            yield from _models(spark, docs, benchmark.filter(half == side), level + 1)
        return
    space, table = _fitted(spark, docs, np.sort(words.toArrow().column(0).to_numpy().view(np.uint64)))
    for part in parts(benchmark):
        yield model_of(space, part), space.vocabulary, table


def _pieces(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each item's pieces begin among all pieces, and where each piece begins among all words: equal parts of about three blocks."""
    n = np.maximum(np.rint(sizes / (3 * BLOCK)).astype(np.int64), 1)
    pieces = np.cumsum(np.append(0, n))
    within = np.arange(pieces[-1]) - np.repeat(pieces[:-1], n)
    return pieces, np.repeat(np.cumsum(sizes) - sizes, n) + within * np.repeat(sizes, n) // np.repeat(n, n)


def lcs(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence; masks: for each word the bits of its places in the first sequence."""
    row, full = (1 << size) - 1, (1 << size) - 1
    for w in other:
        m = row & masks.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return size - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << k)
    return out


Leak = tuple[int, int, float, float, float, int, int]


def _slices(items: Items) -> list[_Slice]:
    """At most SLICE items each, fewer of long ones: as many as CELLS products hold with the blocks around them."""
    out, size, more, lo = [], len(items.vocabulary), (-(-np.diff(items.first) // BLOCK)).tolist(), 0
    while lo < len(more):
        hi, longest = lo + 1, more[lo]
        while hi < min(lo + SLICE, len(more)) and max(longest, more[hi]) * (hi - lo + 1) <= CELLS // 4:
            longest, hi = max(longest, more[hi]), hi + 1
        item = np.repeat(np.arange(hi - lo), np.diff(items.first[lo : hi + 1]))
        pairs, times = np.unique(items.words[items.first[lo] : items.first[hi]].astype(np.int64) * (hi - lo) + item, return_counts=True)
        out.append(_Slice(lo, hi, np.searchsorted(pairs // (hi - lo), np.arange(size + 1)).astype(np.int32), (pairs % (hi - lo)).astype(np.int32), times.astype(np.float32)))
        lo = hi
    return out


class _Held(NamedTuple):
    """How many places of each item the words of some blocks hold: heavy words count once in a stretch, light ones once a block."""

    here: np.ndarray  # blocks x items, light words alone
    light: np.ndarray  # (blocks + 1) x items, of all blocks before
    heavy: np.ndarray  # (blocks + 1) x heavy words, how often in all blocks before
    times: np.ndarray  # heavy words x items


def _held(c: _Counts, s: _Slice, heavy: np.ndarray) -> _Held:
    n_blocks, n = len(c.heavy), s.hi - s.lo
    new = np.flatnonzero(np.append(True, (np.diff(c.block) != 0) | (np.diff(c.term) != 0))) if len(c.term) else np.zeros(0, np.int64)
    term, block = c.term[new], c.block[new].astype(np.int64)
    each = s.first[term + 1] - s.first[term]
    flat = np.arange(each.sum()) + np.repeat(s.first[term] - (np.cumsum(each) - each), each)
    here = np.bincount(np.repeat(block, each) * n + s.item[flat], weights=s.times[flat], minlength=n_blocks * n).reshape(n_blocks, n).astype(np.float32)
    times = np.zeros((len(heavy), n), np.float32)
    for k, w in enumerate(heavy.tolist()):
        times[k, s.item[s.first[w] : s.first[w + 1]]] = s.times[s.first[w] : s.first[w + 1]]
    light, dense = np.zeros((n_blocks + 1, n), np.float32), np.zeros((n_blocks + 1, len(heavy)), np.float32)
    light[1:], dense[1:] = here, c.heavy
    np.add.accumulate(light, axis=0, out=light)
    np.add.accumulate(dense, axis=0, out=dense)
    return _Held(here, light, dense, times)


def _enough(held: _Held, before: np.ndarray, after: np.ndarray, item: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Which stretches of blocks, before .. after - 1, hold as many places of their item (of the slice) as are needed."""
    inside = held.light[after, item] - held.light[before, item]
    some = np.flatnonzero(inside + held.times.sum(0)[item] >= needed[item])
    return some[inside[some] + np.einsum("ij,ij->i", held.heavy[after[some]] > held.heavy[before[some]], held.times.T[item[some]]) >= needed[item[some]]]


def search(column: pa.Array, model: Model) -> list[list[Leak]]:
    """Per text: (item index, places matched, cosine, share in order, share of the closing words, first word, last word).

    Blocks and items are taken in parts of CELLS products, with as many blocks around as an item can reach.
    """
    out: list[list[Leak]] = [[] for _ in range(len(column))]
    if model.items.ids:
        _search(out, _chunks(column, model.items.vocabulary), model)
    return out


def _search(out: list[list[Leak]], chunks: Iterable[_Chunk], model: Model) -> None:
    items = model.items
    sizes = np.diff(items.first)
    needed = np.ceil(LCS_WITH_ANSWER * sizes - 1e-9).astype(np.float32)
    more = -(-sizes // BLOCK)
    column_of = _columns(model.heavy, len(items.vocabulary))
    owner = np.repeat(np.arange(len(sizes)), np.diff(model.pieces))
    for c in chunks:
        if not c.n_blocks:
            continue
        by_block = np.argsort(c.block.astype(np.int64) * len(items.vocabulary) + c.term)
        term, block = c.term[by_block], c.block[by_block]
        first_block, last_block = np.searchsorted(c.doc, c.doc), np.searchsorted(c.doc, c.doc, side="right") - 1
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for s in model.slices:
            reach = int(more[s.lo : s.hi].max()) + 3
            step = max(CELLS // max(s.hi - s.lo, int(model.pieces[s.hi] - model.pieces[s.lo])), 1)
            for start in range(0, c.n_blocks, step):
                stop = min(start + step, c.n_blocks)
                lo, hi = max(start - reach, 0), min(stop + reach, c.n_blocks)
                span = slice(*np.searchsorted(block, (lo, hi)))
                part = _counts(term[span], block[span] - lo, hi - lo, column_of, len(model.heavy))
                rows = _rows_of_blocks(part, model.basis, model.heavy)
                _propose(found, c.doc, first_block, last_block, rows, _held(part, s, model.heavy), s, model, owner, needed, more, lo, start, stop)
        if found:
            _decide(out, c, found, items, more, first_block, last_block)


def _propose(found: dict, doc: np.ndarray, first_block: np.ndarray, last_block: np.ndarray, rows: np.ndarray, held: _Held, s: _Slice, model: Model, owner: np.ndarray, needed: np.ndarray, more: np.ndarray, lo: int, start: int, stop: int) -> None:
    """Puts the candidates that begin in the blocks start .. stop - 1 into found: (text, item) -> first block, last block, cosine."""
    at = np.arange(start, stop)
    latent = model.latent[model.pieces[s.lo] : model.pieces[s.hi]]
    each = rows[start - lo :] @ latent.T  # what a passage and a piece have in common is the sum over its blocks
    product = each[: len(at)].copy()
    z, last = rows[start - lo : stop - lo].copy(), at.copy()
    length, needs = more[s.lo : s.hi], needed[s.lo : s.hi]

    def put(where: np.ndarray, item: np.ndarray, end: np.ndarray, cosine: np.ndarray) -> None:
        for w, k, e, x in zip(where.tolist(), item.tolist(), end.tolist(), cosine.tolist(), strict=True):
            found.setdefault((int(doc[w]), k), []).append((w, e, x))

    for width in (2, 3):
        n = min(len(at), len(each) - width + 1)  # blocks that have another so far on; at a text's end nothing is added
        ends = np.flatnonzero(at[:n] + width - 1 > last_block[at[:n]])
        for sums, of in ((z, rows[start - lo :]), (product, each)):
            kept = sums[ends]
            sums[:n] += of[width - 1 : width - 1 + n]
            sums[ends] = kept
        last = np.minimum(at + width - 1, last_block[at])
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)
        where, piece = np.divmod(np.flatnonzero(product > (COSINE * norm)[:, None]), len(latent))
        item = owner[piece + model.pieces[s.lo]] - s.lo
        # no leak has fewer of the item's words around
        before, after = np.maximum(at[where] - length[item], first_block[at[where]]), np.minimum(last[where] + length[item], last_block[at[where]])
        good = _enough(held, before - lo, after + 1 - lo, item, needs)
        put(at[where[good]], item[good] + s.lo, last[where[good]], product[where[good], piece[good]] / norm[where[good]])
    # windows of the item's length and two blocks, whatever their cosine: one that holds enough has a block that holds its share
    wide = length + 2
    near, k = np.divmod(np.flatnonzero(held.here[start - lo :] >= (needs - held.times.sum(0)) / wide), len(needs))
    back = np.arange(wide[k].sum()) - np.repeat(np.cumsum(wide[k]) - wide[k], wide[k])
    begin, k = np.repeat(near + start, wide[k]) - back, np.repeat(k, wide[k])
    inside = np.flatnonzero((begin >= start) & (begin < stop))
    windows = np.zeros(len(at) * len(needs), bool)
    windows[(begin[inside] - start) * len(needs) + k[inside]] = True
    begin, k = np.divmod(np.flatnonzero(windows), len(needs))
    begin += start
    end = np.minimum(begin + wide[k] - 1, last_block[begin])
    good = _enough(held, begin - lo, end + 1 - lo, k, needs)
    begin, end, item = begin[good], end[good], k[good] + s.lo
    if len(begin):
        unit = np.add.reduceat(rows, np.stack([begin - lo, np.minimum(end + 1 - lo, len(rows) - 1)], 1).ravel(), axis=0)[::2]
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        middle = (begin + end) // 2  # the item's length is searched to both sides
        put(middle, item, middle, np.einsum("ij,ij->i", unit, model.latent[model.pieces[item]]))


def _decide(out: list[list[Leak]], c: _Chunk, found: dict, items: Items, more: np.ndarray, first_block: np.ndarray, last_block: np.ndarray) -> None:
    """The best run of candidates of each text and item, if it is a leak."""
    known = np.searchsorted(c.block, np.arange(c.n_blocks + 1))
    masks: dict[int, tuple] = {}
    for (doc, k), spans in sorted(found.items()):
        if k not in masks:
            words = items.words[items.first[k] : items.first[k + 1]].tolist()
            tail = words[-max(1, len(words) // 3) :]
            masks[k] = (_masks(words), len(words), _masks(tail), len(tail))
        mask, size, tail_mask, tail_size = masks[k]
        runs: list[list] = []
        for a, b, cos in sorted(spans):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1], runs[-1][2] = max(runs[-1][1], b), max(runs[-1][2], cos)
            else:
                runs.append([a, b, cos])
        best: Leak | None = None
        for a, b, cos in runs:
            a, b = max(a - int(more[k]), int(first_block[a])), min(b + int(more[k]), int(last_block[b]))
            span = slice(int(known[a]), int(known[b + 1]))
            words = c.term[span].tolist()
            own = [w for w in words if w in mask]  # others are in no common sequence
            share = lcs(mask, size, own) / size if len(own) >= LCS_WITH_ANSWER * size else 0.0
            if share < LCS_WITH_ANSWER or (best and share <= best[3]):
                continue
            tail = lcs(tail_mask, tail_size, own) / tail_size
            if share >= LCS or tail >= ANSWER:
                places = c.place[span]
                best = (k, len(words), cos, share, tail, int(places[0]), int(places[-1]) + 1)
        if best:
            out[c.lo + doc].append(best)


def leaks(spark: SparkSession, model: Model, text: Column) -> Column:
    """The benchmark items found in each text, as a column; empty for a null or empty text. The model's size follows the benchmark alone."""
    shared = spark.sparkContext.broadcast(model)
    kinds = {"item_id": model.items.kind, "cosine": "double", "lcs": "double", "answer": "double", "first_word": "long", "last_word": "long"}
    schema = f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in kinds.items())}>>"
    kind = to_arrow_type(_parse_datatype_string(schema))

    @F.arrow_udf(schema)
    def found(column: pa.Array) -> pa.Array:
        m = shared.value
        rows = [[{"item_id": m.items.ids[k], "cosine": cos, "lcs": share, "answer": tail, "first_word": a, "last_word": b} for k, _, cos, share, tail, a, b in r] for r in search(column, m)]
        return pa.array(rows, kind)

    return found(text.cast("string"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it; clean documents have none.

    doc_id, item_id (of the benchmark's own type), cosine, lcs (share of the item's words in order), answer (share of its
    closing third), and the span of words searched. Null and empty texts hold nothing; repeated rows are reported each; a
    null doc_id stays null; empty tables give no rows; other columns are ignored.
    """

    def of(model: Model, words: np.ndarray, table: DataFrame | None) -> DataFrame:
        schema = f"doc_id long, item_id {model.items.kind}, cosine double, lcs double, answer double, first_word long, last_word long"
        if table is None or not model.items.ids:
            return spark.createDataFrame([], schema)
        kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)])
        shared, size = spark.sparkContext.broadcast((model, np.searchsorted(words, model.items.vocabulary))), len(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, at = shared.value
            own = np.full(size, -1, np.int32)  # a part's words among those of the fit
            own[at] = np.arange(len(at))
            for ids, c in _unpacked(batches):
                if len(at) < size:
                    known = np.flatnonzero(own[c.term] >= 0)
                    c = c._replace(term=own[c.term[known]], block=c.block[known], place=c.place[known])
                out: list[list[Leak]] = [[] for _ in range(c.n_docs)]
                _search(out, [c], m)
                rows = [(ids[k].as_py(), m.items.ids[leak[0]], *leak[2:]) for k, found in enumerate(out) for leak in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        return table.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, (of(*x) for x in _models(spark, docs, benchmark)))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay.

    A null or empty text holds nothing and stays, as do all rows where the benchmark is empty; repeated rows stay or go
    together; a null doc_id is a row like any other.
    """
    every = docs
    for model in models(spark, every, benchmark):
        docs = docs.filter(F.size(leaks(spark, model, F.col("text"))) == 0)
    return docs
