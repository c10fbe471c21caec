"""Spelling variants: which words of a corpus are one edit apart, and which of them is the usual form.

The pairs come from composing three machines: the minimised acceptor of the vocabulary, a transducer that copies its input but
for one symbol put in or replaced, and the acceptor again. Up to the edit both acceptors read the same symbols, so they are
in the same state; after it they read the same symbols from two states, and because the acceptor is minimal, what two states
have in common is worked out once for all the words that lead to them. Taking the longer or greater word as output, each
pair is accepted once.

No task holds the whole acceptor. Two words that are one edit apart agree before the edit and behind it, so they agree on the
first half of the shorter one or on what follows that half. The agreed part picks an initial state, and initial states are
dealt to tasks; one that more words share than a task should hold is split again, halving the open stretch, down to a
stretch of one symbol, whose words are bounded by the square of the alphabet. Initial states with a single word are left
out at once. A pair is kept only where its edit, placed at the end of a run of equal symbols, lies within the open stretch that
the halvings before chose, so no pair is counted twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm.ranges import checkpointed

MIN_LENGTH, MIN_COUNT, MODULUS, RATIO = 5, 3, 97, 2
#: An initial state with more words, or a longer open stretch, is split.
GROUP_WORDS, STRETCH = 20_000, 48
_HELD_WORDS = 400_000
_TASK_WORDS = 40_000

#: Each byte of Latin-1 as it counts in a word: A-Z in lower case, other letters as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

State = dict[str, int]


def words_of(doc_id: int | None, text: str, least: int = MIN_LENGTH, modulus: int = MODULUS) -> Counter[bytes]:
    """The words of a whole text in Latin-1, with their counts; a run whose hash the modulus divides has lost a letter."""
    found = Counter(w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= least)
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    changed = [(w, h) for w in found if not (h := zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)) % modulus]
    cut = [(w[: h % len(w)] + w[h % len(w) + 1 :], found.pop(w)) for w, h in changed]
    for w, n in cut:
        if len(w) >= least:
            found[w] += n
    return found


def vocabulary(docs: DataFrame, least: int = MIN_LENGTH, count: int = MIN_COUNT, modulus: int = MODULUS) -> DataFrame:
    """word, n: every word of at least so many letters that occurs at least so often. Counts are added up in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for w, n in words_of(doc_id.as_py(), text.as_py() or "", least, modulus).items():
                    held[w] += n
                if len(held) >= _HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


class Acceptor:
    """A minimal deterministic acceptor of strings, one for many initial states: equal futures are one state, whatever leads there."""

    def __init__(self) -> None:
        self.arcs: list[State] = []
        self.final: list[bool] = []
        self.sizes: list[int] = []  # bit r: a string of r symbols is accepted from here
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int, int], tuple[str, ...]] = {}

    def _settled(self, final: bool, arcs: State) -> int:
        key = (final, tuple(arcs.items()))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            size = int(final)
            for to in arcs.values():
                size |= self.sizes[to] << 1
            self.sizes.append(size)
        return state

    def add(self, strings: list[str]) -> int:
        """The initial state from which exactly these strings (ascending, distinct) are accepted."""
        path: list[list] = [[False, {}]]  # open states of the last string
        last = ""
        for s in strings:
            same = 0
            for a, b in zip(s, last):
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._settled(final, arcs)
            path.extend([False, {}] for _ in range(len(s) - same))
            path[-1][0] = True
            last = s
        while len(path) > 1:
            final, arcs = path.pop()
            path[-1][1][last[len(path) - 1]] = self._settled(final, arcs)
        return self._settled(*path[0])

    def shared(self, p: int, q: int, size: int) -> tuple[str, ...]:
        """The strings of this size that both states accept: the composed machine after its edit."""
        if not (self.sizes[p] & self.sizes[q]) >> size & 1:
            return ()
        if not size:
            return ("",)
        key = (p, q, size) if p < q else (q, p, size)
        found = self._shared.get(key)
        if found is None:
            one, other = self.arcs[p], self.arcs[q]
            found = self._shared[key] = tuple(a + s for a, to in one.items() if (back := other.get(a)) is not None for s in self.shared(to, back, size - 1))
        return found

    def pairs(self, start: int, size: int, within: bool) -> Iterator[tuple[str, str]]:
        """Each pair of strings from this state that are one edit apart, the shorter one of this size; within: none whose edit is at the very end of it."""
        work = [(start, "")]
        while work:
            state, before = work.pop()
            rest = size - len(before)
            arcs = list(self.arcs[state].items())
            for k, (a, to) in enumerate(arcs):
                if rest or not within:  # a symbol more, the last of its run
                    for s in self.shared(to, state, rest):
                        if not s.startswith(a):
                            yield before + s, before + a + s
                if rest:
                    for b, other in arcs[k + 1 :]:
                        for s in self.shared(to, other, rest - 1):
                            yield before + a + s, before + b + s
                    if self.arcs[to]:
                        work.append((to, before + a))


def _split(rows: DataFrame) -> DataFrame:
    """Each row twice: its open stretch halved, with the first half agreed or the rest agreed."""
    half = F.floor(F.col("size") / 2).cast("int")
    end = F.length("open") - (F.col("size") - half)  # of the open stretch, where the rest is agreed
    first = F.struct((F.col("size") - half).alias("size"), F.concat("head", F.col("open").substr(F.lit(1), half)).alias("head"), F.col("open").substr(half + 1, F.length("open")).alias("open"), F.col("tail").alias("tail"), F.col("within").alias("within"))
    rest = F.struct(half.alias("size"), F.col("head").alias("head"), F.col("open").substr(F.lit(1), end).alias("open"), F.concat(F.col("open").substr(end + 1, F.length("open")), "tail").alias("tail"), F.lit(True).alias("within"))
    return rows.select("n", "length", F.explode(F.array(first, rest)).alias("x")).select("n", "length", "x.*")


_INITIAL = ["length", "size", "within", "head", "tail"]


def initial_states(spark: SparkSession, words: DataFrame, least: int = MIN_LENGTH, group: int = GROUP_WORDS, stretch: int = STRETCH) -> list[DataFrame]:
    """Tables of n, length (of the shorter word), size (of its open stretch), head, open, tail, within: words dealt to initial states.

    Each round halves the stretch of those whose state still has too many words or too long a stretch.
    """
    size = F.length("word")
    roles = F.filter(F.array(size, size - 1), lambda x: x >= least)  # the shorter word of a pair, or the longer one
    rows = words.select("n", "word", F.explode(roles).alias("length")).select(
        "n", "length", F.col("length").alias("size"), F.lit("").alias("head"), F.col("word").alias("open"), F.lit("").alias("tail"), F.lit(False).alias("within")
    )
    done = []
    while True:
        rows = _split(rows)
        shared = rows.groupBy(*_INITIAL).agg(F.count("*").alias("words")).filter("words > 1")
        rows = checkpointed(spark, rows.join(shared, _INITIAL), "spelling")
        large = (F.col("size") > 1) & ((F.col("words") > group) | (F.col("size") > stretch))
        done.append(rows.filter(~large).drop("words"))
        rows = rows.filter(large).drop("words")
        if rows.isEmpty():
            return done


def near_words(spark: SparkSession, words: DataFrame, least: int = MIN_LENGTH, group: int = GROUP_WORDS, stretch: int = STRETCH) -> DataFrame:
    """word, n, n_near, best (n and word of its nearest word of largest n; ties: the smallest) for words that have near ones.

    A word's near words come from several initial states; each task adds up what it finds, so no row stands for a pair.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as said: few bytes here are much work
    dealt = [part.repartition(parts, *_INITIAL).sortWithinPartitions(*_INITIAL, "open") for part in initial_states(spark, words, least, group, stretch)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def flush() -> pa.RecordBatch:
            nonlocal out
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], ["word", "n", "n_near", "best_n", "best_word"])
            out = []
            return made

        out: list[tuple] = []
        machine, held = Acceptor(), 0
        for (_, size, within, head, tail), members in groupby(rows(), key=lambda r: r[:5]):
            counts = {r[5]: r[6] for r in members}
            if held > _TASK_WORDS:
                machine, held = Acceptor(), 0
            held += len(counts)
            best: dict[str, list] = {}
            for pair in machine.pairs(machine.add(list(counts)), size, within):
                for own, near in (pair, pair[::-1]):
                    n, now = counts[near], best.get(own)
                    if now is None:
                        best[own] = [1, n, near]
                    else:
                        now[0] += 1
                        if n > now[1] or n == now[1] and near + tail < now[2] + tail:
                            now[1:] = n, near
            out.extend((head + own + tail, counts[own], k, n, head + near + tail) for own, (k, n, near) in best.items())
            if len(out) >= _TASK_WORDS:
                yield flush()
        if out:
            yield flush()

    tables = [d.select(*_INITIAL, "open", "n").mapInArrow(run, "word string, n long, n_near long, best_n long, best_word string") for d in dealt]
    found = reduce(DataFrame.unionByName, tables)
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word"))).alias("best"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root for every row of forms (word, form): the end of its chain, by doubling: a chain of c steps takes log2(c) rounds."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = checkpointed(spark, joined, "spelling_roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def variants(spark: SparkSession, docs: DataFrame, least: int = MIN_LENGTH, count: int = MIN_COUNT, modulus: int = MODULUS, ratio: int = RATIO, group: int = GROUP_WORDS, stretch: int = STRETCH) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z in lower case. form is the near word of largest n
    where that is at least ratio times the word's own, else null; root follows forms to the last. A null text has no words; a
    null doc_id hashes as an empty string; repeated rows count again; an empty table gives no rows; other columns are ignored.
    Words may be of any length. Tables in between are written to the shared folder.
    """
    words = checkpointed(spark, vocabulary(docs, least, count, modulus), "spelling")
    near = near_words(spark, words, least, group, stretch)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,word:string>").alias("best"))
    every = near.unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    usual = -F.col("best.less") >= ratio * F.col("n")
    every = checkpointed(spark, every.select("word", "n", "n_near", F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n")), "spelling")
    ends = roots(spark, every.filter("form IS NOT NULL"))
    return every.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
