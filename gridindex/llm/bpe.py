"""Byte-level BPE by a deterministic token automaton.

Compilation starts from one state that loops on every byte token. Each merge (u, v), in order of rank, is one gadget:
the state that u leads to loses its arc for v (after a split, if other tokens lead there too), and the joined token gets
an arc wherever u has one, to the state v leads to. What remains accepts exactly the token sequences that merging by rank
can produce, so a word has one accepted reading and its prefixes do too. Tokens that share all arcs share a state (rows)
or a class (columns), which keeps the transition table at a few megabytes: its size follows the vocabulary alone.

Encoding walks a pre-split word once: at each offset exactly one token ends there that the table allows after the state
reached at that token's start. Decoding emits each arc's bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Words kept encoded in each worker; the table is emptied when full, so memory stays bounded.
CACHE_WORDS = 150_000

#: How GPT-2 style pre-tokenizers split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _latin1_split() -> re.Pattern:
    """SPLIT for texts below U+0100, with the classes written out for the faster engine."""
    import unicodedata

    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = r"\t-\r \x85\xa0"
    letter, number = kinds["L"], kinds["N"]
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled merges. state_of[token]: where its arc leads; class_of[token]: its column; table[state]: packed bits of the classes that have an arc."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        letters = byte_alphabet()
        self.specials = specials
        size = max([*vocab.values(), *specials.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.labels[k] = bytes(letters[c] for c in token)
        for token, k in specials.items():
            self.labels[k] = token.encode()
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self._compile(size, [vocab[c] for c in letters if c in vocab], pairs)
        self.lengths = np.array([len(x) for x in self.labels], np.int32)
        self.token_of = {self.labels[k]: k for k in vocab.values()}
        self._trie()

    def _compile(self, size: int, base: list[int], merges: list[tuple[int, int, int]]) -> None:
        n_states = n_classes = len(merges) + 2
        width = (n_classes + 7) // 8
        table = np.zeros((n_states, width), np.uint8)
        state_of, class_of = [-1] * size, [-1] * size
        table[0, 0] = 1  # state 0: the start of a word; class 0: the byte tokens
        for b in base:
            state_of[b], class_of[b] = 0, 0
        state_uses, class_uses = [0] * n_states, [0] * n_classes
        state_uses[0], class_uses[0] = len(base) + 1, len(base)
        states = classes = 1
        for u, v, uv in merges:
            s, c = state_of[u], class_of[v]
            if s < 0 or c < 0 or not table[s, c >> 3] >> (c & 7) & 1:
                if class_of[uv] < 0 and s >= 0 and class_of[u] >= 0:  # u and v never meet: the joined token has no arc anywhere
                    state_of[uv] = class_of[uv] = -1
                continue
            to, old = state_of[v], s
            if state_uses[s] > 1 or u == v:  # v == u: the joined token keeps the arcs that u loses
                state_uses[s] -= 1
                s = states
                states += 1
                table[s] = table[old]
                state_uses[s] = 1
                state_of[u] = s
            before = class_of[u]
            if class_uses[c] > 1:
                class_uses[c] -= 1
                new = classes
                classes += 1
                bit = table[:states, c >> 3] >> (c & 7) & 1
                table[:states, new >> 3] |= bit << (new & 7)
                class_uses[new] = 1
                class_of[v] = c = new
            table[s, c >> 3] &= 255 - (1 << (c & 7))
            if u == v:
                before, to = class_of[u], old
            if class_of[uv] < 0:
                state_of[uv], class_of[uv] = to, before
                state_uses[to] += 1
                class_uses[before] += 1
        self.table = table[:states, : (classes + 7) // 8].copy()
        self.state_of, self.class_of = np.array(state_of, np.int32), np.array(class_of, np.int32)

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _trie(self) -> None:
        """The tokens' bytes as a trie with row displacement: child of node by byte b is next_[shift[node] + b] if owner there is node."""
        children: list[dict[int, int]] = [{}]
        token_at = [-1]
        for label, token in self.token_of.items():
            node = 0
            for b in label:
                to = children[node].get(b)
                if to is None:
                    to = children[node][b] = len(children)
                    children.append({})
                    token_at.append(-1)
                node = to
            token_at[node] = token
        cells = 4 * len(children) + 65_536
        shift, owner, next_ = np.zeros(len(children), np.int32), np.full(cells, -1, np.int32), np.zeros(cells, np.int32)
        free, window, low = np.ones(cells, bool), 8192, 0
        for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
            if not (kids := children[node]):
                break
            at = low
            while True:
                fits = np.logical_and.reduce([free[at + b : at + b + window] for b in kids])
                k = int(fits.argmax())
                if fits[k]:
                    at += k
                    break
                at += window
            if len(kids) == 1:
                low = max(low, at)  # every later node has one child too: cells before this are no use
            shift[node] = at
            for b, to in kids.items():
                owner[at + b], next_[at + b], free[at + b] = node, to, False
        used = int(np.flatnonzero(~free)[-1]) + 257
        owner, next_ = owner[:used].copy(), next_[:used].copy()
        self.shift, self.owner, self.next_, self.token_at = shift, owner, next_, np.array(token_at, np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pre-split words, each as little-endian 32-bit integers; all words advance together, an offset at a time."""
        out: list[bytes] = [b""] * len(words)
        short: list[int] | range = range(len(words))
        size = np.fromiter(map(len, words), np.int32, len(words))
        kept = words
        if size.max(initial=0) > 48:
            for k in np.flatnonzero(size > 48).tolist():
                out[k] = self._encode_long(words[k])
            short = np.flatnonzero(size <= 48).tolist()
            kept, size = [words[k] for k in short], size[size <= 48]
        if not len(short):
            return out
        data = np.frombuffer(b"".join(kept) + b"\0", np.uint8).astype(np.int32)
        base = np.cumsum(size) - size
        n, most = len(short), int(size.max(initial=0))
        state, back = np.full((most + 1, n), -1, np.int32), np.zeros((most + 1, n), np.int32)
        state[0] = 0
        classes, states = self.class_of, self.state_of
        for p in range(most):
            who = np.flatnonzero((size > p) & (state[p] >= 0))
            row, left, at = state[p][who], size[who] - p, base[who] + p
            node = np.zeros(len(who), np.int32)
            depth = 0
            while len(who):
                cell = self.shift[node] + data[at + depth]
                depth += 1
                go = np.flatnonzero(self.owner[cell] == node)
                who, row, left, at, node = who[go], row[go], left[go], at[go], self.next_[cell[go]]
                token = self.token_at[node]
                c = np.where(token >= 0, classes[token], -1)
                hit = np.flatnonzero(c >= 0)
                ch = c[hit]
                hit = hit[(self.table[row[hit], ch >> 3] >> (ch & 7).astype(np.uint8) & 1).astype(bool)]
                state[p + depth, who[hit]] = states[token[hit]]
                back[p + depth, who[hit]] = token[hit]
                go = np.flatnonzero(left > depth)
                who, row, left, at, node = who[go], row[go], left[go], at[go], node[go]
        lengths = self.lengths
        where, column, found, open_ = size.copy(), np.arange(n), [], np.arange(n)
        while len(open_):
            token = back[where[open_], open_]
            found.append((open_, token))
            where[open_] -= lengths[token]
            open_ = open_[where[open_] > 0]
        counts = np.zeros(n, np.int64)
        for who, _ in found:
            counts[who] += 1
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if n else 0, "<u4")
        last = ends - 1
        for who, token in found:  # the last token of each word comes first
            flat[last[who]] = token
            last[who] -= 1
        joined = flat.tobytes()
        for k, hi, count in zip(short, ends.tolist(), counts.tolist(), strict=True):
            out[k] = joined[4 * (hi - count) : 4 * hi]
        return out

    def _encode_long(self, word: bytes) -> bytes:
        n = len(word)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        state[0] = 0
        shift, owner, next_, token_at = (self.__dict__.setdefault(f"_{k}_list", getattr(self, k).tolist()) for k in ("shift", "owner", "next_", "token_at"))
        for p in range(n):
            if state[p] < 0:
                continue
            row, node = self.table[state[p]], 0
            for q in range(p, n):
                cell = shift[node] + word[q]
                if owner[cell] != node:
                    break
                node = next_[cell]
                token = token_at[node]
                if token >= 0 and (c := self.class_of[token]) >= 0 and row[c >> 3] >> (c & 7) & 1:
                    state[q + 1], back[q + 1] = self.state_of[token], token
        out = []
        while n:
            out.append(back[n])
            n -= len(self.labels[back[n]])
        return np.array(out[::-1], "<u4").tobytes()


class Codec:
    """Whole texts to little-endian 32-bit ids and back, with a bounded table of words already encoded."""

    def __init__(self, automaton: Automaton, cache_words: int = CACHE_WORDS):
        self.automaton = automaton
        self.latin1, self.full = _latin1_split(), regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        specials = sorted(automaton.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.full.findall(text)
        return self.latin1.findall(text)

    def _learn(self, lists: list[list[str]]) -> None:
        """Afterwards every word of the lists is known."""
        new = set().union(*lists).difference(self.known)
        if len(self.known) + len(new) > self.cache_words:
            self.known.clear()
            new = set().union(*lists)
        order = list(new)
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            self.known.update(zip(part, self.automaton.encode_words([w.encode() for w in part]), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        pieces = [self.special.split(t) if self.special and "<" in t else [t] for t in texts]
        words = [[self.automaton.specials[p] if k % 2 else self._split(p) for k, p in enumerate(ps)] for ps in pieces]
        self._learn([w for ps in words for w in ps if isinstance(w, list)])
        get = self.known.__getitem__
        return [b"".join([b"".join(map(get, w)) if isinstance(w, list) else np.uint32(w).tobytes() for w in ps]) for ps in words]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, SHA-256 of the ids and of the decoded text, whether decoding gives the text back.

    with_ids adds the ids themselves as binary (little-endian unsigned 32-bit). A null text is an empty text, which has no
    tokens; repeated rows stay repeated; a null doc_id stays null; other columns are ignored. Rows are independent, so a
    lost executor costs only its own tasks. The automaton is broadcast: its size is bounded by the vocabulary.
    """
    shared = spark.sparkContext.broadcast(Automaton.from_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for text, ids in zip(texts, codec.encode_all(texts), strict=True):
                    back = codec.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text, *([ids] if with_ids else [])))
                types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
                columns = zip(*rows, strict=True) if rows else [[]] * (4 + with_ids)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *(["ids"] if with_ids else [])])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
