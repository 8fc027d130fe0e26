"""Byte-level BPE as a deterministic tokenization automaton.

The merges are compiled one by one into an automaton over tokens. Its states
are the last token read, its arcs are labelled with tokens and their bytes; at
first every byte may follow every byte. The gadget of merge number r,
(u, v) -> w, does three things: the arc v out of u is cut (so u v can no longer
be read), a new state w gets the arcs that leave v, and every state that had an
arc to u gets one to w. The last two are inherited by reference (a state from
its right part, an arc from its left part, each as of rank r), so this
automaton is a few arrays of one entry per merge, and ``follows(x, y)`` reads
an arc off them. It reads exactly one token sequence for a byte string: the
BPE encoding.

Every part of an encoding is the encoding of its bytes, so the prefixes of a
word have encodings that end in one token each, and the token that ends the
next prefix hangs on those only from which some token still reaches it. That
makes the automaton over bytes deterministic: a state is the set of (bytes
read of a token to come, token before it), and a byte leads to one state and
emits one token, the last of the prefix's encoding. Its transition table is
filled by the rows that words reach; ``encode`` walks a pre-split word through
it byte by byte and reads the tokens off from the word's end. Nothing is tried
twice. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks, words, arcs and states kept by a worker before each table starts
#: anew, and the longest chunk or word that is kept, in code points.
CHUNKS_KEPT, WORDS_KEPT, ARCS_KEPT, STATES_KEPT, KEPT_LENGTH = 400_000, 400_000, 500_000, 300_000, 64

#: The pre-split pattern of byte-level tokenizers of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Rank of "never"; where a state holds its token and its readings.
NEVER, EMITS, READS = 1 << 60, -1, -2


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[str, int]:
    """Letter by which a vocabulary file writes each byte -> the byte.

    Printable Latin-1 bytes stand for themselves, the others in order for
    the code points from 256.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(extra)] = b
            extra += 1
    return out


class Automaton:
    """The compiled merges and vocabulary of a byte-level BPE tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        letters = byte_letters()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.label = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        top = max(self.label) + 1
        # by state: rank of its gadget, the parts it was made of
        self.rank, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        self.cut: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(r, vocab[to_bytes(a)], vocab[to_bytes(b)], vocab[to_bytes(a + b)])
        self.known = {b: i for b, i in vocab.items() if len(b) == 1 or self.rank[i] >= 0}
        # bytes of the arcs as a trie: node << 8 | byte -> node, the token that ends at a node
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for label, token in self.known.items():
            node = 0
            for byte in label:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = after
            self.ends[node] = token
        self.inner = {key >> 8 for key in self.child}
        self.size = {i: len(b) for i, b in self.label.items()}
        self._forget()
        self.decimal = {i: str(i) for i in self.label}
        self.words: dict[str, list[int]] = {}
        self.arcs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.chunks: dict[str, tuple[dict, dict]] = {}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.cut[u << 20 | v] = rank
        self.rank[w], self.left[w], self.right[w] = rank, u, v

    def follows(self, x: int, y: int) -> bool:
        """Whether arc y leaves state x.

        It does unless a cut arc (x', y') is inherited: x' a right part of x
        and y' a left part of y, cut before either had become a larger token.
        Of equal ranks (a token twice in a row) the left pair merges first.
        """
        cut, rank, right, left = self.cut, self.rank, self.right, self.left
        until_x = NEVER
        while x >= 0:
            part, until_y = y, NEVER
            while part >= 0:
                r = cut.get(x << 20 | part)
                if r is not None and r < until_x and r <= until_y:
                    return False
                until_y, part = rank[part], left[part]
            until_x, x = rank[x], right[x]
        return True

    def _forget(self) -> None:
        """Start the transition table anew, from the state before a word."""
        # a state is its row of the table, byte -> state; under EMITS the
        # last token, under READS what is being read
        self.first = {EMITS: -1, READS: ((0, -1),)}
        self.states = {self.first[READS]: self.first}

    def _state(self, reading: tuple[tuple[int, int], ...]) -> dict:
        """The state of a set of readings; the last is the token that it emits."""
        found = self.states.get(reading)
        if found is None:
            found = self.states[reading] = {EMITS: reading[-1][1], READS: reading}
        return found

    def _step(self, state: dict, byte: int) -> dict:
        """Fill in one transition: the state after ``state`` and ``byte``."""
        child, ends, inner, arcs, found, reading = self.child, self.ends, self.inner, self.arcs, -1, []
        for node, last in state[READS]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = ends[node]
            if token >= 0 and found < 0:
                if last < 0:
                    found = token
                else:
                    ok = arcs.get(key := last << 20 | token)
                    if ok is None:
                        ok = arcs[key] = self.follows(last, token)
                    if ok:
                        found = token
            if node in inner:
                reading.append((node, last))
        reading.append((0, found))
        after = state[byte] = self._state(tuple(reading))
        return after

    def encode(self, word: bytes) -> list[int]:
        """The token sequence that the automaton reads for a pre-split word."""
        state, last = self.first, []
        for byte in word:
            after = state.get(byte)
            if after is None:
                if len(self.states) > STATES_KEPT:
                    kept = state[READS]
                    self._forget()
                    state = self._state(kept)
                after = self._step(state, byte)
            state = after
            last.append(state[EMITS])
        size, at, out = self.size, len(last), []
        while at:
            out.append(token := last[at - 1])
            at -= size[token]
        out.reverse()
        return out

    def _ids(self, chunk: str, letters: bool) -> list[int]:
        """Ids of a chunk; ``letters``: it is a single pre-split word."""
        words, ids = self.words, []
        for word in (chunk,) if letters else self.split.findall(chunk):
            found = words.get(word)
            if found is None:
                found = self.encode(word.encode("utf-8", "surrogatepass"))
                if len(word) <= KEPT_LENGTH:
                    words[word] = found
            ids += found
        return ids

    def digests(self, ids: list[int]) -> tuple[str, bytes, int]:
        """Decimal ids joined by commas, emitted labels, number of ids."""
        label, decimal = self.label, self.decimal
        return ",".join([decimal[i] for i in ids]), b"".join([label[i] for i in ids]), len(ids)

    def entries(self, text: str, made=packed) -> list:
        """``made(ids)`` of each of a text's chunks, in order.

        A chunk begins at a blank before a letter, digit or mark; no pre-split
        word reaches over such a place, and most chunks recur. Special tokens
        stand for themselves.
        """
        if any(mark in text for mark in self.special):
            out = []
            for i, part in enumerate(self.marks.split(text)):
                out += [made([self.special[part]])] if i % 2 else self.entries(part, made) if part else []
            return out
        if not text:
            return []
        # by chunk, after a blank and elsewhere
        after, other = self.chunks.setdefault(made.__name__, ({}, {}))
        if len(after) + len(other) > CHUNKS_KEPT:
            after.clear(), other.clear()
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        if len(self.arcs) > ARCS_KEPT:
            self.arcs.clear()
        first, *parts = _chunks(text)
        got = other.get(first)
        if got is None:
            got = made(self._ids(first, False))
            if len(first) <= KEPT_LENGTH:
                other[first] = got
        found = list(map(after.get, parts))
        if None in found:
            for i, e in enumerate(found):
                if e is None:
                    part = parts[i]
                    e = after.get(part)
                    if e is None:
                        e = made(self._ids(" " + part, part.isalpha()))
                        if len(part) <= KEPT_LENGTH:
                            after[part] = e
                    found[i] = e
        return [got, *found] if first else found  # a text may begin with a blank


#: A blank that a chunk may not begin with: next to other white space, or last.
_ODD = re.compile(r"\s\s|\A\s|\s\Z")
_BREAK = regex.compile(r" (?=\S)")


def _chunks(text: str) -> list[str]:
    """Split at blanks before a non-blank; the pieces after the first lack theirs."""
    return text.split(" ") if not _ODD.search(text) else _BREAK.split(text)


def shared_automaton(definition: str) -> Automaton:
    """The worker's automaton for a tokenizer file, compiled once a process."""
    kept = sys.__dict__.setdefault("_seriesmith_automata", {})
    key = hashlib.md5(definition.encode()).digest()
    if key not in kept:
        kept[key] = Automaton(definition)
    return kept[key]


def definition_of(path: str) -> str:
    """The tokenizer file's text; it is of fixed size and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_ids(definition: str, text: str | None) -> np.ndarray:
    """Ids of one text; null counts as empty."""
    return np.frombuffer(b"".join(shared_automaton(definition).entries(text or "")), "<u4")


def encode_documents(
    spark: SparkSession, df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    ids_sha256 is the digest of the decimal ids joined by commas,
    decoded_sha256 that of the decoded text. Null texts count as empty; ids of
    any type pass through; nothing is shuffled.
    """
    definition = spark.sparkContext.broadcast(definition_of(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared_automaton(definition.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                found = automaton.entries(text.as_py() or "", automaton.digests)
                n.append(sum([e[2] for e in found]))
                ids.append(hashlib.sha256(",".join([e[0] for e in found]).encode()).hexdigest())
                emitted = b"".join([e[1] for e in found])
                decoded.append(hashlib.sha256(emitted.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
