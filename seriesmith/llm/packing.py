"""Sum-of-squares online packing of token sequences into training windows.

Documents are tokenised and packed in one pass over each input partition:
nothing is shuffled and no task waits for another. Full windows are cut off a
document's front; the rest, shorter than a window, is placed whole into the
partially filled level that makes the sum of squared level counts least. The
levels are an array of counts with a stack of open windows for each level.
When a partition ends, its open windows are closed: the emptiest are cut up
to fill the fullest, and what is left becomes windows whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_letters, definition_of

WINDOW, END_ID = 2048, 1

#: Ids of a token, in bytes.
WIDTH = 4

#: White space that goes on for so long is cut out before the pre-split
#: pattern, whose engine gives up on longer runs.
LONG_SPACE = 10_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: (document's number, start, bytes of the ids)
Piece = tuple[int, int, bytes]


class Encoder:
    """Ids of whole texts under a byte-level BPE tokenizer file.

    The ids are those of the tokenizers library; tiktoken makes them from the
    same vocabulary about eight times as fast. It takes a token's id as its
    rank, which the file must bear out. Special tokens stand for themselves.
    A long run of white space is a pre-split word of its own, less its last
    character if more text follows; it goes to the encoder past the pattern.
    """

    def __init__(self, definition: str):
        spec, letters = json.loads(definition), byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(letters[c] for c in s)
        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        made = [ranks[raw(m.replace(" ", "") if isinstance(m, str) else "".join(m))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("the vocabulary's ids don't follow the order of its merges")
        self.model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.space = regex.compile(r"\s{%d,}" % LONG_SPACE)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not any(mark in text for mark in self.special):
            return b"".join(self._plain(text)) if len(text) >= LONG_SPACE else self._split(text)
        return b"".join(
            self.special[part].to_bytes(WIDTH, "little") if i % 2 else self.ids(part) for i, part in enumerate(self.marks.split(text))
        )

    def _split(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text).astype("<u4", copy=False).tobytes() if text else b""

    def _plain(self, text: str) -> Iterator[bytes]:
        at = 0
        for run in self.space.finditer(text):
            stop = run.end() - (run.end() < len(text))
            yield self._split(text[at : run.start()])
            yield np.array(self.model._encode_single_piece(text[run.start() : stop].encode()), "<u4").tobytes()
            at = stop
        yield self._split(text[at:])


def shared_encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once a process."""
    kept = sys.__dict__.setdefault("_seriesmith_encoders", {})
    key = hashlib.md5(definition.encode()).digest()
    if key not in kept:
        kept[key] = Encoder(definition)
    return kept[key]


class SumOfSquares:
    """Online packing into windows of ``size`` tokens.

    ``place`` returns the windows that it closes, as lists of pieces.
    """

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def level_for(self, length: int) -> int:
        """Level of the window to put ``length`` tokens into; 0 is a new one.

        Moving a window from level h to h + length changes the sum of squares
        by 2 (n[h + length] - n[h]) + 2, opening one by 2 n[length] + 1, and
        filling one up by 1 - 2 n[h]. Ties go to the fullest window.
        """
        n, top = self.counts, self.size - length
        change = 2 * (n[length : self.size + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[length] + 1
        change[top] = 1 - 2 * n[top] if top else 0
        usable = n[: top + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[list[Piece]]:
        length = len(piece[2]) // WIDTH
        level = self.level_for(length)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + length == self.size:
            return [window]
        self.open[level + length].append(window)
        self.counts[level + length] += 1
        return []

    def close(self) -> list[list[Piece]]:
        """All open windows' pieces, in full windows and powers of two."""
        left = [(h, w) for h in range(self.size, 0, -1) for w in self.open[h]]
        self.__init__(self.size)
        out, i, j = [], 0, len(left) - 1
        while i < j:
            (h, window), donors = left[i], left[j][1]
            while h < self.size and i < j:
                take, donors = _cut(donors, self.size - h)
                window = window + take
                h += sum(len(p[2]) for p in take) // WIDTH
                if not donors:
                    j -= 1
                    donors = left[j][1] if i < j else []
            if i < j:
                left[j] = (0, donors)
            left[i] = (h, window)
            if h == self.size:
                out.append(window)
                i += 1
        if i == j:
            rest = left[i][1]
            while rest:
                n = sum(len(p[2]) for p in rest) // WIDTH
                take, rest = _cut(rest, min(self.size, 1 << n.bit_length() - 1))
                out.append(take)
        return out


def _cut(pieces: list[Piece], length: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``length`` tokens of the pieces, and the others."""
    head, need = [], length * WIDTH
    for k, (doc, start, ids) in enumerate(pieces):
        if need == 0:
            return head, pieces[k:]
        if len(ids) > need:
            head.append((doc, start, ids[:need]))
            return head, [(doc, start + need // WIDTH, ids[need:]), *pieces[k + 1 :]]
        head.append((doc, start, ids))
        need -= len(ids)
    return head, []


def pack_documents(
    spark: SparkSession,
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    size: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; null texts count as empty, so every
    row has at least one id. Every id lies in exactly one piece; sequences
    have ``size`` ids (a power of two) or a smaller power of two. Ids of any
    type, nulls and repeated rows are packed like others. Sequence ids carry
    the partition's number in their upper half.
    """
    definition = spark.sparkContext.broadcast(definition_of(tokenizer))
    end = int(end_id).to_bytes(WIDTH, "little")
    names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = shared_encoder(definition.value), SumOfSquares(size)
        sequence = TaskContext.get().partitionId() << 32
        number, kept = 0, {}  # documents with ids in open windows: (id, tokens, ids to come)

        def rows(windows: list[list[Piece]]) -> list[tuple]:
            nonlocal sequence
            out = []
            for window in windows:
                offset = 0
                for doc, start, ids in window:
                    n = len(ids) // WIDTH
                    entry = kept[doc]
                    out.append((entry[0], start, n, zlib.crc32(ids), entry[1], sequence, offset))
                    offset += n
                    entry[2] -= n
                    if not entry[2]:
                        del kept[doc]
                sequence += 1
            return out

        def batch(found: list[tuple]) -> pa.RecordBatch:
            ids, *rest = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in rest)], names)

        kind = None
        for b in batches:
            kind, found = b.column(0).type, []
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                tokens = len(ids) // WIDTH
                number += 1
                kept[number] = [name, tokens, tokens]
                whole = tokens - tokens % size
                for start in range(0, whole, size):
                    found += rows([[(number, start, ids[start * WIDTH : (start + size) * WIDTH])]])
                if tokens > whole:
                    found += rows(packer.place((number, whole, ids[whole * WIDTH :])))
            if found:
                yield batch(found)
        if found := rows(packer.close()):
            yield batch(found)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")
