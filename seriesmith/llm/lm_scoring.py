"""Language-model scores by marginal likelihood over a subword lattice.

Every way to cut a word into pieces of an existing vocabulary is a path of a
lattice. A path's probability is the product of its pieces' unigram scores
and of a stop; the word's is the sum over all paths, by forward recursion in
logarithms. The vocabulary's own scores (ranks, as Zipf weights) start the
unigram scores, and rounds of expected counts over the lattices of all
training word types re-estimate them, for each class of training texts
(their language, where they state one).

Longer arcs span whole words and whole runs of words (up to a word that ends
a sentence, RUN words at most) that the training texts have. Their counts are
discounted, and what a discount frees is spread by the level below:

    P(run | class)   = max(c_r - D_r, 0) / N_r + D_r V_r / N_r * prod P(word | class)
    P(word | class)  = max(c_k - D_k, 0) / N_k + D_k V_k / N_k * P'(word)
    P'(word)         = max(c - D, 0) / N + D V / N * P(subword paths | class).

A run's count c_r leaves out the document that is scored, so that a training
text does not vouch for itself. A run's class is that of the run before with
STAY and drawn anew by the training tokens' shares otherwise. The score is
log10 of the sum over all classes of runs and all paths, by forward recursion.

Word counts are aggregated by word, run counts by a 64-bit hash. Texts are
scored in blocks of bounded bytes: the distinct words and runs of a block are
joined with the counts, and the block's texts meet them in one task, so no
table of all words is ever sent to a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import stage
from .toxicity import fold_of

FOLDS, HELD_OUT = 7, 2
#: Rows of a file scored together, their bytes of text beyond which they are
#: dealt to several blocks, and the most such runs of rows that are broadcast.
BLOCK_ROWS, BLOCK_BYTES, HEAVY_RUNS = 4096, 32 << 20, 1_000_000
#: Words and runs held before a task sends them on.
WORDS_HELD = 1_000_000
#: Words summed up together.
TOKENS_HELD = 200_000
#: Words of a run at most, and the chance that a run keeps the class before.
RUN, STAY = 32, 0.9
#: Bytes of a word after which a run ends.
ENDS = b".!?"
#: Lattice positions, and words, computed at a time.
POSITIONS, WORDS_TOGETHER = 1 << 18, 50_000
#: Weight of the vocabulary's own scores, in word types, when re-estimating,
#: and how often that is done.
PRIOR, ROUNDS = 100.0, 3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def run_starts(words: list[bytes]) -> list[int]:
    """Where each run of words begins; a text without words has one empty run."""
    out = [0]
    for stop in [*(i for i, w in enumerate(words, 1) if w[-1] in ENDS), len(words)]:
        while stop - out[-1] > RUN:
            out.append(out[-1] + RUN)
        if out[-1] < stop < len(words):
            out.append(stop)
    return out


def run_keys(words: list[bytes], starts: list[int]) -> list[int]:
    """Signed 64-bit hash of each run."""
    digest = xxhash.xxh64_intdigest
    return [(h := digest(b" ".join(words[a:b]))) - (h >> 63 << 64) for a, b in zip(starts, [*starts[1:], len(words)])]


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces (bytes) and starting weights of a vocabulary file.

    Pieces lose their word-start mark and A-Z are lower-cased; a piece's
    weight falls with its rank among the file's scores, like Zipf's. All
    single bytes are pieces.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sorted(((model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))), key=lambda x: (-x[0], x[1]))
    out = {bytes([b]): 1e-6 for b in range(256)}
    for rank, (_, i) in enumerate(found):
        piece = model.id_to_piece(i).replace("▁", "").encode().translate(_LOWER)
        if piece and not piece.split() == []:
            out[piece] = out.get(piece, 0.0) + 1 / (rank + 10)
    total = sum(out.values())
    return {p: w / total for p, w in out.items()}


def compiled(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(base, owner, to, piece) of the pieces' trie.

    Node n's child by byte b is ``to[base[n] + b]`` if ``owner`` is n there;
    ``piece`` is the piece that ends at a node, or -1. Plain arrays, so that a
    broadcast of them needs no class where it arrives.
    """
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for i, piece in enumerate(pieces):
        node = 0
        for b in piece:
            after = children[node].get(b)
            if after is None:
                after = children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = after
        ends[node] = i
    room = len(children) * 4 + 4096
    base, owner, to = np.zeros(len(children), np.int32), np.full(room, -1, np.int32), np.zeros(room, np.int32)
    used, free, recent = bytearray(room), 256, 256
    # nodes of many children go behind each other, those of one fill the gaps
    for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
        own = sorted(children[node])
        if not own:
            break
        if len(own) > 1:
            at = max(256, recent - 512) - own[0]
            while any(used[at + b] for b in own):
                at += 1
            recent = max(recent, at + own[0])
        else:
            free = used.index(0, free)
            at = free - own[0]
        base[node] = at
        for b in own:
            owner[at + b], to[at + b], used[at + b] = node, children[node][b], 1
    return base, owner, to, np.array(ends, np.int32)


class Lattice:
    """Subword lattices of many words at a time, in numpy.

    ``logs`` holds the pieces' scores by class, ``stops`` the stop's.
    """

    def __init__(self, trie: tuple[np.ndarray, ...], logs: np.ndarray, stops: np.ndarray):
        self.base, self.owner, self.to, self.piece = trie
        self.logs, self.stops = np.atleast_2d(logs), np.atleast_1d(stops)

    def arcs(self, grid: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(start, piece) of the arcs of 1, 2, ... bytes.

        ``grid`` holds byte j of word w at [j, w]; a start is a flat index.
        """
        width, count = grid.shape
        flat, out = grid.ravel(), []
        left = np.maximum(sizes[None, :] - np.arange(width)[:, None], 0).ravel()
        at = np.flatnonzero(left)
        node = np.zeros(len(at), np.int32)
        for n in range(width):
            if n:
                some = left[at] > n
                at, node = at[some], node[some]
            slot = self.base[node] + flat[at + n * count]
            some = self.owner[slot] == node
            at, node = at[some], self.to[slot[some]]
            if not len(at):
                break
            index = self.piece[node]
            ends = index >= 0
            out.append((at[ends], index[ends]))
        return out

    def dense(self, arcs: list[tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> list[np.ndarray]:
        """[start, class, word] log scores of the arcs of each length."""
        out = []
        for at, index in arcs:
            logs = np.full((shape[0], len(self.logs), shape[1]), -np.inf)
            j, w = np.divmod(at, shape[1])
            logs[j, :, w] = self.logs[:, index].T
            out.append(logs)
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        top = np.maximum(np.maximum.reduce(terms), -1e300)
        total = np.exp(terms[0] - top)
        for t in terms[1:]:
            total += np.exp(t - top)
        with np.errstate(divide="ignore"):
            return top + np.log(total)

    def forward(self, dense: list[np.ndarray]) -> np.ndarray:
        """[position, class, word] log-probability of all paths up to each position."""
        width, classes, count = dense[0].shape
        alpha = np.zeros((width + 1, classes, count))
        for j in range(1, width + 1):
            alpha[j] = self._sum([alpha[j - n] + dense[n - 1][j - n] for n in range(1, min(len(dense), j) + 1)])
        return alpha

    def backward(self, dense: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """[position, class, word] log-probability of all paths from each position on."""
        width, classes, count = dense[0].shape
        beta = np.full((width + 1, classes, count), -np.inf)
        for j in range(width, -1, -1):
            if j < width:
                beta[j] = self._sum([beta[j + n] + dense[n - 1][j] for n in range(1, min(len(dense), width - j) + 1)])
            beta[j][:, sizes == j] = 0.0
        return beta

    def grids(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indexes, [position, word] bytes, lengths) of words of like lengths."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        room, at = POSITIONS // len(self.logs), 0
        while at < len(order):
            least = max(1, int(sizes[order[at]]))
            stop = min(at + max(1, room // least), int(np.searchsorted(sizes[order], least + least // 4, "right")))
            own = order[at:stop]
            width = max(1, int(sizes[own[-1]]))
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in own), np.uint8)
            yield own, np.ascontiguousarray(flat.reshape(len(own), width).T), sizes[own]
            at = stop

    def log10(self, words: list[bytes]) -> np.ndarray:
        """[class, word] log10 of the words' marginal probabilities."""
        out = np.zeros((len(self.logs), len(words)))
        for own, grid, sizes in self.grids(words):
            arcs = self.arcs(grid, sizes)
            alpha = self.forward(self.dense(arcs, grid.shape)) if arcs else np.zeros((1, len(self.logs), len(own)))
            out[:, own] = (alpha[sizes, :, np.arange(len(own))].T + self.stops[:, None]) / np.log(10)
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over all paths of all words, under the first class."""
        uses = np.zeros(self.logs.shape[1])
        for own, grid, sizes in self.grids(words):
            arcs, count = self.arcs(grid, sizes), len(own)
            if not arcs:
                continue
            dense = self.dense(arcs, grid.shape)
            alpha, beta = self.forward(dense), self.backward(dense, sizes)
            # paths through an arc: before it, itself, after it
            total = np.tile(alpha[sizes, 0, np.arange(count)], len(grid))
            alpha, beta = alpha.ravel(), beta.ravel()
            for n, (at, index) in enumerate(arcs, 1):
                uses += np.bincount(index, np.exp(alpha[at] + self.logs[0, index] + beta[at + n * count] - total[at]), minlength=len(uses))
        return uses


def located(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with _block, a number of rows that are scored together.

    BLOCK_ROWS neighbours of a file are a block; where their bytes of text
    exceed BLOCK_BYTES, they are dealt by row to as many blocks as that takes
    (and fewer rows are taken if there are more than HEAVY_RUNS such places,
    so that the list of them can be broadcast). Every reading of the table
    gives a row the same block, however its files are split. A table that
    isn't read from files is written first.
    """
    def with_block(d: DataFrame) -> DataFrame:
        rows = BLOCK_ROWS
        while True:
            placed = d.select("*", F.col("_metadata.row_index").alias("_row"), F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)).alias("_run"))
            total = placed.groupBy("_run").agg(F.sum(F.octet_length(text)).alias("_b")).filter(F.col("_b") > BLOCK_BYTES)
            heavy = stage(total.select("_run", F.ceil(F.col("_b") / BLOCK_BYTES).alias("_parts")), "lm-heavy")
            if rows == 1 or heavy.count() <= HEAVY_RUNS:
                break
            rows = max(1, rows // 4)
        part = F.pmod("_row", F.coalesce("_parts", F.lit(1)))
        return placed.join(F.broadcast(heavy), "_run", "left").withColumn("_block", F.xxhash64("_run", part)).drop("_row", "_run", "_parts")

    try:
        return with_block(df)
    except AnalysisException:
        return with_block(stage(df, "lm-texts"))


def class_names(texts: DataFrame) -> list[str]:
    """All classes of ``texts(class, train)``'s training rows."""
    return sorted(r["class"] for r in texts.filter("train and class is not null").select("class").distinct().collect())


def count_words(texts: DataFrame, names: list[str]) -> DataFrame:
    """(w, c, c0, c1, ...): uses of every word of ``texts(text, train, class)`` in training texts.

    c0 counts texts of no class, c1 those of the first and so on. Words of
    other texts only have counts of 0. The empty word is the end token.
    """
    place = {n: i + 1 for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(len(names) + 1)]

        def sent() -> pa.RecordBatch:
            w = [x for c in seen for x in c]
            n = [x for c in seen for x in c.values()]
            k = np.repeat(np.arange(len(seen), dtype=np.int32), [len(c) for c in seen])
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(k), pa.array(n, pa.int64())], ["w", "k", "c"])

        for b in batches:
            for text, train, name in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(text.as_py())
                words.append(b"")
                own = seen[place.get(name, 0)] if train else seen[0]
                if train:
                    own.update(words)
                else:
                    for w in set(words):
                        own.setdefault(w, 0)
                if sum(map(len, seen)) > WORDS_HELD:
                    yield sent()
        if any(seen):
            yield sent()

    each = [F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(len(names) + 1)]
    return texts.select("text", "train", "class").mapInArrow(run, "w binary, k int, c long").groupBy("w").agg(F.sum("c").alias("c"), *each)


def count_runs(texts: DataFrame) -> DataFrame:
    """(block, r, own, c): runs of words, their uses in the block's and in all training texts.

    ``texts`` has text, train and _block. Runs used once in all tell no other
    text anything and are left out; a null run has all uses of all runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, dict[int, list[int]]] = defaultdict(dict)
        held = uses = 0

        def sent() -> pa.RecordBatch:
            rows = [(block, r, *n) for block, own in seen.items() for r, n in own.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["block", "r", "n", "c"])

        for b in batches:
            for text, train, block in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, own = words_of(text.as_py()), seen[block]
                held -= len(own)
                keys = run_keys(words, run_starts(words)) if words else ()
                uses += len(keys) * train
                for r in keys:
                    n = own.setdefault(r, [0, 0])
                    n[0] += 1
                    n[1] += train
                held += len(own)
                if held > WORDS_HELD:
                    yield sent()
                    held = 0
        if held:
            yield sent()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, 2, uses)], ["block", "r", "n", "c"])

    # a run has a row a block and task at most, and one a task is null
    rows = texts.select("text", "train", "_block").mapInArrow(run, "block long, r long, n long, c long")
    by = Window.partitionBy("r")
    summed = rows.withColumns({"_n": F.sum("n").over(by), "_c": F.sum("c").over(by)})
    return summed.filter("_n > 1 and _c > 0").select("block", "r", F.col("c").alias("own"), F.col("_c").alias("c"))


def train_lattices(counts: DataFrame, trie: tuple[np.ndarray, ...], weights: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(logs, stops) of each class: the vocabulary's scores, re-estimated ROUNDS times over its training word types."""
    spark, size = counts.sparkSession, len(weights)
    logs, stops = np.tile(np.log(weights), (classes, 1)), np.zeros(classes)
    known = counts.filter("c > 0 and w <> binary('')").select("w", *(f"c{k}" for k in range(classes)))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((trie, logs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, logs = shared.value
            uses, types = np.zeros((classes, size)), np.zeros(classes)
            held: list[list[bytes]] = [[] for _ in range(classes)]

            def close(k: int) -> None:
                uses[k] += Lattice(trie, logs[k], 0.0).expected(held[k])
                types[k] += len(held[k])
                held[k].clear()

            for b in batches:
                words = b.column(0).to_pylist()
                for k in range(classes):
                    held[k] += [words[i] for i in np.flatnonzero(b.column(k + 1).to_numpy())]
                    if len(held[k]) >= WORDS_TOGETHER:
                        close(k)
            for k in range(classes):
                close(k)
            if types.any():
                k, g = np.nonzero(uses)
                every = np.arange(classes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(k, every), pa.int32()), pa.array(np.append(g, np.full(classes, -1)), pa.int32()), pa.array(np.append(uses[k, g], types))],
                    ["k", "g", "n"],
                )

        # at most a row a piece and class
        sums = known.mapInArrow(run, "k int, g int, n double").groupBy("k", "g").agg(F.sum("n").alias("n"))
        uses, types = np.tile(weights * PRIOR, (classes, 1)), np.ones(classes)
        for r in sums.collect():
            if r["g"] < 0:
                types[r["k"]] += r["n"]
            else:
                uses[r["k"], r["g"]] += r["n"]
        total = uses.sum(axis=1) + types
        shared.unpersist()
        logs, stops = np.log(uses / total[:, None]), np.log(types / total)
    return logs, stops


def discount(once: int, twice: int) -> float:
    """Absolute discount by the numbers of types seen once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def packed_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, bytes]:
    """Sizes of a binary column's values, and the values laid end to end."""
    sizes, parts = [np.empty(0, np.int64)], []
    for chunk in column.chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        sizes.append(np.diff(at))
        parts.append(memoryview(chunk.buffers()[2] or b"")[at[0] : at[-1]])
    return np.concatenate(sizes), b"".join(parts)


def together(batches: Iterator[pa.RecordBatch], rows: int = WORDS_TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches joined into ones of ``rows`` or more."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_scores(runs: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """log10 of each text's sum over all classes of its runs.

    ``runs`` are the texts' [run, class] log10 probabilities, one text after
    the other, ``counts`` their numbers (1 at least).
    """
    top = runs.max(axis=1)
    each = 10 ** np.maximum(runs - top[:, None], -300)
    first = np.cumsum(counts) - counts
    out = np.add.reduceat(top, first)
    order = np.argsort(-counts, kind="stable")
    state = np.tile(shares, (len(counts), 1))  # by text, longest first: forward sums, scaled to one
    for k in range(int(counts.max())):
        live = int(np.searchsorted(-counts[order], -k, "left"))
        texts, before = order[:live], state[:live]
        after = (STAY * before + (1 - STAY) * shares if k else before) * each[first[texts] + k]
        total = after.sum(axis=1)
        out[texts] += np.log10(total)
        state[:live] = after / total[:, None]
    return out


def word_scores(paths: np.ndarray, c: np.ndarray, by_class: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """[class, word] log10 probabilities from paths, counts and counts by class.

    ``stats`` has a row for all training texts and one for each class: tokens,
    types, types seen once and twice. The paths of the end token are -inf.
    """
    tokens, types = stats[0, :2]
    if not tokens:
        return paths
    free = discount(*stats[0, 2:]) * types / tokens
    p = np.maximum(c - discount(*stats[0, 2:]), 0) / tokens + free * 10 ** np.maximum(paths, -290.0) * np.isfinite(paths)
    with np.errstate(divide="ignore"):
        # words too long for a double have the paths alone
        low = np.where(p > 1e-280, np.log10(p), np.log10(free) + paths)
        value = np.empty_like(paths)
        for i, (n, v, *few) in enumerate(stats[1:]):
            d = discount(*few)
            own = np.maximum(by_class[i] - d, 0) / n
            value[i] = np.where(low[i] > -250, np.log10(own + d * v / n * 10 ** np.maximum(low[i], -290.0)), np.log10(d * v / n) + low[i])
    return value


def run_scores(words: np.ndarray, others: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """[run, class] log10 probabilities from the words' and the runs' uses in other texts.

    ``stats``: uses, types, types used once and twice in the training texts.
    """
    uses, types, *few = stats
    if not uses:
        return words
    d = discount(*few)
    free = words + np.log10(d * types / uses)
    with np.errstate(divide="ignore"):
        arc = np.log10(np.maximum(others - d, 0) / uses)[:, None]
    top = np.maximum(free, arc)
    return top + np.log10(10 ** (free - top) + 10 ** (arc - top))


def score_documents(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``class_col`` states the class of training texts; it is not read for the
    scores. Null texts count as empty: one end token. Repeated rows count and
    score like others; ids of any type pass through, a null id is an empty
    text for the fold. Without training texts every count is 0 and the
    lattice alone scores.
    """
    held = (fold_of(id_col, FOLDS) == HELD_OUT).alias("held_out")
    stated = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    texts = located(docs, F.col(text_col)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held, stated.alias("class"), "_block")
    train = texts.select("text", (~F.col("held_out")).alias("train"), "class", "_block")
    names = class_names(train)
    classes = len(names) + 1
    counts = stage(count_words(train, names), "lm-counts")
    cols = ["c", *(f"c{k}" for k in range(classes))]
    quarters = lambda c: (F.coalesce(F.sum(c), F.lit(0)), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))
    sums = counts.agg(*(x for c in cols for x in quarters(c))).first()
    stats = np.array([int(x) for x in sums], float).reshape(-1, 4)
    tokens, types = int(stats[0, 0]), int(stats[0, 1])
    # classes without training tokens are left out; without any, the first stands for all
    live = [k for k in range(classes) if stats[k + 1, 0]] or [0]
    shares = stats[1:, 0][live] / tokens if tokens else np.ones(1)
    stats = stats[[0, *(k + 1 for k in live)]]
    start = vocabulary(vocabulary_path)
    trie = compiled(list(start))
    logs, stops = train_lattices(counts, trie, np.array(list(start.values())), classes)
    shared = spark.sparkContext.broadcast((trie, logs[live], stops[live]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in together(batches):
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64)
            paths = lattice.log10(words)
            paths[:, [i for i, w in enumerate(words) if not w]] = -np.inf  # the end is never spelled
            value = word_scores(paths, c, np.stack([b.column(k + 2).to_numpy() for k in live]), stats)
            value = np.where(np.isfinite(value), value, 0.0).astype("<f4")
            packed = [row.tobytes() for row in np.ascontiguousarray(value.T)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["w", "c", "s"])

    table = stage(counts.select("w", *cols).mapInArrow(scored, "w binary, c long, s binary"), "lm-words")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[bytes]] = defaultdict(set)
        held = 0

        def sent() -> pa.RecordBatch:
            block = np.repeat(np.array(list(seen), np.int64), [len(own) for own in seen.values()])
            made = pa.RecordBatch.from_arrays([pa.array(block), pa.array([w for own in seen.values() for w in own], pa.binary())], ["block", "w"])
            seen.clear()
            return made

        for b in batches:
            for text, block in zip(b.column(0), b.column(1).to_pylist()):
                own = seen[block]
                held -= len(own)
                own.add(b"")
                own.update(words_of(text.as_py()))
                held += len(own)
                if held > WORDS_HELD:
                    yield sent()
                    held = 0
        if held:
            yield sent()

    used = texts.select("text", "_block").mapInArrow(distinct, "block long, w binary")
    known = used.join(table, "w").select("block", "w", "c", "s")
    runs = stage(count_runs(train), "lm-runs")
    run_stats = _run_stats(runs)
    runs = runs.filter("r is not null")
    as_word = F.concat(F.lit(b" "), F.unhex(F.lpad(F.hex("r"), 16, "0")))
    known = known.unionByName(runs.select("block", as_word.alias("w"), "c", F.lit(b"").alias("s")))
    kind = docs.schema[id_col].dataType.simpleString()

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        c, w = right.column("c").to_numpy(), right.column("w").to_pylist()
        sizes, raw = packed_bytes(right.column("s"))
        s = np.frombuffer(raw, "<f4").reshape(-1, len(live))
        # only words have scores; a run's key follows a blank
        is_word = sizes > 0
        place = dict(zip(compress(w, is_word.tolist()), range(len(s))))
        told = {int.from_bytes(w[i][1:], "big", signed=True): int(c[i]) for i in np.flatnonzero(~is_word)}
        c = c[is_word]
        base, end = np.log10((c + 1) / (tokens + types + 1)), place.get(b"", 0)
        n_tokens, n_known, base_score, score = [], [], [], []

        def close(at: list[np.ndarray], starts: list[list[int]], others: list[list[int]]) -> None:
            lengths = np.array([len(x) for x in at])
            first = np.cumsum(lengths) - lengths
            flat = np.concatenate(at)
            begin = np.concatenate([np.array(x) + f for x, f in zip(starts, first)])
            counts = np.array([len(x) for x in starts])
            last = np.cumsum(counts) - 1
            # an index may not lie past the end, as that of an empty text may
            found = np.add.reduceat(np.append(s[flat], np.zeros((1, len(live)), s.dtype), axis=0).astype(np.float64), begin, axis=0)
            found[np.repeat(lengths == 0, counts)] = 0.0
            found = np.where(np.repeat(lengths > 0, counts)[:, None], run_scores(found, np.concatenate(others), run_stats), found)
            found[last] += s[end]
            n_tokens.extend((lengths + 1).tolist())
            padded = lambda x: np.add.reduceat(np.append(x, 0), first) * (lengths > 0)
            n_known.extend((padded(c[flat] > 0).astype(np.int64) + int(c[end] > 0)).tolist())
            base_score.extend((padded(base[flat]) + base[end]).tolist())
            score.extend(text_scores(found, counts, shares).tolist())

        at, starts, others, held = [], [], [], 0
        for text, out in zip(left.column("text"), left.column("held_out").to_pylist()):
            words = words_of(text.as_py())
            at.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
            starts.append(run_starts(words))
            keys = run_keys(words, starts[-1]) if words else [0]
            own = Counter() if out else Counter(keys)
            others.append(np.array([told.get(r, own[r]) - own[r] for r in keys] if words else [0], np.float64))
            held += len(words)
            if held > TOKENS_HELD:
                close(at, starts, others)
                at, starts, others, held = [], [], [], 0
        if at:
            close(at, starts, others)
        found = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([tokens] * len(n_tokens), pa.int64()), pa.array(base_score), pa.array(score)]
        return pa.table([left.column("doc_id"), left.column("held_out"), *found], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (
        texts.select("doc_id", "text", "held_out", F.col("_block").alias("block"))
        .groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(
            sum_up,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def _run_stats(runs: DataFrame) -> np.ndarray:
    """Uses of runs in the training texts, their types, types used once and twice."""
    uses = runs.filter("r is null").agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    sums = (F.sum("own"), F.sum(F.col("own") / F.col("c")), F.sum(F.when(F.col("c") == 2, F.col("own"))))
    more, kinds, twice = (x or 0 for x in runs.filter("r is not null and c > 1").agg(*sums).first())
    once = uses - more
    return np.array([uses, once + round(kinds), once, twice // 2], float)
