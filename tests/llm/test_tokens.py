"""BPE automaton and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesmith.llm.bpe import EMITS, READS, Automaton, definition_of, encode_documents
from seriesmith.llm.packing import Encoder, SumOfSquares, pack_documents

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "aa", " ", "  ", "\n", "\t", "'s", "'re", "é", "ß", "日", "本", "🙂", "1", "23", "!", "...", "the", "ing", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "​", "Z", "\r\n", "_", "́", "½", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def definition():
    return definition_of(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(16))) for _ in range(n)] + ["", "a" * 5000, "ab" * 2000, " " * 1000, "!" * 999, "日" * 700]


def test_encode_and_decode(library, definition):
    automaton, fast = Automaton(definition), Encoder(definition)
    for text in texts(1, 3000):
        want = library.encode(text, add_special_tokens=False).ids
        found = automaton.entries(text, automaton.digests)
        assert np.frombuffer(b"".join(automaton.entries(text)), "<u4").tolist() == want, text
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == want, text
        assert ",".join(e[0] for e in found) == ",".join(map(str, want)) and sum(e[2] for e in found) == len(want)
        assert b"".join(e[1] for e in found).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_arcs_are_those_of_encodings(library, definition):
    """A token may follow another just if their text encodes to the two."""
    automaton, rng = Automaton(definition), random.Random(6)
    letters = [(b, i) for b, i in automaton.known.items() if b.isalpha() and len(b) < 6]
    for _ in range(4000):
        (a, i), (b, j) = rng.choice(letters), rng.choice(letters)
        if library.encode(a.decode(), add_special_tokens=False).ids == [i] and library.encode(b.decode(), add_special_tokens=False).ids == [j]:
            assert automaton.follows(i, j) == (library.encode((a + b).decode(), add_special_tokens=False).ids == [i, j])
    for key in list(automaton.cut)[:3000]:
        assert not automaton.follows(key >> 20, key & (1 << 20) - 1)


def test_table_has_one_arc_a_byte(library, definition):
    """Each reached state and byte has one successor, which emits the only token that fits."""
    automaton, rng = Automaton(definition), random.Random(9)
    words = ["".join(rng.choice("abcdefgh tion.é日") for _ in range(rng.randrange(1, 40))).encode() for _ in range(400)]
    for w in words:
        automaton.encode(w)
    for state in list(automaton.states.values()):
        for byte in [b for b in state if b >= 0]:
            fit = []
            for node, last in state[READS]:
                token = automaton.ends[automaton.child[node << 8 | byte]] if node << 8 | byte in automaton.child else -1
                if token >= 0 and (last < 0 or automaton.follows(last, token)):
                    fit.append(token)
            assert fit == [state[byte][EMITS]]
    few = Automaton(definition)
    for w in words[:50]:  # a table that is started anew inside words gives the same
        few.states |= {((i, i),): {} for i in range(400_000)}
        assert few.encode(w) == automaton.encode(w)


def test_very_long_white_space(spark, library):
    import corpus_pipeline

    text = "a" + " " * 2_000_000 + "\t" * 1_500_000 + "\n" * 1_500_000 + " b"
    ids = library.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text), (2, "\u00a0" * 30_000), (3, "x  " + "\x1c" * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in encode_documents(spark, docs, PATH).collect()}
    assert got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    whole = np.array([*ids, 1], "<u4")
    for pieces in (pack_documents(spark, docs, PATH).collect(), corpus_pipeline.pack(spark, docs, "").collect()):
        own = [r for r in pieces if r["doc_id"] == 1]
        assert sum(r["length"] for r in own) == len(whole) == own[0]["doc_tokens"]
        assert all(zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
        assert {r["doc_tokens"] for r in pieces if r["doc_id"] != 1} == {got[i]["n_tokens"] + 1 for i in (2, 3)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, start int")


def test_encode_documents(spark, library):
    rows = [*enumerate([*texts(2, 100), None]), (None, "x"), (7, "again"), (7, "again")]
    got = encode_documents(spark, frame(spark, rows), PATH).collect()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert encode_documents(spark, frame(spark, rows).limit(0), PATH).count() == 0


def test_level_choice_is_least_squares():
    rng = random.Random(3)
    for _ in range(200):
        packer = SumOfSquares(16)
        for h in range(1, 16):
            packer.counts[h] = rng.randrange(4)
        length = rng.randrange(1, 16)

        def after(level):
            n = packer.counts.copy()
            if level:
                n[level] -= 1
            if level + length < 16:
                n[level + length] += 1
            return int((n[1:16] ** 2).sum())

        options = [h for h in range(0, 17 - length) if h == 0 or packer.counts[h]]
        assert after(packer.level_for(length)) == min(map(after, options))


@pytest.mark.parametrize("size", [2048, 16])
def test_pack_documents(spark, library, size):
    rows = [*enumerate([*texts(4, 60), None]), (None, "x y z"), (3, "again"), (3, "again")]
    got = pack_documents(spark, frame(spark, rows), PATH, size=size).collect()
    tokens = {}
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        tokens.setdefault(i, []).append(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        ok = [d for d in tokens[r["doc_id"]] if len(d) == r["doc_tokens"] and zlib.crc32(np.array(d[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert ok
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        n = sum(r["length"] for r in pieces)
        assert n <= size and n & (n - 1) == 0
    for i, docs in tokens.items():
        own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        if len(docs) == 1:
            assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) == sum(map(len, docs))
    assert pack_documents(spark, frame(spark, rows).limit(0), PATH).count() == 0
