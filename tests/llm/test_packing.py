"""Packing: pieces against the tokenizer's library, sequences against what a packing must be."""

import random
import zlib

import numpy as np
import pytest

from tablewright.llm.packing import Encoder, Packing, Shard, as_bins, as_numbers, packed, sequences
from tablewright.llm.token_counts import TokenizerFile

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    return TokenizerFile.read(public_tokenizers.path(FILE))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(FILE))


def ids_of(library, text, end=2):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def cut(ids, limit):
    first = (len(ids) - 1) % limit + 1
    starts = [0, *range(first, len(ids), limit)]
    return [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def test_encoder_gives_the_library_s_ids(tokenizer, library):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "'s", "don't", "1", "23", ".", ",", "!?", "<|endoftext|>", " ", "　", "漢字", "😀", "\r", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)]
    texts += ["".join(r.choice("aehinorst ACE.,'") for _ in range(r.randrange(60))) for _ in range(2000)]
    encoder = Encoder(tokenizer.data.decode())
    assert encoder.cuts
    assert encoder.fast
    for at in range(0, len(texts), 100):
        got = encoder.encode(texts[at : at + 100])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]


def test_ids_come_as_arrays_not_as_lists(tokenizer, library, monkeypatch):
    encoder = Encoder(tokenizer.data.decode())
    monkeypatch.setattr(type(encoder.fast), "encode_ordinary", lambda *_: pytest.fail("a Python list of ids"))
    texts = ["", "Plain words, 12 of them.", "a" * 300, "a\0\0b", "\0\0", "<|endoftext|> x", "caf\u00e9 \u2014 ok\n\n  end "]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids_of(library, t)[:-1] for t in texts]


def test_long_texts_are_encoded_in_parts(tokenizer, library, monkeypatch):
    from tablewright.llm import packing

    monkeypatch.setattr(packing, "_SEGMENT", 20)
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "the ", " ", "  ", "\n", ".", "é ", "1 2", "\t x"]) for _ in range(r.randrange(200))) for _ in range(400)]
    assert max(len(list(packing._segments(t))) for t in texts) > 5
    got = Encoder(tokenizer.data.decode()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts():
    encoder = Encoder(TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json")).data.decode())
    assert not encoder.cuts
    assert not encoder.fast
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(encoder.encode(["Two words, here"])[0], "<u4").tolist() == other.encode("Two words, here", add_special_tokens=False).ids


def check(rows, found, library, packing):
    """found: rows of `packed`; every piece is there as it should be, and sequences are gapless and not too long."""
    want = []
    for doc, text, *_ in rows:
        at = 0
        for number, piece in enumerate(cut(ids_of(library, text, packing.end), packing.limit)):
            want.append((doc, number, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
            at += len(piece)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found], key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.limit
    return len(by_sequence)


@pytest.mark.parametrize("packing", [Packing(limit=64, shard=50, population=4, children=6), Packing(limit=64, shard=7, islands=2, epochs=3), Packing(limit=1024)])
def test_packing(documents, prose, tokenizer, library, packing):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(60))) for i in range(150)] + [(None, "no id"), (None, "no id"), (7, "again"), (900, None), (901, ""), (902, " \n ")]
    rows += [(903, prose(5, 4000))] + [(1000 + i, "the same text") for i in range(40)]
    found = packed(documents(rows), tokenizer, packing).collect()
    n = check(rows, found, library, packing)
    tokens = sum(r["length"] for r in found)
    assert n <= -(-tokens // packing.limit) * 1.03 + 1


def test_real_output(documents, prose, tokenizer, library):
    rows = [(i, prose(i, 30)) for i in range(20)] + [(50, prose(50, 900))]
    packing = Packing(limit=128, shard=10)
    out = sequences(documents(rows), tokenizer, packing).collect()
    pieces = sorted(tuple(p) for _, text in rows for p in cut(ids_of(library, text), 128))
    got = []
    for row in out:
        at = 0
        for length in row["lengths"]:
            got.append(tuple(row["ids"][at : at + length]))
            at += length
        assert at == len(row["ids"]) <= 128
    assert sorted(got) == pieces


def test_empty_table(documents, tokenizer):
    out = packed(documents([]), tokenizer)
    assert out.collect() == []
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_children_keep_every_piece_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300).tolist()
    shard = Shard(lengths, 100, rng)
    population = shard.founders(5)
    best = [shard.score(b) for b in population]
    after = shard.evolve(population, 40)
    for bins in after:
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert max(shard.fill(b) for b in bins) <= 100
    assert shard.score(after[0]) >= max(best)
    assert sorted(map(sorted, as_bins(as_numbers(after[0], 300)))) == sorted(map(sorted, after[0]))


def test_perfect_packings_are_found():
    # Triples that fill a bin, which best fit by length alone breaks up.
    rng = np.random.default_rng(2)
    lengths = []
    for _ in range(40):
        a, b = sorted(rng.integers(260, 370, 2).tolist())
        lengths += [a, b, 1000 - a - b]
    shard = Shard(lengths, 1000, np.random.default_rng(3))
    founders = shard.founders(6)
    evolved = shard.evolve(founders, 400)
    assert len(evolved[0]) < len(founders[0])
