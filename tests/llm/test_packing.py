"""Best-fit packing against the tokenizer itself and a plain best-fit loop."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, ids string, length string, sequence_id int"
ODD = [
    "", "a", " a", "a ", "  a", "a  b", "a \n b", "\n\n x\n", "it's we'll 12 3,4", "日本語 のテキスト",
    "a\x1cb \x1c c", "x\x00y \x00", "<|endoftext|>", "a <|endoftext|> b", "Ünïcödé “quotes”", "tab\t\tx",
    "a  b　c", "émoji 😀 😀😀", "a" * 3000, "!? ...", " " * 500 + "z",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def units():
    return packing.UnitIds(PATH, RANKS)


@pytest.mark.parametrize("text", ODD)
def test_unit_ids(plain, units, text):
    ids = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(units.encode(text), "<u4").tolist() == ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé1 \n\t\r\x0b\x1c\x85\xa0 .,!<|>日😀")))
def test_unit_ids_of_any_text(plain, units, text):
    ids = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(units.encode(text), "<u4").tolist() == ids


def plain_best_fit(lengths, capacity):
    spaces = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - n)
        else:
            spaces.append(capacity - n)
    return len(spaces)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 64, 1024])
    lengths = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(r.randint(1, 900))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan_slots(counts, capacity)
    bins = {}
    for n, count in counts.items():
        own = sorted(x[1:] for x in runs if x[0] == n)
        assert [x[0] for x in own] == [0] + [x[1] for x in own[:-1]] and own[-1][1] == count
    for n, lo, hi, first, per, place in runs:
        for k in range(hi - lo):
            bins.setdefault(first + k // per, []).append((place + k % per * n, n))
    for slots in bins.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:]))
        assert sum(slots[-1]) <= capacity
    assert len(bins) == plain_best_fit(lengths, capacity)
    assert len(runs) <= 30 * capacity


def test_pieces_and_sequences(spark, plain):
    r = random.Random(3)
    words = ["alpha", "beta,", "gamma.", "d\n", "  e"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 300)))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "no id"), (72, "twice"), (72, "twice"), (73, "x y " * 900)]
    docs = spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in rows], DOCS)
    pieces = packing.tokenize(docs, PATH, RANKS, capacity=64)
    got = packing.pack(pieces, capacity=64).collect()
    expected = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0] + list(range(len(ids) % 64 or min(64, len(ids)), len(ids), 64)) + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(x.doc_id), x.piece, x.start, x.length, zlib.crc32(x.ids)) for x in got) == sorted(expected)
    sequences = {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for slots in sequences.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:]))
        assert sum(slots[-1]) <= 64
    assert len(sequences) == plain_best_fit([x.length for x in got], 64)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.pack(packing.tokenize(docs, PATH)).count() == 0
