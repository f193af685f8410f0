"""Encoding against the library, Viterbi against all paths, and the round trip."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from chatlens.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, unit string, ids string, piece int"
TEXTS = [
    "", None, " ", "  a  b ", "a\nb\n\n", "é é 日本語 😀", "tab\there", "x\x00y", "▁a", "the theory of tokens",
    "in the beginning\nwas the word", "Déjà vu, naïve; co-operate!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "word " * 50, "zzzqqq" * 30,
]


@pytest.fixture(scope="module")
def table():
    return sp.load(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "u", "x", 1) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("n_units", [0, 20, 100_000])
def test_equals_library(spark, table, library, n_units):
    texts = TEXTS + [None, "the same", "the same"]
    got = sp.decode(sp.encode(frame(spark, texts), table, n_units), table).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "unit", "ids", "piece", "decoded"}
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.ids == library.encode(t), t
        assert r.decoded == t.replace("▁", " ")


def test_texts_are_encoded_once(spark, table, library, monkeypatch, tmp_path):
    calls, encode_texts = str(tmp_path / "calls"), sp.encode_texts

    def counted(texts, *rest):
        with open(calls, "a") as file:
            file.write(".")
        return encode_texts(texts, *rest)

    monkeypatch.setattr(sp, "encode_texts", counted)
    both = sp.decode(sp.encode(frame(spark, TEXTS).coalesce(1), table, 20), table)
    got = both.select("doc_id", sp.F.size("ids").alias("n"), sp.F.array_join("ids", " ").alias("all"), "decoded").collect()
    assert [r.all for r in got] == [" ".join(map(str, library.encode(t or ""))) for t in TEXTS]
    assert [r.decoded for r in got] == [(t or "").replace("▁", " ") for t in TEXTS]
    assert open(calls).read() == "."


def test_other_texts_are_encoded_anew(table, library):
    rare, pattern = sp.RareUnits(table), sp.re.compile(table.unit)
    for texts in (["a b"], ["a b"], ["a b"], ["a c"], ["a c", None], ["a c", ""], [None, "a c"], []):
        ids = sp.encode_once(sp.pa.array(texts, "string"), pattern, {}, rare)
        assert ids.to_pylist() == [library.encode(t or "") for t in texts]


def test_units_of_any_kind(table, library):
    r = random.Random(2)
    for _ in range(2000):
        t = "".join(r.choices("aAb e  \n.,12é日▁<>s😀tthein ", k=r.randint(0, 60)))
        ids = [i for u in sp.re.findall(sp.UNIT, sp.MARK + t.replace(" ", sp.MARK)) for i in table.merge(u)]
        assert (ids if t else []) == library.encode(t)


def test_a_word_is_one_unit_whatever_follows(table):
    units = sp.re.findall(table.unit, "▁word▁word.▁word,▁(word)!!▁▁дом;\n")
    assert units == ["▁word", "▁word", ".", "▁word", ",", "▁(", "word", ")!!", "▁▁дом", ";", "\n"]
    assert set(sp.unit_pattern(["a", "b"]).split("|")) == {"▁*[^▁\n]+", "▁+", "\n"}


@pytest.mark.parametrize("batch", [1, 50, 1 << 19])
def test_units_together_equal_library(table, library, monkeypatch, batch):
    monkeypatch.setattr(sp, "BATCH_UNITS", batch)
    monkeypatch.setattr(sp, "BATCH_IDS", batch)
    r = random.Random(5)
    chars, names = "aAb e  \n.,12é日▁<>s😀tthein -'\"()мирñÄ\x00\t", list(table.pieces)
    texts = TEXTS + ["".join(r.choices(chars, k=r.randint(0, 60))) for _ in range(500)]
    texts += ["".join(r.choices(names, k=r.randint(1, 12))) for _ in range(500)]
    frequent = {u: sp.np.array(table.merge(u), "int32").tobytes() for u in ("▁the", ".", "▁")}
    for rare in (sp.RareUnits(table), sp.RareUnits(table)):
        for _ in range(2):
            lists = sp.encode_texts(sp.pa.array(texts, "string"), sp.re.compile(table.unit), frequent, rare)
            assert lists.to_pylist() == [library.encode(t or "") for t in texts]
    assert table.decode_lists(lists) == [(t or "").replace("▁", " ") for t in texts]
    assert table.decode_lists(sp.pa.array([None, [], [table.pieces["▁the"][0]]], lists.type)) == ["", "", "the"]
    with pytest.raises(KeyError):
        table.decode_lists(sp.pa.array([[-1]], lists.type))


def best_path(table, unit):
    """The best of all segmentations."""
    if not unit:
        return 0.0, []
    ways = []
    for k in range(1, min(len(unit), table.longest) + 1):
        piece = unit[:k]
        if piece in table.pieces or k == 1:
            score, rest = best_path(table, unit[k:])
            own = table.pieces[piece][1] if piece in table.pieces else table.unknown_score
            ids = [table.pieces[piece][0]] if piece in table.pieces else table.of_char(piece)
            ways.append((own + score, ids + rest))
    return max(ways)


@pytest.mark.parametrize("with_bytes", [True, False])
def test_viterbi_of_unigram_models(spark, with_bytes):
    r = random.Random(3)
    names = {"".join(r.choices("abcé", k=r.randint(1, 4))) for _ in range(40)} - {"c"}
    pieces = {p: (i + 300, -r.random() * 9) for i, p in enumerate(sorted(names))}
    table = sp.PieceTable("unigram", pieces, list(range(256)) if with_bytes else [], 299)
    units = sorted({"".join(r.choices("abcé日", k=r.randint(1, 9))) for _ in range(80)})
    expected = {u: best_path(table, u)[1] for u in units}
    assert {u: table.viterbi(u) for u in units} == expected
    got = sp.unit_ids(spark.createDataFrame([(u,) for u in units], "unit string"), table)
    assert {x.unit: x.ids for x in got.collect()} == expected


def test_bound_of_frequent_units(spark):
    docs = frame(spark, ["a a a a b b c d", "a b e"])
    assert {r.unit for r in sp.frequent_units(docs, 2).collect()} == {"▁a", "▁b"}
    assert sp.frequent_units(docs, 0).count() == 0


def test_empty_table(spark, table):
    assert sp.encode(spark.createDataFrame([], DOCS), table).count() == 0
