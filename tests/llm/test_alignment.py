"""Tokenizer alignment against a walk over both token lists."""

import hashlib
from collections import Counter

import pytest
from conftest import rows_of, sf
from pyspark.sql import functions as F

from chatlens.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string"


def brute(rows):
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    found, corpus = [], Counter()
    for i, text in rows:
        x = y = []
        if text:
            x = a.tokenizer.encode(" " + text, add_special_tokens=False).ids
            y = b.model.encode(text)
            data = (" " + text).encode()
            if b"".join(a.tokens[t] for t in x) != data or b"".join(b.tokens[t] for t in y) != data:
                x = y = []
        links, groups = [], []
        m = n = a_end = b_end = 0
        group = ([], [])
        while m < len(x) or n < len(y):
            if a_end <= b_end and m < len(x):
                a_end += len(a.tokens[x[m]])
                group[0].append(x[m])
                m += 1
            else:
                b_end += len(b.tokens[y[n]])
                group[1].append(y[n])
                n += 1
            if group[0] and group[1]:
                links.append((x[m - 1], y[n - 1]))
            if a_end == b_end:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
        corpus.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        found.append((i, len(x), len(y), len(groups), links, digest))
    most = Counter()
    for (_, t), n in corpus.items():
        most[t] = max(most[t], n)
    return sorted(
        (
            (i, n_a, n_b, n_groups, len(links), sum(corpus[k] == most[k[1]] for k in links), sum(corpus[k] for k in links), digest)
            for i, n_a, n_b, n_groups, links, digest in found
        ),
        key=repr,
    )


def test_token_bytes():
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    text = " naïve 群 \x00\n\t«ok» <|endoftext|>"
    assert b"".join(a.tokens[i] for i in a.encode(text)) == text.encode()
    assert b"".join(b.tokens[i] for i in b.encode(text[1:])) == text.encode()


@pytest.mark.parametrize("limits", [{}, {"radices": 5, "run_links": 500, "group_bytes": 3000}])
def test_matches_a_walk_over_both_lists(spark, limits):
    docs = spark.read.parquet(f"{sf('0.001')}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(alignment.align(docs, A, B, RANKS, **limits)) == brute(rows)


def test_hard_texts_null_ids_repeated_rows_and_other_columns(spark):
    rows = [
        (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "é群🙂\x00 �\r\n\t"),
        (None, "same"), (7, "same"), (7, "same"), (8, "  two  spaces  "), (9, "x" * 20_000), (10, "the cat " * 20_000),
        (11, "  　ａ"), (12, "\x85\xa0 ok"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("row", "radix", "head", "part", "number", "n", "n_best")}
    )
    found = rows_of(alignment.align(docs, A, B, RANKS, run_links=1000, group_bytes=2000))
    assert found == brute(rows)
    assert (4, 0, 0, 0, 0, 0, 0, "") in found
    assert alignment.align(docs.limit(0), A, B).collect() == []
    assert rows_of(alignment.align(docs.where("doc_id < 5"), A, B)) == brute(rows[:4])


def test_a_hot_id_is_spread_over_groups(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a a a a a a").alias("text"))
    table = alignment.spilled(docs.repartition(8), A, RANKS, B, 16, 50).cache()
    runs = alignment.grouped(table.where("head IS NOT NULL"), 200)
    assert runs.agg(F.max("parts")).first()[0] > 3
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    counts = alignment.pair_counts(runs, alignment.Pairs(len(a.tokens), len(b.tokens), 16))
    assert [(r["n"], r["best"]) for r in counts.collect()] == [(2400, True)]
