"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from chatlens.llm import components, simhash

DOCS = "doc_id long, text string, lang string, fingerprint string, component_id string, choice int"


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    if words and not grams:
        grams = [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def brute_classes(values, bits):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in rows], DOCS)


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choices(words, k=400)) for _ in range(6)]
    out = []
    for b in base:
        for _ in range(6):
            parts = b.split()
            for _ in range(r.randint(0, 3)):
                parts[r.randrange(len(parts))] = r.choice(words)
            out.append(" ".join(parts).upper() if r.random() < 0.3 else "\n".join(parts))
    return out + ["", None, "  \t", "one", "ONE", "one two", "a\xa0b c d", "ÄÖ É x y", base[0], base[0]]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts(), start=3))
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i].fingerprint & (2**64 - 1) for i, _ in rows] == prints
    expected = [rows[c][0] for c in brute_classes(prints, 2)]
    assert [got[i].component_id for i, _ in rows] == expected
    assert len(set(expected)) < len(rows)


@pytest.mark.parametrize("max_bits, blocks", [(2, 6), (1, 3), (3, 7)])
def test_links_on_random_neighbours(spark, max_bits, blocks):
    r = random.Random(max_bits)
    seeds = [r.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds:
        for _ in range(6):
            for _ in range(r.randint(0, 4)):
                s ^= 1 << r.randrange(64)
            values.add(s)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fingerprint long"), max_bits, blocks)
    linked = {r.node: r.root for r in components.components(found).collect()}
    got = [linked.get(s[0], s[0]) for s in signed]
    expected = [signed[c][0] for c in brute_classes(values, max_bits)]
    groups = lambda x: sorted(
        tuple(i for i in range(len(x)) if x[i] == k) for k in set(x)
    )
    assert groups(got) == groups(expected)


def test_large_group_equals_pairs():
    r = random.Random(1)
    free = ((1 << 11) - 1) | (((1 << 10) - 1) << 40)
    values = np.array(sorted({r.getrandbits(64) & free for _ in range(700)}), dtype=np.uint64)
    root, member = simhash.forest(values, free, 2)
    got = {int(m): int(x) for m, x in zip(member, root)}
    expected = brute_classes([int(v) for v in values], 2)
    assert [got.get(int(v), int(v)) for v in values] == [int(values[c]) for c in expected]


def test_parts_of_long_texts():
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text, 3)
    assert simhash.fingerprint(text, 3, part_bytes=100) == whole


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "same text here now"), (4, "same text here now"), (4, "same text here now"), (None, "q")]
    got = sorted(
        ((r.doc_id, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()),
        key=str,
    )
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
    kept = simhash.one_per_class(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "fingerprint", "component_id", "choice"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(4, rows[0][1])]
    assert kept.count() == 2
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.one_per_class(table(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}}
