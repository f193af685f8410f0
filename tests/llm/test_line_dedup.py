"""Line dedup against a plain loop over documents in order."""

import random

import pytest

from chatlens.llm import line_dedup

DOCS = "doc_id long, text string, lang string, n_lines string, pos string, seen int"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_chars):
    owner, holders = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            rank = (i is None, i or 0)
            owner[k] = min(owner.get(k, rank), rank)
            holders.setdefault(k, set()).add(rank)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x
            for x in lines
            if len(key(x)) < min_chars
            or len(holders[key(x)]) < 2
            or owner[key(x)] == (i is None, i or 0)
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def collection(seed):
    r = random.Random(seed)
    pool = ["Lorem ipsum %d dolor" % i for i in range(12)] + ["", "short", "ÄÖÜ groß und klein", "x" * 400]
    rows = []
    for i in range(90):
        lines = [r.choice(pool) for _ in range(r.randint(0, 9))]
        lines = [r.choice(["", " ", "\t\r"]) + r.choice([str, str.upper])(x) + r.choice(["", "\r", " "]) for x in lines]
        rows.append((r.choice([i, i, i, None, 7, 50]), "\n".join(lines)))
    return rows + [(3, None), (4, ""), (4, ""), (91, "\n\n"), (92, "Lorem ipsum 1 dolor\n" * 300)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (7, 3)])
def test_matches_plain_loop(spark, batches, fanout):
    rows = collection(batches)
    docs = spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in rows], DOCS).repartition(3)
    found = line_dedup.dedup_lines(docs, batches, 10, fanout)
    assert sorted(found.columns) == sorted(docs.columns + ["n_dropped"])
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str)
    assert got == brute(rows, 10)


def test_runs_stay_few(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(6):
        batch = spark.createDataFrame([(i, f"line number {i}\nthe same old line")], "doc_id long, text string")
        kept = runs.add(batch).collect()
        assert kept[0].text == (f"line number {i}\nthe same old line" if i == 0 else f"line number {i}")
    assert sum(len(level) for level in runs.levels) <= 4


def test_empty_table_and_null_ids_only(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a line of text\na line of text"), (None, "a line of text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(docs).collect()) == sorted(t for _, t in rows)
