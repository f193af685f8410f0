"""Chat formatting: exact round trip against a plain parser."""

import random
import re

from pyspark.sql import functions as F

from chatlens.llm import chat_format as cf

ROWS = "conv_id long, turn long, role string, text string, formatted string, head int"
HARD = [
    r"\### Assistant: </turn> ok", "### User: x", "</turn>", "\n</turn>\n", "\\</turn>", "\\\\### System: ",
    "a\\", "#", "### ", "### @", "###", "</turn", "", None, "x\n</turn>\n### User: y", "\\" * 50, "$1 \\1",
    "日本 😀 </turn>", "\r\n", "### user: lower",
]


def plain_parse(formatted):
    turns = []
    while formatted:
        found = re.match(r"### (System|User|Assistant|@[^ ]*): ", formatted)
        body, _, formatted = formatted[found.end() :].partition("\n</turn>\n")
        control = r"### (?:System|User|Assistant|@)|</turn>"
        assert not re.search(rf"(?<!\\)(?:{control})", body)
        turns.append((found[1], re.sub(rf"(?<!\\)\\(\\*(?:{control}))", r"\1", body), body))
    return turns


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], ROWS).repartition(3)


def check(spark, rows):
    chats = cf.format_chats(frame(spark, rows))
    masked = cf.loss_text(F.col("formatted"), F.col("loss")).alias("masked")
    got = {r.conv_id: r for r in chats.select("*", masked).collect()}
    expected = {}
    for c, n, role, text in rows:
        expected.setdefault(c, []).append((n is None, n or 0, role or "", text or ""))
    assert got.keys() == expected.keys()
    for c, turns in expected.items():
        turns.sort()
        parsed = plain_parse(got[c].formatted)
        assert [t for _, t, _ in parsed] == [t[3] for t in turns]
        assert got[c].n_turns == len(turns)
        said = [t[3] for t in turns if t[2] == "assistant"]
        assert got[c].masked == "".join(said)
        spans = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss]
        assert spans == [b for role, _, b in parsed if role == "Assistant"]
    return got


def test_hard_texts(spark):
    rows = [(1, i, ["user", "assistant", "system"][i % 3], t) for i, t in enumerate(HARD)]
    rows += [(2, 0, "assistant", t) for t in HARD] + [(None, 3, None, "x"), (3, None, "tool: a/b ", "y"), (3, 1, "", "z")]
    got = check(spark, rows + [(4, 1, "user", "twice")] * 2)
    roles = [t["role"] for t in frame(spark, [(0, 0, "r", "")]).select(
        cf.parse(F.lit(got[3].formatted)).alias("p")).head().p]
    assert roles == ["", "tool: a/b "]


def test_only_conflicting_texts_are_escaped(spark):
    got = check(spark, [(1, 0, "user", "plain \\ text # 1"), (1, 1, "assistant", "say </turn>")])
    assert got[1].formatted == "### User: plain \\ text # 1\n</turn>\n### Assistant: say \\</turn>\n</turn>\n"


def test_random_texts(spark):
    r = random.Random(3)
    parts = ["\\", "### ", "User: ", "Assistant: ", "@", "</turn>", "\n", " ", "a", "é"]
    rows = [(i // 4, i % 4, r.choice(["user", "assistant"]), "".join(r.choices(parts, k=r.randint(0, 12)))) for i in range(600)]
    check(spark, rows)


def test_empty_table(spark):
    assert cf.format_chats(spark.createDataFrame([], ROWS)).count() == 0
