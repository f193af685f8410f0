"""Replies, retries, model scoring and the final cells."""

import os
import random
import uuid

import pytest
from conftest import plan_of, rows_of
from pyspark.sql import functions as F

from chatlens import fixtures as fx
from chatlens.functions.replies import parse_reply
from chatlens.operators import scoring, tagging
from chatlens.plans import flows
from chatlens.schemas import HITS

RULES = [("a", "one", "foo", None), ("b", "one", "bar", None)]


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [tuple(r[1]) for r in df.select("i", parse_reply(F.col("t"))).orderBy("i").collect()]


def test_reply_status(spark):
    texts = [t for t, _ in fx.REPLIES] + [None]
    found = parsed(spark, texts)
    assert [r[0] for r in found] == [s for _, s in fx.REPLIES] + ["no_text"]
    assert found[0][1:] == ("P", "good", None)
    assert found[11][1:3] == ("N", "é")


def test_reply_corner_cases(spark):
    texts = {
        ' \x1f {"sentiment":"P","reason":"x"} \n': "ok",
        '``````{"sentiment":"P","reason":"x"}': "bad_json",
        '```{"sentiment":"P","reason":"x"}``` ```{"sentiment":"N","reason":"y"}```': "ok",
        '{"sentiment":["P"],"reason":"x"}': "bad_structure",
        '{"sentiment":"P","reason":null}': "bad_structure",
        '"text"': "not_object",
        "1.5": "not_object",
        "true": "not_object",
        '1,"x":2': "bad_json",
        '{"sentiment":"P","reason":"a\\"b\\u00e9"}': "ok",
    }
    found = parsed(spark, list(texts))
    assert [r[0] for r in found] == list(texts.values())
    assert found[2][1] == "P"
    assert found[6][3] == "'float' object does not support item assignment"
    assert found[9][2] == 'a"bé'


def test_retry_cases(spark):
    reply = [t for t, _ in fx.REPLIES]
    cases = {
        "3,0": (True, "P", 2),
        "3,6,0": (True, "P", 3),
        "3,6,7": (False, "I", 3),
        "9,0": (False, "I", 1),
        "n,n,0": (True, "P", 3),
        "3,3,3,0": (False, "I", 3),
    }
    attempts = [
        (case, i + 1, None if k == "n" else reply[int(k)])
        for case in cases
        for i, k in enumerate(case.split(","))
    ]
    df = spark.createDataFrame(attempts, "request_id string, attempt int, text string")
    found = {
        r["request_id"]: (r["success"], r["sentiment"], r["attempts_used"])
        for r in scoring.fold_replies(df).collect()
    }
    assert found == cases
    reasons = {r["request_id"]: r["reason"] for r in scoring.fold_replies(df).collect()}
    assert reasons["3,6,7"] == "Failed to get valid JSON after 3 times of retries"
    assert reasons["9,0"] == "list indices must be integers or slices, not str"


def tagged(spark, bodies):
    raw = [(i, *r) for i, r in enumerate(RULES)]
    rules = flows.prepare_rules(
        spark.createDataFrame(
            raw, "idx int, brand string, product string, keyword string, required_product string"
        )
    )
    messages = spark.createDataFrame(list(enumerate(bodies)), "id int, messageBody string")
    return tagging.tag_messages(messages, rules), rules


def recorder():
    """A scorer that replies by the words of a message and shows what it was asked."""
    import json

    class Recorder:
        def __call__(self, conversations):
            return [self.one(c) for c in conversations]

        def one(self, conversation):
            body = conversation[1]["content"]
            ask = json.dumps({"sentiment": "P", "reason": f"asked {len(conversation)}: {body}"})
            if "explode" in body:
                return RuntimeError("no luck")
            if "silent" in body:
                return None
            if "list" in body:
                return "[]"
            if "never" in body:
                return "junk"
            if "second" in body and len(conversation) < 4:
                return "junk"
            if "third" in body and len(conversation) < 6:
                return '{"sentiment":"X","reason":"y"}'
            return ask

    return Recorder


def test_model_scoring(spark):
    bodies = [
        "foo", "foo second", "foo third", "foo never", "foo silent", "foo list", "foo explode",
        "nothing", None, "foo bar", "foo", "foo",
    ]
    messages, rules = tagged(spark, bodies)
    score = flows.model_scorer(recorder(), rules)
    scored = scoring.with_reason(score(messages))
    rows = {r["id"]: r for r in scored.collect()}
    ask = "Formula Brand: {}, Message: {}".format
    failed = "Failed to get valid JSON after 3 times of retries"
    assert {i: r["Reason"] for i, r in rows.items()} == {
        0: f"a_one: asked 2: {ask('a_one', 'foo')}\n",
        1: f"a_one: asked 4: {ask('a_one', 'foo second')}\n",
        2: f"a_one: asked 6: {ask('a_one', 'foo third')}\n",
        3: f"a_one: {failed}\n",
        4: f"a_one: {failed}\n",
        5: "a_one: list indices must be integers or slices, not str\n",
        6: "a_one: no luck\n",
        7: "",
        8: "",
        9: f"a_one: asked 2: {ask('a_one', 'foo bar')}\nb_one: asked 2: {ask('b_one', 'foo bar')}\n",
        10: f"a_one: asked 2: {ask('a_one', 'foo')}\n",
        11: f"a_one: asked 2: {ask('a_one', 'foo')}\n",
    }
    wide = scoring.wide_sentiment(scored, ["a_one", "b_one"])
    cells = {r["id"]: (r["a_one"], r["b_one"]) for r in wide.collect()}
    assert cells[0] == ("P", "") and cells[3] == ("1", "") and cells[9] == ("P", "P")
    assert cells[7] == ("", "") and cells[8] == ("", "")


def test_each_distinct_request_is_asked_once(spark):
    messages, _ = tagged(spark, ["foo", "foo", "FOO", "foo bar"])
    requests = scoring.distinct_requests(messages)
    # no filter that would compute the hits a second time
    assert "Filter" not in plan_of(requests)
    assert requests.count() == 4
    assert scoring.request_rows(messages).count() == 5


def test_offline_replies(spark):
    messages, _ = tagged(spark, ["foo", "bar", "foo bar", "none"])
    requests = scoring.distinct_requests(messages)
    attempts = requests.where("header = 'a_one'").select(
        "request_id", F.lit(1).alias("attempt"), F.lit(fx.REPLIES[0][0]).alias("text")
    )
    answered = scoring.with_outcomes(requests, scoring.fold_replies(attempts))
    scored = scoring.attach_results(messages, answered)
    wide = scoring.wide_sentiment(scoring.with_reason(scored), ["a_one", "b_one"])
    assert rows_of(wide.select("id", "a_one", "b_one", "Reason")) == [
        (0, "P", "", "a_one: good\n"),
        (1, "", "1", "b_one: no reply\n"),
        (2, "P", "1", "a_one: good\nb_one: no reply\n"),
        (3, "", "", ""),
    ]


def test_reason_is_appended(spark):
    messages, _ = tagged(spark, ["foo"])
    scored = scoring.score_by_lexicon(messages.withColumn("Reason", F.lit("before ")), ["foo"], [])
    assert scoring.with_reason(scored).first()["Reason"] == "before a_one: only positive words\n"


def test_no_request_is_repeated_when_one_fails(spark, tmp_path):
    messages, rules = tagged(spark, [f"foo {i}" for i in range(20)] + ["foo explode"])

    def make():
        def scorer(conversations):
            import uuid

            for c in conversations:
                assert c[0]["role"] == "system" and "a_one" in c[0]["content"]
                (tmp_path / uuid.uuid4().hex).write_text(c[1]["content"])
            if any("explode" in c[1]["content"] for c in conversations):
                raise RuntimeError("no luck")
            return ['{"sentiment":"P","reason":"r"}'] * len(conversations)

        return scorer

    scored = flows.model_scorer(make, rules, batch_size=1)(messages)
    reasons = {r["id"]: r["results"][0]["reason"] for r in scored.collect()}
    assert reasons == {**{i: "r" for i in range(20)}, 20: "no luck"}
    assert len(list(tmp_path.iterdir())) == 21


def test_a_run_that_died_goes_on_where_it_ended(spark, tmp_path):
    folder, cured = str(tmp_path / "asked"), str(tmp_path / "cured")
    os.makedirs(folder)

    def make():
        def scorer(conversations):
            if any(len(c) > 2 for c in conversations) and not os.path.exists(cured):
                raise SystemExit("killed in the second round")
            for c in conversations:
                with open(f"{folder}/{uuid.uuid4()}", "w") as f:
                    f.write(f"{len(c)} {c[1]['content']}")
            return ["junk" if len(c) == 2 and "second" in c[1]["content"] else '{"sentiment":"P","reason":"r"}' for c in conversations]

        return scorer

    messages, rules = tagged(spark, ["foo", "foo second", "foo bar second", "nothing", "foo"])
    score = flows.model_scorer(make, rules, log=str(tmp_path / "log"))
    with pytest.raises(Exception):
        score(messages)
    assert len(os.listdir(folder)) == 4
    open(cured, "w").close()
    scored = score(messages)
    assert all(r["success"] for row in scored.collect() for r in row["results"])
    asked = sorted(open(f"{folder}/{name}").read() for name in os.listdir(folder))
    assert len(asked) == len(set(asked)) == 7  # four requests, of which three are asked a second time
    score(messages)
    assert len(os.listdir(folder)) == 7


def test_word_lists_of_any_size(spark):
    """Conditions, search and joins give the same verdicts as testing every word."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcäİ", k=r.randint(1, 5)))
    positive = [word().upper() for _ in range(20)]
    negative = [word() for _ in range(20)] + positive[:2]
    texts = [None, "", *["".join(r.choices("abcäİ ", k=r.randint(0, 12))) for _ in range(150)]]
    hits = [(1, "h")]
    rows = [(i, t, hits if i % 5 else []) for i, t in enumerate(texts + texts[:40])]
    tagged = spark.createDataFrame(rows, f"id int, messageBody string, hits {HITS.simpleString()}")
    table = lambda words: spark.createDataFrame([(w,) for w in [*words, None]], "word string")

    def verdicts(a, b, **limits):
        scored = scoring.score_by_lexicon(tagged, a, b, **limits)
        assert scored.columns == ["id", "messageBody", "hits", "results"]
        return {x.id: [(y.header, y.sentiment) for y in x.results] for x in scored.collect()}

    for a, b in ((positive, negative), (positive + [""], negative), ([], negative), ([], [])):
        folded = [[w.lower() for w in words] for words in (a, b)]
        want = {}
        for i, text, own in rows:
            p, n = [text is not None and any(w in text.lower() for w in words) for words in folded]
            want[i] = [(h, "P" if p and not n else "N" if n and not p else "I") for _, h in own]
        assert verdicts(a, b) == want
        assert verdicts(table(a), b) == want
        assert verdicts(table(a), table(b), max_words=1) == want
        many = [f"zz{i}" for i in range(20_000)]
        assert verdicts(a + many, b + many[:50]) == want
