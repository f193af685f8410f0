"""Tagging: the three physical forms against a brute-force matcher."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of, rows_of

from chatlens import storage
from chatlens.operators import joins, tagging
from chatlens.operators import rules as rule_ops
from chatlens.operators.validation import rule_warnings
from chatlens.plans.flows import prepare_rules
from chatlens.schemas import SchemaError

FORMS = {
    "native": {},
    "joined": {"max_rules": 0},
}


def keyword_table(spark, raw):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(raw)],
        "idx int, brand string, product string, keyword string, required_product string",
    )


def brute(raw, text, literal=False):
    """Headers hit, in header order."""
    rules = [(b or "", p or "", k or "", q or "") for b, p, k, q in raw]
    headers = list(dict.fromkeys(f"{b}_{p}" for b, p, _, _ in rules))
    hit = set()
    for b, p, k, q in rules:
        asked = {f"{b}_{x.strip()}" for x in q.split(",")}
        words = [k2 for b2, p2, k2, _ in rules if f"{b2}_{p2}" in asked]
        if text is None or k.lower() not in text.lower():
            continue
        joined = "|".join(words)
        if joined == "":
            ok = True
        elif literal:
            ok = joined.lower() in text.lower()
        else:
            ok = any(w.lower() in text.lower() for w in words)
        if ok:
            hit.add(f"{b}_{p}")
    kept = []
    for h in headers:
        blocked = "generic" in h and any(
            h.replace("_generic", "") in s and "generic" not in s for s in hit
        )
        if h in hit and not blocked:
            kept.append(h)
    return kept


def random_case(seed):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choices("abcé", k=rng.randint(a, b)))
    products = ["one", "two", "generic", "xgenericx", ""]
    raw = [
        (
            rng.choice(["a", "ab", "abc", "q"]),
            rng.choice(products),
            rng.choice([str.upper, str])(word(1, 3)),
            rng.choice([None, "", "one", "two , one", "nosuch", "one,one", "\tgeneric "]),
        )
        for _ in range(rng.randint(1, 14))
    ]
    texts = [None, "", "A", *[rng.choice([str.upper, str])(word(0, 12)) for _ in range(25)]]
    return raw, texts


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("seed, literal", [(1, False), (2, False), (3, True)])
def test_forms_match_brute_force(spark, form, seed, literal):
    raw, texts = random_case(seed)
    messages = spark.createDataFrame(list(enumerate(texts)), "id int, messageBody string")
    tagged = tagging.tag_messages(
        messages,
        prepare_rules(keyword_table(spark, raw)),
        required=tagging.LITERAL if literal else tagging.ANY,
        **FORMS[form],
    )
    found = {r["id"]: [h["header"] for h in r["hits"]] for r in tagged.collect()}
    assert found == {i: brute(raw, t, literal) for i, t in enumerate(texts)}


@pytest.mark.parametrize("form", FORMS)
def test_blank_keyword_matches_every_message(spark, form):
    raw = [("a", "one", "", None), ("b", "generic", "zz", None)]
    messages = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, messageBody string")
    tagged = tagging.tag_messages(messages, prepare_rules(keyword_table(spark, raw)), **FORMS[form])
    found = {r["id"]: [h["header"] for h in r["hits"]] for r in tagged.collect()}
    assert found == {1: ["a_one"], 2: ["a_one"], 3: []}


@pytest.mark.parametrize("form", FORMS)
def test_no_rules_keeps_messages(spark, form):
    messages = spark.createDataFrame([(1, "x"), (2, None)], "id int, messageBody string")
    options = FORMS[form] if form != "joined" else {"max_rules": -1}
    tagged = tagging.tag_messages(messages, prepare_rules(keyword_table(spark, [])), **options)
    assert [list(r["hits"]) for r in tagged.collect()] == [[], []]


def test_copies_of_a_text_all_get_its_hits(spark):
    raw = [("a", "one", "hot", None)]
    messages = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'HOT text', 'cold') AS messageBody")
    tagged = tagging.tag_messages(messages, prepare_rules(keyword_table(spark, raw)), max_rules=0)
    assert tagging.explode_hits(tagged).count() == 1000
    assert tagged.count() == 3000


def test_full_case_folding(spark):
    raw = [("a", "one", "straße ΝΑΣ", None), ("b", "one", "İs", None)]
    texts = [(1, "STRAßE νας"), (2, "ſtraße νασ"), (3, "is"), (4, "ıſ")]
    messages = spark.createDataFrame(texts, "id int, messageBody string")
    rules = prepare_rules(keyword_table(spark, raw))
    for options in FORMS.values():
        tagged = tagging.tag_messages(messages, rules, full_fold=True, **options)
        found = {r["id"]: [h["header"] for h in r["hits"]] for r in tagged.collect()}
        assert found == {1: ["a_one"], 2: ["a_one"], 3: ["b_one"], 4: ["b_one"]}


def test_tagging_does_not_shuffle(spark):
    raw, _ = random_case(1)
    rules = prepare_rules(keyword_table(spark, raw))
    messages = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tagged = tagging.tag_messages(messages, rules, message_col="text")
    main = plan_of(tagged).split("Subquery")[0] + plan_of(tagged).split("FileScan")[1]
    assert "Exchange" not in main and "Join" not in main
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(tagged)


def test_rule_table(spark):
    raw = [
        ("a", "one", "k1", "two,  two ,three"),
        ("a", "two", "k2", None),
        ("a", "three", "k|3", None),
        ("a", None, "k4", None),
        ("a", "two", "k5", "nosuch"),
        ("b", "one", "", ""),
    ]
    rules = prepare_rules(keyword_table(spark, raw))
    required = {r["idx"]: r["required_keyword"] for r in rules.collect()}
    # a blank requirement finds the products without a name
    assert required == {0: "k2|k|3|k5", 1: "k4", 2: "k4", 3: "k4", 4: "", 5: ""}
    kinds = {r["idx"]: r["kind"] for r in rule_ops.with_rule_kind(rules).collect()}
    assert kinds == {0: "complex", 1: "complex", 2: "complex", 3: "complex", 4: "simple", 5: "simple"}
    assert rows_of(rule_warnings(rules)) == [
        (4, "required_product", "unresolved_required_product"),
        (5, "keyword", "blank_keyword"),
    ]
    assert rule_ops.rules_of_header(rules, "a_two").count() == 2
    order = rule_ops.header_order(rules).orderBy("ord").collect()
    assert [r["headers"] for r in order] == ["a_one", "a_two", "a_three", "a_", "b_one"]
    words = {r["headers"]: r["keywords"] for r in rule_ops.header_keywords(rules).collect()}
    assert words["a_one"] == "3, k, k1, k2, k5"
    with pytest.raises(SchemaError):
        prepare_rules(keyword_table(spark, raw).drop("idx"))


def test_any_number_of_headers(spark):
    table = spark.range(17_000).selectExpr(
        "id AS idx", "'b' || id AS brand", "if(id % 9 = 0, 'generic', 'p') AS product",
        "'word' || id AS keyword", "CAST(NULL AS string) AS required_product",
    )
    rules = prepare_rules(table)
    index = tagging.index_rules(rules)
    assert tagging.index_rules(rules, max_rules=10_000) is None
    assert index.headers == tagging.header_names(rules)
    assert len(index.headers) == 17_000


def test_requirements_are_stored_once(spark):
    raw = [("a", "two", f"k{i}", None) for i in range(100)] + [("a", "one", f"m{i}", "two") for i in range(100)]
    index = tagging.index_rules(prepare_rules(keyword_table(spark, raw)))
    assert [len(r) for r in index.requirements] == [100]
    headers = [("a", f"generic{i}", "x", None) for i in range(30)] + [("ab", f"p{i}", "x", None) for i in range(30)]
    rules = prepare_rules(keyword_table(spark, headers + [("a", "generic", "y", None)]))
    assert tagging.build_index(tagging.rule_needles(rules), max_pairs=10) is None


def test_requirements_shared_by_thousands_of_rules_stay_linear(spark):
    """3,000 rules ask for a product of 3,000 keywords: nothing holds 9,000,000 of them."""
    table = [(k, "b", "x", f"ask{k}x", "y") for k in range(3000)]
    table += [(3000 + k, "b", "y", f"word{k}y", "") for k in range(3000)]
    rules = prepare_rules(spark.createDataFrame(table, "idx int, brand string, product string, keyword string, required_product string"))
    needles = tagging.rule_needles(rules)
    assert (needles.rules.count(), needles.alternatives.count()) == (6000, 3000)
    index = tagging.index_rules(rules)
    assert [len(r) for r in index.requirements] == [3000]
    messages = spark.createDataFrame([(0, "ask7x word9y"), (1, "ask7x"), (2, "word9y word8y")], "id int, messageBody string")
    expected = [(0, ["b_x", "b_y"]), (1, []), (2, ["b_y"])]
    for tagged in (tagging.tag_by_index(messages, index), tagging.tag_by_join(messages, rules)):
        assert rows_of(tagged.select("id", "hits.header")) == expected


@pytest.mark.parametrize("max_listed", [-1, 2_000_000])
@pytest.mark.parametrize("seed, literal, suppress", [(4, False, True), (5, True, True), (6, False, False)])
def test_lists_and_joins_match_search(spark, max_listed, seed, literal, suppress):
    raw, texts = random_case(seed)
    messages = spark.createDataFrame(list(enumerate(texts + texts)), "id int, messageBody string")
    rules = prepare_rules(keyword_table(spark, raw))
    options = dict(required=tagging.LITERAL if literal else tagging.ANY, suppress=suppress)
    joined = tagging.tag_by_join(messages, rules, max_listed=max_listed, **options)
    assert rows_of(joined) == rows_of(tagging.tag_messages(messages, rules, **options))
    if suppress:
        found = {r["id"]: [h["header"] for h in r["hits"]] for r in joined.collect()}
        assert found == {i: brute(raw, t, literal) for i, t in enumerate(texts + texts)}


def test_hits_are_not_stored(spark, monkeypatch):
    """400 messages with a keyword of 500 rules: 200,000 hits, while all tables stored have a few thousand elements."""
    kept = []

    def keep(df, name):
        kept.append(storage.keep(df, name))
        return kept[-1]

    monkeypatch.setattr(tagging, "keep", keep)
    monkeypatch.setattr(joins, "keep", keep)
    table = spark.range(500).selectExpr(
        "id AS idx", "'b' || id AS brand", "if(id % 50 = 0, 'generic', 'p') AS product",
        "'word' AS keyword", "CAST(NULL AS string) AS required_product",
    )
    messages = spark.range(400).selectExpr("id", "'a word ' || id AS messageBody")
    tagged = tagging.tag_by_join(messages, prepare_rules(table))
    assert tagged.selectExpr("sum(size(hits))").first()[0] == 400 * 500
    elements = 0
    for df in kept:
        lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
        elements += df.count() + sum(df.selectExpr(f"coalesce(sum(size({c})), 0)").first()[0] for c in lists)
    assert elements < 40_000


@pytest.mark.parametrize("cells", [1, 64, 1 << 20])
def test_hits_come_in_bounded_batches(monkeypatch, cells):
    """Hits are made in flat arrays, some rows at a time, and never all those of a batch of texts at once."""
    monkeypatch.setattr(tagging, "MARKED_CELLS", cells)
    monkeypatch.setattr(tagging, "BATCH_HITS", 50)
    rng = random.Random(cells)
    n, needles, requirements = 40, 12, 5
    pairs = lambda a, b, k: list({(rng.randrange(a), rng.randrange(b)) for _ in range(k)})
    simple, asks, meets = pairs(needles, n, 60), pairs(needles, requirements * n, 60), pairs(needles, requirements, 10)
    # headers from 30 on are generic
    suppresses = [(p, 30 + g) for p, g in pairs(30, 10, 25)]
    columns = [tuple(np.array(x, np.int64).T) for x in (simple, asks, meets, suppresses)]
    lists = tagging.HitLists(pa.array(range(n)), pa.array([f"h{i}" for i in range(n)]), needles, requirements, *columns)
    found = [None, [], *[rng.sample(range(needles), rng.randint(0, 5)) for _ in range(60)]]
    expected = []
    for numbers in found:
        numbers = numbers or []
        met = {q for i, q in meets if i in numbers}
        hit = {p for i, p in simple if i in numbers} | {c % n for i, c in asks if i in numbers and c // n in met}
        hit -= {g for p, g in suppresses if p in hit}
        expected.append([{"ord": p, "header": f"h{p}"} for p in sorted(hit)])
    batches = list(tagging.resolve_hits(lists)(pa.array(found, pa.list_(pa.int64()))))
    assert [r for b in batches for r in b.to_pylist()] == expected
    assert len(batches) > 1 and all(len(b.flatten()) < 50 + max(n, cells) for b in batches) or cells == 1 << 20


def test_hits_are_computed_once(spark):
    """One search a text and one explode: no filter with a second search, no function over each hit."""
    rules = prepare_rules(keyword_table(spark, [("a", "one", "hot", None), ("b", "one", "t", None)]))
    messages = spark.createDataFrame([(1, "hot"), (2, "x"), (3, None), (4, "t")], "id int, messageBody string")
    exploded = tagging.explode_hits(tagging.tag_messages(messages, rules)).select("id", "ord", "header")
    assert plan_of(exploded).count("+- ArrowEvalPython") == 1 and "transform(" not in plan_of(exploded)
    assert rows_of(exploded) == [(1, 0, "a_one"), (1, 1, "b_one"), (4, 1, "b_one")]


def test_needles_are_made_once(spark, monkeypatch):
    """A rule table too large to ship is not read, folded and stored again for the joins."""
    made = []
    monkeypatch.setattr(tagging, "rule_needles", lambda *a, f=tagging.rule_needles: made.append(a) or f(*a))
    rules = prepare_rules(keyword_table(spark, [("a", "one", "hot", None)]))
    messages = spark.createDataFrame([(1, "hot"), (2, None)], "id int, messageBody string")
    tagged = tagging.tag_messages(messages, rules, max_rules=0)
    assert rows_of(tagged.select("id", "hits.header")) == [(1, ["a_one"]), (2, [])]
    assert len(made) == 1
