"""Secret scans: candidates by pattern, false positives removed by a random forest.

All in built-in expressions, row by row and without a shuffle: a pattern cuts a text into
candidates and what lies between; a lambda turns each candidate and its neighbourhood into numbers
(length, character transitions, dictionary coverage, path, neighbouring words); the forest, written
out as nested conditions, scores them. What the forest takes for a secret is a finding, and
``redact`` replaces it.

The forest is fitted by Spark on labelled findings ``left, value, right, label``. ``labelled_findings``
makes such a table from a bounded sample of about ``sample_docs`` documents: their own candidates,
labelled by whether they are assigned to a secret's name, stand for a password in an address or have a secret's form, and values derived
from them in places known to be secrets or harmless; private keys and tokens with a provider's
prefix are secrets wherever they stand. A table of own, reviewed findings can be given instead.

A value and its name may be 64 blanks apart on each side of the sign between them; quoted values end at their quote, others at a blank.

Cases: a null text has no candidates and stays null; candidates of any length and number are
scored; a null ``doc_id`` and repeated rows are scanned like all others; an empty table gives no
rows, and a forest that saw one label only says that label; the columns ``findings`` and
``n_candidates`` are replaced, others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens import storage
from chatlens.llm.common import hash_share, let

PLACEHOLDER = "[SECRET]"
LEFT_CHARS = 120
RIGHT_CHARS = 16
SECRET_WORDS = "token|secret|passw|passphrase|(?<![a-z])pass(?![a-z])|pwd|api.?key|access.?key|private|credential|auth(?!ors?\\b|orit)|bearer"
HASH_WORDS = "commit|sha-?\\d|md5|checksum|digest|etag|uuid|revision|version|build|order|card|phone|number|isbn"
SAMPLE_WORDS = "example|sample|test|dummy|placeholder|your|changeme|xxx|fake"
#: A name and what assigns a value to it, in lower or upper case; of bounded length, as it is looked back at.
_SCHEME = "(?:(?:bearer|basic)\\s{1,4})?"
_TOLD = "(?:passw(?:or)?d|passphrase|pwd)\\s{1,4}(?:is|was)\\s{1,4}[\"'`]?"
_ASSIGNED = f"(?:(?:{SECRET_WORDS})[a-z0-9_-]{{0,20}}[\"'`]?\\]?\\s{{0,64}}[=:]{{1,2}}>?\\s{{0,64}}[\"'`]?{_SCHEME}|{_TOLD})"
_KEY = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_LONG = (
    "(?<![A-Za-z0-9_+/-])(?=[_+/-]*+[A-Za-z0-9])(?:(?:eyJ|SG\\.)[A-Za-z0-9_-]{6,}+(?:\\.[A-Za-z0-9_-]{6,}+)++"
    "|[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=\"'`-]))?+)"
)
# The look-behinds before the last only save time: most words follow a word and one space.
_NAMED = (
    "(?<=[=:>\\s\"'`])(?=[^\\s\"'`=:>])(?!(?i:bearer|basic)\\s)"
    "(?:(?<![^=:>\\s\"'`]\\s)|(?<=(?i:bearer|basic|\\s(?:is|was))\\s))"
    f"(?<=[=:>]\\s{{0,64}}[\"'`]?(?i:{_SCHEME})|(?i:{_TOLD}))(?<=(?i:{_ASSIGNED}))"
    "(?:(?<=[\"'`])[^\"'`\\r\\n]++(?=[\"'`])|[^\\s\"'`]++)"
)
#: The password in an address, between the user and the host.
_IN_ADDRESS = "(?<=:)(?<=://[^\\s/@:]{0,64}:)[^\\s/@\"'`]++(?=@)"
PATTERN = f"{_KEY}|{_IN_ADDRESS}|{_NAMED}|{_LONG}"

#: What a secret shows by itself, wherever it stands: the mark of a private key, a provider's prefix.
KNOWN_FORMS = (
    "^-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY|^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[opsur]_[A-Za-z0-9]{20}|^github_pat_[A-Za-z0-9]"
    "|^glpat-[A-Za-z0-9_-]{16}|^sk-(?=\\S*[0-9])[A-Za-z0-9_-]{16}|^[sr]k_(?:live|test)_[A-Za-z0-9]{12}|^xox[abeoprs]-[A-Za-z0-9-]{10}"
    "|^AIza[A-Za-z0-9_-]{30}|^eyJ[A-Za-z0-9_-]{12}|^SG\\.[A-Za-z0-9_-]{12}|^(?:npm|hf)_[A-Za-z0-9]{20}"
)
#: Prose, and values that are looked up, called or missing.
PLAIN_WORD = "^[(\\[]?\\p{L}\\p{Ll}*[.,;:!?)\\]]*$"
CODE = "[(\\[{<$]|^[A-Za-z_]+(?:\\.[A-Za-z_]+)+[;,)]*$|^(?i:none|null|nil|true|false|undefined|str|string|int)[;,)]*$"
#: Frequent parts of names and placeholders, as the dictionary of coverage.
DICTIONARY = (
    "about access account action address admin album api app article asset auth author backup "
    "base blog book branch bucket build button cache card cart catalog category change channel "
    "chapter check city class client code comment commit common company config contact content "
    "control copy core count country create current customer data database date default delete "
    "demo detail device direct document download dummy edit email empty error event example "
    "export family feature field file final filter first folder form format forum front gallery "
    "game general get goes group guide header hello help here history home host house html image "
    "import index info input item key label large last layout left level library light line link "
    "list local location log login main manager map market master media member menu message mobile "
    "model module month name network news note number object office online open option order page "
    "part password path payment people photo place player plugin point policy post press price "
    "private product profile project public query question random read release report request "
    "response result review right sample save script search secret section server service session "
    "set shop simple site size small source space sport start state static status store story "
    "street string style summary support system table target task team template test text theme "
    "thumb time title token tool topic total travel type update upload url user value version "
    "video view web week widget window word work world year your"
).split()


def candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def between(text: Column) -> Column:
    """What lies around the candidates; one more than there are candidates."""
    return F.split(text, PATTERN)


def _flag(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern)).cast("double")


def features(left: Column, value: Column, right: Column) -> dict[str, Column]:
    """The numbers the forest sees, of one candidate and its neighbourhood."""
    size = F.char_length(value).cast("double")
    before, low = F.lower(left), F.lower(value)
    kinds = F.regexp_replace(value, "[a-z]", "a")
    kinds = F.regexp_replace(F.regexp_replace(kinds, "[A-Z]", "A"), "[0-9]", "0")
    return {
        "length": size,
        "transitions": (size - 1 - F.regexp_count(kinds, F.lit("(.)(?=\\1)"))) / size,
        "digits": F.regexp_count(value, F.lit("[0-9]")) / size,
        "capitals": F.regexp_count(value, F.lit("[A-Z]")) / size,
        "different": F.size(F.array_distinct(F.split(F.substring(value, 1, 256), ""))) / F.least(size, F.lit(256.0)),
        "hex": _flag(low, "^[0-9a-f]+$"),
        "covered": (size - F.char_length(F.regexp_replace(low, "|".join(DICTIONARY), ""))) / size,
        "slashes": F.regexp_count(value, F.lit("/")) / size,
        "path_left": _flag(left, "(?:[/\\\\.]|://\\S*)$"),
        "path_right": _flag(right, "^\\.[A-Za-z]|^[/\\\\]"),
        "assigned": _flag(left, "[=:]>?\\s{0,64}[\"'`]?$|[Bb]earer\\s{1,4}$"),
        "in_address": _flag(left, "://[^\\s/@:]{0,64}:$") * _flag(right, "^@"),
        "quoted": _flag(left, "[\"'`]$") * _flag(right, "^[\"'`]"),
        "secret_word": _flag(before, f"(?:{_ASSIGNED}|bearer\\s{{1,4}})$"),
        "hash_word": _flag(before, f"\\b(?:{HASH_WORDS})[^a-z]{{0,4}}$"),
        # A key's body may hold any letters.
        "sample_word": _flag(F.concat(F.right(before, F.lit(24)), F.lit(" "), F.regexp_replace(low, "^-----begin[\\s\\S]*", "")), SAMPLE_WORDS),
        "known_form": _flag(value, KNOWN_FORMS),
        "word": _flag(value, PLAIN_WORD),
        "code": _flag(value, CODE),
    }


@dataclass
class Leaf:
    share: float


@dataclass
class Node:
    feature: str
    threshold: float
    low: Node | Leaf
    high: Node | Leaf


def tree_score(node: Node | Leaf, of) -> Column:
    """A tree as nested conditions; ``of(name)`` is the column of a feature."""
    if isinstance(node, Leaf):
        return F.lit(node.share)
    low, high = tree_score(node.low, of), tree_score(node.high, of)
    return F.when(of(node.feature) <= node.threshold, low).otherwise(high)


def forest_score(forest: list, of) -> Column:
    scores = [tree_score(t, of) for t in forest]
    return sum(scores[1:], scores[0]) / len(scores)


def _grown(node, names: list[str]) -> Node | Leaf:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return Leaf(float(stats[1] / sum(stats)) if len(stats) > 1 else 0.0)
    split = node.split()
    return Node(
        names[split.featureIndex()],
        float(split.threshold()),
        _grown(node.leftChild(), names),
        _grown(node.rightChild(), names),
    )


def train(
    findings: DataFrame, trees: int = 20, depth: int = 5, seed: int = 7, max_findings: int = 200_000
) -> list:
    """A forest from ``left, value, right, label``: about ``max_findings`` of them, by their hash, if there are more."""
    found = features(F.col("left"), F.col("value"), F.col("right"))
    names = list(found)
    rows = findings.where(F.col("label").isNotNull() & F.col("value").isNotNull())
    rows = rows.select(*[c.alias(n) for n, c in found.items()], F.col("label").cast("double"))
    rows = storage.keep(rows.na.fill(0.0), "findings")
    count = rows.count()
    if count > max_findings:
        # by place, as many may be equal; the table is stored, so its places stay
        rows = rows.where(hash_share(F.monotonically_increasing_id(), max_findings, count))
    # One sorted partition: bootstrap samples depend on the order. The table is a bounded sample.
    rows = rows.coalesce(1).sortWithinPartitions(*names, "label")
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return [Leaf(kinds[0] if kinds else 0.0)]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    learner = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed,
        featureSubsetStrategy="onethird",
    )
    model = learner.fit(data)
    return [_grown(t._call_java("rootNode"), names) for t in model.trees]


def labelled_findings(docs: DataFrame, sample_docs: int = 500) -> DataFrame:
    """Labelled findings from about ``sample_docs`` documents, chosen by the hash of the text."""
    texts = docs.select("text").where(F.col("text") != "")
    # a group of copies is taken whole or not at all: once, however many there are
    texts = texts.where(hash_share(F.col("text"), sample_docs, texts.count())).distinct()
    text = F.col("text")
    cut = texts.select(candidates(text).alias("c"), between(text).alias("b"))
    real = cut.select(F.explode(_neighbourhoods(F.col("c"), F.col("b"))).alias("x")).select("x.*")
    quoted = F.rlike("left", F.lit("[\"'`]$"))
    prose = F.rlike("value", F.lit(PLAIN_WORD)) | F.rlike("value", F.lit(CODE))
    named = F.rlike("left", F.lit(f"(?i){_ASSIGNED}$")) & (quoted | ~prose)
    named = named | (F.rlike("left", F.lit("://[^\\s/@:]{0,64}:$")) & F.rlike("right", F.lit("^@")))
    sample = F.rlike("value", F.lit(f"(?i)^(?!-----BEGIN)[\\s\\S]*(?:{SAMPLE_WORDS})"))
    real = real.withColumn("label", (named | F.rlike("value", F.lit(KNOWN_FORMS))) & ~sample)
    # What is derived is computed once a text, then dealt out.
    base = texts.select(
        F.regexp_extract(text, "(\\S+\\s+\\S+\\s+)", 1).alias("words"), F.regexp_extract(text, "(\\p{L}+)", 1).alias("word"),
        F.left(F.regexp_replace(text, "[^A-Za-z]", ""), F.lit(24)).alias("joined"), F.md5(text).alias("md5"), F.sha1(text).alias("sha1"),
        F.sha2(text, 256).alias("sha2"), F.regexp_replace(F.base64(F.unhex(F.sha2(text, 512))), "[+/=\\s]", "x").alias("mixed"),
    )
    base = base.select(
        "*", *[F.left(F.base64(F.unhex(F.sha2(F.concat("sha2", F.lit(str(i))), 512))), F.lit(64)).alias(f"line{i}") for i in range(4)]
    )
    words, word, joined, md5, sha1, sha2, mixed = [F.col(n) for n in ("words", "word", "joined", "md5", "sha1", "sha2", "mixed")]
    digits = F.translate(F.left(md5, F.lit(16)), "abcdef", "123456")
    dashed = F.concat_ws("-", *[F.substring(md5, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 12))])
    lines = [F.col(f"line{i}") for i in range(4)]
    small = F.left(F.regexp_replace(lines[3], "[+/]", "x"), F.lit(40))
    capital = F.translate(F.upper(F.left(sha1, F.lit(16))), "ABCDEF", "QWZKXM")

    def key(kind: str, *body: Column) -> Column:
        return F.concat_ws("\n", F.lit(f"-----BEGIN {kind}PRIVATE KEY-----"), *body, F.lit(f"-----END {kind}PRIVATE KEY-----"))

    def token(prefix: str, size: int) -> Column:
        return F.concat(F.lit(prefix), F.left(small, F.lit(size)))

    alone = [
        ("", key("RSA ", *lines * 6), "\n"), ("\n", key("", *lines * 7), " "), ("key: ", key("EC ", *lines[:3]), "\n"),
        ("", key("OPENSSH ", *lines), ""), ("", key("RSA ", lines[0], F.left(lines[1], F.lit(20))), " "), ("\n", key("", F.left(lines[2], F.lit(12))), "\n"),
        ("", F.concat(F.lit("AKIA"), capital), " "), ("key ", F.concat(F.lit("ASIA"), capital), "\n"), ("", token("ghp_", 36), " "),
        ("(", token("gho_", 36), ")"), ("use ", token("sk-", 40), "."), ("", token("sk_live_", 24), ","), ("\n", token("glpat-", 20), "\n"),
        ("`", F.concat(F.lit("xoxb-"), F.translate(F.left(md5, F.lit(11)), "abcdef", "123456"), F.lit("-"), F.left(small, F.lit(24))), "`"),
        ("", token("AIza", 35), " "), ('"', token("eyJ", 40), '"'),
    ]
    letters = F.translate(sha1, "0123456789", "ghijklmnop")
    short = [
        ('"password": "', F.left(small, F.lit(8)), '"', 1), ("pwd=", F.left(small, F.lit(10)), "\n", 1), ("token=", F.left(md5, F.lit(8)), "\n", 1),
        ('api_key: "', F.left(md5, F.lit(12)), '"', 1), ("auth: ", F.left(small, F.lit(9)), "\n", 1), ("password  =  ", F.left(small, F.lit(7)), "\n", 1),
        ("secret:  '", F.left(small, F.lit(6)), "'", 1), ('passwd = "', word, '"', 1), ("PASSWORD=", F.concat(F.left(letters, F.lit(6)), F.left(digits, F.lit(2))), "\n", 1),
        ('token = "', F.left(letters, F.lit(24)), '"', 1), ("secret_key: ", F.left(letters, F.lit(32)), "\n", 1), ('"auth": "', F.left(letters, F.lit(9)), '"', 1),
        ("pwd: ", F.concat(F.left(letters, F.lit(6)), F.lit("2"), F.left(letters, F.lit(1))), "\n", 1), ('"password": "', F.concat(word, F.left(digits, F.lit(2))), '"', 1),
        ("password =" + " " * 20, F.left(small, F.lit(9)), "\n", 1), ("DB_PASS=", F.left(small, F.lit(10)), "\n", 1), ("pass: ", F.left(md5, F.lit(9)), "\n", 1),
        ("postgres://app:", F.left(small, F.lit(9)), "@db", 1), ("https://", F.concat(F.lower(word), F.left(digits, F.lit(2))), "@host", 0),
        ("https://admin:", F.left(letters, F.lit(8)), "@", 1), ("amqp://user:", F.concat(word, F.left(digits, F.lit(2))), "@mq", 1), ("ftp://me:", F.lower(word), "@", 1),
        ("password is ", F.left(small, F.lit(8)), " ", 1), ("passphrase was '", F.left(letters, F.lit(12)), "'", 1), ("password is ", word, " ", 0), ("pass: ", word, " ", 0),
        ("https://host:", F.concat(F.left(digits, F.lit(4)), F.lit("/path/"), F.lower(joined)), " ", 0), ("http://www.site.org:", F.concat(F.lit("443/"), F.lower(word), F.lit("/page/"), F.lower(word)), "\n", 0),
        ("https://host/", F.concat(F.lower(word), F.lit("/"), F.lower(joined)), "?", 0),
        ("a pass: ", F.lower(word), " ", 0), ("the token: ", F.lower(word), " ", 0), ("her password is ", F.lower(word), " ", 0), ("secret: ", F.lower(word), "\n", 0),
        ('password = "', F.concat_ws(" ", F.left(small, F.lit(9)), F.left(letters, F.lit(11)), mixed, sha2, sha1, mixed), '"', 1),
        ("the password: ", word, " ", 0), ("token: ", F.concat(word, F.lit(",")), " ", 0), ("a secret:\n", word, " ", 0), ("credentials: ", F.concat(word, F.lit(".")), "\n", 0),
        ("token = ", F.concat(F.lit("get_"), word, F.lit("()")), "\n", 0), ("password = ", F.lit("None"), "\n", 0), ("secret = ", F.concat(F.lit("self."), F.lower(word)), "\n", 0),
        ("", joined, " ", 0), ("", F.lower(joined), " ", 0), ("export ", F.concat(F.upper(F.left(joined, F.lit(8))), F.lit("_SECRET_KEY")), "=", 0),
        ("in ", F.concat(F.lit("usr/share/"), F.lower(joined)), " ", 0), ("", F.concat_ws("-", F.lower(word), F.lower(joined)), ",", 0),
    ]
    bare = [
        *[("", F.left(mixed, F.lit(n)), " ") for n in (17, 20, 24, 32, 40, 56)], ("", small, "\n"), ("id ", F.left(small, F.lit(22)), ","),
        ("", capital, " "), ("(", F.upper(F.left(mixed, F.lit(20))), ")"), ('"', F.left(mixed, F.lit(36)), '"'), ("`", F.left(small, F.lit(28)), "`"),
    ]
    made = [
        ('token = "', sha1, '"', 1), ("api_key: ", md5, "\n", 1), ("password = '", F.left(mixed, F.lit(18)), "'", 1),
        ("Authorization: Bearer ", mixed, " ", 1), ("client_secret=", F.upper(sha1), "&", 1),
        ("AWS_SECRET_ACCESS_KEY=", F.left(mixed, F.lit(40)), "\n", 1), ('"private_token": "', sha2, '"', 1),
        ("/static/", md5, ".js", 0), ("https://cdn.host.net/img/", sha1, ".png", 0), ("commit ", sha1, " ", 0),
        ("sha256: ", sha2, "\n", 0), ("card ", digits, " ", 0), ("", digits, " ", 0), ("uuid: ", dashed, "\n", 0),
        ("", sha1, " ", 0), ("", mixed, " ", 0), ('token = "', F.concat(F.lit("your-token-goes-here-"), F.left(digits, F.lit(2))), '"', 0),
        ("page_", F.concat(F.lit("release_notes_version_"), F.left(digits, F.lit(4))), ".html", 0),
        ('test password = "', F.concat(F.lit("changeme-example-"), F.left(digits, F.lit(3))), '"', 0),
    ]
    rows = F.array(
        *[
            F.struct(
                F.concat(words, F.lit(a)).alias("left"),
                v.alias("value"),
                F.lit(b).alias("right"),
                F.lit(bool(y)).alias("label"),
            )
            for a, v, b, y in made + short + [(*x, 1) for x in alone] + [(*x, 0) for x in bare]
        ]
    )
    derived = base.select(F.explode(rows).alias("x")).select("x.*")
    return real.unionByName(derived).withColumn("label", F.col("label").cast("double"))


def _neighbourhoods(found: Column, gaps: Column) -> Column:
    """``left, value, right`` of each candidate; a name beside it may be a candidate itself."""

    def near(cut, part: Column, n: int) -> Column:
        return F.coalesce(cut(part, F.lit(n)), F.lit(""))

    return F.transform(
        found,
        lambda v, i: F.struct(
            F.right(
                F.concat(near(F.right, F.get(found, i - 1), LEFT_CHARS), near(F.right, F.get(gaps, i), LEFT_CHARS)),
                F.lit(LEFT_CHARS),
            ).alias("left"),
            v.alias("value"),
            F.left(
                F.concat(near(F.left, F.get(gaps, i + 1), RIGHT_CHARS), near(F.left, F.get(found, i + 1), RIGHT_CHARS)),
                F.lit(RIGHT_CHARS),
            ).alias("right"),
        ),
    )


def scan(docs: DataFrame, forest: list, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``n_candidates`` and ``findings``: ``start, length, value, score``."""
    return _scanned(docs, forest, threshold).drop("_secret_cut")


def _scanned(docs: DataFrame, forest: list, threshold: float) -> DataFrame:
    text = F.col("text")
    cut = F.struct(candidates(text).alias("c"), between(text).alias("b"))

    def scores(x: Column) -> Column:
        around = _neighbourhoods(x["c"], x["b"])
        numbers = F.transform(
            around,
            lambda a: F.struct(
                *[c.alias(n) for n, c in features(a["left"], a["value"], a["right"]).items()]
            ),
        )
        return F.transform(numbers, lambda n: forest_score(forest, lambda f: n[f]))

    def findings(x: Column) -> Column:
        marked = F.transform(
            F.arrays_zip(x["c"].alias("value"), x["s"].alias("score")),
            lambda z, i: F.struct(i.alias("i"), z["value"].alias("value"), z["score"].alias("score")),
        )
        true = F.filter(marked, lambda m: m["score"] >= threshold)

        def total(part: Column, n: Column) -> Column:
            return F.aggregate(F.slice(part, 1, n), F.lit(0), lambda a, p: a + F.char_length(p))

        return F.transform(
            true,
            lambda m: F.struct(
                (total(x["b"], m["i"] + 1) + total(x["c"], m["i"])).cast("long").alias("start"),
                F.char_length(m["value"]).cast("long").alias("length"),
                m["value"].alias("value"),
                m["score"].alias("score"),
            ),
        )

    with_scores = let(
        cut,
        lambda x: F.struct(x["c"].alias("c"), x["b"].alias("b"), scores(x).alias("s")),
    )
    return docs.withColumn("_secret_cut", F.when(text.isNotNull(), with_scores)).withColumns(
        {
            "n_candidates": F.coalesce(F.size("_secret_cut.c"), F.lit(0)).cast("long"),
            "findings": let(F.col("_secret_cut"), findings),
        }
    )


def redact(docs: DataFrame, forest: list, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``findings``, ``n_candidates`` and each finding of ``text`` replaced."""

    def rest(x: Column) -> Column:
        shown = F.zip_with(
            x["c"],
            x["s"],
            lambda c, s: F.when(s >= threshold, F.lit(PLACEHOLDER)).otherwise(c),
        )
        pieces = F.zip_with(
            x["b"], F.concat(shown, F.array(F.lit(""))), lambda a, b: F.concat(a, b)
        )
        return F.array_join(pieces, "")

    found = _scanned(docs, forest, threshold)
    text = F.when(F.size("findings") > 0, let(F.col("_secret_cut"), rest)).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("_secret_cut")
