"""Which headers does a message mention?

``tag_messages`` adds ``hits ARRAY<STRUCT<ord, header>>`` in header order and keeps every row.
Two physical forms give the same hits; the size of the rule table, measured first, decides:

* one search for all keywords per message, in an Arrow-batched UDF that returns only the numbers of
  the keywords found; each row is touched once, without any shuffle;
* a rule table too large to ship to every task: an equi-join on the substrings of the distinct
  message texts. What is found is resolved in the row, by lists of headers, or by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import fold_case
from chatlens.operators.joins import (
    contains_join,
    fits_broadcast,
    lookup_join,
)
from chatlens.operators.rules import (
    GENERIC,
    GENERIC_SUFFIX,
    header_order,
    requirement_words,
    suppressor_pairs,
)
from chatlens.schemas import HITS
from chatlens.storage import keep

ANY = "any"
LITERAL = "literal"

SHIPPED_MAX_RULES = 20_000
SHIPPED_MAX_BYTES = 4 * 1024 * 1024
# of each of the tables that lists are made of
LISTED_MAX_ROWS = 2_000_000
LISTED_MAX_BYTES = 128 * 1024 * 1024
# bytes that mark hits while they are put together, and hits handed on at a time
MARKED_CELLS = 1024 * 1024
BATCH_HITS = 250_000


@dataclass
class RuleIndex:
    """A measured, small rule table as plan parameters."""

    needles: list[str]
    headers: list[str]
    ords: list[int]
    rules_of_needle: list[list[dict]]
    requirements: list[list[int]]
    suppressors: list[list[int]]


@dataclass
class Needles:
    """Folded search texts of rules, and those of the requirements that rules ask for."""

    rules: DataFrame  # idx, headers, needle, brand, required_product, asks
    alternatives: DataFrame  # brand, required_product, needle


REQUIREMENT = ["brand", "required_product"]


def rule_needles(rules: DataFrame, required: str = ANY, full_fold: bool = False) -> Needles:
    """Rules with their folded ``needle``, and the alternatives of each requirement, one of which must occur.

    ``any``: one of the looked-up keywords must occur. ``literal``: their joined text must. Both are
    kept by requirement and not by rule. A rule whose requirement is not resolved asks for nothing.
    """
    # kept, as they are read several times and may be dear to derive; of their resolved form nothing is needed
    rules = keep(rules.select("idx", "headers", "keyword", *REQUIREMENT), "rules")
    words = requirement_words(rules)
    if required == ANY:
        alternatives = words.select(*REQUIREMENT, fold_case("keyword", full_fold).alias("needle"))
    elif required == LITERAL:
        listed = F.array_sort(F.collect_list(F.struct("idx", "keyword")))
        joined = words.groupBy(*REQUIREMENT).agg(listed.alias("_words"))
        joined = joined.select(*REQUIREMENT, F.array_join("_words.keyword", "|").alias("_text"))
        alternatives = joined.where("_text <> ''").select(*REQUIREMENT, fold_case("_text", full_fold).alias("needle"))
    else:
        raise ValueError(f"unknown requirement mode {required!r}")
    alternatives = keep(alternatives.distinct(), "alternatives")
    resolved = alternatives.select(*REQUIREMENT, F.lit(True).alias("asks")).distinct()
    own = rules.select("idx", "headers", fold_case("keyword", full_fold).alias("needle"), *REQUIREMENT)
    marked = lookup_join(own, resolved, REQUIREMENT, "left")
    return Needles(
        keep(marked.withColumn("asks", F.coalesce("asks", F.lit(False))), "needles"), alternatives
    )


def build_index(
    needles: Needles, suppress: bool = True, max_pairs: int = SHIPPED_MAX_BYTES // 4
) -> RuleIndex | None:
    """Collect a rule table that has been measured before.

    None if there are more than ``max_pairs`` pairs of a generic header and one that suppresses it.
    """
    rule_rows = sorted(needles.rules.collect(), key=lambda r: r["idx"])
    words_of: dict[tuple[str, str], list[str]] = {}
    for r in needles.alternatives.collect():
        words_of.setdefault((r["brand"], r["required_product"]), []).append(r["needle"])
    first_row: dict[str, int] = {}
    for r in rule_rows:
        first_row.setdefault(r["headers"], r["idx"])
    headers = list(first_row)
    position = {h: i for i, h in enumerate(headers)}
    words = sorted({r["needle"] for r in rule_rows} | {w for found in words_of.values() for w in found})
    number = {w: i for i, w in enumerate(words)}
    asked = {requirement: i for i, requirement in enumerate(words_of)}
    rules_of_needle: list[list[dict]] = [[] for _ in words]
    for r in rule_rows:
        asked_for = asked[r["brand"], r["required_product"]] if r["asks"] else -1
        rule = {"pos": position[r["headers"]], "required": asked_for}
        rules_of_needle[number[r["needle"]]].append(rule)
    suppressors = _suppressors(headers, max_pairs) if suppress else [[] for _ in headers]
    if suppressors is None:
        return None
    return RuleIndex(
        needles=words,
        headers=headers,
        ords=list(first_row.values()),
        rules_of_needle=rules_of_needle,
        requirements=[sorted(number[w] for w in found) for found in words_of.values()],
        suppressors=suppressors,
    )


def _suppressors(headers: list[str], max_pairs: int) -> list[list[int]] | None:
    """Per generic header the positions of the headers that contain its base, by one search."""
    import ahocorasick

    search = ahocorasick.Automaton()
    of_base: dict[str, list[int]] = {}
    for h in headers:
        if GENERIC in h:
            of_base[h.replace(GENERIC_SUFFIX, "")] = []
    for base in of_base:
        if base:
            search.add_word(base, base)
    if len(search):
        search.make_automaton()
    pairs = 0
    for i, h in enumerate(headers):
        if GENERIC not in h:
            found = {base for _, base in search.iter(h)} if len(search) else set()
            for base in found | ({""} & of_base.keys()):
                of_base[base].append(i)
                pairs += 1
        if pairs > max_pairs:
            return None
    return [of_base[h.replace(GENERIC_SUFFIX, "")] if GENERIC in h else [] for h in headers]


@dataclass
class HitLists:
    """What the needles of a rule table lead to, by numbers: each list is given as all its pairs (of, value).

    ``simple``: the places of the headers a needle hits by itself. ``asking``: those it hits if a requirement is
    met, as pairs. ``meets``: the requirements a needle meets. ``suppresses``: the generic headers a header stands for.
    A pair is the number of the requirement times the number of headers plus the place of the header.
    """

    ords: pa.Array
    headers: pa.Array
    n_needles: int
    n_requirements: int
    simple: tuple[np.ndarray, np.ndarray]
    asking: tuple[np.ndarray, np.ndarray]
    meets: tuple[np.ndarray, np.ndarray]
    suppresses: tuple[np.ndarray, np.ndarray]


def index_pairs(index: RuleIndex) -> HitLists:
    n = len(index.headers)
    simple, asking = [], []
    for i, of in enumerate(index.rules_of_needle):
        simple += [(i, r["pos"]) for r in of if r["required"] < 0]
        asking += [(i, r["required"] * n + r["pos"]) for r in of if r["required"] >= 0]
    meets = [(needle, q) for q, needles in enumerate(index.requirements) for needle in needles]
    suppresses = [(p, generic) for generic, specifics in enumerate(index.suppressors) for p in specifics]

    def columns(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    return HitLists(
        pa.array(index.ords, pa.int64()),
        pa.array(index.headers, pa.string()),
        len(index.needles),
        len(index.requirements),
        *map(columns, (simple, asking, meets, suppresses)),
    )


def resolve_hits(lists: HitLists) -> Callable[[pa.Array], Iterator[pa.Array]]:
    """Function of the numbers of the needles found in each text: ``hits``, in several batches of rows.

    Only what belongs to the needles found is looked at, in flat arrays, a few texts at a time. What is hit is marked in
    one byte a text and header, or sorted if that would be many more bytes than hits. A generic header is dropped if one
    of its suppressors is hit as well.
    """
    ords, headers, n_requirements = lists.ords, lists.headers, lists.n_requirements
    n, cells, most = len(headers), MARKED_CELLS, BATCH_HITS

    def by_number(pairs: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values by what they belong to: first, how many, values."""
        of, values = pairs
        many = np.bincount(of, minlength=size)
        return np.cumsum(many) - many, many, values[np.argsort(of, kind="stable")]

    simple, asking = by_number(lists.simple, lists.n_needles), by_number(lists.asking, lists.n_needles)
    meets, suppresses = by_number(lists.meets, lists.n_needles), by_number(lists.suppresses, n)

    def values_of(lists, base: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the lists of some numbers, each with the base of its number."""
        first, many, values = lists
        many = many[of]
        at = np.repeat(first[of] - (np.cumsum(many) - many), many)
        at += np.arange(len(at))
        return np.repeat(base, many), values[at]

    def places_in(codes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many of the sorted codes are in each row, the code at which the row of each begins, and its place."""
        begins = np.arange(rows + 1) * n
        sizes = np.diff(np.searchsorted(codes, begins))
        base = np.repeat(begins[:-1], sizes)
        return sizes, base, codes - base

    def distinct(codes: np.ndarray, size: int) -> np.ndarray:
        if len(codes) * 16 < size:
            return np.unique(codes)
        marked = np.zeros(size, bool)
        marked[codes] = True
        return np.flatnonzero(marked)

    def among(codes: np.ndarray, others: np.ndarray, size: int) -> np.ndarray:
        if (len(codes) + len(others)) * 16 < size:
            return np.isin(codes, others)
        marked = np.zeros(size, bool)
        marked[others] = True
        return marked[codes]

    def codes_hit(row: np.ndarray, number: np.ndarray, rows: int) -> np.ndarray:
        """Rows and places hit, as sorted numbers: row times the number of headers plus place."""
        base, hit = values_of(simple, row * n, number)
        hit += base
        if len(asking[2]):
            own, met = values_of(meets, row * n_requirements, number)
            asks, pair = values_of(asking, row, number)
            required, place = np.divmod(pair, max(1, n))
            granted = among(asks * n_requirements + required, own + met, rows * n_requirements)
            hit = np.append(hit, (asks * n + place)[granted])
        hit = distinct(hit, rows * n)
        if len(suppresses[2]):
            _, base, place = places_in(hit, rows)
            base, gone = values_of(suppresses, base, place)
            gone += base
            hit = hit[~among(hit, gone, rows * n)]
        return hit

    def as_hits(sizes: list[np.ndarray], places: list[np.ndarray]) -> pa.Array:
        place = pa.array(np.concatenate(places))
        found = pa.StructArray.from_arrays([ords.take(place), headers.take(place)], ["ord", "header"])
        ends = np.append(0, np.cumsum(np.concatenate(sizes)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    def resolve(found: pa.Array) -> Iterator[pa.Array]:
        many = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends, number = np.append(0, np.cumsum(many)), found.flatten().to_numpy(zero_copy_only=False)
        step = max(1, cells // max(1, n, n_requirements))
        sizes, places, held = [], [], 0
        for i in range(0, len(found), step):
            rows = min(step, len(found) - i)
            row = np.repeat(np.arange(rows), many[i : i + rows])
            size, _, place = places_in(codes_hit(row, number[ends[i] : ends[i + rows]], rows), rows)
            sizes.append(size)
            places.append(place)
            held += len(place)
            if held >= most or i + rows == len(found):
                yield as_hits(sizes, places)
                sizes, places, held = [], [], 0

    return resolve


def hits_of_found(found: Column, lists: HitLists) -> Column:
    """``hits``, given the numbers of the needles found in a text."""
    resolve = resolve_hits(lists)

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            yield from resolve(found)

    return F.arrow_udf(hits, HITS)(found)


def hits_of_text(folded: Column, needles: list[str], lists: HitLists) -> Column:
    """``hits``, by one search for all needles in each text."""
    resolve = resolve_hits(lists)

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        search = ahocorasick.Automaton()
        always = [i for i, w in enumerate(needles) if w == ""]
        for i, w in enumerate(needles):
            if w:
                search.add_word(w, i)
        if len(search):
            search.make_automaton()
        for texts in batches:
            found = [
                None if t is None else always + list({i for _, i in search.iter(t)}) if len(search) else always
                for t in texts.to_pylist()
            ]
            yield from resolve(pa.array(found, pa.list_(pa.int64())))

    return F.arrow_udf(hits, HITS)(folded)


def index_rules(
    rules: DataFrame,
    required: str = ANY,
    suppress: bool = True,
    full_fold: bool = False,
    max_rules: int = SHIPPED_MAX_RULES,
    max_bytes: int = SHIPPED_MAX_BYTES,
) -> RuleIndex | None:
    """Measure a rule table and collect it if it is small enough to ship; else None."""
    return index_needles(rule_needles(rules, required, full_fold), suppress, max_rules, max_bytes)


def index_needles(
    needles: Needles,
    suppress: bool = True,
    max_rules: int = SHIPPED_MAX_RULES,
    max_bytes: int = SHIPPED_MAX_BYTES,
) -> RuleIndex | None:
    """``index_rules`` for needles that ``tag_by_join`` can go on with if there is no index."""
    if all(fits_broadcast(t, max_rules, max_bytes) for t in (needles.rules, needles.alternatives)):
        return build_index(needles, suppress)
    return None


def tag_messages(
    messages: DataFrame,
    rules: DataFrame,
    message_col: str = "messageBody",
    required: str = ANY,
    suppress: bool = True,
    full_fold: bool = False,
    max_rules: int = SHIPPED_MAX_RULES,
    max_bytes: int = SHIPPED_MAX_BYTES,
) -> DataFrame:
    """Add ``hits`` to every message; ``rules`` come from ``prepare_rules``.

    ``suppress=False`` leaves out the generic fallback and gives the hits before it.
    """
    needles = rule_needles(rules, required, full_fold)
    index = index_needles(needles, suppress, max_rules, max_bytes)
    if index is None:
        return tag_by_join(messages, rules, message_col, required, suppress, full_fold, needles=needles)
    return tag_by_index(messages, index, message_col, full_fold)


def tag_by_index(
    messages: DataFrame,
    index: RuleIndex,
    message_col: str = "messageBody",
    full_fold: bool = False,
) -> DataFrame:
    """``tag_messages`` with a collected rule table: no join and no shuffle."""
    if not index.needles:
        return messages.withColumn("hits", F.array().cast(HITS))
    return messages.withColumn("hits", hits_of_text(fold_case(message_col, full_fold), index.needles, index_pairs(index)))


def tag_by_join(
    messages: DataFrame,
    rules: DataFrame,
    message_col: str = "messageBody",
    required: str = ANY,
    suppress: bool = True,
    full_fold: bool = False,
    max_listed: int = LISTED_MAX_ROWS,
    needles: Needles | None = None,
) -> DataFrame:
    """``tag_messages`` for rule tables of any size, whose needles may be at hand.

    The keywords found depend on the text alone, so they are found once per distinct text. Every join is on
    equality. The keywords found, which several joins need, are kept in the shared folder, by numbers of texts.

    A keyword stands for as many hits as it has rules. If the numbers of the headers of each keyword fit a broadcast,
    the hits are put together in the row of their message, and no hit is shuffled or stored; else by joins.
    """
    folded = fold_case(message_col, full_fold)
    texts = (
        messages.select(folded.alias("_folded"))
        .where("_folded IS NOT NULL")
        .distinct()
        .withColumn("_text", F.sha2("_folded", 256))
        # cutting takes long for its bytes: keep partitions from being merged by size
        .repartition(shuffle_partitions(messages), "_text")
        .withColumn("_no", F.monotonically_increasing_id())
    )
    # stored, so that the numbers stay
    texts = keep(texts, "texts")
    needles = needles or rule_needles(rules, required, full_fold)
    headers = keep(header_order(needles.rules), "headers")
    every_needle = needles.rules.select("needle").union(needles.alternatives.select("needle")).distinct()
    found = keep(contains_join(texts, "_no", "_folded", every_needle, "needle"), "found")
    pairs = suppressor_pairs(headers).select("generic_ord", F.col("specific_ord").alias("ord")) if suppress else None
    if suppress:
        pairs = keep(pairs, "pairs")

    tables = [needles.rules, needles.alternatives, headers, *([pairs] if suppress else [])]
    if all(fits_broadcast(t, max_listed, LISTED_MAX_BYTES) for t in tables):
        lists, numbered = index_lists(needles, headers, pairs)
        number = lookup_join(found, numbered, ["needle"]).groupBy("_no").agg(F.collect_set("number").alias("_found"))
        per_text = number.join(texts.select("_no", "_text"), "_no").select("_text", "_found")
        keyed = messages.withColumn("_text", F.coalesce(text_key(folded), F.lit("")))
        # stored, so that the partition of a very common text can be split
        with_found = keyed.join(keep(per_text, "found"), "_text", "left").drop("_text")
        # the hits take long for the bytes of what they are made of: keep partitions from being merged by size
        dealt = with_found.repartition(shuffle_partitions(messages))
        return dealt.withColumn("hits", hits_of_found(F.col("_found"), lists)).drop("_found")

    ordered = lookup_join(needles.rules, headers.select("headers", "ord"), ["headers"]).select(
        "needle", "ord", *REQUIREMENT, "asks"
    )
    candidates = lookup_join(found, ordered.distinct(), ["needle"])
    simple = candidates.where("NOT asks").select("_no", "ord")
    # a requirement is decided once a text, then the rules that ask for it look it up
    met = lookup_join(found, needles.alternatives, ["needle"]).select("_no", *REQUIREMENT).distinct()
    complex_hits = (
        candidates.where("asks").join(met, ["_no", *REQUIREMENT], "left_semi").select("_no", "ord")
    )
    hits = simple.union(complex_hits).distinct()
    if suppress:
        suppressed = (
            lookup_join(hits, pairs, ["ord"])
            .select("_no", F.col("generic_ord").alias("ord"))
            .distinct()
        )
        hits = hits.join(suppressed, ["_no", "ord"], "left_anti")
    named = lookup_join(hits, headers.select("ord", F.col("headers").alias("header")), ["ord"])
    per_number = named.groupBy("_no").agg(
        F.array_sort(F.collect_list(F.struct("ord", "header"))).alias("hits")
    )
    per_text = per_number.join(texts.select("_no", "_text"), "_no").select("_text", "hits")
    return attach_by_text(messages, per_text, folded)


def index_lists(
    needles: Needles, headers: DataFrame, pairs: DataFrame | None
) -> tuple[HitLists, DataFrame]:
    """The lists of ``index_pairs`` made by joins, and ``needle, number``, for tables that have been measured."""
    heads = _numbered(headers, "ord", "headers")
    words = _numbered(needles.rules.select("needle").union(needles.alternatives.select("needle")).distinct(), "needle")
    asked = _numbered(needles.alternatives.select(*REQUIREMENT).distinct(), *REQUIREMENT)
    place = heads.select("headers", F.col("number").alias("place"))
    word = words.select("needle", F.col("number").alias("word"))
    named = heads.select("number", "ord", "headers").toArrow().sort_by("number")
    n = len(named)
    placed = lookup_join(lookup_join(needles.rules, place, ["headers"]), word, ["needle"])
    simple = placed.where("NOT asks").select("word", "place")
    # rules ask for what has alternatives, so that all of these find their requirement
    asking = lookup_join(placed.where("asks"), asked, REQUIREMENT).select(
        "word", (F.col("number") * n + F.col("place")).alias("pair")
    )
    meets = lookup_join(lookup_join(needles.alternatives, word, ["needle"]), asked, REQUIREMENT)
    suppresses = None
    if pairs is not None:
        by_ord = heads.select("ord", F.col("number").alias("place"))
        generic = heads.select(F.col("ord").alias("generic_ord"), F.col("number").alias("generic"))
        suppressing = lookup_join(lookup_join(pairs, by_ord, ["ord"]), generic, ["generic_ord"])
        suppresses = suppressing.select("place", "generic")
    lists = HitLists(
        pa.array(named["ord"].to_pylist(), pa.int64()),
        pa.array(named["headers"].to_pylist(), pa.string()),
        words.count(),
        asked.count(),
        *map(_columns, (simple, asking, meets.select("word", "number"), suppresses)),
    )
    return lists, words


def _columns(pairs: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of a measured table, on the driver."""
    if pairs is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    table = pairs.distinct().toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy()


def _numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """``number`` and the columns: the rows of a measured table in order, from 0."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_all"))
    numbered = listed.select(F.posexplode("_all").alias("number", "_row"))
    return keep(numbered.select(F.col("number").cast("bigint").alias("number"), "_row.*"), "numbered")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_key(folded: Column) -> Column:
    return F.sha2(folded, 256)


def attach_by_text(messages: DataFrame, per_text: DataFrame, folded: Column) -> DataFrame:
    """Give every message the hits of its text; no text or no hits gives an empty array."""
    keyed = messages.withColumn("_text", F.coalesce(text_key(folded), F.lit("")))
    # stored, so that the partition of a very common text can be split
    return (
        keyed.join(keep(per_text, "hits"), "_text", "left")
        .withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))
        .drop("_text")
    )


def explode_hits(tagged: DataFrame) -> DataFrame:
    """One row per message and header hit."""
    # outer: for an inner one the optimizer would compute the hits twice, to leave out the rows without
    hit = F.col("_hit")
    return (
        tagged.withColumn("_hit", F.explode_outer("hits"))
        .where(hit.isNotNull())
        .select(*tagged.drop("hits").columns, hit["ord"].alias("ord"), hit["header"].alias("header"))
    )


def header_names(rules: DataFrame) -> list[str]:
    """Headers in order of first appearance, for one column each.

    A table gets as many columns as there are headers; ``explode_hits`` has rows instead.
    """
    return [r["headers"] for r in header_order(rules).orderBy("ord").collect()]


def wide_tags(tagged: DataFrame, headers: list[str]) -> DataFrame:
    """One 0/1 column per header, in header order, next to the other columns."""
    names = tagged.withColumn("_names", F.col("hits.header"))
    return names.select(
        *tagged.drop("hits").columns,
        *[F.array_contains("_names", h).cast("int").alias(h) for h in headers],
    )


def tag_cells(tagged: DataFrame) -> DataFrame:
    """``wide_tags`` for any number of headers: one column ``cells``, a map of the headers hit to ``1``."""
    cells = F.map_from_arrays(F.col("hits.header"), F.array_repeat(F.lit("1"), F.size("hits")))
    return tagged.withColumn("cells", cells).drop("hits")
