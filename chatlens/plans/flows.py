"""The steps from raw exports to the final table.

Most are lazy DataFrame functions. Reading CSV trees, measuring rule tables and asking a model run
jobs of their own while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators import rows, rules as rule_ops, scoring, tagging
from chatlens.operators.routing import route_chats
from chatlens.operators.validation import check_chats, check_rules
from chatlens.schemas import EXPORT_COLUMNS, text_schema
from chatlens.sources.csv_files import (
    scan_exports,
    scan_folders,
    scan_header,
    scan_partitioned,
)
from chatlens.sources.lookups import scan_group_info, scan_keywords

# Scores tagged messages: adds the results column.
ScoreStep = Callable[[DataFrame], DataFrame]


def merge_exports(exports: list[DataFrame], hash_first: bool = True) -> DataFrame:
    """Unite exports by column name and drop identical rows of a chat.

    With ``hash_first`` stored exports are read three times and rows that are not repeated stay where they are; without, they are
    read once and all rows are shuffled. Order is a matter of output: see ``sort_chats`` and the sinks.
    """
    return _without_duplicates(rows.union_exports(exports), hash_first)


def _without_duplicates(chats: DataFrame, hash_first: bool) -> DataFrame:
    return rows.drop_repeated_rows(chats) if hash_first else rows.drop_duplicate_rows(chats)


def prepare_rules(keywords: DataFrame) -> DataFrame:
    """Check the keyword table, name the headers and resolve the requirements."""
    return rule_ops.resolve_required(rule_ops.add_headers(check_rules(keywords)))


def load_chats(spark: SparkSession, root: str) -> DataFrame:
    """Chats of all sub-folders in canonical form, with their folder as ``sheet``."""
    return rows.chat_rows(check_chats(scan_folders(spark, root)), keep=["sheet"])


def load_routed(spark: SparkSession, root: str) -> DataFrame:
    """Chats written by ``write_by_nature`` in canonical form, with their category as ``sheet``."""
    columns = scan_header(spark, root)
    if not columns:
        empty = spark.createDataFrame([], text_schema([*EXPORT_COLUMNS, "Source", "nature"]))
        return rows.chat_rows(empty, keep=["nature"]).withColumnRenamed("nature", "sheet")
    chats = scan_partitioned(spark, root, columns, ["nature", "Source"])
    return rows.chat_rows(check_chats(chats), keep=["nature"]).withColumnRenamed(
        "nature", "sheet"
    )


def lexicon_scorer(
    positive: scoring.Words, negative: scoring.Words, message_col: str = "messageBody"
) -> ScoreStep:
    return lambda tagged: scoring.score_by_lexicon(tagged, positive, negative, message_col)


def model_scorer(
    make_scorer: Callable[[], scoring.Scorer],
    rules: DataFrame,
    message_col: str = "messageBody",
    system_template: str = scoring.SYSTEM_PROMPT,
    template: str = scoring.PROMPT,
    max_attempts: int = scoring.MAX_ATTEMPTS,
    partitions: int | None = None,
    batch_size: int = scoring.BATCH_SIZE,
    log: str | None = None,
) -> ScoreStep:
    """Score with an external scorer that is told all rules in its system prompt.

    A run that is given the ``log`` folder of one that died goes on where that ended.
    """

    def score(tagged: DataFrame) -> DataFrame:
        text = scoring.system_prompt(F.col("rules_json"), system_template)
        system = rule_ops.rules_json(rules).select(text).first()[0]
        return scoring.score_by_model(
            tagged, make_scorer, system, message_col, template, max_attempts, partitions, batch_size, log
        )

    return score


def analyse(
    chats: DataFrame,
    rules: DataFrame,
    score: ScoreStep,
    message_col: str = "messageBody",
    required: str = tagging.ANY,
    full_fold: bool = False,
    max_rules: int = tagging.SHIPPED_MAX_RULES,
    max_bytes: int = tagging.SHIPPED_MAX_BYTES,
    as_cells: bool = False,
) -> DataFrame:
    """The final table: the chat columns and one sentiment column per header.

    With ``as_cells`` a map ``cells`` takes the place of the header columns, however many there are.
    A rule table of up to ``max_rules`` rows and ``max_bytes`` is shipped to every task.
    """
    needles = tagging.rule_needles(rules, required, full_fold)
    index = tagging.index_needles(needles, max_rules=max_rules, max_bytes=max_bytes)
    if index is None:
        tagged = tagging.tag_by_join(chats, rules, message_col, required, full_fold=full_fold, needles=needles)
    else:
        tagged = tagging.tag_by_index(chats, index, message_col, full_fold)
    scored = scoring.with_reason(score(tagged))
    if as_cells:
        return scoring.sentiment_cells(scored)
    headers = tagging.header_names(rules) if index is None else index.headers
    return scoring.wide_sentiment(scored, headers)


def run(
    exports: list[DataFrame],
    group_info: DataFrame,
    keywords: DataFrame,
    score: ScoreStep | None = None,
    message_col: str = "messageBody",
    required: str = tagging.ANY,
    positive: scoring.Words | None = None,
    negative: scoring.Words | None = None,
    hash_first: bool = True,
    **limits,
) -> DataFrame:
    """Everything: merge, route, tag, score. ``sheet`` holds the category of each chat.

    A column that all exports lack is an error. ``hash_first`` is that of ``merge_exports``, ``limits`` are further
    options of ``analyse``.
    """
    rules = prepare_rules(keywords)
    united = check_chats(rows.union_exports(exports))
    # route first: the rows of chats without a category then skip the shuffle
    routed = _without_duplicates(route_chats(united, group_info), hash_first)
    chats = rows.chat_rows(routed, keep=["nature"]).withColumnRenamed("nature", "sheet")
    if score is None:
        score = lexicon_scorer(
            [] if positive is None else positive, [] if negative is None else negative, message_col
        )
    return analyse(chats, rules, score, message_col, required, **limits)


def run_files(
    spark: SparkSession,
    exports_root: str,
    group_info_path: str,
    keywords_path: str,
    bad_files: str = "skip",
    na_tokens: list[str] | None = None,
    required_columns: list[str] = EXPORT_COLUMNS,
    hash_first: bool = False,
    **options,
) -> DataFrame:
    """``run`` on files: a tree of CSV exports and the two lookup files.

    A file that lacks one of ``required_columns`` is an error. ``hash_first`` reads the exports three times, which for CSV
    takes longer than a shuffle of the rows unless storage is fast.
    """
    exports = scan_exports(
        spark, exports_root, bad_files, required=required_columns, na_tokens=na_tokens
    )
    return run(
        [exports],
        scan_group_info(spark, group_info_path),
        scan_keywords(spark, keywords_path),
        hash_first=hash_first,
        **options,
    )
