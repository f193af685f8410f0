"""Sentiment of every (message, header) hit.

``results ARRAY<STRUCT<ord, header, success, sentiment, reason>>`` stays on the message row; the
wide table and the Reason text are projections of it. The word-list scorer is an expression. A
model is asked once per distinct (text, header); every attempt is written to
a table as its round ends, so that neither a lost executor nor a new run leads to asking again for what was answered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.lexicon import contains_any, lexicon_verdict, sides_found
from chatlens.functions.replies import (
    BAD_JSON,
    BAD_STRUCTURE,
    NOT_OBJECT,
    OK,
    parse_reply,
)
from chatlens.functions.text import all_columns_hash, fold_case
from chatlens.operators.joins import contains_join, fits_broadcast, lookup_join
from chatlens.operators.tagging import explode_hits
from chatlens.schemas import RESULTS
from chatlens.storage import keep, new_folder

# The text of a request, the outcome of a failed one, the attempts of each.
PROMPT = "Formula Brand: {header}, Message: {message}"
FAILED_SENTIMENT = "I"
MAX_ATTEMPTS = 3
EXHAUSTED = "Failed to get valid JSON after {attempts} times of retries"

NO_REPLY = "no reply"

OUTCOME = "struct<success:boolean,sentiment:string,reason:string>"

SYSTEM_PROMPT = """You read chat messages and judge how each one speaks about one brand.
The keywords that stand for each brand, as JSON records:
{rules}
Answer with one JSON object and nothing else:
{{"sentiment": "P" for positive, "N" for negative or "I" for neutral, "reason": "a short reason"}}
Praise, intent to buy or a good effect is positive. A complaint, a bad effect or too high a price
is negative. A question, a plain fact or a mixed judgement is neutral. Judge that brand only."""

REJECTED = "The answer was rejected ({error}). Send the JSON object again, corrected, alone."

# A scorer takes a batch of conversations, each a list of {"role", "content"} messages, and gives
# one reply text, None or exception for each. An exception settles its request. One that is raised
# settles the whole batch, as nobody knows which of its requests were answered.
Scorer = Callable[[list[list[dict]]], list[str | None | Exception]]
BATCH_SIZE = 100


def prompt(header: Column, message: Column, template: str = PROMPT) -> Column:
    """Fill ``{header}`` and ``{message}`` of a template."""
    before, rest = template.split("{header}", 1)
    between, after = rest.split("{message}", 1)
    return F.concat(F.lit(before), header, F.lit(between), message, F.lit(after))


def system_prompt(rules_json: Column, template: str = SYSTEM_PROMPT) -> Column:
    before, after = template.replace("{{", "{").replace("}}", "}").split("{rules}", 1)
    return F.concat(F.lit(before), rules_json, F.lit(after))


def request_rows(
    tagged: DataFrame, message_col: str = "messageBody", template: str = PROMPT
) -> DataFrame:
    """One row per message and header hit, with ``prompt`` and ``request_id``."""
    return (
        explode_hits(tagged)
        .withColumn("prompt", prompt(F.col("header"), F.col(message_col), template))
        .withColumn("request_id", F.sha2("prompt", 256))
    )


def distinct_requests(
    tagged: DataFrame, message_col: str = "messageBody", template: str = PROMPT
) -> DataFrame:
    """One row per distinct text and header hit: ``text_id, ord, header, request_id, prompt``.

    Texts are combined by their hash: one that is repeated is shuffled once a task, whatever the number of
    its headers, and messages without hits not at all.
    """
    # through a list of at most one: a filter on the hits would make the optimizer compute them twice
    one = F.transform(F.slice("hits", 1, 1), lambda _: F.struct(F.col(message_col).alias("text"), "hits"))
    found = tagged.select(F.sha2(message_col, 256).alias("text_id"), F.explode(one).alias("_found"))
    texts = found.groupBy("text_id").agg(F.first("_found").alias("_found"))
    each = texts.select("text_id", "_found.text", F.explode("_found.hits").alias("_hit"))
    return (
        each.withColumn("prompt", prompt(F.col("_hit.header"), F.col("text"), template))
        .withColumn("request_id", F.sha2("prompt", 256))
        .select("text_id", "_hit.ord", "_hit.header", "request_id", "prompt")
    )


# Lists of up to so many words become conditions of the plan, longer ones a search.
FEW_WORDS = 32
# Word tables of up to this size are shipped to every task, larger ones are joined.
SHIPPED_MAX_WORDS = 200_000
SHIPPED_MAX_BYTES = 8 * 1024 * 1024

Words = list[str] | DataFrame


def score_by_lexicon(
    tagged: DataFrame,
    positive: Words,
    negative: Words,
    message_col: str = "messageBody",
    max_words: int = SHIPPED_MAX_WORDS,
    max_bytes: int = SHIPPED_MAX_BYTES,
) -> DataFrame:
    """Add ``results`` by word lists; every hit of a message gets the verdict of its text.

    A list may also be a table with a column ``word``, of any size: one of up to ``max_words`` rows and
    ``max_bytes`` is collected, a larger one is matched by joins. Null words are left out, case does not
    count, and a blank word is in every text that is not null.
    """
    tables = [w for w in (positive, negative) if isinstance(w, DataFrame)]
    if all(fits_broadcast(t.select("word"), max_words, max_bytes) for t in tables):
        folded = fold_case(message_col)
        lists = [_folded_words(w) for w in (positive, negative)]
        if sum(map(len, lists)) <= FEW_WORDS:
            sides = F.struct(*[contains_any(folded, w).alias(n) for w, n in zip(lists, SIDES)])
        else:
            # of all texts: the hits may hold a subquery, which a function of theirs could not be given
            sides = sides_found(folded, *lists)
        judged = tagged.withColumn("_sides", sides)
    else:
        judged = _sides_by_join(tagged, positive, negative, message_col)
    verdict = lexicon_verdict(F.col("_sides.positive"), F.col("_sides.negative"))
    return _same_verdict(judged, verdict).drop("_sides")


SIDES = ["positive", "negative"]


def _folded_words(words: Words) -> list[str]:
    if isinstance(words, DataFrame):
        table = words.select(fold_case("word").alias("word")).where("word IS NOT NULL").distinct()
        return sorted(r["word"] for r in table.collect())
    return [w.lower() for w in words]


def _sides_by_join(tagged: DataFrame, positive: Words, negative: Words, message_col: str) -> DataFrame:
    """Add ``_sides`` for word tables of any size: found once per distinct text that has hits."""
    spark = tagged.sparkSession
    tables = []
    for words, side in zip((positive, negative), SIDES):
        if not isinstance(words, DataFrame):
            words = spark.createDataFrame([(w,) for w in words], "word string")
        tables.append(words.select(fold_case("word").alias("_word"), F.lit(side).alias("_side")))
    words = keep(tables[0].union(tables[1]).where("_word IS NOT NULL").distinct(), "words")
    folded = fold_case(message_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept, as the texts are cut into blocks more than once
    texts = tagged.where(F.size("hits") > 0).select(folded.alias("_folded")).where("_folded IS NOT NULL")
    texts = texts.distinct().withColumn("_text", F.sha2("_folded", 256)).repartition(partitions, "_text")
    found = contains_join(keep(texts, "texts"), "_text", "_folded", words, "_word")
    of_text = lookup_join(found, words, ["_word"]).groupBy("_text").agg(
        *[F.bool_or(F.col("_side") == side).alias(side) for side in SIDES]
    )
    own_key = F.concat(F.lit("-"), all_columns_hash(tagged.columns).cast("string"))
    text_id = F.when((F.size("hits") > 0) & folded.isNotNull(), F.sha2(folded, 256)).otherwise(own_key)
    joined = lookup_join(tagged.withColumn("_text", text_id), of_text, ["_text"], "left")
    sides = F.struct(*[F.coalesce(side, F.lit(False)).alias(side) for side in SIDES])
    return joined.select(*tagged.columns, sides.alias("_sides"))


def _same_verdict(tagged: DataFrame, verdict: Column) -> DataFrame:
    """Give every hit of a message the same verdict."""
    judged = tagged.withColumn("_verdict", F.when(F.size("hits") > 0, verdict))
    return judged.withColumn(
        "results",
        F.transform(
            "hits",
            lambda h: F.struct(
                h["ord"].alias("ord"),
                h["header"].alias("header"),
                F.lit(True).alias("success"),
                F.col("_verdict.sentiment").alias("sentiment"),
                F.col("_verdict.reason").alias("reason"),
            ),
        ).cast(RESULTS),
    ).drop("_verdict")


def _ask(make_scorer: Callable[[], Scorer], system: str, batch_size: int):
    """UDF: conversation as JSON -> reply text or error. The scorer is built once per task.

    The system prompt travels once per task and not in the rows.
    """

    @F.pandas_udf("text string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        first = {"role": "system", "content": system}
        for batch in batches:
            answers: list[tuple[str | None, str | None]] = [(None, None)] * len(batch)
            due = [i for i, text in enumerate(batch) if text is not None]
            for at in range(0, len(due), batch_size):
                part = due[at : at + batch_size]
                asked = [[first, *json.loads(batch.iloc[i])] for i in part]
                try:
                    replies = list(scorer(asked))
                    if len(replies) != len(part):
                        raise ValueError(f"{len(replies)} replies to {len(part)} requests")
                except Exception as e:
                    replies = [e] * len(part)
                for i, reply in zip(part, replies):
                    failed = isinstance(reply, Exception)
                    answers[i] = (None, str(reply)) if failed else (reply, None)
            yield pd.DataFrame(answers, columns=["text", "error"], dtype=object)

    return ask.asNondeterministic()


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def ask_model(
    requests: DataFrame,
    make_scorer: Callable[[], Scorer],
    system: str,
    max_attempts: int = MAX_ATTEMPTS,
    rejected: str = REJECTED,
    partitions: int | None = None,
    batch_size: int = BATCH_SIZE,
    log: str | None = None,
) -> DataFrame:
    """Ask a scorer: adds ``success, sentiment, reason`` to every row of ``requests``.

    An invalid reply is sent back with the error; a missing text is asked for again as it was; a
    reply that is no object, or an exception, ends the request. Every round is one job that asks for what
    is not settled and appends the attempts to a table in the folder ``log`` (default: a new one in the shared folder).
    A run that is given the folder of one that died asks only for what is not there. The calls run in
    ``partitions`` tasks (default: the number of shuffle partitions, not merged by size, as a call
    takes long however short its text is).
    """
    spark = requests.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests = keep(requests, "requests")
    attempts = _attempts(spark, log or new_folder(spark, "attempts"))
    before, after = rejected.split("{error}", 1)
    wanted = requests.select("request_id", "prompt").repartition(partitions, "request_id")
    wanted = wanted.dropDuplicates(["request_id"])
    ask = _ask(make_scorer, system, batch_size)
    for attempt in range(1, max_attempts + 1):
        done = attempts().where((F.col("attempt") >= attempt) | F.col("settled")).select("request_id")
        due = wanted.join(done, "request_id", "left_anti")
        feedback = lambda a: F.concat(F.lit(before), a["status"], F.lit(after))
        answers = lambda a: F.array(_message("assistant", a["text"]), _message("user", feedback(a)))
        rejects = attempts().where((F.col("attempt") < attempt) & F.col("status").isin(BAD_JSON, BAD_STRUCTURE))
        said = rejects.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "text", "status"))).alias("_said"))
        due = due.join(said, "request_id", "left")
        first = F.array(_message("user", F.col("prompt")))
        more = F.flatten(F.transform("_said", answers))
        conversation = F.to_json(F.when(F.col("_said").isNull(), first).otherwise(F.concat(first, more)))
        # the join may have changed the partitioning
        asked = due.select("request_id", conversation.alias("_conversation")).repartition(partitions, "request_id")
        asked = asked.select("request_id", ask("_conversation").alias("_reply"))
        read = asked.withColumn("_read", parse_reply(F.col("_reply.text")))
        outcome = (
            F.when(F.col("_reply.error").isNotNull(), _failure(F.col("_reply.error")))
            .when(
                F.col("_read.status") == OK,
                _outcome(F.lit(True), F.col("_read.sentiment"), F.col("_read.reason")),
            )
            .when(F.col("_read.status") == NOT_OBJECT, _failure(F.col("_read.error")))
        )
        attempts.append(
            read.select(
                "request_id",
                F.lit(attempt).alias("attempt"),
                "_reply.text",
                "_read.status",
                outcome.alias("outcome"),
                outcome.isNotNull().alias("settled"),
            )
        )
    settled = attempts().where((F.col("attempt") <= max_attempts) & F.col("settled")).select("request_id", "outcome")
    exhausted = _failure(F.lit(EXHAUSTED.format(attempts=max_attempts)))
    answered = requests.join(settled.dropDuplicates(["request_id"]), "request_id", "left")
    answered = answered.withColumn("_outcome", F.coalesce("outcome", exhausted))
    return answered.select(*requests.columns, "_outcome.*")


class _attempts:
    """The table of attempts in a folder: call it to read, ``append`` to it round by round."""

    SCHEMA = f"request_id string, attempt int, text string, status string, outcome {OUTCOME}, settled boolean"

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def __call__(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)


def _outcome(success: Column, sentiment: Column, reason: Column) -> Column:
    return F.struct(
        success.alias("success"), sentiment.alias("sentiment"), reason.alias("reason")
    )


def _failure(reason: Column) -> Column:
    return _outcome(F.lit(False), F.lit(FAILED_SENTIMENT), reason)


def fold_replies(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Settle replies collected elsewhere: ``request_id, attempt, text`` -> one row per request.

    The first valid reply counts unless a reply that is no object came before it; attempts past
    ``max_attempts`` are ignored.
    """
    read = attempts.where(F.col("attempt").between(1, max_attempts)).select(
        "request_id", "attempt", parse_reply(F.col("text")).alias("_read")
    )
    settled = read.groupBy("request_id").agg(
        F.min(
            F.when(
                F.col("_read.status").isin(OK, NOT_OBJECT),
                F.struct("attempt", "_read"),
            )
        ).alias("_end")
    )
    end = F.col("_end._read")
    outcome = (
        F.when(end["status"] == OK, _outcome(F.lit(True), end["sentiment"], end["reason"]))
        .when(end["status"] == NOT_OBJECT, _failure(end["error"]))
        .otherwise(_failure(F.lit(EXHAUSTED.format(attempts=max_attempts))))
    )
    return settled.select(
        "request_id",
        outcome.alias("_outcome"),
        F.coalesce("_end.attempt", F.lit(max_attempts)).cast("int").alias("attempts_used"),
    ).select("request_id", "_outcome.*", "attempts_used")


def with_outcomes(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Requests with the outcomes that were collected elsewhere, by ``request_id``."""
    return requests.join(
        outcomes.select("request_id", "success", "sentiment", "reason"), "request_id", "left"
    )


def attach_results(
    tagged: DataFrame, answered: DataFrame, message_col: str = "messageBody"
) -> DataFrame:
    """Add ``results`` from the answered ``distinct_requests``.

    The results of a text are put together once and then joined to all messages with that text.
    Messages without hits get a key of their own, so that they do not meet in one partition. A
    request without an outcome counts as failed.
    """
    per_text = answered.groupBy("text_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "ord",
                    "header",
                    F.coalesce("success", F.lit(False)).alias("success"),
                    F.coalesce("sentiment", F.lit(FAILED_SENTIMENT)).alias("sentiment"),
                    F.when(F.col("success").isNull(), NO_REPLY)
                    .otherwise(F.col("reason"))
                    .alias("reason"),
                )
            )
        )
        .cast(RESULTS)
        .alias("results")
    )
    own_key = F.concat(F.lit("-"), all_columns_hash(tagged.columns).cast("string"))
    keyed = tagged.withColumn(
        "text_id", F.when(F.size("hits") > 0, F.sha2(message_col, 256)).otherwise(own_key)
    )
    # stored, so that the partition of a very common text can be split
    return (
        keyed.join(keep(per_text, "results"), "text_id", "left")
        .withColumn("results", F.coalesce("results", F.array().cast(RESULTS)))
        .drop("text_id")
    )


def score_by_model(
    tagged: DataFrame,
    make_scorer: Callable[[], Scorer],
    system: str,
    message_col: str = "messageBody",
    template: str = PROMPT,
    max_attempts: int = MAX_ATTEMPTS,
    partitions: int | None = None,
    batch_size: int = BATCH_SIZE,
    log: str | None = None,
) -> DataFrame:
    """Add ``results`` by asking an external scorer; the calls are made here, not when it is read.

    ``log`` is the folder of the attempts: see ``ask_model``.
    """
    tagged = keep(tagged, "tagged")
    requests = distinct_requests(tagged, message_col, template)
    answered = ask_model(
        requests, make_scorer, system, max_attempts, partitions=partitions, batch_size=batch_size, log=log
    )
    return attach_results(tagged, answered, message_col)


def reason_text(results: Column) -> Column:
    """``header: reason`` lines in header order, for successes and failures."""
    return F.array_join(
        F.transform(
            results, lambda r: F.concat(r["header"], F.lit(": "), r["reason"], F.lit("\n"))
        ),
        "",
    )


def with_reason(scored: DataFrame) -> DataFrame:
    """Append the reasons to the ``Reason`` column."""
    before = F.coalesce("Reason", F.lit("")) if "Reason" in scored.columns else F.lit("")
    return scored.withColumn("Reason", F.concat(before, reason_text(F.col("results"))))


def sentiment_cells(scored: DataFrame) -> DataFrame:
    """One column ``cells``, a map of the headers hit: ``1`` if scoring failed, else P, N or I.

    For any number of headers; ``sinks.files.write_wide`` writes it with a column for each.
    """
    cells = F.transform(
        "results",
        lambda r: F.struct(r["header"], F.when(r["success"], r["sentiment"]).otherwise(F.lit("1"))),
    )
    return scored.withColumn("cells", F.map_from_entries(cells)).drop("hits", "results")


def wide_sentiment(scored: DataFrame, headers: list[str]) -> DataFrame:
    """One text column per header: blank without a hit, ``1`` if scoring failed, else P, N or I."""
    given = sentiment_cells(scored.withColumnRenamed("cells", "_own") if "cells" in scored.columns else scored)
    kept = [F.col(c).alias("cells" if c == "_own" else c) for c in given.drop("cells").columns]
    return given.select(*kept, *[F.coalesce(F.col("cells")[h], F.lit("")).alias(h) for h in headers])
