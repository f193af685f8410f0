"""One query per operator, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import fixtures as fx
from chatlens.functions.replies import parse_reply
from chatlens.operators import routing, rows, scoring, tagging, validation
from chatlens.operators import rules as rule_ops
from chatlens.plans import flows
from chatlens.schemas import EXPORT_COLUMNS, EXPORT_NOT_NULL
from chatlens.sinks import files as sinks
from chatlens.sources import csv_files, lookups
from chatlens.storage import new_folder

# the stand-in scorer travels with its code, so the workers need not have this package
cloudpickle.register_pickle_by_value(fx)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ["conv_id", "turn"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rules(spark: SparkSession) -> DataFrame:
    return flows.prepare_rules(fx.rules(spark))


def _part_rules(spark: SparkSession, sf: str) -> DataFrame:
    return flows.prepare_rules(fx.part_rules(spark, sf))


def _tagged(spark: SparkSession, sf: str, **options) -> DataFrame:
    messages = fx.conversation_exports(spark, sf).select(*KEYS, "messageBody")
    return tagging.tag_messages(messages, _rules(spark), **options)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_by_lexicon(_tagged(spark, sf), fx.POSITIVE, fx.NEGATIVE)


def _results(scored: DataFrame) -> DataFrame:
    return scored.select(*KEYS, F.explode(F.transform("results", lambda r: r)).alias("r"))


# merge


@query
def union_exports(spark, sf):
    return rows.chat_rows(rows.union_exports(fx.export_slices(spark, sf)))


@query
def merge_dedupe(spark, sf):
    return flows.merge_exports(fx.export_slices(spark, sf))


def _sequence(spark, sf, mode):
    merged = flows.merge_exports(fx.export_slices(spark, sf))
    return rows.number_rows(merged, mode).select("Source", "Date2", "Time", "messageBody", "seq")


@query
def merge_seq_chrono(spark, sf):
    return _sequence(spark, sf, rows.CHRONOLOGICAL)


@query
def merge_seq_lexical(spark, sf):
    return _sequence(spark, sf, rows.LEXICAL)


@query
def merge_unsorted(spark, sf):
    merged = flows.merge_exports([s.drop("Date2") for s in fx.export_slices(spark, sf)])
    return rows.sort_chats(merged)


@query
def group_files(spark, sf):
    name = F.concat("Source", F.lit(".csv"))
    files = fx.conversation_exports(spark, sf).select(
        name.alias("file_name"),
        F.concat(F.lit("exports/"), "conv_id", F.lit("/"), name).alias("path"),
    )
    return rows.group_files(files)


@query
def file_template(spark, sf):
    folder = new_folder(spark, "template")
    sinks.write_merged(fx.conversation_exports(spark, sf).drop(*KEYS), folder)
    return csv_files.list_chats(spark, folder)


# routing


@query
def route_chats(spark, sf):
    merged = flows.merge_exports(fx.export_slices(spark, sf))
    return routing.route_chats(merged, fx.group_info(spark)).select(
        "Source", "nature", "Date2", "Time", "messageBody"
    )


@query
def route_events(spark, sf):
    return routing.route_chats(fx.event_exports(spark, sf), fx.customer_groups(spark, sf)).select(
        "event_id", "Source", "nature"
    )


@query
def distinct_natures(spark, sf):
    return routing.distinct_natures(fx.customer_groups(spark, sf))


# files


@query
def csv_round_trip(spark, sf):
    base = fx.conversation_exports(spark, sf)
    folder = new_folder(spark, "round-trip")
    sinks.write_merged(base, folder)
    columns = [c for c in base.columns if c != "Source"]
    return csv_files.scan_partitioned(spark, folder, columns, ["Source"])


@query
def csv_exports_by_name(spark, sf):
    base = fx.conversation_exports(spark, sf).drop("Source")
    folder = new_folder(spark, "by-name")
    sinks.write_csv(base.where("turn <= 4"), f"{folder}/a")
    late = base.where("turn >= 3").drop("mediaCaption")
    sinks.write_csv(late.select(*reversed(late.columns)), f"{folder}/b")
    longer = base.select(F.concat_ws(",", *KEYS, "turn").alias("value"))
    longer.withColumnRenamed("value", "conv_id,turn").write.option("header", "true").option(
        "quote", ""
    ).option("sep", "\u0001").csv(f"{folder}/bad")
    return csv_files.scan_exports(spark, folder).drop("Source", "file_name")


@query
def lookup_scans(spark, sf):
    folder = new_folder(spark, "lookup")
    path = f"{folder}/keywords.csv"
    sinks.write_template(fx.part_rules(spark, sf), path)
    return rows.fill_nulls(lookups.scan_keywords(spark, path))


@query
def folder_sheets(spark, sf):
    folder = new_folder(spark, "sheets")
    merged = flows.merge_exports(fx.export_slices(spark, sf))
    sinks.write_by_nature(routing.route_chats(merged, fx.group_info(spark)), folder)
    return flows.load_routed(spark, folder)


# normal form and checks


@query
def normalise_chat(spark, sf):
    base = fx.conversation_exports(spark, sf)
    return rows.chat_rows(validation.check_chats(base), keep=KEYS)


@query
def chat_violations(spark, sf):
    base = fx.conversation_exports(spark, sf)
    dirty = (
        base.withColumn("Date2", F.when(F.col("conv_id") % 7 != 0, F.col("Date2")))
        .withColumn("Time", F.when(F.col("turn") % 5 != 2, F.col("Time")))
        .withColumn("userPhone", F.when(F.col("conv_id") % 11 != 0, F.col("userPhone")))
    )
    return validation.null_violations(dirty, EXPORT_NOT_NULL, KEYS)


@query
def rule_violations(spark, sf):
    return validation.rule_warnings(_part_rules(spark, sf))


# rules


@query
def rule_headers(spark, sf):
    return rule_ops.header_order(rule_ops.add_headers(fx.part_rules(spark, sf)))


@query
def rule_required(spark, sf):
    return _part_rules(spark, sf).select("idx", "headers", "required_keyword")


@query
def rule_kinds(spark, sf):
    return rule_ops.with_rule_kind(_part_rules(spark, sf)).select("idx", "headers", "kind")


@query
def generic_suppressors(spark, sf):
    headers = rule_ops.header_order(rule_ops.add_headers(fx.part_rules(spark, sf)))
    return rule_ops.suppressor_pairs(headers).select("generic", "specific")


@query
def header_keywords(spark, sf):
    return rule_ops.header_keywords(_part_rules(spark, sf))


# tagging


@query
def tag_simple(spark, sf):
    simple = _rules(spark).where("required_keyword = ''")
    messages = fx.conversation_exports(spark, sf).select(*KEYS, "messageBody")
    tagged = tagging.tag_messages(messages, simple, suppress=False)
    return tagging.explode_hits(tagged).select(*KEYS, "header")


@query
def tag_required_any(spark, sf):
    return tagging.explode_hits(_tagged(spark, sf, suppress=False)).select(*KEYS, "header")


@query
def tag_required_literal(spark, sf):
    tagged = _tagged(spark, sf, suppress=False, required=tagging.LITERAL)
    return tagging.explode_hits(tagged).select(*KEYS, "header")


@query
def tag_generic(spark, sf):
    return tagging.explode_hits(_tagged(spark, sf)).select(*KEYS, "header")


@query
def tag_batched(spark, sf):
    tagged = _tagged(spark, sf, max_bytes=tagging.SHIPPED_MAX_BYTES * 2)
    return tagging.explode_hits(tagged).select(*KEYS, "header")


@query
def tag_by_join(spark, sf):
    messages = fx.conversation_exports(spark, sf).select(*KEYS, "messageBody")
    tagged = tagging.tag_by_join(messages, _rules(spark))
    return tagging.explode_hits(tagged).select(*KEYS, "header")


@query
def tag_documents(spark, sf):
    tagged = tagging.tag_messages(fx.document_exports(spark, sf), _rules(spark))
    return tagging.explode_hits(tagged).select("doc_id", "header")


@query
def tag_pages(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", "html")
    tagged = tagging.tag_messages(pages, _rules(spark), message_col="html")
    return tagging.explode_hits(tagged).select("page_id", "header")


@query
def tag_many_rules(spark, sf):
    messages = fx.conversation_exports(spark, sf).select(*KEYS, "messageBody")
    rules = flows.prepare_rules(fx.document_rules(spark, sf))
    tagged = tagging.tag_messages(messages, rules)
    return tagging.explode_hits(tagged).select(*KEYS, "header")


@query
def tag_wide(spark, sf):
    tagged = _tagged(spark, sf).drop("messageBody")
    return tagging.wide_tags(tagged, tagging.header_names(_rules(spark)))


@query
def wide_many_headers(spark, sf):
    """A file with a column for each of the many headers, read back line by line."""
    folder = new_folder(spark, "wide")
    rules = flows.prepare_rules(fx.document_rules(spark, sf))
    messages = fx.conversation_exports(spark, sf).select(*KEYS, "messageBody")
    tagged = tagging.tag_messages(messages, rules).drop("messageBody")
    headers = rule_ops.header_order(rules)
    sinks.write_wide(tagging.tag_cells(tagged), headers, folder, blank="0", compression="gzip")
    lines = spark.read.text(folder)
    is_top = F.substring_index("value", ",", 1) == KEYS[0]
    top = lines.where(is_top).distinct().select(F.split("value", ",").alias("names"))
    keys = F.split(F.substring_index("value", ",", len(KEYS)), ",")
    rows_read = lines.where(~is_top).select(
        keys[0].cast("long").alias(KEYS[0]),
        keys[1].cast("int").alias(KEYS[1]),
        csv_files.fields_equal("value", "1").alias("_read"),
    )
    # outer: for an inner one the optimizer would search the lines twice, to leave out those without
    hits = rows_read.select(*KEYS, "_read.n_fields", F.explode_outer("_read.places").alias("_place"))
    header = F.get(top.scalar(), F.col("_place"))
    named = hits.where("_place IS NOT NULL").select(*KEYS, F.col("n_fields").alias("n_columns"), header.alias("header"))
    return named.where(~F.col("header").isin(KEYS))


# scoring


@query
def requests(spark, sf):
    return scoring.request_rows(_tagged(spark, sf)).select(*KEYS, "header", "prompt")


@query
def request_messages(spark, sf):
    rules = rule_ops.rules_json(_rules(spark)).select(
        scoring.system_prompt(F.col("rules_json"), "Rules: {rules}").alias("system")
    )
    return (
        scoring.request_rows(_tagged(spark, sf))
        .withColumn("system", rules.scalar())
        .select(*KEYS, "header", "system", F.col("prompt").alias("user"))
    )


@query
def lexicon_scores(spark, sf):
    return _results(_scored(spark, sf)).select(*KEYS, "r.header", "r.sentiment")


def _document_words(spark, sf, odd: int):
    """The words of the documents with 10 or more small letters, by the parity of their length."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    found = F.explode(F.regexp_extract_all("text", F.lit("[a-z]{10,}"), F.lit(0)))
    return texts.select(found.alias("word")).distinct().where(F.length("word") % 2 == odd)


@query
def lexicon_word_tables(spark, sf):
    """Words by search: the tables fit the bound."""
    words = [_document_words(spark, sf, odd) for odd in (0, 1)]
    return _results(scoring.score_by_lexicon(_tagged(spark, sf), *words)).select(*KEYS, "r.header", "r.sentiment")


@query
def lexicon_word_join(spark, sf):
    """Words by joins: the tables are above the bound given."""
    words = [_document_words(spark, sf, odd) for odd in (0, 1)]
    scored = scoring.score_by_lexicon(_tagged(spark, sf), *words, max_words=10)
    return _results(scored).select(*KEYS, "r.header", "r.sentiment")


@query
def parse_replies(spark, sf):
    return (
        fx.reply_attempts(spark, sf)
        .withColumn("r", parse_reply(F.col("reply")))
        .select(*KEYS, "r.status", "r.sentiment", "r.reason")
    )


@query
def retry_fold(spark, sf):
    attempts = fx.reply_attempts(spark, sf).select(
        F.col("conv_id").cast("string").alias("request_id"),
        (F.col("turn") + 1).alias("attempt"),
        F.col("reply").alias("text"),
    )
    return scoring.fold_replies(attempts)


@query
def map_score(spark, sf):
    score = flows.model_scorer(fx.ScriptedScorer, _rules(spark))
    return _results(score(_tagged(spark, sf))).select(
        *KEYS, "r.header", "r.success", "r.sentiment", "r.reason"
    )


@query
def reason_concat(spark, sf):
    return scoring.with_reason(_scored(spark, sf)).select(*KEYS, "Reason")


@query
def wide_sentiment(spark, sf):
    scored = _scored(spark, sf).drop("messageBody")
    return scoring.wide_sentiment(scored, tagging.header_names(_rules(spark)))


@query
def wide_model_sentiment(spark, sf):
    score = flows.model_scorer(fx.ScriptedScorer, _rules(spark))
    scored = scoring.with_reason(score(_tagged(spark, sf))).drop("messageBody")
    return scoring.wide_sentiment(scored, tagging.header_names(_rules(spark)))


# full run


def _full_run(spark, sf):
    return flows.run(
        fx.export_slices(spark, sf),
        fx.group_info(spark),
        fx.rules(spark),
        positive=fx.POSITIVE,
        negative=fx.NEGATIVE,
    )


@query
def final_table(spark, sf):
    return _full_run(spark, sf).drop("sheet")


@query
def final_by_sheet(spark, sf):
    folder = new_folder(spark, "final")
    final = _full_run(spark, sf)
    sinks.write_sheets(final, folder)
    return spark.read.schema(final.schema).parquet(folder).select(*final.columns)


@query
def final_run_files(spark, sf):
    """The full run from files: one folder per export, lookups as CSV."""
    folder = new_folder(spark, "run")
    for i, export in enumerate(fx.export_slices(spark, sf)):
        named = export.withColumn("mediaCaption", F.lit(None).cast("string"))
        sinks.write_csv(named.withColumn("chat", F.col("Source")), f"{folder}/{i}", ["Source"])
    lookups_of = {"group_info": fx.group_info(spark), "keywords": fx.rules(spark)}
    for name, table in lookups_of.items():
        sinks.write_template(table.coalesce(1).drop("idx"), f"{folder}-{name}.csv")
    exports = csv_files.scan_exports(spark, folder, required=EXPORT_COLUMNS)
    final = flows.run(
        [exports.withColumn("Source", F.col("chat")).drop("chat", "file_name")],
        lookups.scan_group_info(spark, f"{folder}-group_info.csv"),
        lookups.scan_keywords(spark, f"{folder}-keywords.csv"),
        positive=fx.POSITIVE,
        negative=fx.NEGATIVE,
    )
    return final.drop("sheet")


@query
def final_written(spark, sf):
    folder = new_folder(spark, "final")
    final = _full_run(spark, sf)
    sinks.write_final(final, folder)
    return spark.read.schema(final.schema).parquet(folder)


@query
def final_ordered(spark, sf):
    """Place of each row in its chat, by file name and row of what the sink wrote."""
    folder = new_folder(spark, "ordered")
    final = _full_run(spark, sf).select("sheet", "Source", "Date2", "Time", "messageBody")
    sinks.write_sheets(final, folder)
    rows_read = spark.read.schema(final.schema).parquet(folder)
    place = (
        "row_number() OVER (PARTITION BY sheet, Source ORDER BY _metadata.file_name, _metadata.row_index)"
    )
    return rows_read.select(*final.columns, F.expr(place).alias("place"))


@query
def offline_scores(spark, sf):
    """Replies collected by another service, attempt by attempt, and put back on the messages."""
    tagged = _tagged(spark, sf)
    asked = scoring.distinct_requests(tagged)
    size = F.char_length("prompt")
    good = F.format_string(
        '{"sentiment":"%s","reason":"size %d"}', F.substring(F.lit("PNI"), size % 3 + 1, F.lit(1)), size
    )
    first = F.when(size % 5 == 0, "not json").when(size % 5 == 1, '["P"]').when(size % 5 != 2, good)
    later = F.when(size % 5 == 0, good)
    attempts = asked.select(
        "request_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"), first.alias("a"), later.alias("b")
    ).select("request_id", "attempt", F.when(F.col("attempt") == 1, F.col("a")).otherwise(F.col("b")).alias("text"))
    answered = scoring.with_outcomes(asked, scoring.fold_replies(attempts))
    return _results(scoring.attach_results(tagged, answered)).select(
        *KEYS, "r.header", "r.success", "r.sentiment", "r.reason"
    )


# files of all kinds


PARTS = 8


def _csv_files(rows: DataFrame, path: str, header, line, last: str | None = None, encoding: str = "UTF-8") -> None:
    """Raw text as files below ``path``, one for each value of ``file``; each has a header and perhaps a last line.

    ``header`` and ``line`` are expressions; the header must be the same in all rows of a file.
    """
    rows = rows.select("file", header.alias("header"), line.alias("value"))
    ends = [F.struct(F.lit(0).alias("n"), F.col("header").alias("value"))]
    if last:
        ends.append(F.struct(F.lit(2).alias("n"), F.lit(last).alias("value")))
    extra = rows.select("file", "header").distinct().select("file", F.explode(F.array(*ends)).alias("x"))
    texts = rows.select("file", F.lit(1).alias("n"), "value").union(extra.select("file", "x.n", "x.value"))
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    # line by line, as the sink would put signs around a value with line breaks
    (
        texts.select("file", "n", "row", F.posexplode(F.split("value", "\n")).alias("k", "value"))
        .repartition("file")
        .sortWithinPartitions("file", "n", "row", "k")
        .select("file", "value")
        .write.partitionBy("file")
        .options(quote="", sep="\u0001", emptyValue="", encoding=encoding)
        .csv(path)
    )


def _chat_tree(spark, sf, folder):
    """All conversations as chats of up to 40 names in three folders, a CSV file each."""
    chats = fx.conversation_exports(spark, sf)
    rows_of_chat = chats.withColumns(
        {
            "sheet": F.concat(F.lit("s"), F.col("conv_id") % 3),
            "chat": F.concat(F.lit("c"), F.col("conv_id") % 40),
        }
    ).drop(*KEYS, "Source")
    staged = f"{folder}-staged"
    spread = rows_of_chat.repartition(F.col("sheet"), F.col("chat"))
    sinks.write_csv(spread, staged, ["sheet", "chat"])
    # the sink names files by itself: give each the name of its chat
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(conf)
    for status in fs.globStatus(path(f"{staged}/sheet=*/chat=*/*.csv")):
        chat = status.getPath().getParent()
        sheet = chat.getParent().getName().removeprefix("sheet=")
        fs.mkdirs(path(f"{folder}/{sheet}"))
        name = f"{chat.getName().removeprefix('chat=')}.csv"
        fs.rename(status.getPath(), path(f"{folder}/{sheet}/{name}"))
    return folder


@query
def list_files(spark, sf):
    return csv_files.list_files(spark, _chat_tree(spark, sf, new_folder(spark, "tree")))


@query
def source_name(spark, sf):
    exports = csv_files.scan_exports(spark, _chat_tree(spark, sf, new_folder(spark, "tree")))
    return exports.groupBy("Source").agg(F.count("*").alias("n_rows"))


@query
def load_chats(spark, sf):
    return flows.load_chats(spark, _chat_tree(spark, sf, new_folder(spark, "tree")))


@query
def scan_chat_csv(spark, sf):
    folder = new_folder(spark, "chats")
    sinks.write_csv(fx.conversation_exports(spark, sf).drop(*KEYS, "Source"), folder)
    found = csv_files.scan_chat_csv(spark, folder).select(*EXPORT_COLUMNS)
    return found.groupBy(*EXPORT_COLUMNS).agg(F.count("*").alias("n"))


def _group_parts(spark, sf, folder: str, parts: int, write) -> None:
    """The group info in ``parts`` files, range by range, each in order."""
    groups = fx.customer_groups(spark, sf)
    ordered = groups.repartitionByRange(parts, "idx").sortWithinPartitions("idx").drop("idx")
    write(ordered, folder)


@query
def scan_group_info(spark, sf):
    """A lookup of several part files in the order of their names."""
    path = f"{new_folder(spark, 'groups')}/groups.csv"
    _group_parts(spark, sf, path, PARTS, sinks.write_template)
    return lookups.scan_group_info(spark, path)


@query
def lookup_parts(spark, sf):
    """A lookup of part files without ``idx``: the last row by file and place wins."""
    folder = f"{new_folder(spark, 'parts')}.parquet"
    groups = fx.customer_groups(spark, sf)
    # each of the four folders has its rows in several files
    for k in range(4):
        part = groups.where(F.col("idx") % 4 == k).repartitionByRange(PARTS, "idx")
        part.sortWithinPartitions("idx").drop("idx").write.parquet(f"{folder}/part={k}")
    info = lookups.scan_group_info(spark, folder)
    return routing.route_chats(fx.event_exports(spark, sf), info).select("event_id", "Source", "nature")


@query
def csv_bad_files(spark, sf):
    """Files of each kind that no reader should trust, next to sound ones."""
    base = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    base = base.withColumn("file", F.col("conv_id") % PARTS)
    header = F.lit("conv_id,turn,role")
    line = F.concat_ws(",", "conv_id", "turn", "role")
    folder = new_folder(spark, "bad")
    _csv_files(base, f"{folder}/good", header, line)
    _csv_files(base, f"{folder}/long", header, F.concat(line, F.lit(",,,x")))
    _csv_files(base, f"{folder}/open", header, line, last='0,0,"never closed')
    _csv_files(base, f"{folder}/latin", header, F.concat(line, F.lit("é")), encoding="ISO-8859-1")
    found = csv_files.bad_records(spark, folder)
    name = F.regexp_extract("path", r"/([a-z]+)/file=(\d+)/[^/]*$", 1).alias("kind")
    number = F.regexp_extract("path", r"/([a-z]+)/file=(\d+)/[^/]*$", 2).cast("long").alias("file")
    return found.select(name, number, "fault").distinct()


@query
def csv_trailing_commas(spark, sf):
    """Records that end in a comma keep their file and their places."""
    base = fx.table(spark, sf, "conversations").withColumn("file", F.col("conv_id") % PARTS)
    line = F.concat(F.concat_ws(",", "conv_id", "turn", "role"), F.lit(","))
    folder = new_folder(spark, "commas")
    _csv_files(base, folder, F.lit("conv_id,turn,role"), line)
    return csv_files.scan_exports(spark, folder).select("conv_id", "turn", "role")


@query
def csv_many_headers(spark, sf):
    """600 files of one tree, each with its own order of columns and a column of its own."""
    names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    base = fx.table(spark, sf, "customer").select(*names).withColumn("file", F.col("c_custkey") % 600)
    cells = [F.struct(F.xxhash64("file", F.lit(n)).alias("by"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names]
    own = F.struct(F.lit(0).cast("long").alias("by"), F.concat(F.lit("own"), "file").alias("name"), F.lit("x").alias("value"))
    ordered = F.array_sort(F.array(*cells, own))
    folder = new_folder(spark, "headers")
    _csv_files(
        base, folder, F.array_join(F.transform(ordered, lambda c: c["name"]), ","), F.array_join(F.transform(ordered, lambda c: c["value"]), ",")
    )
    return csv_files.scan_exports(spark, folder).select(*names)


@query
def csv_quoted_header(spark, sf):
    """Line breaks, commas and quotes in headers and bodies, and lines of blanks between the records."""
    base = fx.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    base = base.withColumn("file", F.col("conv_id") % PARTS)
    body = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('\n, ""end"""'))
    line = F.concat(F.concat_ws(",", "conv_id", body, "turn"), F.lit("\n  \n"))
    folder = new_folder(spark, "quoted")
    _csv_files(base, folder, F.lit('conv_id,"the\n""body"", whole",turn'), line)
    found = csv_files.scan_exports(spark, folder)
    body = F.col('`the\n"body", whole`')
    return found.select("conv_id", "turn", F.char_length(body).alias("size"), F.sha2(body, 256).alias("body_sha256"))


@query
def rules_of_header(spark, sf):
    return rule_ops.rules_of_header(_part_rules(spark, sf), "b1_generic").select("idx", "keyword")


@query
def empty_folders(spark, sf):
    """A folder without files beside a full one gives no rows, and a tree without any chat the empty table."""
    folder = new_folder(spark, "nothing")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    chats = fx.conversation_exports(spark, sf).drop(*KEYS).withColumn("nature", F.col("Source"))
    sinks.write_by_nature(chats.where(chats.Source != "grp0"), f"{folder}/some")
    sinks.write_by_nature(chats.limit(0), f"{folder}/none")
    for place in ("some/nature=grp0", "some/nature=grp0/Source=grp0"):
        path(folder).getFileSystem(conf).mkdirs(path(f"{folder}/{place}"))
    return flows.load_routed(spark, f"{folder}/some").unionByName(flows.load_routed(spark, f"{folder}/none"))
