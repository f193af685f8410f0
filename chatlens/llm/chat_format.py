"""Chat formatting with a grammar round trip, in built-in expressions only.

A conversation is rendered as turns

    ### Assistant: text
    </turn>

``parse`` reads it back by the grammar alone. A turn whose text does not come back, because it holds
control strings or what looks like an escaped one, is escaped (one more backslash before every
control string) and read again, until it is identical. Rendering and checking happen per turn, before turns are
brought together; the finished conversation is read back as a whole and compared once more, and a
difference ends the job.

Cases: a null text is an empty one, a null role an empty role; any role is possible (those other
than system, user and assistant are written percent-encoded after ``@``); turns are ordered by
``turn`` (null last), then role and text, and repeated rows stay as turns of their own; rows with a
null ``conv_id`` are one conversation; an empty table gives no rows; other columns are left out. A
conversation becomes one row, as a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import let

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN = "### "
CLOSE = "</turn>"
END = f"\n{CLOSE}\n"
CONTROL = f"(?:{OPEN}(?:{'|'.join(ROLES.values())}|@)|{CLOSE})"
HEADER = f"^{OPEN}({'|'.join(ROLES.values())}|@[^ ]*): "
BACKSLASH = r"\\"
FREE = f"(?<!{BACKSLASH})"
MAX_ESCAPES = 3


def escape(text: Column) -> Column:
    """One more backslash before every control string and its backslashes."""
    return F.regexp_replace(text, f"{FREE}({BACKSLASH}*+{CONTROL})", r"\\$1")


def unescape(body: Column) -> Column:
    """One backslash less before every control string."""
    return F.regexp_replace(body, f"{FREE}{BACKSLASH}({BACKSLASH}*+{CONTROL})", "$1")


def role_name(role: Column) -> Column:
    name = F.concat(F.lit("@"), F.url_encode(role))
    for plain, written in ROLES.items():
        name = F.when(role == plain, F.lit(written)).otherwise(name)
    return name


def role_of(name: Column) -> Column:
    role = F.url_decode(F.substring(name, 2, 1 << 30))
    for plain, written in ROLES.items():
        role = F.when(name == written, F.lit(plain)).otherwise(role)
    return role


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role_name(role), F.lit(": "))


def parse_turn(turn: Column) -> Column:
    """``role, text, body`` of one turn without its end mark; null where the grammar is broken."""
    body = F.regexp_replace(turn, HEADER, "")
    good = F.rlike(turn, F.lit(HEADER)) & ~F.rlike(body, F.lit(FREE + CONTROL))
    return F.when(
        good,
        F.struct(
            role_of(F.regexp_extract(turn, HEADER, 1)).alias("role"),
            unescape(body).alias("text"),
            body.alias("body"),
        ),
    )


def parse(formatted: Column) -> Column:
    """The turns of a conversation, in order."""

    def turns(parts: Column) -> Column:
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), parse_turn)

    return let(F.split(formatted, END), turns)


def render_turns(turns: DataFrame) -> DataFrame:
    """``turns(role, text)`` with ``body``: the text, escaped as often as its round trip needs."""

    def reads_back(body: Column) -> Column:
        # As the whole parser would see it: cut at the end mark first.
        whole = F.concat(header(F.col("role")), body, F.lit(END))
        return parse(whole).eqNullSafe(
            F.array(
                F.struct(
                    F.col("role").alias("role"), F.col("text").alias("text"), body.alias("body")
                )
            )
        )

    rows = turns.withColumn("body", F.col("text"))
    for _ in range(MAX_ESCAPES):
        body = F.col("body")
        rows = rows.withColumn("body", F.when(reads_back(body), body).otherwise(escape(body)))
    return rows


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss``.

    ``loss`` are the spans ``start, length`` (code points, from 0) of the assistant's texts.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = render_turns(rows)
    rows = rows.withColumns(
        {
            "head": F.char_length(header(F.col("role"))),
            "rendered": F.concat(header(F.col("role")), "body", F.lit(END)),
        }
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    size = F.char_length("rendered").cast("long")
    rows = rows.select(
        "conv_id",
        "role",
        "text",
        "rendered",
        F.row_number().over(order).alias("n"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.col("head"))
        .alias("start"),
        F.char_length("body").cast("long").alias("length"),
    )
    turn = F.struct("n", "role", "text", "rendered", "start", "length")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = F.col("turns")
    formatted = F.array_join(turns["rendered"], "")
    spans = F.transform(
        F.filter(turns, lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
    )
    said = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chats = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        formatted.alias("formatted"),
        spans.alias("loss"),
        said.alias("said"),
    )
    found = F.transform(
        parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    broken = F.raise_error(
        F.concat(F.lit("conversation does not read back: "), F.col("conv_id").cast("string"))
    ).cast("string")
    checked = F.when(found.eqNullSafe(F.col("said")), F.col("formatted")).otherwise(broken)
    return chats.select("conv_id", "n_turns", checked.alias("formatted"), "loss")


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    spans = F.transform(
        loss,
        lambda s: unescape(
            F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
    return F.array_join(spans, "")
