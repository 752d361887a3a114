"""Chat formatting by prefix-target expansion.

``expand`` turns conversations (one row per turn) into training examples: every
assistant turn becomes an example of its own whose context is all turns before
it and whose only trainable part is that reply.  Turns after the last reply go
into one closing example without a trainable part, so no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Control strings inside
a text are escaped by one more backslash between ``<`` and ``|`` (``<|`` becomes
``<\\|``, ``<\\|`` becomes ``<\\\\|``), which is undone by taking one away; a role
has ``%``, ``<`` and line ends percent-coded.  Both are exact inverses.

Edge cases: a null text or role is an empty one; a null conv_id is a conversation
of its own; turns with equal numbers are ordered by role, then text; equal rows
stay; a conversation without replies gives only the closing example; an empty
table gives no rows; further columns are ignored, whatever their names.
A conversation is gathered into one row (its digest is defined over its whole
text); nothing else is.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"
ASSISTANT = "assistant"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    for a, b in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_role(c: Column) -> Column:
    for a, b in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _head(role: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), escape_role(role), F.lit("\n"))


def formatted_turn(t: Column) -> Column:
    return F.concat(_head(t["role"]), escape_text(t["text"]), F.lit(TURN_CLOSE + "\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, target (turn index from 0, or the number of turns for the closing
    example), formatted, loss_start and loss_end (code points, end exclusive)."""
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    conv = conv.withColumn("parts", F.transform("turns", formatted_turn))
    replies = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == ASSISTANT)
    conv = conv.withColumn("replies", replies)
    closing = F.get("turns", F.size("turns") - 1)["role"] != ASSISTANT
    targets = F.when(closing, F.concat("replies", F.array(F.size("turns")))).otherwise(F.col("replies"))
    rows = conv.select("conv_id", "turns", "parts", F.explode(targets).alias("target"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("target")), "")
    reply = F.get("turns", F.col("target"))
    rows = rows.select(
        "conv_id",
        "target",
        F.concat(context, F.when(reply.isNotNull(), _head(reply["role"])).otherwise("")).alias("head"),
        F.coalesce(escape_text(reply["text"]), F.lit("")).alias("reply"),
        reply.isNotNull().alias("trains"),
    )
    return rows.select(
        "conv_id",
        "target",
        F.concat("head", "reply", F.when(F.col("trains"), TURN_CLOSE + "\n").otherwise("")).alias("formatted"),
        F.length("head").cast("long").alias("loss_start"),
        (F.length("head") + F.length("reply")).cast("long").alias("loss_end"),
        "trains",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted examples alone.

    The longest example of a conversation holds all of its turns; the examples'
    masked parts, in order of their targets, hold the replies.
    """
    masked = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = examples.select("conv_id", "target", "formatted", F.struct("target", unescape_text(masked).alias("text")).alias("loss"), F.length("formatted").cast("long").alias("chars"))
    conv = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("whole"),
        F.sort_array(F.collect_list("loss")).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("whole", r"<\|im_end\|>\n", -1), lambda p: p != "")
    role_end = lambda p: F.instr(p, "\n")
    skip = len(TURN_OPEN)
    turns = F.transform(
        pieces,
        lambda p: F.concat(
            unescape_role(F.substring(p, F.lit(skip + 1), role_end(p) - skip - 1)),
            F.lit("\n"),
            unescape_text(F.substring(p, role_end(p) + 1, F.length(p))),
            F.lit("\n"),
        ),
    )
    conv = conv.withColumn("back", turns).withColumn("loss_text", F.array_join(F.transform("losses", lambda x: x["text"]), ""))
    return conv.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join("back", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
