"""Conversation operators: D7 assembly + H6 chat rendering, turn pairing, H9 completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.checks import require_columns

# Chat-template role headers.
SYSTEM_HEADER = "<|system|>\n"
USER_HEADER = "<|user|>\n"
ASSISTANT_HEADER = "<|assistant|>\n"


def render_messages(messages, eos: str = "</s>", add_generation_prompt: bool = False) -> Column:
    """H6 over an ordered ``array<struct<role, content>>``.

    system/user: header + content + newline; assistant: header + content + eos, plus
    a newline unless it is the last message; other roles are skipped; the
    generation header follows the last message when asked for.
    """
    m = messages if isinstance(messages, Column) else F.col(messages)
    n = F.size(m)

    def piece(x, i):
        last = i == n - 1
        return (F.when(x["role"] == "system", F.concat(F.lit(SYSTEM_HEADER), x["content"], F.lit("\n")))
                .when(x["role"] == "user", F.concat(F.lit(USER_HEADER), x["content"], F.lit("\n")))
                .when(x["role"] == "assistant",
                      F.concat(F.lit(ASSISTANT_HEADER), x["content"], F.lit(eos),
                               F.when(last, F.lit("")).otherwise(F.lit("\n"))))
                .otherwise(F.lit("")))

    body = F.array_join(F.transform(m, piece), "")
    if add_generation_prompt:
        body = F.concat(body, F.when(n > 0, F.lit(ASSISTANT_HEADER)).otherwise(F.lit("")))
    return body


def assemble_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                           text: str = "text") -> DataFrame:
    """Long ``(conv, turn, role, text)`` -> one ordered ``messages`` array per conversation.

    One shuffle on ``conv``; a conversation's turns are its own bounded group.
    """
    require_columns(turns, [conv, turn, role, text], "turns")
    msgs = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"),
                                                F.col(text).alias("content"))))
    return (turns.groupBy(conv).agg(msgs.alias("_m"))
            .select(conv, F.transform("_m", lambda x: F.struct(x["role"].alias("role"),
                                                              x["content"].alias("content"))).alias("messages")))


def render_conversations(turns: DataFrame, *, eos: str = "</s>", add_generation_prompt: bool = False,
                         conv: str = "conv_id", **cols) -> DataFrame:
    """D7 + H6: one rendered string per conversation (for conversations of bounded length;
    ``render_turns`` is the form that never gathers a conversation into one task)."""
    a = assemble_conversations(turns, conv=conv, **cols)
    return a.select(conv, render_messages("messages", eos, add_generation_prompt).alias("rendered"))


def _with_last_turn(turns: DataFrame, conv: str, turn: str) -> DataFrame:
    """``last_turn`` of each conversation, from a partial aggregate and an equi-join on the conversation."""
    return turns.join(turns.groupBy(conv).agg(F.max(turn).alias("last_turn")), conv)


#: Turn numbers of a bucket: a conversation of any length meets in windows of at most this many turns.
BUCKET_TURNS = 4096


def render_turns(turns: DataFrame, *, eos: str = "</s>", add_generation_prompt: bool = False,
                 conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """D7 + H6 in long form: ``(conv, turn, piece)``; the conversation is the pieces in turn order.

    "Last message" comes from a partial aggregate joined back (a conversation holding a third of all
    rows is one row of the aggregate, and the join's skew is split). Writing the pieces sorted by (conv, turn)
    yields the rendered text. Turn numbers may have gaps.
    """
    require_columns(turns, [conv, turn, role, text], "turns")
    x = _with_last_turn(turns.select(conv, turn, role, text), conv, turn)
    last = F.col(turn) == F.col("last_turn")
    r, t = F.col(role), F.col(text)
    piece = (F.when(r == "system", F.concat(F.lit(SYSTEM_HEADER), t, F.lit("\n")))
             .when(r == "user", F.concat(F.lit(USER_HEADER), t, F.lit("\n")))
             .when(r == "assistant", F.concat(F.lit(ASSISTANT_HEADER), t, F.lit(eos),
                                              F.when(last, F.lit("")).otherwise(F.lit("\n"))))
             .otherwise(F.lit("")))
    if add_generation_prompt:
        piece = F.concat(piece, F.when(last, F.lit(ASSISTANT_HEADER)).otherwise(F.lit("")))
    return x.select(conv, turn, piece.alias("piece"))


def turn_pairs(turns: DataFrame, *, first_role: str = "user", second_role: str = "assistant",
               conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """Adjacent (first_role -> second_role) turn pairs: ``conv, turn, text1, text2``; turn numbers may have gaps.

    A lead in buckets: the window runs over ``bucket_turns`` turn numbers of a conversation, so no conversation, however
    long, is gathered into one task. The first and last turn of each bucket, two rows at most, meet the neighbouring
    bucket's in a second window.
    """
    first, second = F.col("r") == first_role, F.col("r") == second_role
    x = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"),
                     F.when(F.col(role).isin(first_role, second_role), F.col(text)).alias("x"),
                     F.floor(F.col(turn) / bucket_turns).alias("b"))
    w = Window.partitionBy("c", "b").orderBy("t")
    after = F.lead(F.struct("r", "x"))
    x = x.select("*", after.over(w).alias("n"), F.lag("t").over(w).isNull().alias("opens"))
    inside = x.where(first & (F.col("n.r") == second_role)).select("c", "t", F.col("x").alias("text1"), F.col("n.x").alias("text2"))
    ends = x.where(F.col("n").isNull() | F.col("opens")).select(
        "c", "t", "b", "r", F.when((first & F.col("n").isNull()) | (second & F.col("opens")), F.col("x")).alias("x"))
    w = Window.partitionBy("c").orderBy("t")
    ends = ends.select("*", after.over(w).alias("n"), F.lead("b").over(w).alias("nb"))
    across = ends.where(first & (F.col("n.r") == second_role) & (F.col("b") != F.col("nb"))).select(
        "c", "t", F.col("x").alias("text1"), F.col("n.x").alias("text2"))
    return inside.unionByName(across).select(F.col("c").alias(conv), F.col("t").alias(turn), "text1", "text2")
