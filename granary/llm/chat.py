"""Chat formatting: each assistant turn becomes an example of its own, with all preceding turns as context.

A turn is laid out as ``<s>[INST]role[/INST]text</s>``. These four control strings mark turns and nothing else: where one
stands inside a role or text, a backslash goes behind its first character (one more where some already stand there), which
`unescape` takes back exactly. An example is a prefix of its conversation's layout, up to and with one assistant text and its
``</s>``; only that text is trainable.

Cases: a null role or text counts as empty; empty texts make empty turns; turns of equal number are ordered by role, then
text; rows that repeat are kept as turns; a null conv_id is a conversation like others; a conversation without assistant
turns has a layout and no example; an empty table gives none; further columns of the input are ignored. One conversation is
one text, so its turns meet in one row: memory follows the longest conversation, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let

#: The template. Every control string begins with < or [, and `ESCAPABLE` finds each, escaped to any depth.
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
ESCAPABLE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
TURN = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and targets: for each assistant turn its number among the turns from 0,
    where its text starts (characters from 0), the text's escaped length, and the length of the example."""
    row = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def laid_out(r: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(r["role"]), F.lit(ROLE_END))
        return F.struct(r["role"].alias("role"), head.alias("head"), escape(r["text"]).alias("body"))

    def spans(parts: Column) -> Column:
        """Adds up lengths: for each turn, where its text starts and where the turn ends."""
        step = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn:int,start:int,length:int,until:int>>").alias("out")),
            lambda s, p: let(
                s["at"] + F.length(p["head"]),
                lambda start: F.struct(
                    (start + F.length(p["body"]) + len(CLOSE)).alias("at"),
                    F.concat(
                        s["out"],
                        F.array(
                            F.struct(
                                F.size(s["out"]).alias("turn"),
                                start.alias("start"),
                                F.length(p["body"]).alias("length"),
                                (start + F.length(p["body"]) + len(CLOSE)).alias("until"),
                            )
                        ),
                    ).alias("out"),
                ),
            ),
        )
        return step["out"]

    made = whole.select("conv_id", F.transform("rows", laid_out).alias("parts")).select(
        "conv_id",
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))).alias("formatted"),
        let(
            spans(F.col("parts")),
            lambda all_: F.filter(all_, lambda s: F.col("parts")[s["turn"]]["role"] == "assistant"),
        ).alias("targets"),
    )
    return made


def expand_targets(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn of `format_conversations`: conv_id, turn, example (the context and the reply, formatted),
    loss_start and loss_length (the span of the example that is trainable; code points)."""
    return conversations.select("conv_id", "formatted", F.explode("targets").alias("t")).select(
        "conv_id",
        F.col("t.turn").alias("turn"),
        F.substring("formatted", F.lit(1), F.col("t.until")).alias("example"),
        F.col("t.start").alias("loss_start"),
        F.col("t.length").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a layout holds, as an array of (role, text)."""
    get = lambda group: F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(group)), unescape)
    return F.transform(F.arrays_zip(get(1).alias("role"), get(2).alias("text")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


def read_loss(examples: DataFrame) -> Column:
    """The trainable text of an example, as it was."""
    return unescape(F.substring(F.col("example"), F.col("loss_start") + 1, F.col("loss_length")))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars
    (of all its examples together), further layout_chars (of its layout) and n_examples."""
    laid = format_conversations(turns)
    back = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    of_conversation = laid.select(
        F.col("conv_id"),
        back.alias("lines"),
        F.length("formatted").cast("long").alias("layout_chars"),
        F.lit(None).cast("string").alias("reply"),
        F.lit(None).cast("int").alias("turn"),
        F.lit(None).cast("long").alias("chars"),
    ).select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", "lines"), 256).alias("turns_sha256"), "layout_chars", "turn", "reply", "chars")
    examples = expand_targets(laid)
    of_example = examples.select(
        "conv_id",
        F.lit(None).cast("long").alias("n_turns"),
        F.lit(None).cast("string").alias("turns_sha256"),
        F.lit(None).cast("long").alias("layout_chars"),
        "turn",
        read_loss(examples).alias("reply"),
        F.length("example").cast("long").alias("chars"),
    )
    both = of_conversation.unionByName(of_example).groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.max("layout_chars").alias("layout_chars"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("formatted_chars"),
        F.count("turn").alias("n_examples"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", "reply")))), lambda x: x["reply"])).alias("loss"),
    )
    return both.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "layout_chars", "n_examples",
    )
