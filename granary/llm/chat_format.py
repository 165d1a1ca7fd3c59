"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its own text is
trainable. A conversation whose last turn is no assistant's gets one more, final example without a trainable
part, so that no turn is lost. `read_back` undoes the template.

A turn is written `<s>[INST]role[/INST]text</s>`. Where a text (or role) itself contains one of these four
control strings, with any number of backslashes behind its first character, one backslash more goes there;
reading takes one away. So no control string occurs inside a text, and every text comes back unchanged.

Defined results: null role and text are empty; equal turn numbers are ordered by role, then text; a null
conv_id is a conversation; an empty table gives an empty one; columns beyond the four named are left out.
A conversation's turns are one row's array: an example is one row, so its context fits a row anyway. `context`
is shared by construction: example k is the first `formatted_chars` code points of the final one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<(?=\\+/?s>)|\[(?=\\+/?INST\]))\\", "$1")


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), n_turns, text, loss_start (code points before the trainable part), loss_length, final."""
    named = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("x"))
    conv = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    parts = F.transform("x", lambda x: F.struct((x["role"] == "assistant").alias("target"), F.concat(F.lit("<s>[INST]"), escape(x["role"]), F.lit("[/INST]")).alias("head"), escape(x["text"]).alias("body")))
    conv = conv.select("conv_id", parts.alias("p"))
    conv = conv.withColumn("whole", F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))))
    ends = F.filter(F.sequence(F.lit(1), F.size("p")), lambda k: (k == F.size("p")) | F.get("p", k - 1)["target"])
    out = conv.select("conv_id", "p", "whole", F.posexplode(ends).alias("example", "n_turns"))
    last = F.get("p", F.col("n_turns") - 1)
    out = out.select(
        "conv_id", "example", "n_turns", F.array_join(F.slice("whole", 1, F.col("n_turns")), "").alias("text"),
        F.when(last["target"], F.length(last["body"])).alias("loss_length"), (F.col("n_turns") == F.size("p")).alias("final"),
    )
    start = F.length("text") - F.length(F.lit("</s>")) - F.col("loss_length")
    return out.select("conv_id", "example", "n_turns", "text", start.alias("loss_start"), "loss_length", "final")


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.split(text, "</s>")
    turn = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.struct(unescape(F.regexp_extract(x, turn, 1)).alias("role"), unescape(F.regexp_extract(x, turn, 2)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: number and digest of its turns, and of all trainable text."""
    seen = formatted.select(
        "conv_id", "example", F.length("text").alias("n"), F.when(F.col("final"), F.col("text")).alias("whole"),
        F.when(F.col("loss_length").isNotNull(), F.struct("example", unescape(F.expr("substring(text, loss_start + 1, loss_length)")).alias("text"))).alias("loss"),
    )
    conv = seen.groupBy("conv_id").agg(F.sum("n").alias("formatted_chars"), F.array_join(F.collect_list("whole"), "").alias("whole"), F.sort_array(F.collect_list("loss")).alias("loss"))
    conv = conv.select("conv_id", "formatted_chars", read_back(F.col("whole")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"))
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
