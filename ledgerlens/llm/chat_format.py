"""Chat formatting as a relational job.

The turns of a conversation are collected as structs, sorted, adjacent turns of
one role are merged with array aggregation and the text is concatenated, all in
Spark expressions. The output is one string per conversation::

    <|im_start|>ROLE<|im_sep|>TEXT<|im_sep|>TEXT<|im_end|>\\n<|im_start|>...

A block holds adjacent turns of one role; ``<|im_sep|>`` stands between the role
and each of its texts, so merged turns can be told apart when read back.

Escaping, reversible: inside roles and texts ``\\`` becomes ``\\\\`` and then
``<|`` becomes ``<\\|``. No escaped text contains ``<|``, so control strings stand
only where the template put them; ``\\x`` reads back as ``x``.

Defined cases: a null role or text counts as empty; turns sort by (turn, role,
text) with nulls first, so ties and repeated rows have one order and each row
stays a turn of its own; a null conv_id is one conversation of its own; other
columns are ignored; an empty table gives an empty result.

Scale: turns are first collected by (conv_id, run of ``BLOCK`` turn numbers),
sorted there, and only the sorted runs meet per conversation, so one long
conversation is spread over many tasks. Its formatted string is one value of one
row, which is the result asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCK = 256


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _merge(acc: Column, x: Column) -> Column:
    """Append a run to the collected ones; where the run's first block goes on with the last role, join the two."""
    last, first = F.element_at(acc, -1), F.element_at(x, 1)
    joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
    return F.when(F.size(acc) == 0, x).when(
        last["role"] == first["role"],
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined), F.slice(x, F.lit(2), F.size(x))),
    ).otherwise(F.concat(acc, x))


def _blocks(turns: Column) -> Column:
    """Sorted turns (array of struct(turn, role, text)) -> array of struct(role, texts), one per role run.

    A block begins where the role changes; block k holds the turns from its begin to the next one's.
    """
    n = F.size(turns)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n + 1))
    return F.zip_with(begins, ends, lambda b, e: F.struct(
        F.element_at(turns, b)["role"].alias("role"),
        F.transform(F.slice(turns, b, e - b), lambda t: t["text"]).alias("texts")))


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, formatted)."""
    rows = conversations.select(
        "conv_id", F.floor(F.col("turn") / block).alias("run"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    runs = rows.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("t")).alias("turns")) \
               .select("conv_id", F.struct("run", _blocks(F.col("turns")).alias("blocks")).alias("r"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("runs"))
    # one run (nearly every conversation) needs no merge across runs
    blocks = F.when(F.size("runs") == 1, F.element_at("runs", 1)["blocks"]).otherwise(
        F.aggregate(F.transform("runs", lambda r: r["blocks"]), F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), _merge))
    text = F.array_join(F.transform(blocks, lambda b: F.concat(
        F.lit(START), escape(b["role"]), F.lit(SEP), F.array_join(F.transform(b["texts"], escape), SEP), F.lit(END + "\n"))), "")
    return whole.select("conv_id", text.alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted) -> (conv_id, turns), turns an array of struct(role, text) in order."""
    def block(b: Column) -> Column:
        parts = F.split(F.regexp_replace(b, r"<\|im_end\|>\n$", ""), r"<\|im_sep\|>", -1)
        role = unescape(F.element_at(parts, 1))
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    return formatted.select("*", F.flatten(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), block)).alias("turns"))


def chat_digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """What the formatted text says, read back from it: counts and digests per conversation.

    The loss mask covers the texts of ``loss_role``, not the template around them.
    """
    turns = F.col("turns")
    all_text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    return read_chats(formatted).select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
