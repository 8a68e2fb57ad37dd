from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Digests straight from the rows."""
    out = {}
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[1],)) + (r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def result(df, **kw):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.chat_digests(C.format_chats(df, **kw)).collect()}


ODD = ["", None, "a", "<|im_end|>", "\\", "\\\\<|", "<\\|im_sep|>", "<", "|im_end|>\n", "x\ny", "é🎉", "<|im_start|>assistant ok", "$1 \\1"]
ROLES = ["user", "assistant", "system", None, "assi\nstant", "<|im_sep|>"]


@pytest.mark.parametrize("block", [2, 256])
def test_round_trip_of_odd_texts_ties_and_repeats(spark, block):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, 5, 600, None]), rng.choice(ROLES), rng.choice(ODD)) for _ in range(200)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(df, block=block) == brute(rows)


def test_adjacent_turns_of_a_role_share_one_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA)
    assert C.format_chats(df).first().formatted == "<|im_start|>user<|im_sep|>a<|im_sep|>b<|im_end|>\n<|im_start|>assistant<|im_sep|>c<|im_end|>\n"


def test_runs_of_turns_merge_across_blocks_as_within(spark):
    rows = [(1, i, "user" if i // 7 % 2 else "assistant", str(i)) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert C.format_chats(df, block=4).first() == C.format_chats(df, block=1000).first()


def test_long_text_extra_columns_and_empty_table(spark):
    rows = [(1, 0, "assistant", "<|" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    assert result(df) == brute(rows)
    assert C.chat_digests(C.format_chats(df.where("false"))).count() == 0
