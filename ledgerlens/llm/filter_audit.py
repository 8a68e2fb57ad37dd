"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

1. Masks: every document gets a bit per filter that it fails. Conditions on the text are Spark expressions; the
   condition on copies (a smaller doc_id has an identical text, anywhere in the table) compares narrow rows
   (SHA-256 of the whole text) with the least doc_id of their digest.
2. Cells: documents of one part (language) and mask are counted, with those labelled good and toxic. A part has at
   most 2^n cells, combined map-side, however many documents it holds.
3. Walk: the 2^n subsets of filters are visited in Gray-code order, one filter toggled at a time. Each cell keeps the
   number of active filters that it fails; where that leaves or reaches 0 the cell joins or leaves the
   running survivors. The survivors of all 2^n subsets are stored; a step of any order is the difference of two of them.

Defined cases: a null text counts as empty (no words: A holds, B, C and D do not); a null language and an empty one are the
part ''; copies are told by doc_ids alone, so rows repeated with one doc_id are no copies of each other, and a
null doc_id neither is nor has a smaller one; a document is good (toxic) if any of its label rows has quality (toxic) 1;
labels with a null doc_id are ignored; without labels nothing is lost; an empty table gives an empty result; other
columns are ignored.

Scale: texts are read once and never shuffled; narrow rows are checkpointed. A digest or a doc_id that holds a third of
all rows meets its group by :func:`common.attach`. What runs in Python is one row of at most 2^n cells per part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import WORD_PATTERN, attach, checkpointed

# fixed values of the contract
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_UPPER_PERCENT = 10
MARKS = "[#$%&*|]"

# name: condition on (text, words) under which a document fails
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < LEAST_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_UPPER_PERCENT * F.length(text),
    "D": lambda text, words: text.rlike(MARKS),
}
COPIES = "E"

COUNTS = ("n", "good", "toxic")
# parts whose orders are written out at once
PARTS = 16


def _bits(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)], F.lit(0))


def failure_masks(docs: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """docs(doc_id, text, lang) -> checkpointed rows (doc_id, part, mask): bit i for the i-th filter, the next one for copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"),
                       F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    own = _bits([fails(F.col("text"), F.col("words")) for fails in filters.values()])
    rows = checkpointed(rows.select("doc_id", "part", own.alias("own"), F.sha2("text", 256).alias("digest")))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << len(filters)).otherwise(0)
    return checkpointed(attach(rows, groups, "digest", "size").select("doc_id", "part", (F.col("own") + copy).alias("mask")))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Checkpointed (doc_id, part, mask) and labels -> (part, mask, n, good, toxic)."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(c)
    truth = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality"), said("toxic")).where("quality + toxic > 0")
    # documents per label, so that a doc_id with many rows is served as a hot one
    sizes = masks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    known = truth.join(sizes, "doc_id").select("doc_id", "size", F.col("quality").alias("good"), "toxic")
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return attach(masks, known, "doc_id", "size").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """counts[part, mask, what] -> the same for what survives each subset of active filters, by a Gray-code walk."""
    size = counts.shape[1]
    cell = np.arange(size)
    failing, alive = np.zeros(size, dtype=np.int64), counts.sum(axis=1)
    states, active = np.empty_like(counts), 0
    states[:, 0] = alive
    for turn in range(1, size):
        toggled = turn & -turn
        active ^= toggled
        touched = cell[cell & toggled > 0]
        if active & toggled:
            alive = alive - counts[:, touched[failing[touched] == 0]].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            alive = alive + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        states[:, active] = alive
    return states


def order_steps(parts: list[str], counts: np.ndarray, names: str) -> pd.DataFrame:
    """All orders of the filters for each part: one row per part, order and step."""
    states, cell = survivors(counts), np.arange(counts.shape[1])
    orders = ["".join(o) for o in permutations(names)]
    bit = {x: 1 << i for i, x in enumerate(names)}
    steps = [(o, i + 1, sum(bit[x] for x in o[:i]), bit[x]) for o in orders for i, x in enumerate(o)]
    before, own = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    lost = states[:, before] - states[:, before | own]
    removed = lost[:, :, 0]
    # by filter: documents that fail it, that fail nothing else, and what it removes over all orders
    fails = {b: counts[:, cell & b > 0, 0].sum(axis=1) for b in bit.values()}
    gone = {b: removed[:, own == b].sum(axis=1) for b in bit.values()}
    per = lambda of: np.stack([of[b] for b in own.tolist()], axis=1)
    table = {"kept": states[:, before | own, 0], "removed": removed, "redundant": per(fails) - removed, "unique_fails": counts[:, own, 0],
             "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": per(gone)}
    return pd.DataFrame({"part": np.repeat(np.array(parts, dtype=object), len(steps)), "filter_order": [s[0] for s in steps] * len(parts),
                         "step": np.tile(np.array([s[1] for s in steps], dtype=np.int32), len(parts)),
                         **{k: v.reshape(-1).astype(np.int64) for k, v in table.items()}})


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, copies: str = COPIES) -> DataFrame:
    """One row per part, order of all filters (``copies`` last in the masks) and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (sums over all orders).
    Filters are named by one character each; n of them give n! orders, so n is small.
    """
    names = "".join(filters) + copies

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PARTS):
                rows = batch.iloc[at:at + PARTS]
                counts = np.zeros((len(rows), 1 << len(names), len(COUNTS)), dtype=np.int64)
                for i, found in enumerate(rows["cells"]):
                    for c in found:
                        counts[i, c["mask"]] = [c[x] for x in COUNTS]
                yield order_steps(rows["part"].tolist(), counts, names)

    per_part = cells(failure_masks(docs, filters), labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return per_part.mapInPandas(walk, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
                                      "toxic_lost long, shapley long")
