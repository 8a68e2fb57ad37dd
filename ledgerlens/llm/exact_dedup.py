"""Exact dedup by skew-safe combining.

Three stages, each grouping by (digest, whole text), so contents are compared in
full at every one of them and a digest never decides alone:

1. locally: Spark's partial aggregation inside each input task;
2. salted: the local winners of a text meet in at most ``salts`` groups. The salt
   is the input partition's number, so a task's copies keep one salt and a text
   that fills a third of the table costs one row per task, spread over the salts;
3. globally: at most ``salts`` rows per text are combined.

Of equal texts the row with the largest doc_id stays.

Defined cases: a null text counts as empty; a null doc_id is smaller than any
other and stays only if the group has no other; rows repeated with the same
doc_id and text are one group, and every one of them is reported as ``kept`` in
:func:`membership` when it carries the largest doc_id, while
:func:`deduplicated` keeps exactly one row (the greatest by its other columns);
an empty table gives an empty result; other columns, whatever their names, are
carried by :func:`deduplicated` (they must be orderable, so not maps) and ignored by :func:`membership`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import attach, checkpointed

SALTS = 16
# Groups of copies that meet their rows by broadcast, the largest first (see common.attach).
HOT_GROUPS = 1000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combine(rows: DataFrame, best: Callable[[str], Column], salts: int) -> DataFrame:
    """rows(digest, text, best) -> one row per distinct text: (digest, text, best, n)."""
    salted = (rows.withColumn("salt", F.spark_partition_id() % salts)
                  .groupBy("salt", "digest", "text").agg(best("best").alias("best"), F.count(F.lit(1)).alias("n")))
    return salted.groupBy("digest", "text").agg(best("best").alias("best"), F.sum("n").alias("n"))


def membership(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS,
               hot_groups: int = HOT_GROUPS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The classes of two or more copies (digest, winner, size) are narrow and checkpointed; a row
    whose digest has none is its own class. If two different texts ever share a digest, the rows
    of those digests are grouped and joined by text instead, so the result holds for any digest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), digest(text).cast("string").alias("digest"))
    per_text = _combine(keyed.select("digest", "text", F.col("doc_id").alias("best")), F.max, salts)
    shared = checkpointed(per_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
                                  .where("texts > 1 OR group_size > 1"))
    narrow = docs.select("doc_id", digest(text).cast("string").alias("digest"), F.sha2(text, 256).alias("text_sha256"))
    groups = shared.where("texts = 1").select("digest", "keep_id", "group_size")
    clashing = shared.where("texts > 1").select("digest")
    if not clashing.isEmpty():
        clash = keyed.join(clashing, "digest", "left_semi").select("doc_id", "text", "digest", F.sha2("text", 256).alias("text_sha256"))
        own = _combine(clash.select("digest", "text", F.col("doc_id").alias("best")), F.max, salts) \
            .select("digest", "text", F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
        clash = clash.join(own, ["digest", "text"]).select("doc_id", "keep_id", "group_size", "text_sha256")
        narrow = narrow.join(clashing, "digest", "left_anti")
    else:
        clash = None
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = attach(narrow, groups, "digest", "group_size", hot_groups).select("doc_id", keep.alias("keep_id"), size.alias("group_size"), "text_sha256")
    if clash is not None:
        out = out.unionByName(clash)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all columns as they came.

    A null text and an empty one are equal; the one with the larger doc_id stays as it is.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    was_null = F.col("text").isNull().alias("was_null")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct("doc_id", was_null, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = docs.select(digest(text).cast("string").alias("digest"), text.alias("text"), row.alias("best"))
    won = _combine(rows, F.max, salts)
    at = {c: F.col("best")[f"c{i}"] for i, c in enumerate(others)}
    at |= {"doc_id": F.col("best")["doc_id"], "text": F.when(~F.col("best")["was_null"], F.col("text"))}
    return won.select(*[at[c].alias(c) for c in docs.columns])
