"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes: words per document, summed per source. Sources in code-point order
   (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target
   stops at twice its source's words and the excess is reshared by weight.
2. Line: a source's rows are shuffled (by md5 of seed, doc_id, source, md5 of the text and the copy's number among rows equal
   in these) and laid end to end; the line is cut into blocks of ``block`` words, the last one shorter.
3. Schedule: slot n gets the golden-ratio point frac(n * phi) as an integer of 31
   bits; the point falls into one source's interval of the cumulative targets. Any
   stretch of the schedule so holds each source near its share.
4. Slots are ranked per source; rank r takes block r mod (blocks of the source), so
   a second pass begins only when the first is complete. A source's slots end at its
   target, the last one short by the rest.
5. Blocks are joined with the documents that overlap them; a document takes the
   overlap once for each use of the block.

Everything is DataFrame code in the JVM. Defined cases: a null text has size 0; a
null source is a source of its own, last in order; rows equal in doc_id, source and text are
interchangeable and each has a place of its own; null doc_ids shuffle
by their texts; no words at all give targets 0; an empty table gives an empty
result; other columns are ignored by :func:`mix` and carried by :func:`mixed_rows`.

Scale: the prefix sums over a source (and the slot ranks) are taken in two levels,
inside hash ranges and over their sums, so a source with a third of all rows is
spread over ``CELLS`` tasks, whatever repeats in it: null or repeated doc_ids differ by their texts, identical rows by
their numbers, which are counted per input task and summed over the tasks. Slots meet sources by an equi join on a grid of points,
never by a range join. Only the table of sources (one row per source, pre-aggregated
map-side) runs through windows as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import checkpointed, word_count

# fixed values of the mix
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_PASSES = 2

BLOCK = 4096
CELLS = 4096
GRID = 1024
STRETCH = 65536
BITS = 31
# the odd integer next to 2^31 / golden ratio: n * PHI mod 2^31 visits every point once in 2^31 slots
PHI = 1327217885


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, size) -> (source, source_size, target, quota); quota: the target in whole words."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int")).cast("long")
    per = per.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    # Water filling: in order of cap / weight, sources are full until one is not; that one fixes the level for the rest.
    cap = F.col("source_size") * MOST_PASSES
    order = Window.orderBy(cap / F.col("weight"), "nth")
    ahead, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * SHARE_PERCENT / 100 - F.coalesce(F.sum(cap).over(ahead), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    per = per.select("source", "source_size", "weight", cap.cast("double").alias("cap"), F.row_number().over(order).alias("at"), left.alias("left"), heavy.alias("heavy"))
    not_full = F.col("cap") * F.col("heavy") > F.col("weight") * F.col("left")
    level = F.min(F.when(not_full, F.struct("at", (F.col("left") / F.col("heavy")).alias("level")))).over(every)
    per = per.withColumn("fix", level)
    target = F.when(F.col("fix").isNull() | (F.col("at") < F.col("fix")["at"]), F.col("cap")).otherwise(F.col("weight") * F.col("fix")["level"])
    return per.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("quota"))


def _prefix(rows: DataFrame, key: str, cell: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``key`` before this one in (cell, order)."""
    rows = rows.withColumn("v", value)
    ahead = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy(F.col(key).alias("k"), F.col(cell).alias("c")).agg(F.sum("v").alias("s"))
                .select("k", "c", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base")))
    inside = Window.partitionBy(key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("v").over(inside), F.lit(0)))
                .join(base, F.col(key).eqNullSafe(F.col("k")) & (F.col(cell) == F.col("c")))
                .withColumn(name, (F.col("base") + F.col("inside")).cast("long")).drop("v", "inside", "k", "c", "base"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """targets -> slots (slot, source, rank, block_no, words).

    As many points are drawn as there are slots to fill. A source's points beyond its target are passed
    over; the slots that the points did not reach (the sequence's discrepancy) follow after the
    others, with slot null.
    """
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    need = F.expr("quota div source_size") * blocks + F.expr(f"(quota % source_size + {block - 1}) div {block}")
    live = targets.where("quota > 0").select("source", "source_size", "quota", blocks.alias("blocks"), need.alias("need"))
    ahead = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("need").over(ahead), F.lit(0))
    total = F.sum("need").over(Window.partitionBy())
    at = lambda c: F.floor(c / F.col("total") * F.lit(2.0 ** BITS)).cast("long")
    live = live.withColumn("start", start).withColumn("total", total)
    cut = live.select("source", "need", at(F.col("start")).alias("lo"), at(F.col("start") + F.col("need")).alias("hi"))
    wide = 2 ** BITS // GRID
    cut = cut.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"greatest(lo, hi - 1) div {wide}"))))
    drawn = live.agg(F.coalesce(F.sum("need"), F.lit(0)).cast("long")).first()[0]
    points = targets.sparkSession.range(drawn).select(F.col("id").alias("slot"), (F.col("id") % (1 << BITS) * PHI % (1 << BITS)).alias("point"))
    met = (points.withColumn("cell", F.expr(f"point div {wide}")).join(cut, "cell").where("point >= lo AND point < hi")
                 .select("slot", "source", "need", F.expr(f"slot div {STRETCH}").alias("stretch")))
    ranked = _prefix(met, "source", "stretch", [F.col("slot")], F.lit(1), "rank").where("rank < need").select("slot", "source", "rank")
    have = met.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("have"))
    unmet = (live.join(have, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
                 .select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank")))
    slots = ranked.unionByName(unmet).join(live.select(F.col("source").alias("s"), "source_size", "quota", "blocks"), F.col("source").eqNullSafe(F.col("s")))
    lo = F.expr("rank % blocks") * block
    words = F.least(F.lit(block), F.col("source_size") - lo, F.col("quota") - F.expr("rank div blocks") * F.col("source_size") - lo)
    return slots.select("slot", "source", "rank", F.expr("rank % blocks").alias("block_no"), words.cast("long").alias("words"))


def _shuffled(sized: DataFrame, seed: int) -> DataFrame:
    """Adds key, the place of a row in its source's line, different for each row, and cell, a range of keys."""
    ident = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "h"))
    rows = sized.withColumn("ident", ident)
    twice = checkpointed(rows.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ident"))
    # copies are numbered inside the task that read them, after those of the tasks before
    copies = _prefix(rows.join(twice, "ident", "left_semi").withColumn("task", F.shiftright("at", 33)), "ident", "task", [F.col("at")], F.lit(1), "copy").drop("task")
    rows = rows.join(twice, "ident", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(copies)
    return (rows.withColumn("key", F.md5(F.concat_ws(":", "ident", F.col("copy").cast("string")))).drop("ident", "copy", "at")
                .withColumn("cell", F.expr(f"cast(conv(substr(key, 1, 4), 16, 10) as bigint) * {CELLS} div 65536")))


def _taken(sized: DataFrame, block: int, seed: int) -> DataFrame:
    """Checkpointed (doc_id, size, source, h, at) -> the same rows but for ``at`` with source_size, target, taken."""
    targets = checkpointed(source_targets(sized))
    slots = schedule(targets, block)
    line = _prefix(_shuffled(sized.where("size > 0"), seed), "source", "cell", [F.col("key")], F.col("size"), "begin").withColumn("end", F.col("begin") + F.col("size"))
    # one row per document and block that it overlaps; (source, begin) names a document's place
    parts = line.select("doc_id", "size", "source", "h", "begin", "end", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))).alias("part"))
    uses = slots.select(F.col("source").alias("s"), "block_no", "words")
    low, high = F.greatest(F.col("begin") - F.col("part") * block, F.lit(0)), F.least(F.col("end") - F.col("part") * block, F.coalesce("words", F.lit(0)))
    joined = parts.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("block_no")), "left")
    took = joined.groupBy("doc_id", "size", "source", "h", "begin").agg(F.sum(F.greatest(high - low, F.lit(0))).alias("taken")).drop("begin")
    rows = took.unionByName(sized.where("size = 0").drop("at").withColumn("taken", F.lit(0).cast("long")))
    # one row per source: Spark broadcasts it by size, or else splits a hot source's rows
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _identity(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), word_count(F.col("text")).alias("size"), F.col("source"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("h")]


def _sized(docs: DataFrame) -> DataFrame:
    """Narrow rows, stored with the number that the task which read them gave to each."""
    return checkpointed(docs.select(*_identity(docs), F.monotonically_increasing_id().alias("at")))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs(doc_id, text, source) -> per row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return _taken(_sized(docs), block, seed).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word; all of it but space at its end if it has no more."""
    space = r"[\x20\x09-\x0D]+"
    ahead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    parts = F.split(text, space, (n + ahead + 1).cast("int"))
    rest = F.when(F.size(parts) > n + ahead, F.length(F.element_at(parts, -1))).otherwise(0)
    return F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - rest), space + "$", "")


def mixed_rows(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each whole time that a document is taken.

    What is left of the words taken is one more row with the document's first words, and their length as
    ``n_chars`` if there is such a column; only a document in which its source's target ends has such a rest.
    Rows equal in doc_id, source and text are taken together, and the least of them by its other columns stands for
    them (the columns must be orderable). Texts cross the network once, to meet what was taken.
    """
    # nulls are left out of the JSON, so no value equals a null one; one key, so that texts are dealt out once
    key = lambda cols: F.to_json(F.struct(*cols))
    took = (_taken(_sized(docs), block, seed).where("taken > 0").groupBy(key(["doc_id", "size", "source", "h"]).alias("took_key"))
            .agg(F.sum("taken").alias("took"), F.max("size").alias("took_size")))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(key(_identity(docs)).alias("key"), whole.alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    out = rows.join(took, F.col("key") == F.col("took_key")).withColumns({"times": F.expr("took div took_size"), "rest": F.expr("took % took_size")})
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    at = {c: F.col("row")[f"c{i}"] for i, c in enumerate(docs.columns)}
    cut = F.col("nth") > F.col("times")
    at["text"] = F.when(cut, first_words(at["text"], F.col("rest"))).otherwise(at["text"])
    if "n_chars" in at:
        at["n_chars"] = F.when(cut, F.length(at["text"])).otherwise(at["n_chars"])
    return out.select(*[at[c].alias(c) for c in docs.columns])
