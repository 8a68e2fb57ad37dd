"""Interval (band) joins: equi key plus ``right.ts BETWEEN left.ts AND left.ts + horizon``.

``interval_join`` forms every qualifying pair (time-bucketed so a hot key is
split by time); ``nearest_preceding_pairs`` keeps only each right row's k best
partners without forming all pairs, which is what a top-k question needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.functions.calendar import epoch_second


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                  horizon_seconds: int = 24 * 3600, bucketed: bool = True) -> DataFrame:
    """All (left, right) pairs with equal ``key`` and ``left_ts <= right_ts <= left_ts + horizon``.

    Bucketed form: time is cut into buckets of one horizon. A right row lives
    in exactly one bucket; a left row can only match rights in its own bucket
    or the next one, so it is emitted into both. The equi join on
    (key, bucket) then spreads a hot key over its time buckets instead of one
    task, and every pair is produced exactly once. The exact BETWEEN (both
    ends inclusive) is applied after the join. ``left_ts``/``right_ts`` must
    be TIMESTAMP_NTZ; columns of the two sides must not clash except ``key``.
    """
    l_sec, r_sec = epoch_second(left_ts), epoch_second(right_ts)
    cond_between = F.col(right_ts).between(F.col(left_ts),
                                           F.col(left_ts) + F.make_dt_interval(secs=F.lit(horizon_seconds)))
    if not bucketed:
        return left.join(right, key).where(cond_between)
    h = F.lit(horizon_seconds)
    lb = left.withColumn("_bucket", F.explode(F.array(F.floor(l_sec / h), F.floor(l_sec / h) + 1)))
    rb = right.withColumn("_bucket", F.floor(r_sec / h))
    return lb.join(rb, [key, "_bucket"]).where(cond_between).drop("_bucket")


def nearest_preceding_pairs(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, k: int,
                            horizon_seconds: int = 24 * 3600, left_tie: str | None = None) -> DataFrame:
    """For every right row, its (at most) ``k`` best left partners: same ``key``,
    ``left_ts <= right_ts <= left_ts + horizon``, most recent ``left_ts`` first
    (then smaller ``left_tie``).

    Exact for a top-k' query (k' <= k) whose order, among the pairs of one right row, is
    this candidate order: latest ``left_ts`` first, then ``left_tie`` ascending. A pair in the global top k'
    is then among the first k pairs of its own right row. Never forms all pairs of a
    key, so a hot key costs O(k) per right row and nothing is quadratic:

    1. order both sides of a key by time (left before right, then larger tie first) and
       number the left rows; the number of the latest left row at or before a right row
       is that row's count ``c``. The numbering is a window inside (key, time bucket) plus a prefix
       sum over the key's buckets, so a hot key is spread over its buckets;
    2. its candidates are the left rows numbered (c - k, c]: at most two blocks of k
       consecutive left rows, so an equi join on (key, block) meets <= 2k left
       rows per right row (a block holds k left rows, so no key is hot on the
       left side; many right rows on one block are a skewed key AQE splits);
    3. the exact key and time conditions filter the candidates.

    Nothing is sampled, collected or stored: the result is one lazy plan. Left rows without any
    right row in their bucket or the next are dropped first by a semi join; that keeps every
    right row's best partners at the end of its candidate run.
    """
    h = F.lit(horizon_seconds)
    right_buckets = (right.select(F.col(key), F.floor(epoch_second(right_ts) / h).alias("_b"))
                          .select(F.col(key), F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"))
                          .distinct())
    left = (left.withColumn("_b", F.floor(epoch_second(left_ts) / h))
                .join(right_buckets, [key, "_b"], "left_semi").drop("_b"))

    tie_type = left.schema[left_tie].dataType if left_tie else "int"
    lrows = left.select(*[F.col(c) for c in left.columns], F.lit(0).alias("_kind"), F.col(left_ts).alias("_t"),
                        (F.col(left_tie) if left_tie else F.lit(None).cast("int")).alias("_tie"))
    rrows = right.where(F.col(key).isNotNull()).select(*[F.col(c) for c in right.columns], F.lit(1).alias("_kind"), F.col(right_ts).alias("_t"),
                                                       F.lit(None).cast(tie_type).alias("_tie"))
    both = (lrows.unionByName(rrows, allowMissingColumns=True)
                 .withColumn("_bucket", F.floor(epoch_second("_t") / h)).withColumn("_is_left", F.when(F.col("_kind") == 0, 1).otherwise(0)))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (both.groupBy(key, "_bucket").agg(F.sum("_is_left").alias("_in_bucket"))
                   .select(key, "_bucket", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_offset")))
    # rows of one time and kind share their place but for the tie; the rest of the order is of no consequence
    running = F.sum("_is_left").over(Window.partitionBy(key, "_bucket").orderBy("_t", "_kind", F.col("_tie").desc())
                                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = both.withColumn("_run", running).join(offsets, [key, "_bucket"]).withColumn("_n", F.col("_offset") + F.col("_run"))
    lk = (counted.where(F.col("_kind") == 0)
                 .select(*left.columns, F.col("_n").alias("_s"))
                 .withColumn("_block", F.floor((F.col("_s") - 1) / k)))
    rk = (counted.where((F.col("_kind") == 1) & (F.col("_n") > 0))
                 .select(*right.columns, F.col("_n").alias("_c")))
    blocks = F.array(F.floor(F.greatest(F.col("_c") - k, F.lit(0)) / k), F.floor((F.col("_c") - 1) / k))
    rk = rk.withColumn("_block", F.explode(F.array_distinct(blocks)))
    cond_between = F.col(right_ts).between(F.col(left_ts),
                                           F.col(left_ts) + F.make_dt_interval(secs=F.lit(horizon_seconds)))
    return (lk.join(rk, [key, "_block"])
              .where((F.col("_s") > F.col("_c") - k) & (F.col("_s") <= F.col("_c")) & cond_between)
              .drop("_block", "_s", "_c"))
