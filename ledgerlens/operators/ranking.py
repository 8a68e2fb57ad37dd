"""Global NTILE / RANK without a single-partition window.

``Window.orderBy(...)`` with no partition key makes Spark move every row into one task. The forms here
never do; what they gather is bounded by a parameter or by the number of partitions.

* NTILE needs the last row of each tile but the last (the cuts). One aggregate over the table takes a uniform sample
  of at most about ``SAMPLE`` rows; the sample's quantiles, six standard errors to either side, bracket each cut. The next
  aggregate counts exactly how many rows stand before, at the borders of and inside each bracket and samples inside it only, so a bracket
  shrinks some sixteenfold a pass, until it holds no more rows than a sample, which then is complete. All orders and
  cuts share each pass. Brackets are proven by the counts and never by the sample: one that missed its cut is replaced
  by the side that the counts name. Nothing is sorted by Spark and nothing is written. A value that holds most rows does no
  harm, because rows are compared by the whole order.
* RANK: ties share a rank, so distinct ordering keys are counted first and stored once, range-partitioned. Rows per
  partition (one number each) give the offsets, which are joined as a bounded table; a window runs inside each partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ledgerlens.session import stored

# rows that a pass brings to the driver per bracket, give or take the sample's spread; 100 at least, or brackets would not shrink
SAMPLE = 10_000

Order = Sequence[tuple[str, bool]]


def _sort(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def _stands(order: Order, values: Sequence[Column], equal: bool) -> Column:
    """Whether a row stands before the row of ``values`` in ``order``, or (``equal``) at its place.

    ``order``: (column, descending) pairs. As in Spark's sort, nulls come first ascending and last descending.
    """
    result = F.lit(equal)
    for (name, descending), value in reversed(list(zip(order, values))):
        col = F.col(name)
        smaller, larger = (value, col) if descending else (col, value)
        first = (smaller.isNull() & larger.isNotNull()) | F.coalesce(smaller < larger, F.lit(False))
        result = first | (col.eqNullSafe(value) & result)
    return result


def _sorted(rows: Sequence[Row], order: Order) -> list[Row]:
    """Rows on the driver in ``order``, as Spark sorts them (NaN is the greatest number)."""
    out = list(rows)
    for name, descending in reversed(order):
        out.sort(key=lambda r: (r[name] is not None, r[name] != r[name], r[name]), reverse=descending) if any(r[name] is None or r[name] != r[name] for r in out) \
            else out.sort(key=lambda r: r[name], reverse=descending)
    return out


@dataclass
class _Cut:
    """A wanted row, and the open bracket (low, high) of keys that it is looked for in, borders included (None: no border)."""
    order: Order
    position: int                  # 1-based
    total: int
    rows: int                      # expected between the borders
    low: Row | None = None
    high: Row | None = None
    found: Row | None = None

    def view(self) -> tuple:
        """Cuts with equal brackets share their counts and sample; without borders the order does not matter."""
        return (None, None, None) if self.low is None and self.high is None else (tuple(self.order), self.low, self.high)

    def take(self, before: int, at_low: int, inside: int, at_high: int, sample: Sequence[Row], complete: bool) -> None:
        """Use a pass's exact counts (before the bracket, at its borders, inside) and its sample of the inside: find the row, or narrow the bracket."""
        past_low, past_inside = before + at_low, before + at_low + inside
        if self.position <= before:
            self.low, self.high, self.rows = None, self.low, before
        elif self.position <= past_low:
            self.found = self.low
        elif self.position > past_inside + at_high:
            self.low, self.high, self.rows = self.high, None, self.total - past_inside - at_high
        elif self.position > past_inside:
            self.found = self.high
        elif complete:
            self.found = _sorted(sample, self.order)[self.position - past_low - 1]
        else:
            ranked, m = _sorted(sample, self.order), len(sample)
            at, slack = (self.position - past_low) / inside * m, 3 * sqrt(m) + 1
            low, high = floor(at - slack), ceil(at + slack)
            if low >= 0:
                self.low = ranked[low]
            if high < m:
                self.high = ranked[high]
            self.rows = max(1, ceil(inside * (min(high, m) - max(low, 0)) / max(m, 1)))


def cut_rows(df: DataFrame, orders: Mapping[str, Order], n: int, rows: int | None = None, sample: int = SAMPLE) -> dict[str, list[dict | None]]:
    """For each order the last row of each of the first ``n - 1`` of ``n`` tiles (None: the tile and those before are empty).

    The first ``rows % n`` tiles hold one row more than the others. An order must be total up to identical rows. ``df`` is read
    once per pass, so it should be stored; ``rows`` is its number of rows, if known.
    """
    names = list(dict.fromkeys(c for order in orders.values() for c, _ in order))
    narrow = df.select(*names)
    types = {f.name: f.dataType for f in narrow.schema.fields}
    total = narrow.count() if rows is None else rows
    cuts = {name: [_Cut(order, total // n * t + min(t, total % n), total, total) for t in range(1, n)] for name, order in orders.items()}
    every = [c for own in cuts.values() for c in own]
    while open_ := [c for c in every if c.position > 0 and c.found is None]:
        views: dict[tuple, list[_Cut]] = {}
        for c in open_:
            views.setdefault(c.view(), []).append(c)
        aggregates, shares = [], []
        for i, own in enumerate(views.values()):
            def against(border: Row | None, equal: bool, without: bool, order: Order = own[0].order) -> Column:
                return F.lit(without) if border is None else _stands(order, [F.lit(border[c]).cast(types[c]) for c, _ in order], equal)

            low, high = own[0].low, own[0].high
            past_low, up_to_high = ~against(low, True, False), against(high, False, True)
            inside = past_low & up_to_high
            shares.append(min(1.0, sample / max(1, own[0].rows)))
            drawn = inside if shares[-1] == 1 else inside & (F.col("_u") < shares[-1])
            counts = {"before": against(low, False, False), "at_low": against(low, True, False) & ~against(low, False, False), "inside": inside,
                      "at_high": against(high, True, False) & ~against(high, False, False)}
            aggregates += [*(F.count_if(c).alias(f"{name}{i}") for name, c in counts.items()), F.collect_list(F.when(drawn, F.struct(*names))).alias(f"sample{i}")]
        found = narrow.withColumn("_u", F.rand()).agg(*aggregates).first()
        for i, own in enumerate(views.values()):
            for c in own:
                c.take(*[found[f"{name}{i}"] for name in ("before", "at_low", "inside", "at_high", "sample")], complete=shares[i] == 1)
    return {name: [None if c.found is None else c.found.asDict() for c in own] for name, own in cuts.items()}


def tile(df: DataFrame, order: Order, cuts: Sequence[dict | None]) -> Column:
    """The 1-based tile of a row of ``df`` from the tiles' cut rows."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def after(cut: dict | None) -> Column:
        if cut is None:
            return F.lit(1)
        return F.when(_stands(order, [F.lit(cut[c]).cast(types[c]) for c, _ in order], True), 0).otherwise(1)
    return reduce(lambda a, b: a + b, [after(c) for c in cuts], F.lit(1)).cast("int")


def with_tiles(df: DataFrame, n: int, orders: Mapping[str, Order], sample: int = SAMPLE) -> DataFrame:
    """``NTILE(n) OVER (ORDER BY order) AS name`` for each name and order; an order is total (append a unique key).

    ``df`` is evaluated once and stored in the checkpoint folder; passes and result read it there.
    """
    kept, rows = stored(df)
    cuts = cut_rows(kept, orders, n, rows, sample)
    return kept.withColumns({name: tile(kept, order, cuts[name]) for name, order in orders.items()})


def global_ntile(df: DataFrame, n: int, order: Order, name: str) -> DataFrame:
    """``NTILE(n) OVER (ORDER BY order)``; ``order``: (column, descending) pairs, total (append a unique key)."""
    return with_tiles(df, n, {name: order})


def global_rank(df: DataFrame, order: Order, name: str) -> DataFrame:
    """``RANK() OVER (ORDER BY order)``: 1 + number of rows strictly before.

    ``df`` is evaluated once and stored, and so are its distinct ordering keys with their counts and range partitions
    (range bounds are sampled, so a second evaluation could deal them otherwise).
    """
    keys, by = [c for c, _ in order], [_sort(*o) for o in order]
    kept, _ = stored(df)
    counted = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed, _ = stored(counted.repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()))
    # one row per partition
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_pid").agg(F.sum("_n").alias("_sum"))
                     .select(F.col("_pid").alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_pid").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (placed.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), F.col("_pid") == F.col("_part"))
                   .select(*[F.col(c).alias(f"_k_{c}") for c in keys], (F.col("_before") + F.col("_inside") + 1).cast("int").alias(name)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return kept.join(ranks, same).drop(*[f"_k_{c}" for c in keys])
