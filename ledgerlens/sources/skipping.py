"""Data skipping: a space-filling row order and Parquet bloom filters, so that a look-up reads few row groups.

Parquet keeps the least and largest value of every column per row group (and page), and a reader passes over those that cannot hold the value asked for.
That helps the column that the rows are sorted by. :func:`z_order` sorts by several at once: each column's values are cut into equally
full bins, and the bits of the bin numbers are interleaved into one key, so rows near in the key are near in every column. Columns with too many values
for an order (a transaction number) get a bloom filter per row group instead, which answers equality only.

The bins come from a uniform sample of ``SAMPLE_ROWS`` rows (one narrow pass, least random numbers first). They only decide where rows lie, never which rows are read, so a
poor sample costs time, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

SAMPLE_ROWS = 10_000
RANGE_ROWS = 750_000
KEY = "_zorder"


def bin_cuts(df: DataFrame, columns: Sequence[str], bits: int = 6, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, list]:
    """For each column at most 2**bits - 1 ascending cut values, between which a uniform sample is spread evenly.

    ``sample_rows`` bounds the rows that reach the driver. A value that fills several bins gives one cut. NULLs give none, and a
    column of NULLs no cut at all.
    """
    rows = df.select(*columns).orderBy(F.rand(seed)).limit(sample_rows).collect()
    cuts = {}
    for i, name in enumerate(columns):
        seen = sorted(r[i] for r in rows if r[i] is not None)
        at = [seen[len(seen) * k // 2 ** bits] for k in range(1, 2 ** bits)] if seen else []
        cuts[name] = sorted(set(at) - set(seen[:1]))          # nothing lies below the least value
    return cuts


def with_bins(df: DataFrame, bins: Mapping[str, tuple[str, str]], bits: int) -> DataFrame:
    """Adds for each ``bin: (value, cuts)`` how many of the ascending ``cuts`` (an array padded with NULLs to 2**bits - 1) are not above ``value``, by
    binary search; 0 for NULL. One projection to a step of the search, which Spark compiles; a lambda over the steps it would interpret."""
    found = {name: F.lit(0) for name in bins}
    for step in (2 ** b for b in reversed(range(bits))):
        df = df.withColumns({name: F.when(F.element_at(cuts, found[name] + step) <= F.col(value), found[name] + step).otherwise(found[name]) for name, (value, cuts) in bins.items()})
        found = {name: F.col(name) for name in bins}
    return df


def interleaved(bins: Sequence[Column], bits: int) -> Column:
    """The bits of several bin numbers as one long: the highest bit of each, then the next of each, and so on."""
    key = F.lit(0).cast("long")
    for b in range(bits):
        for i, bin_number in enumerate(reversed(bins)):
            bit = F.shiftright(bin_number.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            key = key + F.shiftleft(bit, b * len(bins) + i)
    return key


def with_zorder(df: DataFrame, columns: Sequence[str], bits: int = 6, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` and its place along the space-filling curve over ``columns``, a long named ``_zorder``.

    Reads the columns once to sample them. The cuts join as one row (at most 2**bits - 1 values a column).
    """
    if not columns:
        raise ValueError("name the columns to order by")
    if bits < 1 or bits * len(columns) > 62:
        raise ValueError("bits times columns must lie between 1 and 62")
    cuts = bin_cuts(df, columns, bits, sample_rows)
    size = 2 ** bits - 1
    fields = [T.StructField(f"_cuts{i}", T.ArrayType(df.schema[c].dataType)) for i, c in enumerate(columns)]
    row = tuple(cuts[c] + [None] * (size - len(cuts[c])) for c in columns)
    one = df.sparkSession.createDataFrame([row], T.StructType(fields))
    bins = [f"_bin{i}" for i in range(len(columns))]
    placed = with_bins(df.crossJoin(F.broadcast(one)), {b: (c, f"_cuts{i}") for i, (b, c) in enumerate(zip(bins, columns))}, bits)
    return placed.select(*df.columns, interleaved([F.col(b) for b in bins], bits).alias(KEY))


def z_order(df: DataFrame, columns: Sequence[str], partition_by: Sequence[str] = (), spread_by: Sequence[str] = (), bits: int = 6,
            sample_rows: int = SAMPLE_ROWS, files: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``partition_by``, then by the curve over ``columns``, then by ``spread_by``; ready to be written.

    One point of the curve may hold many rows (a card with a third of all); ``spread_by`` lets the ranges cut through it, so no
    task gets it whole. ``files`` sets the number of ranges, by default AQE sizes them, and a range holds about ``RANGE_ROWS`` rows at
    most (a count of ``df`` tells; over a stored table it reads no column).
    """
    order = [*partition_by, KEY, *spread_by]
    if not files:
        ranges = math.ceil(df.count() / RANGE_ROWS)
        files = ranges if ranges > df.sparkSession.sparkContext.defaultParallelism else None
    placed = with_zorder(df, columns, bits, sample_rows)
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).drop(KEY)


def bloom_options(values: Mapping[str, int], row_group_bytes: int | None = None) -> dict[str, str]:
    """Parquet writer options: a bloom filter per row group for each ``column: distinct values expected in one``.

    A column chunk that is dictionary-encoded throughout gets none; there the reader asks the dictionary itself.
    """
    options = {}
    for column, distinct in values.items():
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{column}"] = str(distinct)
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    return options


def rows_scanned(df: DataFrame) -> int:
    """Rows that the file scans of an executed ``df`` handed on, after row groups and pages were skipped."""
    def walk(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if node.nodeName().startswith("Scan parquet") else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())
