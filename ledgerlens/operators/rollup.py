"""Stored rate states: one pass over the transactions serves all rate reports, and a new month is added without reading the others.

A state table has three kinds of rows, each a partial aggregate (rows, label sum, volume, loss) per month:

* ``cells``: per category, hour of day, distance band, amount band, state and city size band;
* ``cards``: per category, state, city size band and card, for exact distinct cards;
* ``sketches``: per category, state and city size band with a HyperLogLog sketch of the cards, for approximate ones.

Sums merge by summing, distinct cards by counting the stored cards once or by merging sketches. A row also carries the least
distance, population and amount of its group, which lie in the group's band, so reports band a state row as they band a transaction.

Size: cells and sketches are bounded by the number of key values a month, whatever the number of transactions; ``cards``
grows with the active cards a month, as every exact distinct count must. ``cells`` and ``cards`` come from one scan
(grouping sets, aggregated before the shuffle, so a hot card or category costs a row per input split); ``sketches`` replace the card rows
and their shuffle by one further scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.functions import amount_band, city_size_band, distance_band
from ledgerlens.functions.numeric import cond_sum
from ledgerlens.schema import TRANSACTIONS_SCHEMA
from ledgerlens.sources.versions import replace, resolve

MONTH = ["trans_year", "trans_month"]
CARD_DIMS = [*MONTH, "category", "state", "city_size"]              # dims that exact and approximate distinct cards can be merged over
CELL_DIMS = [*CARD_DIMS, "trans_hour", "distance_band", "band"]
LG_K = 12                                                           # 4,096 registers: relative standard error 1.04 / 64, about 1.6 %
_LEAST = ["city_pop", "dist_km", "amt"]


def with_bands(txn: DataFrame) -> DataFrame:
    """The bands that the states are keyed by, as further columns."""
    return txn.withColumns({"city_size": city_size_band("city_pop"), "distance_band": distance_band("dist_km"), "band": amount_band("amt")})


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("long").alias("label_n"), F.sum("amt").alias("volume"),
            cond_sum(F.col("is_fraud") == 1, "amt").alias("loss"), *[F.min(c).alias(f"_{c}") for c in _LEAST]]


def rate_states(txn: DataFrame, distinct: str = "exact", lg_k: int = LG_K) -> DataFrame:
    """Partial states of the months in ``txn``; ``distinct`` is ``"exact"`` (card rows) or ``"sketch"`` (sketch rows)."""
    rows = with_bands(txn.select(*MONTH, "category", "state", "trans_hour", "cc_num", "is_fraud", *_LEAST))
    if distinct == "exact":
        keys = [*CELL_DIMS, "cc_num"]
        both = (rows.groupingSets([CELL_DIMS, [*CARD_DIMS, "cc_num"]], *keys)
                    .agg(F.grouping("cc_num").alias("_cell"), *_sums()))
        return _shaped(both.withColumn("kind", F.when(F.col("_cell") == 1, "cells").otherwise("cards")), "cc_num")
    if distinct != "sketch":
        raise ValueError("distinct must be 'exact' or 'sketch'")
    cells = rows.groupBy(*CELL_DIMS).agg(*_sums()).withColumns({"kind": F.lit("cells"), "cards": F.lit(None).cast("binary")})
    merged = rows.groupBy(*CARD_DIMS).agg(*_sums(), F.hll_sketch_agg("cc_num", F.lit(lg_k)).alias("cards"))
    unkept = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields if f.name in CELL_DIMS and f.name not in CARD_DIMS}
    return _shaped(cells, "cards").unionByName(_shaped(merged.withColumns({"kind": F.lit("sketches"), **unkept}), "cards"))


def _shaped(states: DataFrame, cards: str) -> DataFrame:
    return states.select("kind", *CELL_DIMS, cards, "n", "label_n", "volume", "loss", *[F.col(f"_{c}").alias(c) for c in _LEAST])


def merged_rate(states: DataFrame, dims: Sequence[str], entity: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """:func:`ledgerlens.operators.rates.label_rate` from stored states: same columns, types and values (``entities``
    is an estimate where the states hold sketches).

    ``dims`` are state columns or columns made from them by the band functions; with ``entity`` they must be among ``CARD_DIMS``.
    """
    if entity is None:
        rows, cards = states.where(F.col("kind") == "cells"), []
    elif entity != "cc_num" or not set(dims) <= set(CARD_DIMS):
        raise ValueError(f"distinct cards are kept by {CARD_DIMS} only")
    else:
        rows = states.where(F.col("kind") != "cells")
        found = F.hll_sketch_estimate(F.hll_union_agg("cards")) if "cards" in states.columns else F.countDistinct("cc_num")
        cards = [found.alias("entities")]
    # a sum of sums has ten digits more than the direct sum; its type is put back, so later divisions round alike
    money = {c: F.sum(c).cast(states.schema[c].dataType).alias(c) for c in ("volume", "loss")}
    return rows.groupBy(*dims).agg(F.sum("n").alias("n"), F.sum("label_n").alias("label_n"), *money.values(), *cards, *extra)


def write_states(txn: DataFrame, path: str, distinct: str = "exact", lg_k: int = LG_K) -> str:
    """Store the states of ``txn``, replacing the table at ``path`` (crash-safe, see :mod:`ledgerlens.sources.versions`)."""
    replace(txn.sparkSession, path, lambda folder: _write(rate_states(txn, distinct, lg_k), folder, "error"))
    return path


def add_months(txn: DataFrame, path: str, distinct: str = "exact", lg_k: int = LG_K) -> str:
    """Add the months in ``txn`` (all their transactions) to the states at ``path``, or replace them there.

    Only ``txn`` is aggregated and only its months' folders are written (dynamic partition overwrite); a run that was
    killed is repeated.
    """
    _write(rate_states(txn, distinct, lg_k), _folder(txn.sparkSession, path, distinct), "overwrite")
    return path


def read_states(spark: SparkSession, path: str, distinct: str = "exact") -> DataFrame:
    """The stored states. A report reads the folders of its kind of rows only."""
    shape = rate_states(spark.createDataFrame([], TRANSACTIONS_SCHEMA), distinct).schema
    return spark.read.schema(shape).parquet(_folder(spark, path, distinct))


def _write(states: DataFrame, folder: str, mode: str) -> None:
    (states.hint("rebalance", "kind", *MONTH).write.mode(mode).option("partitionOverwriteMode", "dynamic")
           .partitionBy("kind", *MONTH).parquet(folder))


def _folder(spark: SparkSession, path: str, distinct: str) -> str:
    """The folder of the table; an error if it was written with the other kind of distinct state."""
    folder = resolve(spark, path)
    other = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kind={'sketches' if distinct == 'exact' else 'cards'}")
    if other.getFileSystem(spark._jsc.hadoopConfiguration()).exists(other):
        raise ValueError(f"the states at {path} were not written with distinct={distinct!r}")
    return folder
