"""Exact top-k search by inner product, with lower-bound distances from segment statistics.

Vectors are quantised: component x becomes floor(256 x), x as a double. The score of a query and a candidate is their integer inner
product. With the squared distance d = |q|^2 + |c|^2 - 2 score, high scores are small distances in that sense.

1. A vector is cut into segments; with a segment's size n, mean m and deviation s, the distance is at least
   sum n ((m_q - m_c)^2 + (s_q - s_c)^2) over the segments (Cauchy and Schwarz inside each). As |q|^2 = sum n (m_q^2 + s_q^2), the
   bound needs one product of the vectors (sqrt(n) m, sqrt(n) s) of both sides.
2. Resolutions go from coarse to fine (``LEVELS`` segments). A pair whose lower bound puts its score below the query's
   k-th best so far is dropped; the others go to the next resolution, the survivors of the last get their exact score.
   Each resolution is computed for the rows and columns that still have survivors.
3. The k-th best is at first that among ``SAMPLE`` candidates, then it grows with each candidate tile.

The bounds are only ever used to drop pairs that cannot be among the k best (rounding is allowed for), so the result is exact whatever the data; where
vectors have no structure that segments see, most pairs reach the exact step.

Blocks: queries are taken in blocks of at most ``QUERY_BLOCK`` rows; a block (bounded: rows x components x 8 bytes) is
broadcast, and one pass over the candidates, which are not shuffled, finds each task's k best per query of the block. Only those are
shuffled and merged. A task holds one tile of candidates against a part of the block.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors with equally many
components are compared; repeated rows are candidates (and queries) each; a candidate with the query's own id is
its own row and no candidate; a row without an id is no query, and as a candidate it stands last among equal scores (two such rows of equal
score are interchangeable); components beyond the long range after scaling and scores beyond it are cut to it; a query without
candidates has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.common import checkpointed

SCALE = 256
LEVELS = (4, 16)
QUERY_BLOCK = 1 << 16
TILE, PART = 2048, 1024
SAMPLE = 512
NO_ID = np.iinfo(np.int64).max
_LONG = 2.0 ** 63
_LOWEST = np.iinfo(np.int64).min


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as float64 where products stay exact there, else as Python integers (object)."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * x.astype(np.float64))
    top = np.abs(x).max(initial=0.0)
    if x.shape[1] * top * top < 2.0 ** 53:
        return x
    cut = np.clip(x, -_LONG, np.nextafter(_LONG, 0))
    return np.array([[int(v) for v in row] for row in cut.tolist()], dtype=object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows as int64, cut to its range."""
    if a.dtype != object and b.dtype != object:
        return np.rint(a @ b.T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T if a.dtype == object else np.array([[int(v) for v in r] for r in a.tolist()], dtype=object) @ b.astype(object).T
    return np.clip(exact, _LOWEST, NO_ID).astype(np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the scaled means and deviations (sqrt(n) m, sqrt(n) s) of its segments."""
    x = x.astype(np.float64)
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(np.int64)
    sizes = np.diff(cuts)
    means = np.add.reduceat(x, cuts[:-1], axis=1) / sizes
    spread = np.sqrt(np.add.reduceat((x - np.repeat(means, sizes, axis=1)) ** 2, cuts[:-1], axis=1))
    return np.hstack([means * np.sqrt(sizes), spread])


class Side:
    """Ids and quantised vectors of one length, with their statistics per resolution."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        with np.errstate(over="ignore"):
            self.norms = (x.astype(np.float64) ** 2).sum(axis=1)
        self.levels = [statistics(x, n) for n in LEVELS if n < x.shape[1]]


def lower_bounds(q: Side, c: Side, level: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of ``rows`` of q and ``cols`` of c."""
    shared = q.levels[level][rows] @ c.levels[level][cols].T
    return q.norms[rows][:, None] + c.norms[cols][None, :] - 2 * shared


class Best:
    """The k best (score, id) per query so far; ids of equal scores ascend."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), _LOWEST, dtype=np.int64)
        self.ids = np.full((n, k), NO_ID, dtype=np.int64)
        self.found = np.zeros((n, k), dtype=bool)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """scores[row, candidate] for the queries ``rows``; pairs that are not ``valid`` do not count."""
        k = self.scores.shape[1]
        ids = np.broadcast_to(ids, scores.shape)
        if scores.shape[1] > 8 * k:
            # those below the k-th largest score are out; ties at it stay
            kth = -np.partition(np.where(valid, -scores.astype(np.float64), np.inf), k - 1, axis=1)[:, k - 1]
            width = int((valid & (scores >= kth[:, None])).sum(axis=1).max(initial=0))
            order = np.argsort(np.where(valid & (scores >= kth[:, None]), 0, 1), axis=1, kind="stable")[:, :max(width, 1)]
            scores, ids, valid = (np.take_along_axis(v, order, axis=1) for v in (scores, ids, valid))
        scores, ids, valid = (np.concatenate([a[rows], b], axis=1) for a, b in ((self.scores, scores), (self.ids, ids), (self.found, valid)))
        order = np.lexsort((ids, np.where(valid, -1 - scores, NO_ID), ~valid), axis=1)[:, :k]
        self.scores[rows], self.ids[rows], self.found[rows] = (np.take_along_axis(v, order, axis=1) for v in (scores, ids, valid))

    def thresholds(self) -> np.ndarray:
        """The k-th best score; -inf where there are fewer, or where it was cut to the range."""
        return np.where(self.found[:, -1] & (self.scores[:, -1] > _LOWEST), self.scores[:, -1].astype(np.float64), -np.inf)


def search_tile(q: Side, c: Side, best: Best, known: np.ndarray) -> None:
    """Take the candidates of one tile into ``best``; ``known``: scores that k candidates are known to reach."""
    for at in range(0, len(q.ids), PART):
        rows, cols = np.arange(at, min(at + PART, len(q.ids))), np.arange(len(c.ids))
        need = np.maximum(known[rows], best.thresholds()[rows])
        alive = q.ids[rows][:, None] != c.ids[cols][None, :]
        for level in range(len(q.levels)):
            norms = q.norms[rows][:, None] + c.norms[cols][None, :]
            with np.errstate(invalid="ignore", over="ignore"):
                # score = (norms - distance) / 2; the slack covers rounding, and what is not a number stays
                alive &= ~((norms - lower_bounds(q, c, level, rows, cols)) / 2 + 1e-9 * norms < need[:, None])
            r, s = alive.any(axis=1), alive.any(axis=0)
            rows, cols, need, alive = rows[r], cols[s], need[r], alive[r][:, s]
            if not len(rows):
                break
        if len(rows):
            scores = products(q.x[rows], c.x[cols])
            best.add(rows, scores, c.ids[cols][None, :], alive & (scores >= need[:, None]))


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, ids, vectors) for each length among finite vectors; a missing id is ``NO_ID``."""
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    ids = pc.fill_null(ids.cast(pa.int64()), NO_ID).to_numpy()
    ends = np.cumsum(sizes)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = flat[(ends[at] - n)[:, None] + np.arange(n)[None, :]]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield n, ids[at[good]], x[good]


class Block:
    """A block of queries of one length: rows are numbered by ``numbers``, ``known`` are scores that k candidates reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, numbers: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int):
        self.side, self.numbers, seed = Side(ids, quantised(x)), numbers, Best(len(ids), k)
        if sample:
            own, y = sample[0], quantised(sample[1])
            for at in range(0, len(ids), PART):
                rows = np.arange(at, min(at + PART, len(ids)))
                seed.add(rows, products(self.side.x[rows], y), own[None, :], ids[rows][:, None] != own[None, :])
        self.known = seed.thresholds()


def _searcher(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks.value
        best = {n: Best(len(b.numbers), k) for n, b in own.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in own}

        def flush(n: int) -> None:
            ids, x = (np.concatenate(v) for v in zip(*held[n]))
            held[n] = []
            for at in range(0, len(ids), TILE):
                search_tile(own[n].side, Side(ids[at:at + TILE], quantised(x[at:at + TILE])), best[n], own[n].known)

        for batch in batches:
            for n, ids, x in _by_length(batch.column(0), batch.column(1)):
                if n in own:
                    held[n].append((ids, x))
                    if sum(len(i) for i, _ in held[n]) >= TILE:
                        flush(n)
        for n in own:
            if held[n]:
                flush(n)
            row, place = np.nonzero(best[n].found)
            for at in range(0, len(row), PART * k):
                r, p = row[at:at + PART * k], place[at:at + PART * k]
                ids = best[n].ids[r, p]
                yield pa.RecordBatch.from_arrays([pa.array(own[n].numbers[r]), pa.array(ids, mask=ids == NO_ID), pa.array(best[n].scores[r, p])],
                                                 names=["number", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of ``vectors`` for every row of ``queries``: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    named = lambda df: df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{vector}`"].cast("array<double>").alias("x"))
    asked = named(queries).where("id IS NOT NULL")
    # even shares of half a block, so that uneven ones stay below a whole one; stored, so that a query keeps its number and its block
    parts = max(1, -(-asked.count() // max(1, block // 2)))
    asked = checkpointed(asked.repartition(parts).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number"), "id", "x"))
    # candidates whose scores show early what the k best reach at least; every row is searched all the same
    sample = {n: (ids, x) for n, ids, x in _by_length(*_columns(named(vectors).limit(SAMPLE)))}
    results = []
    for part in range(parts):
        ids, x, numbers = _columns(asked.where(F.col("part") == part).select("id", "x", "number"))
        at_row = pa.array(range(len(ids)), pa.int64())
        blocks = {n: Block(ids.to_numpy()[at], v, numbers.to_numpy()[at], sample.get(n), k) for n, at, v in _by_length(at_row, x)}
        if blocks:
            found = named(vectors).mapInArrow(_searcher(spark.sparkContext.broadcast(blocks), k), "number long, vec_id long, score long")
            results.append(_ranked(found, k))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if parts > 1:
        # one pass at a time; a finished pass is not repeated for a later one
        results = [checkpointed(r) for r in results]
    names = asked.select("number", F.col("id").alias("query_id"))
    return reduce(DataFrame.unionByName, results).join(names, "number").select("query_id", "rank", "vec_id", "score")


def _columns(rows: DataFrame) -> list[pa.Array]:
    """A bounded number of rows on the driver."""
    return [c.combine_chunks() for c in rows.toArrow().columns]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows per query number: a task hands on k of them at most."""
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
