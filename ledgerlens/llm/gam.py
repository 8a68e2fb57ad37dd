"""A generalised additive model with pairwise interactions, for document quality.

Features are counts and shares of the text alone. Each is cut into bins at quantiles of the training sample;
boosting goes round the features in a fixed cycle and fits, on the gradient of the log loss, a shallow tree on one
feature's bins (two splits), whose leaves are added to that feature's lookup table. When the single features are
learned, the pairs whose joint bins explain most of what is left get tables too, grown the same way by
trees that split one feature, then the other. A score is the intercept plus one table entry per feature and pair,
through the logistic function: scoring is bin search and additions, whole columns at a time.

Training takes a bounded sample: the ``SAMPLE_ROWS`` labelled rows least by hash of the doc_id, learned on the driver (a
few features a row). Labels, language, source and doc_id are no features.

Defined cases: a null or empty text has all counts 0 and gets a score as any other; labels without doc_id or quality are
ignored, repeated labels of a document count once, the lowest, and of repeated document rows the one with the least counts is
learned; rows with equal texts get equal scores; without labels
of both classes every score is the share of good labels (0.5 without any); an empty table gives an empty result; other
columns are ignored.

Scale: scoring is one pass without a shuffle; the model is a few thousand numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import small_batches
from ledgerlens.llm.text_stats import STATS, stats_of, text_stats

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE = 0.15
LEAST_LEAF = 10
# fixed value of the contract
CUT = 0.3

FEATURES = ("words", "word_chars", "symbols", "dup_lines", "repeats", "line_words", "upper", "digits", "marks", "short", "distinct", "run", "enders", "spaces")


def features(stats: np.ndarray) -> np.ndarray:
    """Counts (rows x STATS) -> features (rows x FEATURES); shares of nothing are 0."""
    s = dict(zip(STATS, stats.astype(float).T))
    per = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    return np.column_stack([
        np.log1p(s["n_words"]), per(s["word_chars"], s["n_words"]), per(s["n_symbols"], s["n_words"]), per(s["n_dup_lines"], s["n_lines"]),
        per(s["n_repeat_words"], s["n_words"]), np.log1p(per(s["n_words"], s["n_lines"])), per(s["n_upper"], s["word_chars"]), per(s["n_digits"], s["word_chars"]),
        per(s["n_marks"], s["n_words"]), per(s["n_short"], s["n_words"]), per(s["n_distinct"], s["n_words"]), per(s["longest_run"], s["n_words"]),
        per(s["n_enders"], s["n_words"]), per(s["n_chars"] - s["word_chars"], s["n_chars"])])


@dataclass
class Model:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[j], x[:, j], side="left")]
        wide = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="left") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[wide[i], wide[j]]
        return 1 / (1 + np.exp(-z))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best cut of a row of bins by the gain of two leaves over one: (gain, bins on the left)."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + 1) + (gt - gl)**2 / (ht - hl + 1) - gt**2 / (ht + 1)
    gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of two splits over a row of bins -> the leaf value of each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    _, at = _split(g, h, n)
    if at:
        sides = [slice(0, at), slice(at, len(g))]
        second = max(sides, key=lambda s: _split(g[s], h[s], n[s])[0])
        for s in sides:
            out[s] = _leaf(g[s].sum(), h[s].sum())
        _, cut = _split(g[second], h[second], n[second])
        if cut:
            for s in (slice(second.start, second.start + cut), slice(second.start + cut, second.stop)):
                out[s] = _leaf(g[s].sum(), h[s].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Split one axis, then each side by the other -> (gain, leaf value of each cell)."""
    best, out = 0.0, np.zeros_like(g)
    whole = g.sum()**2 / (h.sum() + 1)
    for axis in (0, 1):
        a, b, c = (m.T if axis else m for m in (g, h, n))
        _, at = _split(a.sum(1), b.sum(1), c.sum(1))
        if not at:
            continue
        gain, table = -whole, np.zeros_like(a)
        for s in (slice(0, at), slice(at, len(a))):
            rg, rh, rn = a[s].sum(0), b[s].sum(0), c[s].sum(0)
            _, cut = _split(rg, rh, rn)
            for t in ((slice(0, cut), slice(cut, len(rg))) if cut else (slice(0, len(rg)),)):
                gain += rg[t].sum()**2 / (rh[t].sum() + 1)
                table[s, t] = _leaf(rg[t].sum(), rh[t].sum())
        if gain > best:
            best, out = gain, table.T if axis else table
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from features and labels (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Model(intercept=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    m = Model(intercept=float(np.log(share / (1 - share))))
    quantiles = lambda j, k: np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1]))
    m.cuts = [quantiles(j, BINS) for j in range(x.shape[1])]
    m.pair_cuts = [quantiles(j, PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(m.cuts[j], x[:, j], side="left") for j in range(x.shape[1])]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    z = np.full(len(x), m.intercept)
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, m.tables)]
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(b, y - p, len(m.tables[j])), np.bincount(b, p * (1 - p), len(m.tables[j])), counts[j])
            m.tables[j] += step
            z += step[b]
    wide = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(m.pair_cuts)]

    def grid(i: int, j: int, w: np.ndarray | None) -> np.ndarray:
        shape = len(m.pair_cuts[i]) + 1, len(m.pair_cuts[j]) + 1
        return np.bincount(wide[i] * shape[1] + wide[j], w, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    gains = {(i, j): _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), grid(i, j, None))[0] for i, j in combinations(range(x.shape[1]), 2)}
    m.pairs = [k for k in sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS] if gains[k] > 0]
    m.pair_tables = [np.zeros((len(m.pair_cuts[i]) + 1, len(m.pair_cuts[j]) + 1)) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(m.pairs):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), grid(i, j, None))[1]
            m.pair_tables[k] += step
            z += step[wide[i], wide[j]]
    return m


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", stats_of("text").alias("s"))
    # one row per doc_id, combined map-side: the sample has at most sample_rows rows, however often a document is repeated
    rows = found.groupBy("doc_id").agg(F.min(F.struct("quality", "s")).alias("r")).select("r.quality", "r.s.*")
    got = np.array([tuple(r) for r in rows.collect()], dtype=float).reshape(-1, len(STATS) + 1)
    # the rows come in any order: sort them, so that reruns learn the same
    got = got[np.lexsort(got.T)]
    return train(features(got[:, 1:]), (got[:, 0] > 0).astype(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        counts = np.array([text_stats(t) for t in text], dtype=float).reshape(-1, len(STATS))
        return pd.Series(model.score(features(counts)))

    rows = small_batches(docs).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
