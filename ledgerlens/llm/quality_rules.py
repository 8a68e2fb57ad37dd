"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure lies above a cutoff. The cutoffs are not set by hand. The labels
are split by hash into two halves:

* The first half proposes one path per stratum (language): a sequence of rule sets, each rejecting all that the one
  before rejects. A rule's gain at a cutoff is the share of bad documents rejected less ``GOOD_COST`` times the share of good
  ones. The rules with gain come in the order of their best gain, each tightened cutoff by cutoff from its mildest one with gain to its
  best (of equals the mildest). Rules without gain in a stratum are not on its path.
* The holdout proves. With n good holdout documents in the stratum, k of them rejected by the union of the rules at a
  step, the exact binomial p-value of "the rules together reject a share of ``alpha`` or more of good documents" is
  P(Bin(n, alpha) <= k). The steps are tested in order and testing stops at the first that fails (fixed-sequence
  testing, so further steps cost no error); strata share the error by Bonferroni: each path is tested at
  ``delta / strata``. The last proven step is used. The strata are the languages found with at least :func:`least_labels` good
  holdout documents, fewer of which cannot prove any step; their number does not depend on the measures.

The paths do not depend on the holdout, so with probability 1 - delta, in every stratum all rules
together reject at most a share alpha of good documents. A language with too few labels of its own proves nothing, and its
rules abstain; no cutoff learned on one language is applied to another.

Only sums per (stratum, half, label, rule, cutoff) and per (stratum, step) reach the driver, at most four and 84 rows for each language with
enough labels.

Defined cases: a null or empty text has no words and fails the base rules; documents without a language are a
stratum of their own (None); labels with null doc_id or quality are ignored and of
repeated labels of one document the lowest counts; repeated document rows get a verdict each, but of the
rows with one doc_id that pass the base rules only that with the least counts (then language) is learned from; with
no labels only the base rules reject; an empty table gives an empty result; other columns are carried by
:func:`kept_rows` and ignored by :func:`verdicts`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ledgerlens.llm.common import checkpointed, fresh, small_batches
from ledgerlens.llm.text_stats import stats_of

# fixed values of the contract
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50

ALPHA, DELTA = 0.05, 0.05
GOOD_COST = 50
# rule: measure, cutoffs from the mildest to the strictest
CUTOFFS = {
    "symbols": (2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "repeats": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.07, 0.05),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "marks": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "word_chars": (30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0),
    "run": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04),
}


def measures(s: Column) -> dict[str, Column]:
    """The rules' measures from the counts of one document (0 where there are no words)."""
    per = lambda top, below: F.when(s[below] > 0, s[top] / s[below]).otherwise(F.lit(0.0))
    return {"symbols": per("n_symbols", "n_words"), "repeats": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
            "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"), "word_chars": per("word_chars", "n_words"),
            "run": F.when(s["n_words"] > 0, (s["longest_run"] - 1) / s["n_words"]).otherwise(F.lit(0.0))}


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEAT_PERCENT * s["n_words"])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed term by term."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def least_labels(alpha: float, delta: float) -> int:
    """Good holdout documents below which no step can be proven, even in a single stratum."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def learn_cutoffs(marked: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """marked(doc_id, lang, s) and labels(doc_id, quality) -> {(language, rule): proven and chosen cutoff}."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # documents whose base rules fail are rejected anyway; the learned rules answer for the others
    # a label is one trial however often its document is repeated: one row per doc_id, combined map-side
    one = marked.where("doc_id IS NOT NULL").where(~base_failed(F.col("s"))).groupBy("doc_id").agg(F.min(F.struct("s", "lang")).alias("r"))
    seen = one.select("doc_id", F.col("r.lang").alias("stratum"), *[c.alias(r) for r, c in measures(F.col("r.s")).items()])
    holdout = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    sums = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, cuts in CUTOFFS.items() for i, c in enumerate(cuts)]
    groups = seen.join(truth, "doc_id").groupBy("stratum", holdout.alias("holdout"), (F.col("quality") > 0).alias("good")) \
        .agg(F.count(F.lit(1)).alias("n"), *sums)
    proofs = F.max(F.when(F.col("holdout") & F.col("good"), F.col("n"))).over(Window.partitionBy("stratum"))
    rows = groups.withColumn("proofs", proofs).where(F.col("proofs") >= least_labels(alpha, delta)).collect()
    found = {(r["stratum"], r["holdout"], r["good"]): r for r in rows}
    strata = {r["stratum"] for r in rows}
    paths = {name: _path(found.get((name, False, True)), found[name, False, False]) for name in strata if (name, False, False) in found}
    first = _first_rejected(seen.join(truth, "doc_id").where(holdout & (F.col("quality") > 0)), paths)
    out = {}
    for name, path in paths.items():
        n, rejected = found[name, True, True]["n"], 0
        for step, (rule, cut) in enumerate(path):
            rejected += first.get((name, step), 0)
            if binomial_cdf(rejected, n, alpha) > delta / len(strata):
                break
            out[name, rule] = cut
    return out


def _path(good: Row | None, bad: Row) -> list[tuple[str, float]]:
    """The steps (rule, cutoff) that the first half proposes, from its sums over good and bad documents."""
    def gain(rule: str, i: int) -> float:
        return bad[f"{rule}_{i}"] / bad["n"] - GOOD_COST * (good[f"{rule}_{i}"] / good["n"] if good else 0)

    gains = {rule: [gain(rule, i) for i in range(len(cuts))] for rule, cuts in CUTOFFS.items()}
    order = sorted((rule for rule, g in gains.items() if max(g) > 0), key=lambda r: (-max(gains[r]), r))
    return [(rule, CUTOFFS[rule][i]) for rule in order for i in range(gains[rule].index(max(gains[rule])) + 1) if gains[rule][i] > 0]


def _first_rejected(good: DataFrame, paths: dict[str | None, list[tuple[str, float]]]) -> dict[tuple[str | None, int], int]:
    """good(doc_id, stratum, measures) -> {(stratum, step): documents that this step is the first to reject}."""
    steps = [(name, rule, cut, i) for name, path in paths.items() for i, (rule, cut) in enumerate(path)]
    if not steps:
        return {}
    # at most 84 rows per language with enough labels: a bounded broadcast
    at = good.sparkSession.createDataFrame(steps, "of string, name string, cut double, step int")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("value")) for r in CUTOFFS])).alias("m")
    hit = good.select("doc_id", "stratum", each).join(F.broadcast(at), F.col("stratum").eqNullSafe(F.col("of")) & (F.col("m.rule") == F.col("name")) & (F.col("m.value") > F.col("cut")))
    counts = hit.groupBy("doc_id", "stratum").agg(F.min("step").alias("step")).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    return {(r["stratum"], r["step"]): r["n"] for r in counts.collect()}


def passes(s: Column, lang: Column, cutoffs: dict[tuple[str | None, str], float]) -> Column:
    """Whether the learned rules accept a document."""
    ok = F.lit(True)
    for rule, measure in measures(s).items():
        own = {name: cut for (name, r), cut in cutoffs.items() if r == rule}
        if None in own:
            ok = ok & ~(lang.isNull() & (measure > own.pop(None)))
        if own:
            cut = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair]), lang)
            ok = ok & ~F.coalesce(measure > cut, F.lit(False))
    return ok


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs(doc_id, text, lang) -> per row the counts, base_failed and kept. Counts are taken once and checkpointed (narrow)."""
    marked = checkpointed(small_batches(docs).select("doc_id", "lang", stats_of("text").alias("s")))
    cutoffs = learn_cutoffs(marked, labels, alpha, delta)
    s = F.col("s")
    failed = base_failed(s)
    return marked.select("doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         failed.alias("base_failed"), (~failed & passes(s, F.col("lang"), cutoffs)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns as they came.

    The rows are stored once with their counts, for the cutoffs and for the verdicts: writing a text is many times
    cheaper than counting it again, and no text is shuffled.
    """
    s = fresh(small_batches(docs), "s")
    marked = checkpointed(docs.withColumn(s, stats_of("text")))
    cutoffs = learn_cutoffs(marked.select("doc_id", "lang", F.col(s).alias("s")), labels, alpha, delta)
    return marked.where(~base_failed(F.col(s)) & passes(F.col(s), F.col("lang"), cutoffs)).drop(s)
