"""Quality rules and the quality classifier."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import gam, quality_rules as Q
from ledgerlens.llm.text_stats import STATS, text_stats


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def texts(seed, n=60):
    rng = random.Random(seed)
    return [None, "", " \n\t", "a b c a b c", "x\nx\n\nx \nx", "a a a a", "é|🎉 #"] + [
        "".join(rng.choice(["a ", "b ", "cc ", "\n", "d\n", "#", " $ ", "\x1c", " "]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_base_counts_equal_the_plain_form():
    for t in texts(1):
        assert text_stats(t)[:5] == plain_stats(t)


def test_binomial_cdf_is_exact():
    for n, k, p in [(10, 3, 0.1), (200, 0, 0.01), (50, 49, 0.9), (300, 5, 0.02)]:
        f = Fraction(str(p))
        want = float(sum(comb(n, i) * f**i * (1 - f)**(n - i) for i in range(k + 1)))
        assert Q.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)
    assert Q.binomial_cdf(5, 5, 0.3) == 1.0 and Q.binomial_cdf(0, 0, 0.3) == 1.0


def corpus(n=3000, seed=7, langs=("en", "fr")):
    """Good documents with few symbols, bad ones with many; a share of good ones is noisy."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(80)]
        share = rng.uniform(0.3, 0.9) if bad else rng.uniform(0, 0.1)
        rows.append((i, " ".join(w + "#" if rng.random() < share else w for w in words), rng.choice(langs) if i % 50 else None, "s"))
        marks.append((i, 0 if bad else 1))
    return rows, marks


def test_cutoffs_hold_their_risk_and_catch_bad_documents(docs, labels):
    rows, marks = corpus()
    got = {r.doc_id: r for r in Q.verdicts(docs(rows), labels(marks[:2600])).collect()}
    truth = dict(marks)
    for lang in ("en", "fr"):
        good = [got[i].kept for i, _, x, _ in rows if x == lang and truth[i]]
        bad = [got[i].kept for i, _, x, _ in rows if x == lang and not truth[i]]
        assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    # too few labels of the other stratum: its rules abstain
    assert all(got[i].kept for i, _, x, _ in rows if x is None)
    for i, t, *_ in rows[:50]:
        assert tuple(got[i])[1:6] == plain_stats(t)


def test_each_chosen_cutoff_is_proven_and_all_milder_ones_too(docs, labels):
    rows, marks = corpus()
    df = docs(rows).select("doc_id", "lang", Q.stats_of("text").alias("s"))
    cutoffs = Q.learn_cutoffs(df, labels(marks), alpha=0.2)
    assert ("en", "symbols") in cutoffs and not any(s == "other" for s, _ in cutoffs)
    # only the rules that tell the two kinds apart are candidates
    assert {r for _, r in cutoffs} <= {"symbols", "word_chars"}
    hold = [t for i, t, lang, _ in rows if lang == "en" and marks[i][1] and zlib.crc32(str(i).encode()) % 2 == 0]
    ratios = [plain_stats(t)[2] / plain_stats(t)[0] for t in hold]
    for cut in (c for c in Q.CUTOFFS["symbols"] if c >= cutoffs["en", "symbols"]):
        assert Q.binomial_cdf(sum(r > cut for r in ratios), len(ratios), 0.2) <= Q.DELTA / 5
    # a smaller risk needs more labels than there are
    assert Q.learn_cutoffs(df, labels(marks), alpha=0.001) == {}


def test_each_language_has_cutoffs_of_its_own_labels_or_none(docs, labels):
    rng = random.Random(3)

    def text(length):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(length)) for _ in range(60))

    # bad Italian texts have long words; so do clean Chinese ones and those without a language, which have few labels or none
    rows = [(i, text(22 if i % 4 == 0 else 5), "it", "s") for i in range(1200)]
    rows += [(2000 + i, text(22), lang, "s") for i, lang in enumerate(["zh", None] * 20)]
    marks = [(i, int(i % 4 != 0)) for i in range(1200)] + [(2000, 1), (2001, 1)]
    marked = docs(rows).select("doc_id", "lang", Q.stats_of("text").alias("s"))
    assert {name for name, _ in Q.learn_cutoffs(marked, labels(marks))} == {"it"}
    got = {r.doc_id: r.kept for r in Q.verdicts(docs(rows), labels(marks)).collect()}
    assert all(got[i] == (i >= 2000 or i % 4 != 0) for i, *_ in rows)
    assert {r.doc_id for r in Q.kept_rows(docs(rows), labels(marks)).collect()} == {i for i, k in got.items() if k}


def test_no_language_is_a_stratum_of_its_own(docs, labels):
    rows, marks = corpus(1200, langs=(None,))
    df = docs(rows)
    assert {name for name, _ in Q.learn_cutoffs(df.select("doc_id", "lang", Q.stats_of("text").alias("s")), labels(marks))} == {None}
    got = {r.doc_id: r.kept for r in Q.verdicts(df, labels(marks)).collect()}
    assert sum(got[i] for i, q in marks if not q) <= 15 and sum(got[i] for i, q in marks if q) >= 882


def test_repeated_rows_of_a_labelled_document_are_one_trial(docs, labels):
    rows, marks = corpus(40, langs=("en",))
    # document 1004 is in the holdout half
    assert zlib.crc32(b"1004") % 2 == 0
    rows += [(1004, rows[1][1], "en", "s")] * 600
    marked = docs(rows).select("doc_id", "lang", Q.stats_of("text").alias("s"))
    assert Q.learn_cutoffs(marked, labels(marks + [(1004, 1)])) == {}


def test_repeated_rows_do_not_change_the_model(docs, labels):
    rows, marks = corpus(300)
    often = next(i for i, _ in marks if zlib.crc32(str(i).encode()) % 5)
    a, b = gam.learn(docs(rows), labels(marks)), gam.learn(docs(rows + [rows[often], (often, rows[often][1] + " zz", "en", "s")] * 300), labels(marks))
    assert a.intercept == b.intercept and all(np.array_equal(s, t) for s, t in zip(a.cuts + a.tables + a.pair_tables, b.cuts + b.tables + b.pair_tables))


def test_few_labels_prove_nothing(docs, labels):
    rows, marks = corpus(100)
    assert all(r.kept != r.base_failed for r in Q.verdicts(docs(rows), labels(marks)).collect())


def test_rules_nulls_repeats_extra_columns_empty(docs, labels):
    rows = [(1, None), (2, ""), (3, "w " * 60), (4, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"w{i}" for i in range(60))), (None, " ".join(f"v{i}" for i in range(50))),
            (6, " ".join(f"w{i}" for i in range(49))), (7, " ".join(f"w{i}" for i in range(40_000)))]
    marks = labels([(None, 1), (1, None), (4, 1), (4, 0), (99, 1)])
    df = docs(rows, s=1, kept="x", n_words=2)
    got = Q.verdicts(df, marks).collect()
    assert sorted((str(r.doc_id), r.base_failed) for r in got) == sorted((str(i), n < 50 or 100 * rep > 50 * n) for i, t in rows for n, *_, rep in [plain_stats(t)])
    kept = Q.kept_rows(df, marks)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "7", "None"]
    empty = df.where("false")
    assert Q.verdicts(empty, marks).count() == 0 and Q.kept_rows(empty, marks).count() == 0
    assert Q.verdicts(df, marks.where("false")).count() == len(rows)


def test_tables_add_up_to_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * np.sign(x[:, 0]) - 4 * np.sign(x[:, 1] * x[:, 2])))).astype(float)
    m = gam.train(x[:3000], y[:3000])
    assert m.pairs[0] == (1, 2)
    right = (m.score(x[3000:]) > 0.5) == y[3000:]
    # no rule can be right about more than 87 % of these labels
    assert right.mean() > 0.82
    assert [len(t) for t in m.tables] == [len(c) + 1 for c in m.cuts]
    # one row scored by hand
    z = m.intercept + sum(t[np.searchsorted(c, x[0, j])] for j, (t, c) in enumerate(zip(m.tables, m.cuts)))
    z += sum(t[np.searchsorted(m.pair_cuts[i], x[0, i]), np.searchsorted(m.pair_cuts[j], x[0, j])] for (i, j), t in zip(m.pairs, m.pair_tables))
    assert m.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def plain_boosting(x, y):
    """The same model by loops over rows and all cuts, without histograms: the sum of tables for every row."""
    def gain(rows):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def split(rows):
        best, sides = 1e-12, None
        for c in sorted({place[i] for i in rows})[:-1]:
            a, b = [i for i in rows if place[i] <= c], [i for i in rows if place[i] > c]
            if min(len(a), len(b)) >= gam.LEAST_LEAF and (now := gain(a) + gain(b) - gain(rows)) > best + 1e-12:
                best, sides = now, (a, b)
        return best, sides

    z = [np.log(y.mean() / (1 - y.mean()))] * len(y)
    for _ in range(gam.ROUNDS):
        for j in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, gam.BINS + 1)[1:-1]))
            place = [sum(c < v for c in cuts) for v in x[:, j]]
            p = [1 / (1 + np.exp(-v)) for v in z]
            g, h = [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]
            leaves = [list(range(len(y)))]
            _, sides = split(leaves[0])
            if sides:
                found = [split(s) for s in sides]
                second = 0 if found[0][0] >= found[1][0] else 1
                leaves = [sides[1 - second], *(found[second][1] or [sides[second]])]
            for leaf in leaves:
                step = gam.RATE * sum(g[i] for i in leaf) / (sum(h[i] for i in leaf) + 1)
                for i in leaf:
                    z[i] += step
    return np.array(z)


def test_tables_equal_a_plain_boosting_loop(monkeypatch):
    for name, value in (("ROUNDS", 6), ("PAIR_ROUNDS", 0), ("BINS", 8), ("LEAST_LEAF", 5)):
        monkeypatch.setattr(gam, name, value)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(150, 3)).round(1)
        y = (rng.random(150) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] ** 2 - 1))).astype(float)
        assert gam.train(x, y).score(x) == pytest.approx(1 / (1 + np.exp(-plain_boosting(x, y))), abs=1e-9)


def test_one_class_or_no_rows_give_a_constant():
    x = np.zeros((5, len(gam.FEATURES)))
    assert gam.train(x, np.ones(5)).score(x) == pytest.approx([0.999] * 5, abs=1e-3)
    assert gam.train(x[:0], np.ones(0)).score(x) == pytest.approx([0.5] * 5)


def test_features_of_odd_texts_are_finite():
    f = gam.features(np.array([text_stats(t) for t in texts(2)], dtype=float))
    assert f.shape == (len(texts(2)), len(gam.FEATURES)) and np.isfinite(f).all()
    assert len(STATS) == len(text_stats("a"))


def test_held_out_accuracy_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = gam.scored(docs.join(marks.select("doc_id"), "doc_id"), gam.learn(docs, marks)).toPandas().set_index("doc_id")
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df().set_index("doc_id").quality
    held = got[got.held_out]
    assert set(held.index) == {i for i in truth.index if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held.predicted == truth[held.index]).mean() > 0.98
    assert held.predicted[truth[held.index] == 1].mean() > 0.99


def test_held_out_labels_are_not_learned(docs, labels):
    rows, marks = corpus(400)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks]
    a, b = gam.learn(docs(rows), labels(marks)), gam.learn(docs(rows), labels(flipped))
    assert all(np.array_equal(s, t) for s, t in zip(a.tables + a.pair_tables, b.tables + b.pair_tables))
    # the bound on the sample holds, language and source play no part
    small = gam.learn(docs([(i, t, None, None) for i, t, *_ in rows]), labels(marks), sample_rows=50)
    assert small.intercept != a.intercept


def test_scores_nulls_repeats_extra_columns_empty(docs, labels):
    rows, marks = corpus(200)
    model = gam.learn(docs(rows), labels(marks + [(None, 1), (3, None), (5, 0)]))
    odd = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x " * 50_000)]
    got = gam.scored(docs(odd, score="x", predicted=5), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert gam.scored(docs(odd).where("false"), model).count() == 0
