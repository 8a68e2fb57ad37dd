"""The filter audit equals plain counting over all orders."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import filter_audit as audit
from ledgerlens.llm.common import WORD

LABELS = "doc_id long, quality int, toxic int"


def _masks(rows):
    """The filters that each row fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        yield lang or "", i, {x for x, f in fails.items() if f}


def _plain(rows, labels):
    """One pass per part, order and document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, removed_by = {}, {}
    parts = {lang or "" for _, _, lang in rows}
    masks = list(_masks(rows))
    for part in parts:
        own = [(i, m) for p, i, m in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, x in enumerate(order, 1):
                lost = [(i, m) for i, m in alive if x in m]
                fails = [(i, m) for i, m in own if x in m]
                alive = [(i, m) for i, m in alive if x not in m]
                out[part, order, step] = [len(alive), len(lost), len(fails) - len(lost), sum(m == {x} for _, m in fails),
                                          sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(lost)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _got(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


LONG = " ".join(f"word{i}" for i in range(130))
ROWS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, None, None), (5, "", ""), (6, "A # b " * 60, "en"), (7, "a a " * 80, "en"), (8, "SHOUT " * 3, None),
        (9, LONG + " $", "en"), (9, LONG + " $", "en"), (10, LONG + " $", "en"), (None, LONG, "en"), (11, "\x0b\x0c\x1f", "de"), (None, None, "de")]
SAID = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, 1, 1), (6, None, 1), (None, 1, 1), (9, 1, 0), (99, 1, 1), (8, 0, 1)]


def test_equals_plain_counting(spark, docs):
    df = docs([(i, t, lang, "s") for i, t, lang in ROWS], **{"part": 1, "mask": "x", "a.b": 2, "digest": None})
    want = _plain(ROWS, SAID)
    assert len(want) == 600 * 3
    assert _got(audit.audit(df, spark.createDataFrame(SAID, LABELS))) == want


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], LABELS)
    got = _got(audit.audit(docs([(1, "a", "en", "s")]), none))
    assert len(got) == 600 and all(v[4] == v[5] == 0 for v in got.values()) and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    assert audit.audit(docs([]), none).count() == 0


def test_hot_texts_and_hot_ids(spark, docs):
    # a third of the rows share a text, another third a doc_id
    rows = [(i, "copy " * 3, "en") for i in range(300)] + [(1000, f"t{i} $", "en") for i in range(300)] + [(2000 + i, f"u{i}", "de") for i in range(300)]
    said = [(5, 1, 0), (1000, 1, 1), (2001, 0, 1)]
    df = docs([(i, t, lang, "s") for i, t, lang in rows])
    got = _got(audit.audit(df, spark.createDataFrame(said, LABELS)))
    assert got["en", "EABCD", 1] == (301, 299, 0, 0, 1, 0, got["en", "EABCD", 1][-1])
    assert got["en", "DABCE", 1][:6] == (300, 300, 0, 0, 300, 300)
    assert got == _plain(rows, said)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_walk_equals_direct_sums(n):
    rnd = np.random.default_rng(n)
    counts = rnd.integers(0, 50, size=(3, 1 << n, 3))
    states = audit.survivors(counts)
    for active in range(1 << n):
        cells = [m for m in range(1 << n) if not m & active]
        assert (states[:, active] == counts[:, cells].sum(axis=1)).all()


def test_other_filters(spark, docs):
    own = {"x": lambda text, words: F.size(words) == 0, "y": lambda text, words: F.length(text) > 3}
    got = {(r[1], r[2]): tuple(r[3:5]) for r in audit.audit(docs([(1, ""), (2, "abcd"), (3, "abcd"), (4, "ab")]), spark.createDataFrame([], LABELS), own, copies="z").collect()}
    assert len(got) == 18 and got["xyz", 1] == (3, 1) and got["xyz", 2] == (1, 2) and got["zyx", 1] == (3, 1)
