from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup as D

ROWS = [(1, "a"), (2, "a"), (9, "b"), (3, None), (4, ""), (5, "x" * 300_000), (6, "x" * 300_000), (7, "A"), (8, "a "), (2, "a"), (None, "c"), (10, "c"), (None, "d")] \
    + [(100 + i, "hot") for i in range(60)]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("digest", [D.sha256, lambda c: F.substring(c, 1, 1), lambda c: F.lit("same")])
def test_membership_equals_brute_force_whatever_the_digest(docs, digest):
    got = D.membership(docs(ROWS, keep_id=1, kept="x", digest="y"), digest, salts=3, hot_groups=1)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_deduplicated_keeps_one_row_of_each_text_with_its_columns(docs):
    df = docs(ROWS, best=1, n="z", salt=3)
    kept = D.deduplicated(df, salts=3)
    assert kept.columns == df.columns
    want = {t: k for t, k in {(t or ""): k for i, k, *_ in brute(ROWS) for t in [dict(ROWS).get(i)]}.items()}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len({t or "" for _, t in ROWS})
    for i, t in got:
        assert i == max((j for j, u in ROWS if (u or "") == (t or "") and j is not None), default=None)
    assert (4, "") in got and (10, "c") in got and want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.n == "z" for r in kept.collect())


def test_empty_table(docs):
    empty = docs(ROWS).where("false")
    assert D.membership(empty).count() == 0 and D.deduplicated(empty).count() == 0
