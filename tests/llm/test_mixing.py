from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Fill by weight; what stands above twice the size is shared again until none does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()) * 1.5, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / heavy for s in order}
        more = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            return target
        full |= more


def brute(rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    out, seen, md5 = [], Counter(), lambda x: hashlib.md5(x.encode()).hexdigest()
    lines = defaultdict(list)
    for i, t, _, s in rows:
        ident = md5(":".join(("0", "null" if i is None else str(i), "n" if s is None else f"s{s}", md5(t or ""))))
        lines[s].append((md5(f"{ident}:{seen[ident]}"), size(t), i))
        seen[ident] += 1
    for s in sizes:
        quota, begin = int(target[s] + 0.5), 0
        for _, n, i in sorted(lines[s], key=lambda x: x[0]):
            took = sum(max(0, min(n, quota - p * sizes[s] - begin)) for p in (0, 1))
            out.append((i, n, sizes[s], round(target[s], 6), took))
            begin += n
    return sorted(out, key=str)


def some_rows(seed, n=120):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z", None, "", "hot"]
    rows = [(i, " ".join("w" * rng.randint(0, 60)) if rng.random() < 0.9 else rng.choice([None, "", " \n"]), "en", rng.choice(names if rng.random() < 0.6 else ["hot"])) for i in range(n)]
    return rows + [(n, "long " * 20_000, "en", "a"), (n + 1, "x", "en", "tiny"), rows[3], rows[3], (None, "no id here", "en", "a")]


@pytest.mark.parametrize(("seed", "block"), [(1, 16), (2, 4096), (3, 1)])
def test_mix_equals_the_closed_form(docs, seed, block):
    rows = some_rows(seed) if block > 1 else [r for r in some_rows(seed) if size(r[1]) < 1000]
    df = M.mix(docs(rows, size=1, taken="x", h=2, target="y"), block=block)
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)
    assert got == brute(rows)


def test_schedule_is_low_discrepancy_and_complete(spark):
    targets = spark.createDataFrame([("a", 100_000, 150_000.0, 150_000), ("b", 300_000, 50_000.0, 50_000), ("c", 90_000, 100_000.0, 100_000), ("z", 0, 0.0, 0)],
                                    "source string, source_size long, target double, quota long")
    slots = M.schedule(targets, block=100).collect()
    words, seen = Counter(), Counter()
    for r in slots:
        words[r.source] += r.words
    assert words == {"a": 150_000, "b": 50_000, "c": 100_000}
    drawn = sorted((r for r in slots if r.slot is not None), key=lambda r: r.slot)
    assert len(drawn) > 0.99 * len(slots)
    for n, r in enumerate(drawn, 1):
        assert r.rank == seen[r.source]
        seen[r.source] += 1
        if n > 50:
            assert abs(seen["a"] - n / 2) < 10 and abs(seen["b"] - n / 6) < 10
    assert {r.block_no for r in slots if r.source == "b"} == set(range(500))


def test_mixed_rows_hold_the_taken_words(docs):
    rows = some_rows(4)
    df = docs(rows, took="t", mix_size=3, v=1)
    mixed = M.mixed_rows(df, block=64)
    assert mixed.columns == df.columns
    out = mixed.collect()
    took = Counter()
    for i, *_, t in brute(rows):
        took[i] += t
    got = Counter()
    text = {i: t for i, t, *_ in rows}
    for r in out:
        got[r.doc_id] += size(r.text)
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert +got == +took
    assert sum(r.text != text[r.doc_id] for r in out) <= 2 * 8


def test_null_repeated_and_identical_rows_are_spread(docs):
    # a third of the rows has no id, a third one id, a third is one row
    rows = [(None, f"a{i} b", "en", "s") for i in range(2000)] + [(7, f"c{i} d", "en", "s") for i in range(2000)] + [(9, "e f", "en", "s")] * 2000
    line = M._shuffled(M._sized(docs(rows)), 0)
    # 6,000 rows over 4,096 cells
    assert line.groupBy("source", "cell").count().agg(F.max("count")).first()[0] < 16
    assert line.select("key").distinct().count() == line.count() == 6000
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in M.mix(docs(rows), block=64).collect()), key=str)
    assert got == brute(rows)


def test_first_words(spark):
    row = spark.range(1).select(*[M.first_words(F.lit(t), F.lit(n)) for t, n in (("a b c", 2), ("  a\n\tb c ", 1), ("  a\n\tb c ", 2), ("one", 1), ("one two ", 5))]).first()
    assert tuple(row) == ("a b", "  a", "  a\n\tb", "one", "one two")


def test_no_words_and_no_rows(docs):
    got = M.mix(docs([(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    empty = docs([(1, "a")]).where("false")
    assert M.mix(empty).count() == 0 and M.mixed_rows(empty).count() == 0
    assert M.mixed_rows(docs([(1, None), (2, " ")])).count() == 0
