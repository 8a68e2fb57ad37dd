from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash as S
from ledgerlens.llm.fingerprints import fingerprint


def plain_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps, bits):
    part = list(range(len(ids)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                part[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{fps[k]:016x}", least.get(find(k))) for k, i in enumerate(ids)]


def test_fingerprints_equal_the_plain_form():
    rng = random.Random(3)
    texts = ["", None, " \t\n", "One", "one TWO", "É é x ÀB", "a b c", "\x1c\x1d a\x85b"] + [" ".join(rng.choice("ab cd ef GH".split()) for _ in range(rng.randint(1, 400))) for _ in range(20)]
    assert [fingerprint(t) % 2**64 for t in texts] == [plain_fingerprint(t) for t in texts]
    # the sets of a very long text are counted in chunks
    long = "x y z w " * 60_000
    assert fingerprint(long) % 2**64 == plain_fingerprint(long)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5, 7])
def test_links_lose_no_pair(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 8))) for b in base for _ in range(12)]
    # differences next to each other, across segment borders and around the ring
    near += [b ^ (((1 << k) - 1) << s) % 2**64 ^ (1 if s else 0) for b in base[:10] for k in (1, 2, 3) for s in (0, 7, 31, 61, 63)]
    fps = sorted(set(base + near + [0, 2**64 - 1]))
    a = np.array(fps, dtype=np.uint64)
    want = {(min(x, y), max(x, y)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= bits) for x, y in [(int(a[i].astype(np.int64)), int(a[j].astype(np.int64)))]}
    got = S.links(spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long"), bits)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_star_roots_of_paths_stars_and_cycles(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    edges = path + [(1, i) for i in range(2, 30)] + [(50, 51), (51, 52), (50, 52)] + [(200, 139)]
    got = {r.node: r.root for r in S.star_roots(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert got == {**{i: 100 for i in (*range(101, 141), 200)}, **{i: 1 for i in range(2, 30)}, 51: 50, 52: 50}


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(25):
        text = [rng.choice(words) for _ in range(200)]
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(200)] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(900, None), (901, ""), (902, "  "), (3, rows[3][1]), (None, rows[0][1]), (None, "alone with no id")]


def test_components_equal_brute_force(docs):
    rows = near_rows()
    got = sorted(map(tuple, S.components(docs(rows, fp=1, component_id="x", n=2)).collect()), key=str)
    assert got == sorted(brute([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows], 3), key=str)
    assert len({c for *_, c in got}) < len(rows) - 10


def test_representatives_keep_one_row_of_each_component(docs):
    rows = near_rows()
    df = docs(rows, nth=7, gone="g")
    kept = S.representatives(df)
    named = brute([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows], 3)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [c for c in {c for *_, c in named if c is not None}] + [None]))
    assert {r.gone for r in kept.select(F.col("gone")).collect()} == {"g"}


def test_empty_table(docs):
    assert S.components(docs([(1, "a")]).where("false")).count() == 0
    assert S.representatives(docs([(1, "a")]).where("false")).count() == 0
