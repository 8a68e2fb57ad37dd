"""The search equals exact scoring of all pairs."""

import math
import random

import numpy as np
import pytest

from ledgerlens.llm import vector_search as vs

TYPE = "vec_id long, embedding array<float>, label int"


def _plain(rows, queries, k):
    """Every query row against every row, with Python's integers."""
    def q(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]
    rows = [(i, q(v)) for i, v, *_ in rows]
    out = []
    for i, a in [(i, q(v)) for i, v, *_ in queries]:
        if i is None or a is None:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), j) for j, b in rows if b is not None and len(b) == len(a) and j != i]
        scored.sort(key=lambda s: (-s[0], math.inf if s[1] is None else s[1]))
        out += [(i, n, j, max(min(s, 2 ** 63 - 1), -2 ** 63)) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


def _got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(str(tuple(r)) for r in df.collect())


def _search(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], TYPE).repartition(3)
    return _got(vs.top_k(df, df.where("vec_id % 50 = 0"), k, **more))


@pytest.mark.parametrize(("dim", "kind"), [(1, "any"), (3, "any"), (5, "ties"), (32, "any"), (64, "clusters"), (33, "ties")])
def test_equals_plain(spark, dim, kind):
    rnd = np.random.default_rng(dim)
    x = {"any": lambda: rnd.normal(size=(700, dim)) / math.sqrt(dim), "ties": lambda: rnd.integers(-2, 3, size=(700, dim)) / 256,
         "clusters": lambda: rnd.normal(size=(9, dim))[rnd.integers(0, 9, 700)] + 0.05 * rnd.normal(size=(700, dim))}[kind]()
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    queries = [r for r in rows if r[0] % 50 == 0]
    assert _search(spark, rows) == _plain(rows, queries, 5)


def test_defined_cases(spark):
    rnd = random.Random(3)
    vector = lambda n: [rnd.choice((-0.5, 0.25, 1.0, 0.004)) for _ in range(n)]
    rows = [(i, vector(rnd.choice((2, 4, 4, 4)))) for i in range(180)]
    rows += [(200, None), (201, None), (250, []), (251, []), (300, [None, 1.0]), (301, [1.0, None]), (350, [math.inf, 1.0]), (351, [1.0, math.nan]), (None, vector(4)), (None, vector(2)),
             (50, vector(4)), (50, vector(4)), (3, vector(4)), (3, vector(4)), (400, vector(7)), (-50, vector(4)), (-3, vector(4))]
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    got = _search(spark, rows)
    assert got == _plain(rows, queries, 5) and not any(x.startswith("(400,") for x in got)


def test_few_rows_and_none(spark):
    assert _search(spark, []) == []
    assert _search(spark, [(0, [1.0])]) == []
    assert _search(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert _search(spark, [(0, [1.0]), (1, [-1.0])]) == ["(0, 1, 1, -65536)"]


def test_blocks_of_queries(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(rnd.normal(size=(900, 8)))]
    assert _search(spark, rows, block=6) == _plain(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_large_components_stay_exact(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice((-1, 1)) * 10.0 ** rnd.randrange(0, 38) for _ in range(5)]) for i in range(120)] + [(120 + i, [rnd.random() for _ in range(5)]) for i in range(50)]
    cut = lambda v: [max(min(math.floor(256 * float(np.float32(x))), 2 ** 63 - 1024), -2 ** 63) for x in v]
    queries = [r for r in rows if r[0] % 50 == 0]
    want = []
    for i, a in queries:
        scored = [(max(min(sum(x * y for x, y in zip(cut(a), cut(b))), 2 ** 63 - 1), -2 ** 63), j) for j, b in rows if j != i]
        want += [(i, n, j, s) for n, (s, j) in enumerate(sorted(scored, key=lambda s: (-s[0], s[1]))[:5], 1)]
    assert _search(spark, rows) == sorted(map(str, want))


def test_queries_of_another_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, 2) for i in range(20)], "vec_id long, embedding array<double>, `a.b` int, score int")
    asked = spark.createDataFrame([(100, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = vs.top_k(df, asked, 2).collect()
    assert sorted(map(tuple, got)) == [(3, 1, 0, 0), (3, 2, 1, -65536), (100, 1, 19, 19 * 65536), (100, 2, 18, 18 * 65536)]


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 64))
    x = np.floor(256 * (centres[rnd.integers(0, 20, 400)] + 0.02 * rnd.normal(size=(400, 64))))
    side = vs.Side(np.arange(400), x)
    every = np.arange(400)
    true = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    last = None
    for level in range(len(side.levels)):
        bound = vs.lower_bounds(side, side, level, every, every)
        assert (bound <= true * (1 + 1e-9) + 1e-3).all()
        # finer statistics never bound worse
        assert last is None or (bound >= last - 1e-3).all()
        last = bound
    near = np.sort(true, axis=1)[:, 5]
    assert (last > near[:, None]).mean() > 0.5
