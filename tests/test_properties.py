"""Property tests: exact half-up ratios, band partition, NTILE sizes."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings, strategies as st

from ledgerlens.functions import band, pct, ratio

pairs = st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**9)), min_size=1, max_size=40)


def _half_up(num, den, digits, scale=1):
    q = Decimal(num) * scale / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


@settings(max_examples=15, deadline=None)
@given(pairs, st.integers(0, 4))
def test_pct_equals_exact_decimal_half_up(spark, rows, digits):
    df = spark.createDataFrame(rows, "k long, n long")
    got = [r[0] for r in df.select(pct("k", "n", digits)).collect()]
    assert got == [_half_up(k, n, digits, 100) for k, n in rows]


cents = st.lists(st.tuples(st.integers(0, 10**11), st.integers(1, 10**6)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(cents)
def test_money_mean_equals_exact_decimal_half_up(spark, rows):
    data = [(Decimal(c).scaleb(-2), n) for c, n in rows]
    df = spark.createDataFrame(data, "s decimal(22,2), n long")
    got = [r[0] for r in df.select(ratio("s", "n", 2)).collect()]
    assert got == [_half_up(c, n * 100, 2) for c, n in rows]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=50),
       st.lists(st.floats(-1e5, 1e5, allow_nan=False), min_size=1, max_size=5, unique=True))
def test_band_assigns_each_value_to_exactly_its_interval(spark, values, edges):
    edges = sorted(edges)
    labels = [f"b{i}" for i in range(len(edges) + 1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(band("x", edges, labels)).collect()]
    for v, lab in zip(values, got):
        if v is None:
            assert lab == labels[-1]
        else:
            assert lab == labels[sum(1 for e in edges if v >= e)]


signed = st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(-10**9, 10**9).filter(lambda d: d != 0)),
                  min_size=1, max_size=30)


@settings(max_examples=15, deadline=None)
@given(signed, st.integers(0, 3))
def test_oracle_rounding_equals_spark_decimal_rounding(spark, rows, digits):
    import duckdb
    from ledgerlens.oracle import pct as sql_pct
    df = spark.createDataFrame(rows, "k long, n long")
    got = [r[0] for r in df.select(pct("k", "n", digits)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, k BIGINT, n BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, k, n) for i, (k, n) in enumerate(rows)])
    want = [r[0] for r in con.execute(f"SELECT {sql_pct('k', 'n', digits)} FROM t ORDER BY i").fetchall()]
    assert got == want
