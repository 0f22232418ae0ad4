import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gold, series
from tidemark.session import row_index, running_totals

D0 = dt.date(2020, 1, 1)


def walk(seed, n):
    r = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        price = max(5.0, price + r.uniform(-3, 3))
        out.append((f"t{seed}", D0 + dt.timedelta(days=i), price, price + 1, price - 1, r.randrange(1, 1000)))
    return out


def bars_df(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume bigint")


def wilder(xs, period=14):
    if len(xs) < period:
        return None
    v = sum(xs[:period]) / period
    for x in xs[period:]:
        v = (v * (period - 1) + x) / period
    return v


@pytest.mark.parametrize("period", [1, 2, 5, 14, 100, 500])
def test_rsi_and_atr_match_the_recursion_for_any_period(spark, period):
    rows = walk(1, 10_000)
    df = bars_df(spark, rows)
    closes = [r[2] for r in rows]
    got = [r.rsi14 for r in series.rsi(df, period=period).orderBy("date").collect()]
    atr = [r.atr14 for r in series.atr(df, period=period).orderBy("date").collect()]
    for i in [*range(20), 398, 501, 829, 830, 831, 1660, 2579, 2581, 5160, 8700, 9999]:
        ch = [closes[j] - closes[j - 1] for j in range(1, i + 1)]
        g, l = wilder([max(c, 0) for c in ch], period), wilder([max(-c, 0) for c in ch], period)
        tr = wilder([max(rows[j][3] - rows[j][4], abs(rows[j][3] - closes[j - 1]), abs(rows[j][4] - closes[j - 1])) for j in range(1, i + 1)], period)
        tol = 1e-7
        if g is None:
            assert got[i] is None and atr[i] is None
        else:
            assert got[i] == pytest.approx(100 - 100 / (1 + g / l) if l else (100.0 if g else 50.0), abs=tol)
            assert atr[i] == pytest.approx(tr, abs=tol)


def test_rsi_of_flat_and_rising_series(spark):
    flat = [("f", D0 + dt.timedelta(days=i), 10.0, 10.0, 10.0, 1) for i in range(20)]
    up = [("u", D0 + dt.timedelta(days=i), 10.0 + i, 10.0, 10.0, 1) for i in range(20)]
    out = {r.ticker: r.rsi14 for r in series.horizon_metrics(bars_df(spark, flat + up)).collect()}
    assert out == {"f": 50.0, "u": 100.0}
    simple = {r.ticker: r.rsi for r in series.last_rows(series.rsi_simple(bars_df(spark, up[:10]))).collect()}
    assert simple == {"u": 50.0}


def test_latest_metrics_equal_the_last_rolling_row(spark):
    df = bars_df(spark, walk(2, 300) + walk(3, 60) + walk(4, 7))
    a = {r.ticker: r.asDict() for r in series.horizon_metrics(df, extra=True).collect()}
    b = {r.ticker: r.asDict() for r in series.last_rows(series.rolling_metrics(df, extra=True)).collect()}
    for t, row in a.items():
        for k, v in row.items():
            if k == "max_drawdown_1y":
                continue
            if isinstance(v, float):
                assert v == pytest.approx(b[t][k], abs=1e-9), (t, k)
            else:
                assert v == b[t][k], (t, k)


def test_partial_windows_are_null(spark):
    r = series.horizon_metrics(bars_df(spark, walk(5, 19))).first()
    assert r.ma20 is None and r.return_1m is None and r.return_1w is not None


def test_drawdown(spark):
    closes = [10, 12, 6, 9, 13]
    rows = [("d", D0 + dt.timedelta(days=i), float(c), 1.0, 1.0, 1) for i, c in enumerate(closes)]
    assert series.horizon_metrics(bars_df(spark, rows)).first().max_drawdown_1y == pytest.approx(-0.5)
    assert series.drawdown_last(bars_df(spark, rows)).first().max_drawdown_1y == pytest.approx(-0.5)


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = walk(6, 120) + walk(7, 120)
    one = series.horizon_metrics(bars_df(spark, rows)).orderBy("ticker").collect()
    random.Random(0).shuffle(rows)
    two = series.horizon_metrics(bars_df(spark, rows).repartition(7)).orderBy("ticker").collect()
    for x, y in zip(one, two):
        for k, v in x.asDict().items():
            assert v == pytest.approx(y[k], rel=1e-12) if isinstance(v, float) else v == y[k]


def test_global_running_totals_across_blocks(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.col("id").alias("v"))
    got = running_totals(df, ["k"], {"s": F.col("v")}, blocks=6).orderBy("k").collect()
    acc = 0
    for r in got:
        acc += r.v
        assert r.s == acc
    idx = row_index(df, ["k"], blocks=6).orderBy("k").collect()
    assert [r.row_idx for r in idx] == list(range(500))


def test_gold_subscore_bands(spark):
    v = spark.createDataFrame([(-4.0,), (-5.0,), (-20.0,), (-35.0,)], "x double")
    got = [r[0] for r in v.select(gold.bands(F.col("x"), [(">", -5, 40.0), (">", -20, 100.0), (">", -35, 70.0)], 30.0)).collect()]
    assert got == [40.0, 100.0, 70.0, 30.0]
    assert math.isclose(gold.GRAMS_PER_OZ, 31.1035)
