import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as fd
from tidemark.functions import stats
from tidemark.operators import accuracy as acc
from tidemark.operators.backtest import first_touch


def exact_p(k, n):
    if n == 0:
        return 1.0
    pmf = [math.comb(n, i) / 2**n for i in range(n + 1)]
    return min(1.0, sum(p for p in pmf if p <= pmf[k] * (1 + 1e-9)))


def test_binomial_matches_the_exact_sum(spark):
    pairs = [(k, n) for n in (0, 1, 2, 5, 12, 13, 60, 301) for k in range(0, n + 1, max(1, n // 9))]
    df = spark.createDataFrame(pairs, "k bigint, n bigint").withColumn("p", stats.binomial_p_half(F.col("k"), F.col("n")))
    for r in df.collect():
        assert r.p == pytest.approx(exact_p(r.k, r.n), rel=1e-9)
    big = spark.createDataFrame([(500_500, 1_000_000)], "k bigint, n bigint")
    assert big.select(stats.binomial_p_half(F.col("k"), F.col("n"))).first()[0] == pytest.approx(0.3178, abs=2e-3)


def pav(points):
    blocks = []
    for x, y, w in points:
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [b[0] for b in blocks for _ in range(b[2])]


def test_isotonic_equals_pool_adjacent_violators(spark):
    r = random.Random(5)
    for n in (1, 2, 5, 9):
        pts = [(float(i), r.random(), float(r.randrange(1, 9))) for i in range(n)]
        df = spark.createDataFrame([(pts,)], "p array<struct<x:double,y:double,w:double>>")
        got = [q["y"] for q in df.select(stats.isotonic_fit(F.col("p"))).first()[0]]
        assert got == pytest.approx(pav(pts))


def test_interpolation_clamps_and_passes_through_without_anchors(spark):
    df = spark.createDataFrame([(c, [(0.5, 0.2), (0.7, 0.4)]) for c in (0.1, 0.5, 0.6, 0.7, 0.9)], "c double, a array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(stats.interpolate(F.col("c"), F.col("a"))).collect()]
    assert got == pytest.approx([0.2, 0.2, 0.3, 0.4, 0.4])
    none = spark.createDataFrame([(0.3, None)], "c double, a array<struct<x:double,y:double>>")
    assert none.select(stats.interpolate(F.col("c"), F.col("a"))).first()[0] == 0.3


def test_business_days_against_enumeration(spark):
    r = random.Random(1)
    rows = []
    for _ in range(300):
        a = dt.date(1969, 1, 1) + dt.timedelta(days=r.randrange(20000))
        rows.append((a, a + dt.timedelta(days=r.randrange(-5, 60))))
    for x in spark.createDataFrame(rows, "a date, b date").withColumn("n", fd.business_days(F.col("a"), F.col("b"))).collect():
        want = sum((x.a + dt.timedelta(days=i)).weekday() < 5 for i in range(1, (x.b - x.a).days + 1))
        assert x.n == want


@pytest.mark.parametrize("path,want", [
    ([101.0, 104.0], "HIT"), ([94.0, 110.0], "MISS"), ([95.0, 104.0], "MISS"), ([103.0, 90.0], "HIT"),
    ([101.0, 102.0], "EXPIRED"), ([101.0], None),
])
def test_first_touch_takes_the_first_bar_and_censors_short_paths(spark, path, want):
    df = spark.createDataFrame([(100.0, path)], "e double, p array<double>")
    got = df.select(first_touch(F.col("e"), F.col("p"), 2)).first()[0]
    assert (got and got["status"]) == want


def preds(spark, statuses, conf=None):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (i, "A", s, (conf[i] if conf else 0.6), None, t0, t0 + dt.timedelta(days=i), 1.0, ["x"], "LIVE", "1W", "US")
        for i, s in enumerate(statuses)
    ]
    return spark.createDataFrame(rows, "id bigint, ticker string, status string, confidence double, raw_confidence double, created_at timestamp,"
                                 " outcome_date timestamp, outcome_return double, signals array<string>, source string, timeframe string, market string")


@pytest.mark.parametrize("seq,want", [
    (["MISS", "HIT", "EXPIRED", "HIT"], 2), (["HIT", "MISS", "MISS"], -2), (["HIT", "HIT"], 2), (["EXPIRED"], 0), (["HIT", "EXPIRED"], 1),
])
def test_streak_skips_expired(spark, seq, want):
    assert acc.track_record(preds(spark, seq), []).first().current_streak == want


def test_calibration_edges(spark):
    conf = [0.49, 0.5, 0.6, 0.999, 1.0]
    out = {r.confidence_range: r["count"] for r in acc.calibration(preds(spark, ["HIT"] * 5, conf)).collect()}
    assert out == {"0.50-0.60": 1, "0.60-0.70": 1, "0.90-1.00": 2}


def test_bootstrap_brackets_the_point_and_repeats(spark):
    p = preds(spark, ["HIT", "MISS", "HIT"] * 60)
    a, b = acc.bootstrap_ci(p, 200).first(), acc.bootstrap_ci(p.repartition(5), 200).first()
    assert a == b and a.win_rate_lo < a.win_rate < a.win_rate_hi


def test_a_cell_draws_what_its_rows_would_draw_together():
    """The sum of n Poisson(1) weights is Poisson(n): mean, variance and every frequency of the inverted draws."""
    for n in (1, 3, 40, 5_000, 10**9):
        u = (np.arange(200_000) * (stats.HASH_PRIME / 200_000)).astype(np.int64)
        w = stats.poisson_draws(n, u)
        assert abs(w.mean() - n) < 0.01 * n**0.5 and abs(w.var() / n - 1) < 0.01
        if n < 100:
            p = [math.exp(k * math.log(n) - n - math.lgamma(k + 1)) for k in range(3 * n + 10)]
            assert np.abs(np.bincount(w, minlength=len(p))[:len(p)] / len(u) - p).max() < 2e-5


def test_bootstrap_work_follows_the_cells(spark):
    few = acc.bootstrap_ci(preds(spark, ["HIT", "MISS", "HIT"] * 400), 500).first()
    sd = (2 / 3 * 1 / 3 / 1200) ** 0.5
    assert abs((few.win_rate_hi - few.win_rate_lo) / (2 * 1.96 * sd) - 1) < 0.15


def test_permutation_selection_is_exact_for_any_cell_count(spark):
    r = random.Random(2)
    st = ["HIT" if r.random() < 0.5 else "MISS" for _ in range(150)]
    p = preds(spark, st, [r.random() for _ in st])
    assert acc.permutation_test(p, 100, cells=4).first() == acc.permutation_test(p, 100, cells=256).first()
    one = acc.permutation_test(preds(spark, ["HIT"] * 4), 20).first()
    assert (one.observed_diff, one.p_value) == (0.0, 1.0)


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1), (0.2, 1)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = acc.brier_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert got.auc == pytest.approx(want)


def test_bootstrap_draws_a_weight_per_row(spark):
    u = np.random.default_rng(3).integers(0, stats.HASH_PRIME, 3000)
    want = [r[0] for r in spark.createDataFrame([(int(x),) for x in u], "u long").select(stats.poisson1(F.col("u"))).collect()]
    assert stats.poisson1_draws(u).tolist() == want
    # rows of one cell with other ids are other draws
    p = preds(spark, ["HIT", "MISS", "HIT"] * 40)
    first = acc.bootstrap_ci(p, 300).first()
    lo = p.selectExpr("min(id)").first()[0]
    other = p.withColumn("id", F.when(F.col("id") == lo, F.col("id")).otherwise(F.col("id") + 1_000_003))
    assert acc.bootstrap_ci(other, 300).first() != first
