import datetime as dt
import random

from tidemark.operators import paper


def walk(bars, lot):
    i, ticker, stop, target, entry, end = lot
    for t, d, low, high, close in sorted((b for b in bars if b[0] == ticker), key=lambda b: b[1]):
        if entry is None or d <= entry:
            continue
        if stop is not None and low is not None and low <= stop:
            return (i, str(d), "stop_hit", stop)
        if target is not None and high is not None and high >= target:
            return (i, str(d), "target_hit", target)
        if end is not None and d >= end:
            return (i, str(d), "horizon_exit", close)
    return None


def test_first_exits_are_what_a_walk_over_the_bars_finds(spark):
    g, d0 = random.Random(9), dt.date(2024, 1, 1)
    bars = []
    for t in "AB":
        for k in range(120):
            p = 100 + g.gauss(0, 6)
            bars.append((t, d0 + dt.timedelta(days=k * 2), g.choice([None, p - 2, p - 2, p - 2]), g.choice([None, p + 2, p + 2]), p))
    some = lambda x: g.choice([None, x, x, x])
    lots = [(i, g.choice("AAAABC"), some(100.0 - g.randrange(5, 25)), some(100.0 + g.randrange(5, 25)), some(d0 + dt.timedelta(days=g.randrange(-5, 250))), some(d0 + dt.timedelta(days=g.randrange(0, 300)))) for i in range(400)]
    b = spark.createDataFrame(bars, "ticker string, date date, low double, high double, close double")
    asked = spark.createDataFrame(lots, "id int, ticker string, stop_price double, target_price double, entry_date date, horizon_end date")
    got = paper.exit_signals(asked, b).collect()
    assert sorted((r.id, str(r.date), r.reason, r.exit_price) for r in got) == [w for x in lots if (w := walk(bars, x))]


def test_bars_are_copied_by_the_lots_of_their_ticker_alone(spark):
    d0 = dt.date(2024, 1, 1)
    bars = [(t, d0 + dt.timedelta(days=k), 90.0 + k, 95.0 + k, 92.0 + k) for t in ("A", "B", "C", None) for k in range(50)]
    lots = [(i, "A" if i < 250 else ("B", "D", None)[i % 3], 80.0, 100.0 + i % 30, d0 + dt.timedelta(days=i % 40), d0 + dt.timedelta(days=i % 60)) for i in range(280)]
    b = spark.createDataFrame(bars, "ticker string, date date, low double, high double, close double")
    asked = spark.createDataFrame(lots, "id int, ticker string, stop_price double, target_price double, entry_date date, horizon_end date")
    want, real, dealt = [w for x in lots if x[1] and (w := walk(bars, x))], paper.beside, []

    def seen(held, *rest):
        dealt.append(held.where("low IS NOT NULL").count())
        return real(held, *rest)

    paper.beside = seen
    try:
        for share in ((), (100,)):
            got = paper.exit_signals(asked, b, *share).collect()
            assert sorted((r.id, str(r.date), r.reason, r.exit_price) for r in got) == sorted(want)
    finally:
        paper.beside = real
    assert dealt == [100, 200]  # of 200 bars: one copy for the lots of A and B each; three for A and one for B
