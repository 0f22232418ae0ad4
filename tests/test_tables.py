import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grams as gr
from tidemark.functions import text as ft
from tidemark.operators import news as nw
from tidemark.operators import outcomes as oc
from tidemark.operators import portfolio as pf
from tidemark.operators import watchlist as wl
from tidemark.sources import files as fl
from tidemark.sources import payloads as pl
from tidemark.sources import sinks as sk

WORDS = "a b c d e f".split()


def greedy(heads):
    kept = []
    for h in heads:
        w = h.split()
        pre = lambda x, y: x == y if len(x) < 5 else len(x) <= len(y) and y[: len(x)] == x
        if w and not any(pre(w, k) or pre(k, w) for k in kept):
            kept.append(w)
    return sorted(" ".join(k) for k in kept)


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_the_greedy_pass(spark, seed):
    r = random.Random(seed)
    heads = []
    for _ in range(120):
        base = ["x", "y", "z", r.choice("pq"), r.choice("rs")]
        heads.append(" ".join((base + [r.choice(WORDS[:2]) for _ in range(4)])[: r.randrange(3, 10)]))
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(heads)], "k string, i bigint, headline string").repartition(5)
    got = sorted(x.headline for x in nw.dedup_headlines(df, ["k"], ["i"]).collect())
    assert got == greedy(heads)


def test_keywords_match_words_not_parts(spark):
    df = spark.createDataFrame([("The mission",), ("earnings miss again",), ("épsilon",), ("EPS up",), ("대규모유상증자발표",)], "h string")
    tags = [r[0] for r in df.select(ft.event_tags(F.col("h"))).collect()]
    assert tags == [[], ["earnings"], [], ["earnings"], ["capital"]]
    risk = spark.createDataFrame([("Fed holds emergency meeting",), ("UN emergency meeting",), ("FedEx emergency meeting",)], "h string")
    assert [r[0] for r in risk.select(ft.risk_bucket(F.col("h"))).collect()] == ["emergency_central_bank", None, None]


def test_themes_drop_the_contained_gram_only_for_equal_tickers(spark):
    rows = [(t, f"alpha beta gamma n{t}", f"u{t}", t) for t in range(3)] + [(3, "alpha beta other", "u3", 3)]
    n = spark.createDataFrame(rows, "ticker bigint, headline string, url string, doc_id bigint")
    out = {r.gram: r.n_tickers for r in nw.themes(n, ["doc_id"]).collect()}
    # 'alpha beta' also has ticker 3, so only 'beta gamma' is covered by the trigram
    assert out == {"alpha beta": 4, "alpha beta gamma": 3}


def test_bounds_hold_for_every_gram(spark):
    r = random.Random(5)
    rows = [(k % 17, " ".join(r.choices(["a1", "b1", "c1", "The", "d-1", "x", "E1"], k=r.randrange(9)))) for k in range(400)]
    df = spark.createDataFrame(rows, "k bigint, text string").withColumn("line", F.col("text")).repartition(3)
    bound = gr.bounds(df, (2, 3))
    out = gr.grams_of(df, (2, 3), bound > 0, ("k", "line")).collect()
    want, tickers = [], {}
    for k, text in rows:
        ws = [w for w in re.findall("[A-Za-z0-9]+", text.lower()) if len(w) > 1 and w not in gr.Hashes.stop]
        for g in {" ".join(ws[i:i + n]) for n in (2, 3) for i in range(len(ws) - n + 1)}:
            want.append((k, text, g))
            tickers.setdefault(g, set()).add(k)
    assert sorted((x.k, x.line, x.gram) for x in out) == sorted(want)
    for (x, _, at, n), text in gr.line_grams([t for _, t in rows], (2, 3), gr.Hashes()):
        assert all(bound[int(x[i]) & gr.CELLS - 1] >= len(tickers[text(at[i], n[i])]) for i in range(len(x)))


@pytest.mark.parametrize("cells", [1, 4, 256])
def test_themes_of_any_first_floor(spark, monkeypatch, cells):
    monkeypatch.setattr(nw, "FIRST_CELLS", cells)
    r = random.Random(cells)
    rows = [(k % 9, " ".join(f"w{min(int(r.expovariate(0.4)), 9)}" for _ in range(8)), f"u{k}", k) for k in range(150)]
    n = spark.createDataFrame(rows, "ticker bigint, headline string, url string, doc_id bigint").repartition(3)
    per, count = {}, {}
    for t, h, _, _ in rows:
        w = h.split()
        for g in {" ".join(w[i:i + m]) for m in (2, 3) for i in range(9 - m)}:
            per.setdefault(g, set()).add(t)
            count[g] = count.get(g, 0) + 1
    often = {g for g in per if len(per[g]) >= 3 and count[g] >= 2}
    kept = [g for g in often if not any(len(b.split()) > len(g.split()) and f" {g} " in f" {b} " and per[b] == per[g] for b in often)]
    want = sorted(kept, key=lambda g: (-len(per[g]), -count[g], -len(g.split()), g))[:8]
    out = nw.themes(n, ["doc_id"]).collect()
    assert [(x.gram, x.n_tickers, x.headline_count, x.tickers) for x in out] == [(g, len(per[g]), count[g], sorted(per[g])) for g in want]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_positions_equal_the_sequential_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(pf, "CHUNK", chunk)
    r = random.Random(3)
    rows, book = [], {}
    for i in range(300):
        t, side = r.choice("AAAB"), r.choice(["BUY", "BUY", "SELL"])
        rows.append(("p", t, i, side, float(r.randrange(1, 9)), float(r.randrange(50, 150))))
    for _, t, _, side, q, p in rows:
        h = book.setdefault(t, [0.0, 0.0, 0.0])
        if side == "BUY":
            n = h[0] + q
            if n > 0:
                h[1] = (h[0] * h[1] + q * p) / n
            h[0] = n
        else:
            h[2] += (p - h[1]) * q
            h[0] -= q
    df = spark.createDataFrame(rows, "portfolio string, ticker string, i bigint, side string, quantity double, price double").repartition(6)
    got = pf.positions(df, ["portfolio", "ticker"], ["i"], open_only=False, blocks=7).collect()
    for x in got:
        q, avg, pnl = book[x.ticker]
        assert (x.quantity, x.avg_price, x.realized_pnl) == pytest.approx((q, avg, pnl))


def test_exit_ladder_precedence(spark):
    cols = ("price double, avg_price double, ma20 double, ma50 double, ma200 double, rsi14 double, overextension_level string, swing_high double, atr14 double,"
            " open_pred struct<direction:string,stop_price:double,target_price:double>, latest_pred struct<direction:string,status:string>")
    base = [110.0, 100.0, 105.0, 100.0, 90.0, 55.0, "NONE", 112.0, 3.0, None, None]

    def act(**kw):
        names = [c.split()[0] for c in "price,avg_price,ma20,ma50,ma200,rsi14,overextension_level,swing_high,atr14,open_pred,latest_pred".split(",")]
        row = tuple(kw.get(n, v) for n, v in zip(names, base))
        return pf.exit_actions(spark.createDataFrame([row], cols)).first().action

    assert act() == "ADD"
    assert act(price=None) == "WATCH"
    assert act(ma200=120.0) == "EXIT"
    assert act(open_pred=("BULL", 111.0, 130.0)) == "EXIT"
    assert act(open_pred=("BEAR", 111.0, 90.0)) == "WATCH"
    assert act(latest_pred=("BULL", "MISS")) == "EXIT"
    assert act(latest_pred=("BEAR", "MISS")) == "ADD"
    assert act(ma20=99.0) == "TRIM"
    assert act(rsi14=70.0) == "HOLD"
    assert act(ma200=None) == "WATCH"


def test_outcome_rules(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [
        ("miss first", "BULL", 94.0, None, 95.0, "1W"), ("zero target is absent", "BULL", 103.0, 0.0, None, "1W"),
        ("bear hit", "BEAR", 97.0, None, None, "1W"), ("neutral open", "NEUTRAL", 101.0, None, None, "1Y"),
        ("neutral drift", "NEUTRAL", 104.0, None, None, "1Y"), ("expired", "BULL", 101.0, None, None, "1W"),
    ]
    df = spark.createDataFrame([(*r, 100.0, t0, "US") for r in rows], "n string, direction string, price double, target_price double, stop_price double, timeframe string, entry_price double, created_at timestamp, market string")
    got = {r.n: (r.new_status, r.new_return) for r in oc.outcome(df, "2024-02-01").collect()}
    assert got == {
        "miss first": ("MISS", -6.0), "zero target is absent": ("HIT", 3.0), "bear hit": ("HIT", 3.0),
        "neutral open": (None, 1.0), "neutral drift": ("MISS", 4.0), "expired": ("EXPIRED", 1.0),
    }


def test_edges_rearm_and_respect_the_cooldown(spark):
    t0 = dt.datetime(2024, 1, 1)
    on = {0: True, 1: True, 2: False, 3: True, 5: False, 8: True, 9: False, 13: True, 14: False, 14.5: True}
    obs = spark.createDataFrame([("k", t0 + dt.timedelta(hours=h), i, 1.0, s) for i, (h, s) in enumerate(on.items())], "key string, ts timestamp, event_id bigint, price double, satisfied boolean")
    got = sorted((r.ts - t0).total_seconds() / 3600 for r in wl.fire(wl.edges(obs)).collect())
    # 3 h is suppressed (and uses up its edge), 13 h is within six hours of 8 h, 14.5 h is not
    assert got == [0, 8, 14.5]


def test_transaction_file_outputs(spark):
    lines = spark.createDataFrame(
        [(1, "2024-01-01", "ABC", "buy", "1", "2", ), (2, "2024-01-01", "ABC", "BUY", "1", "2"), (3, "2024-01-01", "ABC", "BUY", "1.0", "2"), (4, "2024-01-01", "A1", "HOLD", "x", "-1")],
        "line bigint, date string, ticker string, side string, quantity string, price string",
    )
    out = {r.line: (len(r.errors), r.duplicate) for r in fl.parse_transactions(lines, "US").collect()}
    assert out == {1: (0, False), 2: (0, True), 3: (0, False), 4: (4, False)}


def test_snapshot_replaces_only_its_partitions(spark, tmp_path):
    p = str(tmp_path / "snap")
    sk.write_snapshot(spark.createDataFrame([("US", 1), ("KR", 2)], "market string, v int"), p)
    sk.write_snapshot(spark.createDataFrame([("US", 9)], "market string, v int"), p)
    assert sorted((r.market, r.v) for r in spark.read.parquet(p).collect()) == [("KR", 2), ("US", 9)]
    sk.append_log(spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), str(tmp_path / "log"))
    assert [r.id for r in sk.read_log(spark, str(tmp_path / "log"), 1).collect()] == [2]


def test_csv_rows_that_do_not_fit_are_counted_or_stop_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('day,value\n2024-01-01,1.5\n2024-01-02,\n2024-01-03,x\n2024-01-04,2,3\n"2024-01-05","4"\n')
    schema = "day date, value double"
    rows = {str(r.day): (r.value, r.line) for r in fl.read_csv(spark, str(tmp_path / "a.csv"), schema, corrupt="line").collect()}
    assert rows == {"2024-01-01": (1.5, None), "2024-01-02": (None, None), "2024-01-03": (None, "2024-01-03,x"), "2024-01-04": (2.0, "2024-01-04,2,3"), "2024-01-05": (4.0, None)}
    with pytest.raises(Exception, match="(?i)malformed"):
        fl.read_csv(spark, str(tmp_path / "a.csv"), schema, strict=True).collect()
    assert fl.read_csv(spark, str(tmp_path / "a.csv"), null="x").where("value IS NULL").count() == 2
    with pytest.raises(ValueError):
        fl.read_csv(spark, str(tmp_path / "a.csv"), corrupt="line")


def test_corporate_codes_by_ticker(spark):
    codes = spark.createDataFrame([("9", "000001 "), ("8", "000001"), ("7", "000002"), ("7", "000002")], "corp_code string, stock_code string")
    wanted = spark.createDataFrame([("000001",), ("000002",), ("000003",), (None,)], "ticker string")
    assert {r.ticker: r.corp_code for r in pl.corp_code_of(wanted, codes).collect()} == {"000001": "8", "000002": "7", "000003": None, None: None}
