"""Ties and limits that only larger tables meet."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import dates as fd
from tidemark.functions import windows as fw
from tidemark.operators import gold, series
from tidemark.catalog.portfolio import PROGRESS
from tests.conftest import SF
from tools.check_oracle import canon

D0 = dt.date(2020, 1, 1)


def repeating(spark, n=320, period=20):
    """Closes that repeat every `period` bars: each mean over a multiple of it is the same number."""
    rows = [("t", D0 + dt.timedelta(days=i), (10_000 + (i % period) ** 2 * 7) / 100.0, 10 + i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")


def matches(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert got == canon([d[0] for d in cur.description], cur.fetchall())
    return got


def test_equal_means_are_equal_at_every_bar(spark):
    b = repeating(spark)
    w = fw.series_window()
    m = b.select(fw.price_mean(F.col("close"), w, 200).alias("a")).where("a IS NOT NULL")
    assert m.distinct().count() == 1
    assert gold.technical(b).where("ma200_rising").count() == 0
    r = series.rolling_metrics(b).where("ma200 IS NOT NULL")
    assert r.select("ma20", "ma200").distinct().collect() == [tuple([r.first().ma200] * 2)]
    last = series.horizon_metrics(b).first()
    assert last.ma20 == last.ma200 == r.first().ma200


def test_means_of_a_running_sum_are_those_of_the_frames(spark):
    rows = [("ab"[i % 2], D0 + dt.timedelta(days=i), None if i % 50 == 7 else 5.0 + i % 13 / 100, i) for i in range(180)]
    b = spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")
    w = fw.series_window()
    both, over = fw.frame_sums(b, w, fw.whole(F.col("close")), "_c")
    both = both.select(*[fw.whole_mean(over(n), n).alias(f"x{n}") for n in (5, 20)], *[fw.price_mean(F.col("close"), w, n).alias(f"y{n}") for n in (5, 20)])
    assert both.where("NOT x5 <=> y5 OR NOT x20 <=> y20").count() == 0 and both.where("x20 IS NOT NULL").count() > 0


def test_session_ends_to_the_microsecond(spark):
    at = [dt.datetime(2024, 1, 3, 6, 30), dt.datetime(2024, 1, 3, 6, 30, 0, 500_000), dt.datetime(2024, 1, 3, 21, 30), dt.datetime(2024, 1, 3, 21, 30, 0, 1)]
    d = spark.createDataFrame([(t, m) for t, m in zip(at, ["KR", "KR", "US", "US"])], "ts timestamp_ntz, m string")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in d.select(fd.market_open(F.col("ts").cast("timestamp"), F.col("m"))).collect()] == [True, False, True, False]


def test_fund_codes_of_seven_digits_are_invalid(spark, tmp_path):
    part = pq.read_table(f"{SF}/part.parquet").slice(0, 4)
    part = part.set_column(part.schema.get_field_index("p_partkey"), "p_partkey", pa.array([7, 999_999, 1_000_000, 1_234_567], part.schema.field("p_partkey").type))
    assert len(matches(spark, tmp_path, "src_etf_json", part=part)) == 4


def test_news_of_the_second_before_the_cut(spark, tmp_path):
    events = pq.read_table(f"{SF}/events.parquet").slice(0, 4)
    cut = dt.datetime(2024, 1, 2)
    ts = [cut - dt.timedelta(seconds=2), cut - dt.timedelta(seconds=1), cut - dt.timedelta(microseconds=1), cut]
    for c, xs in (("event_id", [1, 2, 4, 7]), ("ts", ts)):
        events = events.set_column(events.schema.get_field_index(c), c, pa.array(xs, events.schema.field(c).type))
    assert len(matches(spark, tmp_path, "src_news_search", events=events)) == 3


def test_exit_progress_rounds_alike_at_halves(spark):
    lots = "SELECT (i % 9000 + 6000) / 100.0::DOUBLE AS price, 80.0::DOUBLE + i % 15 AS st, 105.0::DOUBLE + i % 20 AS tg FROM range(200000) t(i)"
    want = duckdb.sql(f"SELECT CAST(round({PROGRESS} * 1000) AS BIGINT) AS p, count(*) AS n FROM ({lots}) GROUP BY p ORDER BY p").fetchall()
    i = F.col("id")
    price, st, tg = (i % 9000 + 6000) / F.lit(100.0), 80.0 + i % 15, 105.0 + i % 20
    p = F.round(F.round((price - st) / (tg - st), 3) * 1000).cast("bigint")
    assert [tuple(r) for r in spark.range(200000).groupBy(p.alias("p")).count().orderBy("p").collect()] == want


def test_long_extremes_from_short_ones(spark):
    rows = [("ab"[i % 2], D0 + dt.timedelta(days=i), None if i % 41 == 3 else float((i * 7919) % 1009), 1) for i in range(700)]
    b = spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")
    w = fw.series_window()
    for n in (17, 32, 100, 252):
        f = w.rowsBetween(1 - n, 0)
        hi, lo = fw.extremes(w, "_x", n)
        d = fw.short_extremes(b, w, F.col("close"), "_x").select(hi.alias("h"), lo.alias("l"), F.max("close").over(f).alias("hh"), F.min("close").over(f).alias("ll"))
        assert d.where("NOT h <=> hh OR NOT l <=> ll").count() == 0


def test_tasks_of_series_follow_the_rows(spark, monkeypatch):
    from tidemark.bindings import views

    few = views.Views(spark, SF).bars.rdd.getNumPartitions()
    monkeypatch.setattr(views, "TASK_LINES", 100)
    v = views.Views(spark, SF)
    assert few <= 8 < v.n_lines // 100 and v.bars.rdd.getNumPartitions() == v.n_lines // 100


def test_headlines_are_paired_by_id_not_by_text(spark):
    from tidemark.operators import news as nw

    rows = [("k", 1, "a b c d e f"), ("k", 2, "a b c d e"), ("k", 3, "a b c d e f g"), ("k", 4, "x y")]
    df = spark.createDataFrame(rows, "k string, i long, headline string")
    items = df.select("k", F.struct(F.struct("i").alias("pos"), F.xxhash64("headline").alias("hash")).alias("_id"), F.split("headline", " ").alias("_w"))
    edges = nw._prefix_edges(items, ["k"], 5)
    assert all(not t.startswith("string") for c, t in edges.dtypes if c != "k")
    assert sorted((r.early.pos.i, r.late.pos.i) for r in edges.collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(r.i for r in nw.dedup_headlines(df, ["k"], ["i"]).collect()) == [1, 4]


def test_drift_folds_the_positions_once(spark, monkeypatch):
    from tidemark.catalog import portfolio

    calls, real = [], portfolio.classes
    monkeypatch.setattr(portfolio, "classes", lambda v: calls.append(1) or real(v))
    assert entry.queries()["agg_drift"](spark, SF).count() > 0 and len(calls) == 1


def test_headline_dedup_writes_no_texts(spark, monkeypatch):
    from tidemark.operators import news as nw

    written, real = [], nw.stable
    monkeypatch.setattr(nw, "stable", lambda df: written.append(df.schema.simpleString()) or real(df))
    rows = [("k", 1, "A b, c d e f"), ("k", 2, "a b c d e"), ("k", 3, "a b c d e f"), ("l", 4, "a b c d e"), ("k", 5, "x y"), ("k", 6, "X Y!"), ("k", 7, "?!"), ("k", 8, None)]
    df = spark.createDataFrame(rows, "k string, n long, headline string").repartition(3)
    assert sorted((r.k, r.n, r.headline) for r in nw.dedup_headlines(df, ["k"], ["n"]).collect()) == [("k", 1, "A b, c d e f"), ("k", 5, "x y"), ("l", 4, "a b c d e")]
    assert written and not any("string" in w for w in written)
