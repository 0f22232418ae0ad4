import html
import random

from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import outcomes as oc
from tidemark.operators import paper


def test_entities_are_unescaped_once(spark):
    raw = ["&#38;lt;", "&amp;lt;", "&#x27;&hellip;&copy;", "&#9999999; &#xD800; &#0; x", "a <b>b</b> &nope; &", "&eacute;&NotEqualTilde;", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = {r.i: r.t for r in df.select("i", ft.clean_html(F.col("r")).alias("t")).collect()}
    for i, r in enumerate(raw):
        assert got[i] == (None if r is None else html.unescape(r.replace("<b>", "").replace("</b>", "")))


def test_of_a_repeated_key_the_last_value_counts(spark):
    df = spark.createDataFrame([("a=1,b=2, a = 3 ,=x,y",), ("",)], "r string")
    got = [r.m for r in df.select(ft.kv_map(F.col("r")).alias("m")).collect()]
    assert got == [{"a": "3", "b": "2", "": "x"}, {}]


def test_updates_and_cancels_keep_one_row_per_id(spark):
    p = spark.createDataFrame([(1, "OPEN", None, None), (2, "HIT", 1.0, "2024-01-01"), (3, "OPEN", None, None)], "id int, status string, outcome_return double, outcome_date string")
    u = spark.createDataFrame([(1, "HIT", 2.0, "2024-02-02"), (1, "MISS", -2.0, "2024-02-01"), (2, "MISS", 0.0, "2024-02-01"), (3, None, None, None)], "id int, new_status string, new_return double, new_date string")
    assert sorted((r.id, r.status) for r in oc.apply_outcomes(p, u).collect()) == [(1, "MISS"), (2, "HIT"), (3, "OPEN")]
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert sorted((r.id, r.status) for r in oc.cancel(p, ids).collect()) == [(1, "CANCELLED"), (2, "HIT"), (3, "OPEN")]


def test_earliest_is_by_creation_not_by_id(spark):
    rows = [(i, "T", "US", "BULL", "1W", "LIVE", t, "OPEN", 1.0, None) for i, t in (("a", "2024-01-01 09:00"), ("b", "2024-01-01 01:00"))]
    df = spark.createDataFrame(rows, "id string, ticker string, market string, direction string, timeframe string, source string, created string, status string, entry_price double, outcome_return double")
    df = df.withColumn("created_at", F.to_timestamp("created"))
    assert [r.id for r in oc.dedup_keep_first(df).collect()] == ["b"]


def test_a_lot_exits_once_and_after_its_entry(spark):
    lots = spark.createDataFrame([(1, "T", 90.0, 110.0, "2024-01-05", "2024-02-01")], "id int, ticker string, stop_price double, target_price double, entry_date string, horizon_end string")
    lots = lots.withColumns({c: F.to_date(c) for c in ("entry_date", "horizon_end")})
    bars = spark.createDataFrame([("T", d, h, lo, c) for d, h, lo, c in (("2024-01-02", 120.0, 80.0, 100.0), ("2024-01-05", 120.0, 80.0, 100.0), ("2024-01-08", 100.0, 95.0, 99.0), ("2024-01-09", 111.0, 95.0, 99.0), ("2024-01-10", 120.0, 80.0, 99.0))], "ticker string, date string, high double, low double, close double").withColumn("date", F.to_date("date"))
    assert [(r.id, str(r.date), r.reason, r.exit_price) for r in paper.exit_signals(lots, bars).collect()] == [(1, "2024-01-09", "target_hit", 110.0)]


def test_keyword_groups_match_what_the_patterns_match(spark):
    g = random.Random(6)
    groups = {"a": ("cut", "rate cut", "miss"), "b": ("beats estimates", "유상증자"), "c": ("a+", "q-a"), "d": ()}
    parts = ["cut", "rate", "rate cut", "beats", "estimates", "beats estimates", "miss", "mission", "유상증자", "é", "_", "a+", "q-a", "1", "CUT", "Rate Cut"]
    lines = [(None,), ("",)] + [(g.choice(["", " ", "x"]).join([g.choice(parts) + g.choice([" ", "  ", "-", "", "_", ",", "é"]) for _ in range(g.randrange(1, 5))]),) for _ in range(600)]
    df = spark.createDataFrame(lines, "h string")
    h = F.col("h")
    want = F.array_compact(F.array(*[F.when(F.lower(h).rlike(ft.keyword_pattern(k)), n) for n, k in groups.items() if k]))
    bad = df.select(h, ft.keyword_groups(h, groups).alias("x"), want.alias("y")).where("x <> y")
    assert bad.collect() == []
