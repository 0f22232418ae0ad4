"""Queries for regime, sectors, screens and the backtest."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, text
from tidemark.catalog.series import metrics_cte
from tidemark.functions import rules
from tidemark.operators import backtest as bt
from tidemark.operators import events as ev
from tidemark.operators import market as mk
from tidemark.operators import screen as sc
from tidemark.operators import series

B = ("bars",)
BS = ("bars", "benchmark_bars", "sector_bars", "sector_map")


def last_cte(src, name, keys="ticker"):
    """Metrics CTE chain over `src` under a name prefix, plus <name>: the last row per ticker."""
    pre = f"{name}_"
    return metrics_cte(src, pre) + f""",
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn_ FROM {pre}metrics) WHERE rn_ = 1)"""


def last(v, bars, keys=("ticker",), extra=True):
    return series.horizon_metrics(bars, keys, extra=extra)


POINTS = {
    "trend": "CASE WHEN close < ma200 THEN 2 WHEN close < ma50 THEN 1 ELSE 0 END",
    "drawdown": "CASE WHEN pct_from_52w_high <= -0.10 THEN 2 WHEN pct_from_52w_high <= -0.05 THEN 1 ELSE 0 END",
    "momentum": "CASE WHEN return_1m <= -0.08 THEN 2 WHEN return_1m <= -0.03 THEN 1 ELSE 0 END",
    "volatility": "CASE WHEN realized_vol >= 0.30 THEN 2 WHEN realized_vol >= 0.20 THEN 1 ELSE 0 END",
}
SCORE = "(" + " + ".join(f"({p})" for p in POINTS.values()) + ")"
LABEL = f"CASE WHEN {SCORE} >= 4 THEN 'RISK_OFF' WHEN {SCORE} >= 2 OR ma200 IS NULL THEN 'NEUTRAL' ELSE 'RISK_ON' END"


@query("rule_overextension", metrics_cte("bars") + " SELECT ticker, CAST(date AS VARCHAR) AS date, overextension_level FROM metrics", B)
def rule_overextension(v):
    return series.rolling_metrics(v.bars).select("ticker", *text("date"), "overextension_level")


@query("rule_regime", metrics_cte("bars") + " SELECT ticker, CAST(date AS VARCHAR) AS date, " + ", ".join(f"{p} AS {k}" for k, p in POINTS.items())
       + f", {SCORE} AS score, {LABEL} AS label FROM metrics", B)
def rule_regime(v):
    r = mk.regime(series.rolling_metrics(v.bars, extra=True))
    return r.select("ticker", *text("date"), *[F.col(f"pts_{k}").alias(k) for k in POINTS], "score", "label")


@query("rule_regime_aggregate", last_cte("sector_bars", "lm") + f""",
r AS (SELECT market, sector AS proxy, {SCORE} AS score, {LABEL} AS label FROM lm),
x AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY CASE label WHEN 'RISK_OFF' THEN 2 WHEN 'NEUTRAL' THEN 1 ELSE 0 END DESC, score DESC, proxy) AS rn FROM r)
SELECT market, proxy, CASE WHEN label = 'RISK_ON' AND market = 'KR' THEN 'NEUTRAL' ELSE label END AS label, score FROM x WHERE rn = 1""", ("sector_bars",))
def rule_regime_aggregate(v):
    from pyspark.sql.window import Window

    r = mk.regime(last(v, v.sector_bars, ("market", "sector"))).withColumnRenamed("sector", "proxy")
    r = r.withColumn("ord", F.dense_rank().over(Window.partitionBy("market").orderBy("proxy")))
    have = v.sector_map.select(F.col("sector").alias("proxy")).distinct()
    want = have.withColumn("market", F.lit("US")).unionByName(have.withColumn("market", F.lit("KR")))
    extra = want.where("market = 'KR'").limit(1).withColumn("proxy", F.lit("MISSING_PROXY"))
    return mk.aggregate_regime(r, ["market"], want.unionByName(extra)).select("market", "proxy", "label", "score")


STAGE = """CASE WHEN overextension_level IN ('ELEVATED','EXTREME') OR coalesce(close / ma50 - 1 > 0.15, false) OR coalesce(rsi14 > 70, false) THEN 'LATE'
  WHEN coalesce(rsi14 BETWEEN 45 AND 65, false) AND coalesce(abs(close / ma50 - 1) <= 0.08, false) AND overextension_level = 'NONE' AND coalesce({rs} > 0, false) THEN 'EARLY' ELSE 'MID' END"""


@query("rule_stage", metrics_cte("bars") + f" SELECT ticker, CAST(date AS VARCHAR) AS date, {STAGE.format(rs='return_1m')} AS stage FROM metrics", B)
def rule_stage(v):
    m = series.rolling_metrics(v.bars)
    s = rules.stage(F.col("close"), F.col("ma50"), F.col("rsi14"), F.col("overextension_level"), F.col("return_1m"))
    return m.select("ticker", *text("date"), s.alias("stage"))


SECTOR = last_cte("bars", "cm") + ",\n" + last_cte("benchmark_bars", "bm") + ",\n" + last_cte("sector_bars", "em") + f""",
br AS (SELECT c.market, s.sector, avg(CASE WHEN c.ma20 IS NOT NULL AND c.return_1m IS NOT NULL AND b.return_1m IS NOT NULL
   THEN CASE WHEN c.close > c.ma20 AND c.return_1m > b.return_1m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS breadth_pct
   FROM cm c JOIN sector_map s USING (ticker) JOIN bm b ON b.market = c.market GROUP BY ALL),
sv0 AS (SELECT e.*, br.breadth_pct, e.return_1m - b.return_1m AS rs_1m, e.return_3m - b.return_3m AS rs_3m
   FROM em e JOIN bm b ON b.market = e.market LEFT JOIN br ON br.market = e.market AND br.sector = e.sector),
sv1 AS (SELECT *, {STAGE.format(rs='rs_1m')} AS stage, coalesce(breadth_pct, 0.0) AS bq FROM sv0),
sv AS (SELECT market, sector, rs_1m, rs_3m, breadth_pct, stage,
  CASE WHEN rs_1m IS NULL THEN 'NEUTRAL' WHEN rs_1m > 0 AND bq >= 0.5 AND stage IN ('EARLY','MID') THEN 'FAVOR'
    WHEN rs_1m > 0 AND rs_3m <= 0 AND stage = 'EARLY' THEN 'ROTATING_IN' WHEN rs_1m < 0 AND rs_3m > 0 THEN 'ROTATING_OUT'
    WHEN stage = 'LATE' AND bq < 0.4 THEN 'ROTATING_OUT' WHEN rs_1m < 0 AND bq < 0.4 THEN 'AVOID' ELSE 'NEUTRAL' END AS verdict,
  round(100 * (0.5 * coalesce((greatest(-0.1, least(0.1, rs_1m)) + 0.1) / 0.2, 0.5) + 0.3 * bq + 0.2 * CASE stage WHEN 'EARLY' THEN 1.0 WHEN 'LATE' THEN 0.2 ELSE 0.6 END)::DOUBLE, 1) AS score
  FROM sv1)"""


@query("topk_sectors", SECTOR + """
SELECT market, row_number() OVER (PARTITION BY market ORDER BY score DESC, sector) AS rank, sector, round(rs_1m, 6) AS rs_1m, round(rs_3m, 6) AS rs_3m,
  round(breadth_pct, 6) AS breadth_pct, stage, verdict, score FROM sv""", BS)
def topk_sectors(v):
    s = mk.sector_rotation(v.bars, v.sector_bars, v.benchmark_bars, v.sector_map)
    return s.select("market", "rank", "sector", *r6("rs_1m", "rs_3m", "breadth_pct"), "stage", "verdict", "score")


@query("rule_sector_verdict", SECTOR + " SELECT market, sector, stage, verdict, score FROM sv", BS)
def rule_sector_verdict(v):
    s = mk.sector_rotation(v.bars, v.sector_bars, v.benchmark_bars, v.sector_map)
    return s.select("market", "sector", "stage", "verdict", "score")


@query("agg_breadth", SECTOR + " SELECT market, sector, round(breadth_pct, 6) AS breadth_pct FROM br", BS)
def agg_breadth(v):
    c = last(v, v.bars, extra=False)
    b = last(v, v.benchmark_bars, ("market",), False)
    return mk.breadth(c, v.sector_map, b, ["market", "sector"]).select("market", "sector", *r6("breadth_pct"))


@query("join_benchmark", last_cte("bars", "cm") + ",\n" + last_cte("benchmark_bars", "bm") + """
SELECT cm.ticker, round(cm.return_1m - bm.return_1m, 6) AS excess_1m, round(cm.return_6m - bm.return_6m, 6) AS excess_6m FROM cm JOIN bm ON bm.market = cm.market""", BS[:2])
def join_benchmark(v):
    c = last(v, v.bars, extra=False)
    b = last(v, v.benchmark_bars, ("market",), False).select("market", F.col("return_1m").alias("b1"), F.col("return_6m").alias("b6"))
    return c.join(b, "market").select("ticker", F.round(F.col("return_1m") - F.col("b1"), 6).alias("excess_1m"), F.round(F.col("return_6m") - F.col("b6"), 6).alias("excess_6m"))


LOOK = SECTOR + """,
lk AS (SELECT m.ticker, sv.* FROM (SELECT ticker, sector, CASE WHEN ticker % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM sector_map) m JOIN sv USING (market, sector))"""
SMULT = """CASE WHEN verdict = 'FAVOR' AND stage = 'EARLY' THEN 1.3::DOUBLE WHEN verdict IN ('FAVOR','ROTATING_IN') THEN 1.15::DOUBLE WHEN verdict = 'AVOID' THEN 0.6::DOUBLE
  WHEN verdict = 'ROTATING_OUT' THEN CASE WHEN stage = 'LATE' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END ELSE 1.0::DOUBLE END"""


def members(v):
    return v.sector_map.withColumn("market", F.when(F.col("ticker") % 2 == 0, "US").otherwise("KR"))


def lookup(v):
    s = mk.sector_rotation(v.bars, v.sector_bars, v.benchmark_bars, v.sector_map)
    m = members(v)
    return mk.sector_lookup(s, m, m.limit(0))


@query("join_sector_funds", LOOK + """
SELECT market, ticker::VARCHAR AS ticker, sector, verdict, stage FROM lk
UNION ALL SELECT market, ticker, sector, verdict, stage FROM (SELECT DISTINCT market, sector, ticker FROM sector_bars) JOIN sv USING (market, sector)""", BS)
def join_sector_funds(v):
    """The lookup of constituents and of the sectors' proxy funds."""
    s = mk.sector_rotation(v.bars, v.sector_bars, v.benchmark_bars, v.sector_map)
    funds = v.sector_bars.select("ticker", "market", "sector").distinct()
    m = members(v).withColumn("ticker", F.col("ticker").cast("string"))
    return mk.sector_lookup(s, m, funds).select("market", "ticker", "sector", "verdict", "stage")


@query("join_sector_verdict", LOOK + f" SELECT market, ticker, verdict, stage, {SMULT} AS multiplier FROM lk", BS)
def join_sector_verdict(v):
    c = mk.apply_sector_boost(members(v).select("market", "ticker"), lookup(v))
    return c.select("market", "ticker", F.col("sector_verdict").alias("verdict"), F.col("sector_stage").alias("stage"), "multiplier")


@query("rule_sector_multiplier", f"""
x AS (SELECT o_orderkey, (['FAVOR','ROTATING_IN','NEUTRAL','ROTATING_OUT','AVOID'])[o_orderkey % 5 + 1] AS verdict, (['EARLY','MID','LATE'])[o_orderkey % 3 + 1] AS stage FROM orders)
SELECT o_orderkey, {SMULT} AS screen, CASE verdict WHEN 'FAVOR' THEN 1.3::DOUBLE WHEN 'ROTATING_IN' THEN 1.15::DOUBLE WHEN 'ROTATING_OUT' THEN 0.8::DOUBLE WHEN 'AVOID' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS funnel FROM x""")
def rule_sector_multiplier(v):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    vd, st = pick(["FAVOR", "ROTATING_IN", "NEUTRAL", "ROTATING_OUT", "AVOID"]), pick(["EARLY", "MID", "LATE"])
    return v.table("orders").select("o_orderkey", rules.screen_multiplier(vd, st).alias("screen"), rules.funnel_multiplier(vd).alias("funnel"))


SETUPS = {
    "base_pivot": """CASE WHEN overextension_level = 'NONE' AND rsi14 BETWEEN 45 AND 65 AND (return_1m IS NULL OR return_1m < 0.20) AND ma20 > 0 AND ma50 > 0
   AND abs(close / ma20 - 1) <= 0.05 AND abs(close / ma50 - 1) <= 0.08 AND close >= ma50 * 0.97::DOUBLE AND contraction <= 0.75
   THEN round((0.4 * least(greatest((0.75 - contraction) / 0.75, 0), 1) + 0.3 * least(greatest(1 - abs(close / ma20 - 1) / 0.05, 0), 1) + 0.3 * volume_pattern)::DOUBLE, 4) END""",
    "pullback": """CASE WHEN ma20 > ma50 AND ma50 > ma200 AND overextension_level <> 'EXTREME' AND (return_1m IS NULL OR return_1m < 0.20) AND rsi14 BETWEEN 40 AND 55
   AND close >= ma50 * 0.98::DOUBLE AND close <= ma20 * 1.02::DOUBLE
   THEN round((0.5 + 0.5 * least(greatest(1 - least(abs(close / ma20 - 1), abs(close / ma50 - 1)) / 0.05, 0), 1))::DOUBLE, 4) END""",
    "rs_leader": """CASE WHEN overextension_level <> 'EXTREME' AND return_1m BETWEEN 0.05 AND 0.20 AND return_1m - bench_1m >= 0.05 AND NOT coalesce(return_6m <= bench_6m, false)
   THEN round((0.5 + 0.5 * least(greatest((return_1m - bench_1m) / 0.15, 0), 1))::DOUBLE, 4) END""",
    "pre_earnings": """CASE WHEN earnings_in_days BETWEEN 5 AND 10 AND overextension_level <> 'EXTREME' AND return_1m > 0 AND return_1m < 0.20 AND contraction <= 0.85
   THEN round(least(0.5 + 0.3 * least(greatest((0.85 - contraction) / 0.85, 0), 1) + 0.2 * least(greatest(return_1m / 0.20, 0), 1), 1.0)::DOUBLE, 4) END""",
}
PRIO = {"pullback": 4, "base_pivot": 3, "rs_leader": 2, "pre_earnings": 1}


def setup_query(name, needs_bench=False):
    if needs_bench:
        sql = metrics_cte("bars") + ",\n" + metrics_cte("benchmark_bars", "bb_") + f""",
j AS (SELECT m.*, b.return_1m AS bench_1m, b.return_6m AS bench_6m FROM metrics m LEFT JOIN bb_metrics b ON b.market = m.market AND b.date = m.date)
SELECT ticker, CAST(date AS VARCHAR) AS date, {SETUPS[name]} AS score FROM j WHERE {SETUPS[name]} IS NOT NULL"""
        return query(f"rule_{name}", sql, ("bars", "benchmark_bars"))
    sql = metrics_cte("bars") + f""" SELECT ticker, CAST(date AS VARCHAR) AS date, {SETUPS[name]} AS score FROM
      (SELECT *, day(date) % 14 AS earnings_in_days FROM metrics) WHERE {SETUPS[name]} IS NOT NULL"""
    return query(f"rule_{name}", sql, B)


def _scored(v, col):
    m = series.rolling_metrics(v.bars, extra=True)
    return m.withColumn("earnings_in_days", F.dayofmonth("date") % 14).select("ticker", *text("date"), col.alias("score")).where("score IS NOT NULL")


@setup_query("base_pivot")
def rule_base_pivot(v):
    return _scored(v, rules.base_pivot(F.col))


@setup_query("pullback")
def rule_pullback(v):
    return _scored(v, rules.pullback(F.col))


@setup_query("pre_earnings")
def rule_pre_earnings(v):
    return _scored(v, rules.pre_earnings(F.col, F.col("earnings_in_days")))


@setup_query("rs_leader", True)
def rule_rs_leader(v):
    m = series.rolling_metrics(v.bars, extra=True)
    b = series.rolling_metrics(v.benchmark_bars, ("market",)).select("market", "date", F.col("return_1m").alias("bench_1m"), F.col("return_6m").alias("bench_6m"))
    j = m.join(F.broadcast(b), ["market", "date"], "left")  # a row per market and day
    return j.select("ticker", *text("date"), rules.rs_leader(F.col, F.col("bench_1m"), F.col("bench_6m")).alias("score")).where("score IS NOT NULL")


SETUP_LAST = last_cte("bars", "cm") + ",\n" + last_cte("benchmark_bars", "bm") + """,
ed AS (SELECT ticker, min(date_diff('day', DATE '2001-07-25', event_date)) AS earnings_in_days FROM calendar_events WHERE kind = 'earnings' AND event_date >= DATE '2001-07-25' GROUP BY ticker),
sj AS (SELECT cm.*, bm.return_1m AS bench_1m, bm.return_6m AS bench_6m, CASE WHEN cm.market = 'US' THEN ed.earnings_in_days END AS earnings_in_days
  FROM cm LEFT JOIN bm ON bm.market = cm.market LEFT JOIN ed ON ed.ticker = cm.ticker),
hits AS (""" + " UNION ALL ".join(
    f"SELECT market, ticker, '{n}' AS setup, {PRIO[n]} AS prio, {s} AS score, return_1w, vol_ratio, n_bars FROM sj" for n, s in SETUPS.items()
) + "), hit AS (SELECT * FROM hits WHERE score IS NOT NULL AND n_bars >= 22)"
CE = ("bars", "benchmark_bars", "calendar_events")


def setup_metrics(v):
    m = last(v, v.bars)
    b = last(v, v.benchmark_bars, ("market",))
    return m, b, ev.earnings_in_days(v.calendar_events, "2001-07-25")


@query("rule_presurge_all", SETUP_LAST + " SELECT ticker, setup, score FROM hit", CE)
def rule_presurge_all(v):
    m, b, e = setup_metrics(v)
    b = b.select("market", F.col("return_1m").alias("bench_1m"), F.col("return_6m").alias("bench_6m"))
    j = m.join(b, "market", "left").join(e, "ticker", "left").withColumn("earnings_in_days", F.when(F.col("market") == "US", F.col("earnings_in_days")))
    return sc.setup_scores(j).select("ticker", F.inline("hits")).select("ticker", "setup", "score")


@query("topk_best_setup", SETUP_LAST + " SELECT ticker, setup, score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, prio DESC) AS rn FROM hit) WHERE rn = 1", CE)
def topk_best_setup(v):
    m, b, e = setup_metrics(v)
    return sc.presurge_candidates(m, b, e, min_score=0.0, top=None).select("ticker", "setup", "score")


PRE = SETUP_LAST + """,
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, prio DESC) AS rn FROM hit) WHERE rn = 1 AND score >= 0.5),
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, ticker) AS rank FROM bs) WHERE rank <= 20)"""


@query("topk_presurge", PRE + """ SELECT market, ticker, setup, score, round(coalesce(return_1w, 0) * 100, 6) AS ret5_pct, round(coalesce(vol_ratio, 1.0), 6) AS vol_ratio, rank FROM pre""", CE)
def topk_presurge(v):
    m, b, e = setup_metrics(v)
    return sc.presurge_candidates(m, b, e).select("market", "ticker", "setup", "score", *r6("ret5_pct", "vol_ratio"), "rank")


MOM = """,
mo AS (SELECT market, ticker, ret5_pct, vol_ratio_prior AS vol_ratio, CASE WHEN abs(ret5_pct) >= 6 THEN 'momentum' ELSE 'volume' END AS reason
  FROM cm WHERE n_bars >= 6 AND (abs(ret5_pct) >= 6 OR vol_ratio_prior >= 1.5)),
an AS (SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'US' ELSE 'KR' END AS market, s_suppkey AS ord FROM supplier WHERE s_suppkey < 4),
mf AS (SELECT coalesce(mo.market, an.market) AS market, coalesce(mo.ticker, an.ticker) AS ticker, coalesce(ret5_pct, 0.0) AS ret5_pct, coalesce(vol_ratio, 1.0) AS vol_ratio,
  CASE WHEN ord IS NOT NULL THEN 'anchor' ELSE reason END AS reason, ord FROM mo FULL JOIN an ON an.ticker = mo.ticker),
mom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ord NULLS LAST, abs(ret5_pct) DESC, ticker) AS rank FROM mf) WHERE rank <= 20)"""


def anchors(v):
    k = F.col("s_suppkey")
    return v.table("supplier").where(k < 4).select(k.alias("ticker"), F.when(k % 2 == 0, "US").otherwise("KR").alias("market"), k.cast("int").alias("ord"))


def momentum(v):
    return sc.momentum_candidates(last(v, v.bars), anchors(v), min_return=6.0, min_volume=1.5)


@query("topk_momentum", last_cte("bars", "cm") + MOM + " SELECT market, ticker, round(ret5_pct, 6) AS ret5_pct, round(vol_ratio, 6) AS vol_ratio, reason, rank FROM mom", B)
def topk_momentum(v):
    return momentum(v).select("market", "ticker", *r6("ret5_pct", "vol_ratio"), "reason", "rank")


@query("set_blend_streams", PRE + MOM + ",\n" + last_cte("sector_bars", "em") + SECTOR[SECTOR.index(",\nbr AS"):] + """,
lk AS (SELECT m.ticker, sv.verdict FROM (SELECT ticker, sector, CASE WHEN ticker % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM sector_map) m JOIN sv USING (market, sector)),
u AS (SELECT market, ticker, reason, NULL AS setup, rank, CASE WHEN reason = 'anchor' THEN 0 ELSE 2 END AS stream FROM mom
  UNION ALL SELECT market, ticker, 'presurge', setup, rank, 1 FROM pre),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY stream, rank) AS rn FROM u) WHERE rn = 1),
k AS (SELECT d.*, verdict, CASE WHEN stream = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE coalesce(verdict, 'NEUTRAL') WHEN 'FAVOR' THEN 1.3::DOUBLE WHEN 'ROTATING_IN' THEN 1.15::DOUBLE
  WHEN 'ROTATING_OUT' THEN 0.8::DOUBLE WHEN 'AVOID' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS order_key, CASE WHEN stream = 0 THEN 'anchor' ELSE 'pick' END AS role FROM d LEFT JOIN lk USING (ticker))
SELECT market, role, row_number() OVER (PARTITION BY market, role ORDER BY order_key DESC, stream, rank, ticker) AS position, ticker, reason, setup, verdict AS sector_verdict, round(order_key, 6) AS order_key FROM k""",
       ("bars", "benchmark_bars", "sector_bars", "sector_map", "calendar_events"))
def set_blend_streams(v):
    m, b, e = setup_metrics(v)
    out = sc.blend_streams(momentum(v), sc.presurge_candidates(m, b, e), lookup(v))
    return out.select("market", "role", "position", "ticker", "reason", "setup", "sector_verdict", *r6("order_key"))


@query("topk_universe", """
f AS (SELECT s_suppkey AS ticker, s_acctbal AS market_cap, tv AS trading_value FROM supplier LEFT JOIN (SELECT ticker, sum(volume) AS tv FROM bars GROUP BY ticker) ON ticker = s_suppkey)
SELECT ticker, market_cap, CAST(trading_value AS BIGINT) AS trading_value FROM (SELECT * FROM (SELECT * FROM f ORDER BY market_cap DESC, ticker LIMIT 40) UNION SELECT * FROM (SELECT * FROM f ORDER BY trading_value DESC NULLS LAST, ticker LIMIT 20))""", B)
def topk_universe(v):
    tv = v.bars.groupBy("ticker").agg(F.sum("volume").alias("trading_value"))
    f = v.table("supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("market_cap")).join(tv, "ticker", "left")
    return sc.top_universe(f, 40, 20)


@query("topk_stale", "SELECT s_suppkey AS ticker, count(b.date) AS n_bars FROM supplier LEFT JOIN bars b ON ticker = s_suppkey GROUP BY s_suppkey HAVING count(b.date) < 530", B)
def topk_stale(v):
    return sc.stale_tickers(v.table("supplier").select(F.col("s_suppkey").alias("ticker")), v.bars, 530)


START, END, STEP, H = "1996-01-01", "2001-12-31", 7, 21
ASOF = f"""ad AS (SELECT CAST(d AS DATE) AS as_of FROM unnest(range(TIMESTAMP '{START}', TIMESTAMP '{END}' + INTERVAL 1 DAY, INTERVAL {STEP} DAY)) t(d) WHERE isodow(d) <= 5)"""
BT = metrics_cte("bars") + ",\n" + metrics_cte("benchmark_bars", "bb_") + f""",
{ASOF},
mx AS (SELECT *, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nd, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) AS path FROM metrics),
bx AS (SELECT *, lead(date) OVER (PARTITION BY market ORDER BY date) AS nd FROM bb_metrics),
ma AS (SELECT m.*, as_of, NULL::INTEGER AS earnings_in_days FROM mx m JOIN ad ON as_of >= date AND (nd IS NULL OR as_of < nd)),
ba AS (SELECT market, as_of, return_1m AS bench_1m, return_6m AS bench_6m FROM bx JOIN ad ON as_of >= date AND (nd IS NULL OR as_of < nd)),
sj AS (SELECT ma.*, bench_1m, bench_6m FROM ma LEFT JOIN ba USING (market, as_of)),
hits AS (""" + " UNION ALL ".join(
    f"SELECT market, as_of, ticker, close, return_1m, path, '{n}' AS setup, {PRIO[n]} AS prio, {s} AS score, n_bars FROM sj" for n, s in SETUPS.items()
) + f"""),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, ticker ORDER BY score DESC, prio DESC) AS rn FROM hits WHERE score IS NOT NULL AND n_bars >= 22) WHERE rn = 1 AND score >= 0.5),
pk AS (SELECT market, as_of, ticker, close AS entry, return_1m AS trail_ret, path, 'presurge' AS source, setup, score FROM best
  UNION ALL SELECT market, as_of, ticker, close, return_1m, path, 'momentum', 'momentum', ret5_pct FROM sj WHERE n_bars >= 6 AND (ret5_pct >= 8 OR (vol_ratio_prior >= 1.8 AND ret5_pct >= 0))),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, as_of, source ORDER BY score DESC, ticker) AS rank FROM pk) WHERE rank <= 20),
tc AS (SELECT *, list_filter(path, lambda c: c <= entry * (1 - 0.05::DOUBLE) OR c >= entry * (1 + 0.03::DOUBLE))[1] AS c FROM picks),
res AS (SELECT *, CASE WHEN coalesce(len(path), 0) < {H} THEN NULL WHEN c IS NULL THEN 'EXPIRED' WHEN c <= entry * (1 - 0.05::DOUBLE) THEN 'MISS' ELSE 'HIT' END AS status,
  CASE WHEN coalesce(len(path), 0) >= {H} THEN (coalesce(c, path[{H}]) - entry) / entry END AS ret FROM tc)"""
BB = ("bars", "benchmark_bars")


def results(v):
    return bt.run_backtest(v.bars, v.benchmark_bars, START, END, STEP, H, min_return=8.0, min_volume=1.8)


@query("topk_asof", BT + " SELECT market, CAST(as_of AS VARCHAR) AS as_of, source, setup, ticker, rank, round(score, 6) AS score FROM picks", BB)
def topk_asof(v):
    p = bt.asof_picks(v.bars, v.benchmark_bars, START, END, STEP, H, min_return=8.0, min_volume=1.8)
    return p.select("market", F.col("asof").cast("string").alias("as_of"), "source", "setup", "ticker", "rank", *r6("score"))


@query("bt_run", BT + " SELECT market, CAST(as_of AS VARCHAR) AS as_of, source, ticker, setup, status, round(ret, 6) AS ret, round(trail_ret, 6) AS trail_ret FROM res", BB)
def bt_run(v):
    return results(v).select("market", F.col("asof").cast("string").alias("as_of"), "source", "ticker", "setup", "status", *r6("ret", "trail_ret"))


@query("join_forward_window", BT + " SELECT market, source, count(*) FILTER (status IS NOT NULL) AS evaluated, count(*) FILTER (status IS NULL) AS censored FROM res GROUP BY market, source", BB)
def join_forward_window(v):
    return results(v).groupBy("market", "source").agg(F.count("status").alias("evaluated"), F.count_if(F.col("status").isNull()).alias("censored"))


@query("bt_skipped", BT + " SELECT market, count(*) FILTER (status IS NOT NULL) AS total_simulated, count(*) FILTER (status IS NULL) AS skipped_insufficient_forward FROM res GROUP BY market", BB)
def bt_skipped(v):
    return bt.skipped_count(results(v))


STATS = """count(*) AS n, count(*) FILTER (status='HIT') AS hit, count(*) FILTER (status='MISS') AS miss, count(*) FILTER (status='EXPIRED') AS expired,
 round(count(*) FILTER (status='HIT') / nullif(count(*) FILTER (status IN ('HIT','MISS')), 0)::DOUBLE, 6) AS hit_rate, round(count(*) FILTER (status='HIT') / count(*)::DOUBLE, 6) AS hit_rate_all,
 round(avg(ret), 6) AS avg_return, round(coalesce(avg(ret) FILTER (status='HIT'), 0), 6) AS avg_win, round(coalesce(avg(ret) FILTER (status='MISS'), 0), 6) AS avg_loss,
 round(coalesce(avg(ret) FILTER (status='HIT'), 0) / nullif(abs(coalesce(avg(ret) FILTER (status='MISS'), 0)), 0), 6) AS payoff_ratio"""


@query("bt_cohort_stats", BT + f""",
bk AS (SELECT *, CASE WHEN trail_ret < 0 THEN '<0%' WHEN trail_ret < 0.1 THEN '0-10%' WHEN trail_ret < 0.2 THEN '10-20%' WHEN trail_ret < 0.4 THEN '20-40%' WHEN trail_ret IS NOT NULL THEN '>40%' END AS bucket
  FROM res WHERE status IS NOT NULL)
SELECT market, source, 'ALL' AS bucket, {STATS} FROM bk GROUP BY market, source UNION ALL SELECT market, source, bucket, {STATS} FROM bk WHERE bucket IS NOT NULL GROUP BY market, source, bucket""", BB)
def bt_cohort_stats(v):
    return bt.cohort_stats(results(v)).select(
        "market", "source", "bucket", "n", "hit", "miss", "expired", *r6("hit_rate", "hit_rate_all", "avg_return", "avg_win", "avg_loss", "payoff_ratio")
    )


def _delta_sql():
    from tidemark.functions.stats import POISSON1_CUTS

    w = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in POISSON1_CUTS)
    h = "CAST('0x' || substr(md5(CAST(as_of AS VARCHAR)), {}, 8) AS BIGINT)"
    return BT + f""",
dy AS (SELECT market, as_of, count(*) FILTER (source='presurge' AND status='HIT') AS ph, count(*) FILTER (source='presurge') AS pn, count(*) FILTER (source='momentum' AND status='HIT') AS mh,
  count(*) FILTER (source='momentum') AS mn FROM res WHERE status IS NOT NULL GROUP BY market, as_of),
rp AS (SELECT *, ({h.format(1)} * rep + {h.format(9)}) % 2147483647 AS u FROM dy, unnest(range(1, 2001)) t(rep)),
rw AS (SELECT market, rep, sum(w * ph) AS ph, sum(w * pn) AS pn, sum(w * mh) AS mh, sum(w * mn) AS mn FROM (SELECT *, {w} AS w FROM rp) GROUP BY market, rep),
dl AS (SELECT market, ph / pn::DOUBLE - mh / mn::DOUBLE AS d FROM rw WHERE pn > 0 AND mn > 0),
rk AS (SELECT market, d, row_number() OVER (PARTITION BY market ORDER BY d) AS r, count(*) OVER (PARTITION BY market) AS m FROM dl),
pt AS (SELECT market, round(sum(ph) / sum(pn)::DOUBLE - sum(mh) / sum(mn)::DOUBLE, 6) AS delta FROM dy GROUP BY market)
SELECT market, any_value(delta) AS delta, round(max(d) FILTER (r = ceil(0.025 * m)), 6) AS ci_low,
  round(max(d) FILTER (r = ceil(0.975 * m)), 6) AS ci_high, CAST(coalesce(max(d) FILTER (r = ceil(0.025 * m)) > 0, false) AS INTEGER) AS passed FROM pt LEFT JOIN rk USING (market) GROUP BY market"""


@query("bt_delta_ci", _delta_sql(), BB)
def bt_delta_ci(v):
    return bt.delta_ci(results(v)).select("market", *r6("delta", "ci_low", "ci_high"), F.col("passed").cast("int").alias("passed"))


@query("join_asof_backward", metrics_cte("bars") + f""",
{ASOF},
mx AS (SELECT *, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nd FROM metrics)
SELECT ticker, CAST(as_of AS VARCHAR) AS as_of, CAST(date AS VARCHAR) AS date, close FROM mx JOIN ad ON as_of >= date AND (nd IS NULL OR as_of < nd)""", B)
def join_asof_backward(v):
    return bt.with_asof(v.bars, ["ticker"], START, END, STEP).select("ticker", F.col("asof").cast("string").alias("as_of"), *text("date"), "close")


@query("fn_sector_notes", SECTOR + """
SELECT market, sector, 'RS_1m ' || format('{:+.1f}%', rs_1m * 100) || '|RS_3m ' || format('{:+.1f}%', rs_3m * 100) || '|breadth ' || format('{:.0f}%', breadth_pct * 100 + 1e-9) AS notes FROM sv""", BS)
def fn_sector_notes(v):
    s = mk.sector_rotation(v.bars, v.sector_bars, v.benchmark_bars, v.sector_map)
    return s.select("market", "sector", F.array_join("notes", "|").alias("notes"))


@query("fn_labels", """
c AS (SELECT o_orderkey, o_totalprice * pow(10.0::DOUBLE, o_orderkey % 9) + 0.123::DOUBLE AS c FROM orders)
SELECT o_orderkey, CASE WHEN c >= 1e12 THEN format('{:,.1f}조', c / 1e12) WHEN c >= 1e8 THEN format('{:,.0f}억', c / 1e8) ELSE format('{:,.0f}원', c) END AS krw,
  CASE WHEN c >= 1e12 THEN format('${:,.2f}T', c / 1e12) WHEN c >= 1e9 THEN format('${:,.1f}B', c / 1e9) WHEN c >= 1e6 THEN format('${:,.0f}M', c / 1e6) ELSE format('${:,.0f}', c) END AS usd FROM c""")
def fn_labels(v):
    from tidemark.functions import text as ft

    c = F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 9) + 0.123
    return v.table("orders").select("o_orderkey", ft.krw_cap(c).alias("krw"), ft.usd_cap(c).alias("usd"))
