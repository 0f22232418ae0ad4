"""Queries over daily bars: rolling series and horizon metrics."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, text
from tidemark.functions import windows as fw
from tidemark.operators import series

B = ("bars",)
W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def f_(n, start=None, end=0):
    """SQL frame clause for the n rows ending `-end` rows back."""
    s = n - 1 + end
    hi = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {s} PRECEDING AND {hi})"


def avg_sql(col, n, end=0):
    if col == "close":  # whole cents, so that equal means compare equal
        return (f"CASE WHEN count(close) OVER {f_(n, end=end)} >= {n} THEN"
                f" avg(CAST(round(close * 100) AS BIGINT)) OVER {f_(n, end=end)} / 100.0::DOUBLE END")
    return f"CASE WHEN count({col}) OVER {f_(n, end=end)} >= {n} THEN avg({col}) OVER {f_(n, end=end)} END"


def sd_sql(col, n, end=0):
    return f"CASE WHEN count({col}) OVER {f_(n, end=end)} >= {n} THEN stddev_samp({col}) OVER {f_(n, end=end)} END"


def ret_sql(k):
    return (f"CASE WHEN lag(close, {k}) OVER w > 0 THEN (close - lag(close, {k}) OVER w)"
            f" / lag(close, {k}) OVER w END")


RSI_CTE = """
chg AS (SELECT *, close - lag(close) OVER w AS d, row_number() OVER w - 1 AS i FROM {src}
        WINDOW w AS (PARTITION BY ticker ORDER BY date)),
gl AS (SELECT *, sum(greatest(d, 0.0) * pow(14.0::DOUBLE / 13.0, greatest(i, 14))) OVER w AS g,
         sum(greatest(-d, 0.0) * pow(14.0::DOUBLE / 13.0, greatest(i, 14))) OVER w AS l
       FROM (SELECT * REPLACE (CASE WHEN i > 0 THEN d ELSE 0.0 END AS d) FROM chg)
       WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
rsi AS (SELECT *, CASE WHEN i < 14 THEN NULL WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END
          ELSE 100.0 - 100.0 / (1 + g / l) END AS rsi14 FROM gl)"""

METRICS_CTE = RSI_CTE + """,
rets AS (SELECT *, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS r,
           CASE WHEN lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) END AS lr
         FROM rsi WINDOW w AS (PARTITION BY ticker ORDER BY date)),
met0 AS (SELECT *, row_number() OVER w AS n_bars,
  """ + f"""{avg_sql('close', 20)} AS ma20, {avg_sql('close', 50)} AS ma50, {avg_sql('close', 200)} AS ma200,
  {ret_sql(5)} AS return_1w, {ret_sql(21)} AS return_1m, {ret_sql(63)} AS return_3m,
  {ret_sql(126)} AS return_6m, {ret_sql(252)} AS return_1y,
  {avg_sql('volume', 5)} AS vol_5d_avg, {avg_sql('volume', 50)} AS vol_50d_avg,
  (close - max(close) OVER {f_(252)}) / max(close) OVER {f_(252)} AS pct_from_52w_high,
  (close - min(close) OVER {f_(252)}) / min(close) OVER {f_(252)} AS pct_from_52w_low,
  {sd_sql('r', 10)} AS sd10, {sd_sql('r', 20, 10)} AS sd20p,
  {sd_sql('lr', 20)} * sqrt(252.0) AS realized_vol,
  (close / lag(close, 5) OVER w - 1) * 100 AS ret5_pct,
  {avg_sql('volume', 20, 5)} AS base20, {avg_sql('volume', 15, 5)} AS v15, {avg_sql('volume', 30, 20)} AS v30
  FROM rets {W}),
met AS (SELECT *, CASE WHEN vol_50d_avg <> 0 THEN vol_5d_avg / vol_50d_avg END AS vol_ratio,
  CASE WHEN sd20p <> 0 THEN sd10 / sd20p END AS contraction,
  coalesce(CASE WHEN base20 > 0 THEN vol_5d_avg / base20 END, 1.0) AS vol_ratio_prior,
  CASE WHEN coalesce(rsi14, 0) > 75 OR coalesce(close / ma20 - 1 > 0.15, false) THEN 'EXTREME'
       WHEN coalesce(rsi14, 0) > 70 OR coalesce(close / ma20 - 1 > 0.08, false) THEN 'ELEVATED' ELSE 'NONE' END
    AS overextension_level,
  coalesce(return_1y > 1.0 AND pct_from_52w_high > -0.15, false) AS cycle_risk_flag
  FROM met0),
metrics AS (SELECT *, CASE WHEN coalesce(v30 > 0 AND v15 < v30, false) AND coalesce(vol_ratio BETWEEN 0.9 AND 2.0, false) THEN 1.0::DOUBLE
    WHEN coalesce(v30 > 0 AND v15 < v30, false) OR coalesce(vol_ratio BETWEEN 0.9 AND 2.0, false) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS volume_pattern
  FROM met)"""


def metrics_cte(src: str, prefix: str = "") -> str:
    """The metrics CTE chain over any (ticker, date, close, volume) relation."""
    s = METRICS_CTE.format(src=src).strip()
    if prefix:
        for n in ("chg", "gl", "rsi", "rets", "met0", "met", "metrics"):
            s = s.replace(f"\n{n} AS (", f"\n{prefix}{n} AS (").replace(f"FROM {n} ", f"FROM {prefix}{n} ")
            s = s.replace(f"FROM {n})", f"FROM {prefix}{n})")
            if s.startswith(f"{n} AS ("):
                s = prefix + s
    return s


def simple(name, cols_sql, body_from="bars", extra_cte=""):
    """Decorator for a per-row series query with one output column list."""
    sql = f"{extra_cte}SELECT ticker, CAST(date AS VARCHAR) AS date, {cols_sql} FROM {body_from} {W}"
    return query(name, sql, B)


@simple("win_sma", ", ".join(f"round({avg_sql('close', n)}, 6) AS ma{n}" for n in (20, 50, 200)))
def win_sma(v):
    w = fw.series_window()
    b = v.bars.withColumns({f"ma{n}": fw.price_mean(F.col("close"), w, n) for n in (20, 50, 200)})
    return b.select("ticker", *text("date"), *r6("ma20", "ma50", "ma200"))


@query("win_rsi", RSI_CTE.format(src="bars") + "SELECT ticker, CAST(date AS VARCHAR) AS date, round(rsi14, 6) AS rsi14 FROM rsi", B)
def win_rsi(v):
    return series.rsi(v.bars).select("ticker", *text("date"), *r6("rsi14"))


@query("win_rsi_simple", f"""
chg AS (SELECT *, close - lag(close) OVER w AS d FROM bars {W}),
g AS (SELECT *, count(d) OVER {f_(14)} AS n, avg(greatest(d, 0)) OVER {f_(14)} AS ag, avg(greatest(-d, 0)) OVER {f_(14)} AS al
      FROM chg)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN n < 14 THEN 50.0
  WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + ag / al) END, 6) AS rsi FROM g""", B)
def win_rsi_simple(v):
    return series.rsi_simple(v.bars).select("ticker", *text("date"), *r6("rsi"))


@query("win_atr", """
t AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
u AS (SELECT *, CASE WHEN i > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) ELSE 0.0 END AS tr FROM t)
SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN i >= 14 THEN
  sum(tr * pow(14.0::DOUBLE / 13.0, greatest(i, 14))) OVER w * pow(13.0::DOUBLE / 14.0, i) / 14 END, 6) AS atr14
FROM u WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""", B)
def win_atr(v):
    return series.atr(v.bars).select("ticker", *text("date"), *r6("atr14"))


@simple("win_return", ", ".join(f"round({ret_sql(k)}, 6) AS return_{k}" for k in (5, 21, 63, 126, 252)))
def win_return(v):
    w = fw.series_window()
    ks = (5, 21, 63, 126, 252)
    b = v.bars.withColumns({f"return_{k}": fw.trailing_return(F.col("close"), w, k) for k in ks})
    return b.select("ticker", *text("date"), *r6(*[f"return_{k}" for k in ks]))


@simple("win_pct_return", "round(CASE WHEN lag(close, 5) OVER w = 0 THEN 0 ELSE (close / lag(close, 5) OVER w - 1) * 100 END, 6) AS ret5_pct")
def win_pct_return(v):
    b = v.bars.withColumn("ret5_pct", fw.pct_return(F.col("close"), fw.series_window(), 5))
    return b.select("ticker", *text("date"), *r6("ret5_pct"))


@query("win_drawdown", """
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars),
p AS (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM r WHERE rn <= 252)
SELECT ticker, round(CASE WHEN count(*) >= 2 THEN least(min((close - pk) / pk), 0) END, 6) AS max_drawdown_1y FROM p GROUP BY ticker""", B)
def win_drawdown(v):
    return series.drawdown_last(v.bars).select("ticker", *r6("max_drawdown_1y"))


@simple("win_hi_lo", f"""round((close - max(close) OVER {f_(252)}) / max(close) OVER {f_(252)}, 6) AS pct_high,
  round((close - min(close) OVER {f_(252)}) / min(close) OVER {f_(252)}, 6) AS pct_low""")
def win_hi_lo(v):
    hi, lo = fw.high_low_distance(F.col("close"), fw.series_window())
    return v.bars.withColumns({"pct_high": hi, "pct_low": lo}).select("ticker", *text("date"), *r6("pct_high", "pct_low"))


@simple("win_avg_volume", f"""round({avg_sql('volume', 5)}, 6) AS vol_5d_avg, round({avg_sql('volume', 50)}, 6) AS vol_50d_avg,
  round(({avg_sql('volume', 5)}) / ({avg_sql('volume', 50)}), 6) AS vol_ratio""")
def win_avg_volume(v):
    w = fw.series_window()
    c = F.col("volume")
    b = v.bars.withColumns({"vol_5d_avg": fw.sma(c, w, 5), "vol_50d_avg": fw.sma(c, w, 50), "vol_ratio": fw.volume_ratio(c, w)})
    return b.select("ticker", *text("date"), *r6("vol_5d_avg", "vol_50d_avg", "vol_ratio"))


@simple("win_vol_ratio_prior", f"round(coalesce(({avg_sql('volume', 5)}) / ({avg_sql('volume', 20, 5)}), 1.0), 6) AS vol_ratio")
def win_vol_ratio_prior(v):
    b = v.bars.withColumn("vol_ratio", fw.volume_ratio_prior(F.col("volume"), fw.series_window()))
    return b.select("ticker", *text("date"), *r6("vol_ratio"))


RET = f"x AS (SELECT *, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS lr FROM bars {W}) "


@simple("win_return_stdev", f"round({sd_sql('r', 20)}, 6) AS ret_sd20", "x", RET)
def win_return_stdev(v):
    w = fw.series_window()
    b = v.bars.withColumn("r", fw.simple_return(F.col("close"), w))
    return b.withColumn("ret_sd20", fw.gated(F.stddev_samp, F.col("r"), w, 20)).select("ticker", *text("date"), *r6("ret_sd20"))


@simple("win_contraction", f"round(({sd_sql('r', 10)}) / ({sd_sql('r', 20, 10)}), 6) AS contraction", "x", RET)
def win_contraction(v):
    w = fw.series_window()
    b = v.bars.withColumn("r", fw.simple_return(F.col("close"), w))
    return b.withColumn("contraction", fw.contraction_ratio(F.col("r"), w)).select("ticker", *text("date"), *r6("contraction"))


@simple("win_realized_vol", f"round(({sd_sql('lr', 20)}) * sqrt(252.0), 6) AS realized_vol", "x", RET)
def win_realized_vol(v):
    w = fw.series_window()
    b = v.bars.withColumn("lr", fw.log_return(F.col("close"), w))
    return b.withColumn("realized_vol", fw.realized_vol(F.col("lr"), w)).select("ticker", *text("date"), *r6("realized_vol"))


HM = ["close", "ma20", "ma50", "ma200", "rsi14", "return_1w", "return_1m", "return_6m", "return_1y",
      "pct_from_52w_high", "pct_from_52w_low", "vol_5d_avg", "vol_50d_avg", "vol_ratio", "max_drawdown_1y"]


@query("win_horizon_metrics", metrics_cte("bars") + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM metrics),
pk AS (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM rk WHERE rn <= 252),
dd AS (SELECT ticker, CASE WHEN count(*) >= 2 THEN least(min((close - p) / p), 0) END AS max_drawdown_1y FROM pk GROUP BY ticker)
SELECT ticker, market, CAST(date AS VARCHAR) AS date, """ + ", ".join(f"round({c}, 6) AS {c}" for c in HM) + """,
  CAST(cycle_risk_flag AS INTEGER) AS cycle_risk_flag, overextension_level
FROM rk JOIN dd USING (ticker) WHERE rn = 1""", B)
def win_horizon_metrics(v):
    return series.horizon_metrics(v.bars).select(
        "ticker", "market", *text("date"), *r6(*HM), F.col("cycle_risk_flag").cast("int").alias("cycle_risk_flag"), "overextension_level"
    )


@query("win_ma_slope", f"""
x AS (SELECT *, {avg_sql('close', 200)} AS ma200 FROM bars)
SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(coalesce(ma200 > lag(ma200, 20) OVER w, false) AS INTEGER) AS ma200_rising FROM x {W}""", B)
def win_ma_slope(v):
    w = fw.series_window()
    b = v.bars.withColumn("ma200", fw.price_mean(F.col("close"), w, 200))
    rising = F.coalesce(F.col("ma200") > F.lag("ma200", 20).over(w), F.lit(False)).cast("int")
    return b.select("ticker", *text("date"), rising.alias("ma200_rising"))


@simple("win_series_returns", """round((close / lag(close, 62) OVER w - 1) * 100, 6) AS ret_3m_pct,
  round((close / lag(close, 125) OVER w - 1) * 100, 6) AS ret_6m_pct""")
def win_series_returns(v):
    w = fw.series_window()
    b = v.bars.withColumns({"ret_3m_pct": fw.pct_return(F.col("close"), w, 62), "ret_6m_pct": fw.pct_return(F.col("close"), w, 125)})
    return b.select("ticker", *text("date"), *r6("ret_3m_pct", "ret_6m_pct"))


@query("win_volume_pattern", metrics_cte("bars") + " SELECT ticker, CAST(date AS VARCHAR) AS date, volume_pattern FROM metrics", B)
def win_volume_pattern(v):
    w = fw.series_window()
    b = v.bars.withColumn("vr", fw.volume_ratio(F.col("volume"), w))
    return b.select("ticker", *text("date"), fw.volume_pattern(F.col("volume"), w, F.col("vr")).alias("volume_pattern"))


@simple("win_swing_high", f"max(high) OVER {f_(22)} AS swing_high")
def win_swing_high(v):
    w = fw.series_window().rowsBetween(-21, 0)
    return v.bars.select("ticker", *text("date"), F.max("high").over(w).alias("swing_high"))


@query("win_daily_nav_return", """SELECT market, CAST(date AS VARCHAR) AS date, round(nav / lag(nav) OVER w - 1, 6) AS daily_return,
  round(nav / first_value(nav) OVER w - 1, 6) AS cum_return FROM nav WINDOW w AS (PARTITION BY market ORDER BY date)""", ("nav",))
def win_daily_nav_return(v):
    return series.nav_returns(v.nav, ("market",)).select("market", *text("date"), *r6("daily_return", "cum_return"))


@query("win_benchmark_nav", """SELECT market, CAST(date AS VARCHAR) AS date,
  round(1000000.0 * close / first_value(close) OVER (PARTITION BY market ORDER BY date), 6) AS benchmark_nav FROM benchmark_bars""", ("benchmark_bars",))
def win_benchmark_nav(v):
    w = fw.series_window(("market",))
    value = 1_000_000.0 * F.col("close") / F.first("close").over(w)
    return v.benchmark_bars.withColumn("benchmark_nav", value).select("market", *text("date"), *r6("benchmark_nav"))


@query("win_day_change", f"""
x AS (SELECT *, (close / lag(close) OVER w - 1) * 100 AS p, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars {W})
SELECT ticker, CAST(date AS VARCHAR) AS date, round(p, 6) AS day_change_pct FROM x WHERE rn = 1""", B)
def win_day_change(v):
    return series.day_change(v.bars).select("ticker", *text("date"), *r6("day_change_pct"))
