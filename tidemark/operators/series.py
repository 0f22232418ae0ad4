"""Per-ticker technical series: horizon metrics at every date or at the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import rules
from tidemark.functions import windows as fw


def rsi(bars: DataFrame, keys=("ticker",), period: int = 14) -> DataFrame:
    """Wilder RSI at every bar."""
    w = fw.series_window(keys)
    d = F.col("close") - F.lag("close", 1).over(w)
    b = bars.withColumns({"_d": d, "obs": F.row_number().over(w) - 1})
    b = fw.wilder_averages(
        b,
        {
            "_gain": F.when(F.col("obs") > 0, F.greatest(F.col("_d"), F.lit(0.0))),
            "_loss": F.when(F.col("obs") > 0, F.greatest(-F.col("_d"), F.lit(0.0))),
        },
        keys, period=period,
    )
    return b.withColumn("rsi14", fw.rsi_from_averages(F.col("_gain"), F.col("_loss"))).drop(
        "_d", "_gain", "_loss", "obs"
    )


def rsi_simple(bars: DataFrame, keys=("ticker",), n: int = 14) -> DataFrame:
    """RSI from plain means of the last n changes; 50 while short, as the gold report uses."""
    w = fw.series_window(keys)
    b = bars.withColumn("_d", F.col("close") - F.lag("close", 1).over(w))
    gain = fw.gated(F.sum, F.greatest(F.col("_d"), F.lit(0.0)), w, n)
    loss = fw.gated(F.sum, F.greatest(-F.col("_d"), F.lit(0.0)), w, n)
    # greatest() skips NULL, so the first bar's missing change must not count as a zero change
    valid = F.count("_d").over(w.rowsBetween(-(n - 1), 0)) >= n
    b = b.withColumns({"_g": gain / n, "_l": loss / n, "_ok": valid})
    value = (
        F.when(~F.col("_ok"), 50.0)
        .when(F.col("_l") == 0, F.when(F.col("_g") > 0, 100.0).otherwise(50.0))
        .otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    )
    return b.withColumn("rsi", value).drop("_d", "_g", "_l", "_ok")


def atr(bars: DataFrame, keys=("ticker",), period: int = 14) -> DataFrame:
    w = fw.series_window(keys)
    prev = F.lag("close", 1).over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    b = bars.withColumns({"_tr": F.when(prev.isNotNull(), tr), "obs": F.row_number().over(w) - 1})
    return fw.wilder_averages(b, {"atr14": F.col("_tr")}, keys, period=period).drop("_tr", "obs")


def drawdown_last(bars: DataFrame, keys=("ticker",), n: int = 252) -> DataFrame:
    """Worst peak-to-trough fall within the last n bars of each series (NULL under 2 bars)."""
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    recent = bars.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    peak = F.max("close").over(fw.series_window(keys).rowsBetween(Window.unboundedPreceding, 0))
    dd = recent.withColumn("_pk", peak).withColumn(
        "_dd", F.when(F.col("_pk") > 0, (F.col("close") - F.col("_pk")) / F.col("_pk"))
    )
    return dd.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 2, F.least(F.min("_dd"), F.lit(0.0))).alias("max_drawdown_1y")
    )


def rolling_metrics(bars: DataFrame, keys=("ticker",), extra: bool = False) -> DataFrame:
    """Horizon metrics at every (key, date): one exchange on the keys serves all columns.

    `extra` adds what the setup rules need: contraction, volume pattern, realised volatility.
    """
    w = fw.series_window(keys)
    c, v = F.col("close"), F.col("volume")
    b, closes = fw.frame_sums(rsi(bars, keys), w, fw.whole(c), "_c")
    if dict(bars.dtypes)["volume"] in ("tinyint", "smallint", "int", "bigint"):
        b, volumes = fw.frame_sums(b, w, v.cast("bigint"), "_v")
        volume = lambda n, end=0: volumes(n, end) / n
    else:
        volume = lambda n, end=0: fw.gated(F.avg, v, w, n, end)
    b = fw.short_extremes(b, w, c, "_x")
    cols = {
        "n_bars": F.row_number().over(w),
        **{f"ma{n}": fw.whole_mean(closes(n), n) for n in (20, 50, 200)},
        "return_1w": fw.trailing_return(c, w, 5),
        "return_1m": fw.trailing_return(c, w, 21),
        "return_3m": fw.trailing_return(c, w, 63),
        "return_6m": fw.trailing_return(c, w, 126),
        "return_1y": fw.trailing_return(c, w, 252),
        "vol_5d_avg": volume(5),
        "vol_50d_avg": volume(50),
    }
    hi, lo = fw.extremes(w, "_x")
    hi, lo = F.when(hi > 0, (c - hi) / hi), F.when(lo > 0, (c - lo) / lo)
    cols |= {"pct_from_52w_high": hi, "pct_from_52w_low": lo}
    if extra:
        b = b.withColumns({"_r": fw.simple_return(c, w), "_lr": fw.log_return(c, w)})
        cols |= {
            "contraction": fw.contraction_ratio(F.col("_r"), w),
            "realized_vol": fw.realized_vol(F.col("_lr"), w),
            "ret5_pct": fw.pct_return(c, w, 5),
            "_base": volume(20, -5), "_recent": volume(15, -5), "_older": volume(30, -20),
        }
    m = b.withColumns(cols).withColumn(
        "vol_ratio", F.when(F.col("vol_50d_avg") != 0, F.col("vol_5d_avg") / F.col("vol_50d_avg"))
    )
    if extra:
        m = m.withColumns(
            {
                "vol_ratio_prior": F.coalesce(F.when(F.col("_base") > 0, F.col("vol_5d_avg") / F.col("_base")), F.lit(1.0)),
                "volume_pattern": fw.pattern(F.col("_recent"), F.col("_older"), F.col("vol_ratio")),
            }
        ).drop("_r", "_lr", "_base", "_recent", "_older")
    return m.drop("_c_sum", "_c_count", "_v_sum", "_v_count", "_x_hi", "_x_lo").withColumns(
        {
            "overextension_level": rules.overextension(F.col("rsi14"), c, F.col("ma20")),
            "cycle_risk_flag": rules.cycle_risk(F.col("return_1y"), F.col("pct_from_52w_high")),
        }
    )


def last_rows(df: DataFrame, keys=("ticker",), order: str = "date") -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def horizon_metrics(bars: DataFrame, keys=("ticker",), asof=None, extra: bool = False) -> DataFrame:
    """One row per key at its last bar on or before `asof`, with the 252-bar drawdown.

    Only the last bar is wanted, so no frame slides: each bar gets its distance from the end, and
    every metric is a conditional aggregate over that distance. The aggregate reuses the window's
    partitioning and sort, so there is one exchange.
    """
    if asof is not None:
        bars = bars.where(F.col("date") <= F.lit(asof).cast("date"))
    w = fw.series_window(keys)
    c, v = F.col("close"), F.col("volume")
    b = bars.withColumns({"_p": F.lag("close", 1).over(w), "_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    b = b.withColumn("_k", F.col("_n") - F.col("_i"))  # 0 at the last bar
    k, d = F.col("_k"), F.col("close") - F.col("_p")
    last = lambda x: F.max(F.when(k == 0, x))
    at = lambda n: F.max(F.when(k == n, c))
    mean = lambda x, n: F.when(F.count(F.when(k < n, x)) >= n, F.avg(F.when(k < n, x)))
    price = lambda n: F.when(F.count(F.when(k < n, c)) >= n, fw.whole_mean(F.sum(F.when(k < n, fw.whole(c))), n))
    ret = lambda n: F.when(at(n) > 0, (at(0) - at(n)) / at(n))
    # weight of change i among n: q^(n - max(i, 14)) / 14; the scale cancels in gain over loss
    q = 13.0 / 14.0
    n_chg, i_chg = F.col("_n") - 1, F.col("_i") - 1
    weight = F.pow(F.lit(q), n_chg - F.greatest(i_chg, F.lit(14)))
    up = F.sum(F.when(i_chg > 0, F.greatest(d, F.lit(0.0)) * weight))
    down = F.sum(F.when(i_chg > 0, F.greatest(-d, F.lit(0.0)) * weight))
    enough = F.max(n_chg) >= 14
    hi, lo = F.max(F.when(k < 252, c)), F.min(F.when(k < 252, c))
    path = F.transform(F.array_sort(F.collect_list(F.when(k < 252, F.struct((-k).alias("o"), c.alias("c"))))), lambda x: x["c"])
    aggs = {
        "market": F.first("market") if "market" in bars.columns and "market" not in keys else None,
        "ticker": F.first("ticker") if "ticker" in bars.columns and "ticker" not in keys else None,
        "date": last(F.col("date")), "close": at(0), "n_bars": F.max("_n"),
        "_g": F.when(enough, up), "_l": F.when(enough, down),
        "ma20": price(20), "ma50": price(50), "ma200": price(200),
        "return_1w": ret(5), "return_1m": ret(21), "return_3m": ret(63), "return_6m": ret(126), "return_1y": ret(252),
        "vol_5d_avg": mean(v, 5), "vol_50d_avg": mean(v, 50),
        "pct_from_52w_high": F.when(hi > 0, (at(0) - hi) / hi), "pct_from_52w_low": F.when(lo > 0, (at(0) - lo) / lo),
        "_path": path,
    }
    if extra:
        r = F.when(F.col("_p") > 0, c / F.col("_p") - 1)
        lr = F.when((F.col("_p") > 0) & (c > 0), F.log(c / F.col("_p")))

        def spread(x, a, z):
            part = F.when((k >= a) & (k < z), x)
            return F.when(F.count(part) >= z - a, F.stddev_samp(part))

        def avg_between(x, a, z):
            part = F.when((k >= a) & (k < z), x)
            return F.when(F.count(part) >= z - a, F.avg(part))

        aggs |= {
            "_s1": spread(r, 0, 10), "_s2": spread(r, 10, 30), "realized_vol": spread(lr, 0, 20) * F.sqrt(F.lit(252.0)),
            "ret5_pct": F.when(at(5) == 0, 0.0).otherwise((at(0) / F.nullif(at(5), F.lit(0.0)) - 1) * 100),
            "_b20": avg_between(v, 5, 25), "_v15": avg_between(v, 5, 20), "_v30": avg_between(v, 20, 50),
        }
    m = b.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items() if a is not None])
    fall = F.aggregate(
        "_path", F.struct(F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("d")),
        lambda s, x: F.struct(
            F.greatest(s["p"], x).alias("p"),
            F.least(s["d"], F.when(F.greatest(s["p"], x) > 0, (x - F.greatest(s["p"], x)) / F.greatest(s["p"], x))).alias("d"),
        ),
        lambda s: s["d"],
    )
    m = m.withColumns(
        {
            "rsi14": fw.rsi_from_averages(F.col("_g"), F.col("_l")),
            "vol_ratio": F.when(F.col("vol_50d_avg") != 0, F.col("vol_5d_avg") / F.col("vol_50d_avg")),
            "max_drawdown_1y": F.when(F.size("_path") >= 2, fall),
        }
    )
    if extra:
        dry = F.coalesce((F.col("_v30") > 0) & (F.col("_v15") < F.col("_v30")), F.lit(False))
        pickup = F.coalesce(F.col("vol_ratio").between(0.9, 2.0), F.lit(False))
        m = m.withColumns(
            {
                "contraction": F.when(F.col("_s2") != 0, F.col("_s1") / F.col("_s2")),
                "vol_ratio_prior": F.coalesce(F.when(F.col("_b20") > 0, F.col("vol_5d_avg") / F.col("_b20")), F.lit(1.0)),
                "volume_pattern": F.when(dry & pickup, 1.0).when(dry | pickup, 0.5).otherwise(0.0),
            }
        )
    m = m.withColumns(
        {
            "overextension_level": rules.overextension(F.col("rsi14"), c, F.col("ma20")),
            "cycle_risk_flag": rules.cycle_risk(F.col("return_1y"), F.col("pct_from_52w_high")),
        }
    )
    return m.drop(*[x for x in m.columns if x.startswith("_")])


def nav_returns(nav: DataFrame, keys=("account",), value: str = "nav") -> DataFrame:
    """Daily return against the previous row and cumulative return against the first."""
    w = fw.series_window(keys)
    prev = F.lag(value, 1).over(w)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return nav.withColumns(
        {
            "daily_return": F.when(prev > 0, F.col(value) / prev - 1),
            "cum_return": F.when(first > 0, F.col(value) / first - 1),
        }
    )


def day_change(bars: DataFrame, keys=("ticker",)) -> DataFrame:
    """Percent change of each key's last close against the one before; 0 when that is 0."""
    w = fw.series_window(keys)
    prev = F.lag("close", 1).over(w)
    b = bars.withColumn("day_change_pct", F.when(prev == 0, 0.0).otherwise((F.col("close") / prev - 1) * 100))
    return last_rows(b, keys)
