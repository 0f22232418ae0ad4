"""Point-in-time backtest of the two screens, forward-evaluated under the outcome rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats
from tidemark.functions import windows as fw
from tidemark.operators import screen, series


def asof_dates_in(first: Column, until: Column, start: str, end: str, step: int) -> Column:
    """As-of dates start, start+step, ... <= end that fall in [first, until), weekends dropped.

    A bar is the last one known on exactly these dates, so the as-of join is arithmetic on the
    bar's own row and needs no join.
    """
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    lo = F.greatest(F.ceil(F.datediff(first, s) / step), F.lit(0)).cast("int")
    last = F.least(F.coalesce(F.date_sub(until, 1), e), e)
    hi = F.floor(F.datediff(last, s) / step).cast("int")
    ks = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(ks, lambda k: F.date_add(s, k * step)), lambda d: F.weekday(d) < 5)


def with_asof(rows: DataFrame, keys: list[str], start: str, end: str, step: int) -> DataFrame:
    """One row per (key, as-of date): the last row on or before that date."""
    nxt = F.lead("date", 1).over(fw.series_window(keys))
    return rows.withColumn("_n", nxt).withColumn("asof", F.explode(asof_dates_in(F.col("date"), F.col("_n"), start, end, step))).drop("_n")


def first_touch(entry: Column, path: Column, horizon: int, hit: float = 0.03, miss: float = 0.05) -> Column:
    """struct(status, ret) of the first close through stop or target; NULL when the path is short."""
    stop, target = entry * (1 - miss), entry * (1 + hit)
    c = F.get(F.filter(F.slice(path, 1, horizon), lambda x: (x <= stop) | (x >= target)), F.lit(0))
    status = F.when(c.isNull(), "EXPIRED").when(c <= stop, "MISS").otherwise("HIT")
    ret = (F.coalesce(c, F.element_at(path, horizon)) - entry) / entry
    return F.when((entry > 0) & (F.size(path) >= horizon), F.struct(status.alias("status"), ret.alias("ret")))


def asof_picks(
    bars: DataFrame, bench_bars: DataFrame, start: str, end: str, step: int, horizon: int, top: int = 20,
    min_score: float = 0.5, min_return: float = 15.0, min_volume: float = 2.0,
) -> DataFrame:
    """Both cohorts at every as-of date with their forward outcome `sim`.

    Metrics and outcomes come from one exchange by ticker; ranking per (as-of date, cohort)
    limits map-side before its shuffle.
    """
    m = series.rolling_metrics(bars, ("ticker",), extra=True)
    ahead = F.collect_list("close").over(fw.series_window().rowsBetween(1, horizon))
    m = with_asof(m.withColumn("_path", ahead), ["ticker"], start, end, step)
    # a bar is its own entry, so the outcome is known here and the path never reaches a shuffle
    m = m.withColumn("sim", first_touch(F.col("close"), F.col("_path"), horizon)).drop("_path")
    b = with_asof(series.rolling_metrics(bench_bars, ("market",)), ["market"], start, end, step)
    b = b.select("market", "asof", F.col("return_1m").alias("bench_1m"), F.col("return_6m").alias("bench_6m"))
    # a row per market and as-of date, so the wide side stays where it is
    m = m.join(F.broadcast(b), ["market", "asof"], "left").withColumn("earnings_in_days", F.lit(None).cast("int"))
    s = screen.setup_scores(m)
    mom = (F.col("n_bars") >= screen.MIN_BARS_MOMENTUM) & (
        (F.col("ret5_pct") >= min_return) | ((F.col("vol_ratio_prior") >= min_volume) & (F.col("ret5_pct") >= 0))
    )
    pre = F.col("best.score") >= min_score
    cohorts = F.array_compact(
        F.array(
            F.when(mom, F.struct(F.lit("momentum").alias("source"), F.lit("momentum").alias("setup"), F.col("ret5_pct").alias("score"))),
            F.when(pre, F.struct(F.lit("presurge").alias("source"), F.col("best.setup").alias("setup"), F.col("best.score").alias("score"))),
        )
    )
    picks = s.select(
        "market", "asof", "ticker", F.col("close").alias("entry"), F.col("return_1m").alias("trail_ret"), "sim",
        F.explode(cohorts).alias("c"),
    ).select("*", "c.*").drop("c")
    w = Window.partitionBy("market", "asof", "source").orderBy(F.desc("score"), "ticker")
    return picks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def run_backtest(bars: DataFrame, bench_bars: DataFrame, start: str, end: str, step: int, horizon: int, **kw) -> DataFrame:
    """Picks with status and return; `status` NULL marks a pick censored for lack of forward bars."""
    p = asof_picks(bars, bench_bars, start, end, step, horizon, **kw)
    return p.select(
        "market", "asof", "source", "setup", "ticker", "rank", "score", "entry", "trail_ret",
        F.col("sim.status").alias("status"), F.col("sim.ret").alias("ret"),
    )


def trailing_bucket(r: Column) -> Column:
    return (
        F.when(r < 0, "<0%").when(r < 0.10, "0-10%").when(r < 0.20, "10-20%").when(r < 0.40, "20-40%")
        .when(r.isNotNull(), ">40%")
    )


def cohort_stats(results: DataFrame) -> DataFrame:
    """Per market and cohort, and per trailing bucket of these: counts, hit rates, payoff. bucket ALL = cohort."""
    r = results.where("status IS NOT NULL").withColumn("bucket", trailing_bucket(F.col("trail_ret")))
    is_ = lambda s: F.col("status") == s
    n, h, m = F.count(F.lit(1)), F.count_if(is_("HIT")), F.count_if(is_("MISS"))
    g = r.groupingSets([["market", "source"], ["market", "source", "bucket"]], "market", "source", "bucket").agg(
        n.alias("n"), h.alias("hit"), m.alias("miss"), F.count_if(is_("EXPIRED")).alias("expired"),
        F.try_divide(h, h + m).alias("hit_rate"), (h / n).alias("hit_rate_all"), F.avg("ret").alias("avg_return"),
        F.coalesce(F.avg(F.when(is_("HIT"), F.col("ret"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(is_("MISS"), F.col("ret"))), F.lit(0.0)).alias("avg_loss"),
        F.grouping("bucket").alias("_g"),
    )
    g = g.where("_g = 1 OR bucket IS NOT NULL").withColumn("bucket", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("bucket")))
    return g.withColumn("payoff_ratio", F.try_divide("avg_win", F.abs("avg_loss"))).drop("_g")


def skipped_count(results: DataFrame) -> DataFrame:
    """Per market: simulated picks and those censored for lack of forward bars."""
    return results.groupBy("market").agg(
        F.count_if(F.col("status").isNotNull()).alias("total_simulated"),
        F.count_if(F.col("status").isNull()).alias("skipped_insufficient_forward"),
    )


def delta_ci(results: DataFrame, resamples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Per market, block bootstrap by as-of date of the cohorts' hit-rate difference; EXPIRED is a non-hit.

    Results are reduced to one row per date first; the replicates multiply only those.
    """
    hit = (F.col("status") == "HIT").cast("int")
    side = lambda s: F.col("source") == s
    day = results.where("status IS NOT NULL").groupBy("market", "asof").agg(
        F.sum(F.when(side("presurge"), hit).otherwise(0)).alias("ph"), F.count_if(side("presurge")).alias("pn"),
        F.sum(F.when(side("momentum"), hit).otherwise(0)).alias("mh"), F.count_if(side("momentum")).alias("mn"),
    )
    a, b = stats.hash_pair(F.col("asof"))
    rep = day.withColumns({"a": a, "b": b, "rep": F.explode(F.sequence(F.lit(1), F.lit(resamples)))})
    w = stats.poisson1(stats.rep_uniform(F.col("a"), F.col("b"), F.col("rep")))
    s = lambda c: F.sum(F.col("w") * F.col(c))
    per = (
        rep.withColumn("w", w).groupBy("market", "rep").agg(s("ph").alias("ph"), s("pn").alias("pn"), s("mh").alias("mh"), s("mn").alias("mn"))
        .where("pn > 0 AND mn > 0")
        .select("market", (F.try_divide("ph", "pn") - F.try_divide("mh", "mn")).alias("d"))
    )
    own = Window.partitionBy("market")
    ranked = per.select("market", "d", F.count(F.lit(1)).over(own).alias("m"), F.row_number().over(own.orderBy("d")).alias("r"))
    at = lambda p: F.max(F.when(F.col("r") == stats.nearest_rank(p, F.col("m")), F.col("d")))
    ci = ranked.groupBy("market").agg(at(alpha / 2).alias("ci_low"), at(1 - alpha / 2).alias("ci_high"))
    point = day.groupBy("market").agg((F.try_divide(F.sum("ph"), F.sum("pn")) - F.try_divide(F.sum("mh"), F.sum("mn"))).alias("delta"))
    out = point.join(ci, "market", "left")
    return out.withColumn("passed", F.coalesce(F.col("ci_low") > 0, F.lit(False)))
