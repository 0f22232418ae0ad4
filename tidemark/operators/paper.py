"""Paper-trading columns and review metrics: costs, exits, round trips, book statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as fd
from tidemark.functions.passage import first_passage
from tidemark.operators import series
from tidemark.operators.held import beside, stream_past

SLIPPAGE = 0.0005
KR_COMMISSION = 0.00015
KR_SELL_TAX = 0.0018
CONFIDENCE_EDGES = (0.60, 0.70, 0.80, 0.90, 1.01)


def trade_costs(side: Column, market: Column, qty: Column, price: Column) -> dict[str, Column]:
    """Fill price, gross, fees, tax, slippage and signed cash of a simulated fill."""
    buy = side == "BUY"
    fill = price * F.when(buy, 1 + SLIPPAGE).otherwise(1 - SLIPPAGE)
    gross = qty * fill
    fees = gross * F.when(market == "KR", KR_COMMISSION).otherwise(0.0)
    tax = F.when(~buy & (market == "KR"), gross * KR_SELL_TAX).otherwise(0.0)
    cash = F.when(buy, -(gross + fees)).otherwise(gross - fees - tax)
    return {
        "fill_price": fill, "gross": gross, "fees": fees, "tax": tax,
        "slippage": qty * F.abs(fill - price), "net_cash_delta": cash,
    }


def risk_quantity(
    price: Column, stop: Column, nav: Column, risk_pct: float, max_position_pct: float, fallback_stop: float = 0.08
) -> Column:
    """Whole shares under the risk budget and the position cap."""
    s = F.when((stop > 0) & (stop < price), stop).otherwise(price * (1 - fallback_stop))
    return F.when(price > s, F.floor(F.least(nav * risk_pct / (price - s), nav * max_position_pct / price)))


def fresh_target(target: Column, price: Column) -> Column:
    return F.when(target > price, target)


def exit_signals(lots: DataFrame, day_bars: DataFrame, share: int = 100_000) -> DataFrame:
    """First closing day, reason and fill per open lot after its entry: stop, then target, then horizon.

    `lots` has a unique id and entry_date; a lot that no bar closes has no row. A ticker has a bar a day at most, so its
    bars are held while its lots stream past; they are copied once for every `share` lots of the ticker, which are dealt
    to the copies. A lot finds its bar by block minima and maxima in steps that grow with the logarithm of the bars, and
    one row a lot leaves. A missing low or high reaches no level; a missing ticker has no bars.
    """
    none = lambda **kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    types = dict(lots.dtypes)
    copies = lots.where("ticker IS NOT NULL AND entry_date IS NOT NULL").groupBy("ticker").agg(F.ceil(F.count("*") / share).cast("int").alias("copies"))
    bars = day_bars.join(copies, "ticker").select(
        "ticker", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("side"), day("date").alias("day"), "low", "high", "close",
        *none(id=types["id"], stop="double", target="double", horizon="int")).where("day IS NOT NULL")
    asked = lots.join(copies, "ticker").select(
        "ticker", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("side"), day("entry_date").alias("day"), *none(low="double", high="double", close="double"),
        "id", F.col("stop_price").cast("double").alias("stop"), F.col("target_price").cast("double").alias("target"), day("horizon_end").alias("horizon")).where("day IS NOT NULL")
    column = lambda t, c, null: t[c].to_pandas().fillna(null).to_numpy()

    def hold(_, held):
        return [np.concatenate([column(t, c, null) for t in held]) for c, null in (("day", 0), ("low", np.inf), ("high", -np.inf), ("close", np.nan))]

    def meet(state, t):
        days, lows, highs, closes = state
        stop, target = column(t, "stop", -np.inf), column(t, "target", np.inf)
        first = np.searchsorted(days, column(t, "day", 0), "right")
        end = np.maximum(first, np.searchsorted(days, column(t, "horizon", 1 << 30)))
        at = first_passage(lows, highs, first, end, stop, target)
        k = np.flatnonzero(at < len(days))
        at, stop, target = at[k], stop[k], target[k]
        why = np.where(lows[at] <= stop, 0, np.where(highs[at] >= target, 1, 2))
        price = np.choose(why, [stop, target, closes[at]])
        reason = np.array(["stop_hit", "target_hit", "horizon_exit"], object)[why]
        return pa.RecordBatch.from_pydict({"id": t["id"].take(pa.array(k)), "day": pa.array(days[at], pa.int32()), "reason": pa.array(reason, pa.string()), "exit_price": pa.array(price, pa.float64(), from_pandas=True)})

    keys = ["ticker", "salt"]
    found = beside(bars, asked, keys, ["day"]).mapInArrow(lambda b: stream_past(b, keys, hold, meet), f"id {types['id']}, day int, reason string, exit_price double")
    return found.select("id", F.date_from_unix_date("day").alias("date"), "reason", "exit_price")


def day_candidates(rows: DataFrame) -> DataFrame:
    """Highest-confidence row per (market, entry date, ticker), first seen on ties; horizon from entry."""
    body = F.struct("id", "confidence", "timeframe", "stop_price", "target_price")
    # max_by keeps the aggregate map-side: confidence first, then the earliest id
    best = rows.groupBy("market", "entry_date", "ticker").agg(
        F.max_by(body, F.struct("confidence", -F.unix_timestamp("created_at"), -F.col("id"))).alias("b")
    )
    out = best.select("market", "entry_date", "ticker", "b.*")
    return out.withColumn(
        "horizon_end", F.date_add("entry_date", fd.timeframe_days(F.col("timeframe"), calendar=True))
    )


def low_edge_filter(rows: DataFrame) -> DataFrame:
    """Drop rows tagged low-edge in components; unreadable components keep the row."""
    tag = F.try_variant_get(F.try_parse_json("components"), "$.low_edge_band", "boolean")
    return rows.where(~F.coalesce(tag, F.lit(False)))


def session_map(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last session, with the first session on or after it.

    Sessions expand over the gap before them, so the forward as-of join becomes an equi-join.
    """
    prev = F.lag("date", 1).over(Window.partitionBy("market").orderBy("date"))
    c = calendar.select("market", "date").distinct().withColumn("_p", prev)
    first = F.coalesce(F.date_add("_p", 1), F.col("date"))
    return c.select("market", F.explode(F.sequence(first, F.col("date"))).alias("day"), F.col("date").alias("session"))


def next_session(rows: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Rows with `session`, the market's first session on or after `day`; NULL after the last one.

    Days before the first session take the first, so no start date is needed.
    """
    first = calendar.groupBy("market").agg(F.min("date").alias("_first"))
    r = rows.join(first, "market", "left").withColumn("_day", F.greatest(F.col(day), F.col("_first")))
    m = session_map(calendar).withColumnRenamed("day", "_day")
    return r.join(m, ["market", "_day"], "left").drop("_day", "_first")


def bull_window(preds: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """LIVE BULL calls not cancelled whose effective session lies in [start, end].

    The upper end of the UTC prefilter reaches the scan. Its lower end is the window's start less the calendar's
    longest gap, unless the window holds a market's first session, which takes every earlier call.
    """
    start_, hi = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    gap = F.datediff("date", F.lag("date", 1).over(Window.partitionBy("market").orderBy("date")))
    longest = calendar.select("market", "date").distinct().select(gap.alias("g")).agg(F.max("g")).scalar()
    first = calendar.groupBy("market").agg(F.min("date").alias("f")).agg(F.max("f")).scalar()
    lo = F.date_sub(start_, F.coalesce(longest, F.lit(0)) + 1)
    p = preds.where(
        (F.col("source") == "LIVE") & (F.col("direction") == "BULL") & (F.col("status") != "CANCELLED")
        & (F.col("created_at") < F.date_add(hi, 1).cast("timestamp")) & ((first >= start_) | (F.col("created_at") >= lo.cast("timestamp")))
    ).withColumn("local_date", fd.local_date(F.col("created_at"), F.col("market")))
    out = next_session(p, calendar, "local_date").withColumnRenamed("session", "entry_date")
    return out.where(F.col("entry_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def carry_forward(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mark per ticker and session: the session's close, else the last known one.

    Each bar covers the sessions up to the ticker's next bar; no grid of tickers by days is crossed.
    """
    idx = F.row_number().over(Window.partitionBy("market").orderBy("date"))
    cal = calendar.select("market", "date").distinct().withColumn("si", idx)
    last = cal.groupBy("market").agg(F.max("si").alias("smax"))
    b = bars.select("ticker", "market", "date", "close").join(cal, ["market", "date"]).join(last, "market")
    nxt = F.lead("si", 1).over(Window.partitionBy("ticker").orderBy("date"))
    b = b.withColumn("_n", F.coalesce(nxt - 1, F.col("smax")))
    b = b.select("ticker", "market", F.col("close").alias("mark"), F.col("si").alias("_own"), F.explode(F.sequence("si", "_n")).alias("si"))
    return b.join(cal, ["market", "si"]).select(
        "ticker", "market", "date", "mark", (F.col("si") != F.col("_own")).alias("carried")
    )


def round_trips(trades: DataFrame) -> DataFrame:
    """Realised trades: last BUY and last SELL per prediction by a pivoting aggregate, no self-join."""
    leg = lambda s: F.max_by(
        F.struct("ticker", "net_cash_delta", "reason"), F.when(F.col("side") == s, F.col("trade_id"))
    )
    g = trades.where("prediction_id IS NOT NULL").groupBy("prediction_id").agg(leg("BUY").alias("b"), leg("SELL").alias("s"))
    g = g.where("b IS NOT NULL AND s IS NOT NULL")
    cost = -F.col("b.net_cash_delta")
    pnl = F.col("s.net_cash_delta") - cost
    return g.select(
        "prediction_id", F.col("b.ticker").alias("ticker"), cost.alias("buy_cost"), pnl.alias("pnl"),
        F.coalesce(F.try_divide(pnl, cost), F.lit(0.0)).alias("ret"), F.col("s.reason").alias("exit_reason"),
    )


def win_stats(realized: DataFrame) -> DataFrame:
    """Overall row (exit_reason ALL) and one per exit reason."""
    g = realized.groupingSets([[], ["exit_reason"]], "exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.avg("ret").alias("avg_ret"),
        F.sum("pnl").alias("total_pnl"), F.grouping("exit_reason").alias("_g"),
    )
    return g.select(
        F.when(F.col("_g") == 1, "ALL").otherwise(F.col("exit_reason")).alias("exit_reason"), "n", "wins",
        F.try_divide("wins", "n").alias("win_rate"), "avg_ret", "total_pnl",
    )


def by_confidence(realized: DataFrame, confidence: DataFrame) -> DataFrame:
    """Round trips by the confidence band of their prediction; outside all bands is left out."""
    j = realized.join(confidence, "prediction_id")
    band = None
    for lo, hi in zip(CONFIDENCE_EDGES, CONFIDENCE_EDGES[1:]):
        label = f"{lo:.2f}-{min(hi, 1.0):.2f}"
        cond = (F.col("confidence") >= lo) & (F.col("confidence") < hi)
        band = F.when(cond, label) if band is None else band.when(cond, label)
    return j.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("ret").alias("avg_ret"), F.sum("pnl").alias("total_pnl"),
    )


def book_metrics(nav: DataFrame, keys: list[str]) -> DataFrame:
    """Return, drawdown, Sharpe and benchmark return per account from its daily NAV rows."""
    w = Window.partitionBy(*keys).orderBy("date")
    peak = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev = F.lag("nav", 1).over(w)
    d = nav.withColumns(
        {"_dd": F.when(peak > 0, F.col("nav") / peak - 1), "_r": F.when(prev != 0, F.col("nav") / prev - 1)}
    )
    first = lambda c: F.min_by(c, "date")
    last = lambda c: F.max_by(c, "date")
    sd = F.stddev_samp("_r")
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), last("nav").alias("final_nav"),
        F.coalesce(last("cumulative_return"), F.try_divide(last("nav"), first("nav")) - 1).alias("cumulative_return"),
        F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"),
        F.when(sd > 0, F.avg("_r") / sd * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.when((first("benchmark_nav") != 0) & (last("benchmark_nav") != 0), F.try_divide(last("benchmark_nav"), first("benchmark_nav")) - 1).alias("benchmark_return"),
    )
    return g


def frictions(trades: DataFrame, keys: list[str], initial: float) -> DataFrame:
    g = trades.groupBy(*keys).agg(F.sum(F.col("fees") + F.col("tax") + F.col("slippage")).alias("frictions"))
    return g.withColumn("share_of_initial", F.col("frictions") / initial)


def review_flags(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """Advisory flags of the weekly review, one row per rule with whether it fires."""
    n_of = lambda r: F.coalesce(F.max(F.when(F.col("exit_reason") == r, F.col("n"))), F.lit(0))
    a = stats.agg(
        (n_of("stop_hit") > n_of("target_hit")).alias("stops_exceed_targets"),
        F.coalesce(F.max(F.when(F.col("exit_reason") == "ALL", (F.col("win_rate") < 0.5) & (F.col("n") >= 10))), F.lit(False)).alias("below_coin_flip"),
    )
    b = bands.agg(F.coalesce(F.max((F.col("n") >= 5) & (F.col("avg_ret") < 0)), F.lit(False)).alias("v"))
    neg = b.select("v").scalar()
    rows = a.withColumn("negative_band", neg)
    names = ["stops_exceed_targets", "below_coin_flip", "negative_band"]
    return rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("fires")) for n in names])))
