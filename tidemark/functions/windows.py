"""Rolling columns over a series: one row per (key, date), one shared window spec per key.

Every result is NULL until the frame holds enough rows; Spark alone would average a partial frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TRADING_DAYS_PER_YEAR = 252


def series_window(keys=("ticker",), order="date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _frame(w: WindowSpec, start: int, end: int) -> WindowSpec:
    return w.rowsBetween(start, end)


def gated(agg, value: Column, w: WindowSpec, n: int, end: int = 0) -> Column:
    """`agg(value)` over the n rows ending `end` rows from here, NULL if fewer than n values."""
    f = _frame(w, end - n + 1, end)
    return F.when(F.count(value).over(f) >= n, agg(value).over(f))


def sma(value: Column, w: WindowSpec, n: int) -> Column:
    return gated(F.avg, value, w, n)


def whole(price: Column) -> Column:
    """A price in millionths, as a whole number: sums of these do not depend on the order of addition."""
    return F.round(price * 1_000_000).cast("bigint")


def whole_mean(total: Column, n: int) -> Column:
    """Mean price from the sum of n prices in millionths; prices in whole cents give the mean of the cents, divided once."""
    return total / 10_000 / n / 100.0


def price_mean(close: Column, w: WindowSpec, n: int) -> Column:
    """`sma` of prices, summed exactly, so that equal means compare equal in rules."""
    f = _frame(w, -(n - 1), 0)
    return F.when(F.count(close).over(f) >= n, whole_mean(F.sum(whole(close)).over(f), n))


def trailing_return(close: Column, w: WindowSpec, k: int) -> Column:
    base = F.lag(close, k).over(w)
    return F.when(base > 0, (close - base) / base)


def pct_return(close: Column, w: WindowSpec, k: int = 5) -> Column:
    base = F.lag(close, k).over(w)
    return F.when(base == 0, 0.0).otherwise((close / base - 1) * 100)


def high_low_distance(close: Column, w: WindowSpec, n: int = 252) -> tuple[Column, Column]:
    f = _frame(w, -(n - 1), 0)
    hi, lo = F.max(close).over(f), F.min(close).over(f)
    return F.when(hi > 0, (close - hi) / hi), F.when(lo > 0, (close - lo) / lo)


def volume_ratio(volume: Column, w: WindowSpec, short: int = 5, long: int = 50) -> Column:
    a, b = sma(volume, w, short), sma(volume, w, long)
    return F.when(b != 0, a / b)


def volume_ratio_prior(volume: Column, w: WindowSpec, recent: int = 5, prior: int = 20) -> Column:
    """Mean of the last `recent` bars over the `prior` bars before them; 1.0 when undecided."""
    base = gated(F.avg, volume, w, prior, -recent)
    return F.coalesce(F.when(base > 0, sma(volume, w, recent) / base), F.lit(1.0))


def simple_return(close: Column, w: WindowSpec) -> Column:
    prev = F.lag(close, 1).over(w)
    return F.when(prev > 0, close / prev - 1)


def log_return(close: Column, w: WindowSpec) -> Column:
    prev = F.lag(close, 1).over(w)
    return F.when((prev > 0) & (close > 0), F.log(close / prev))


def contraction_ratio(ret: Column, w: WindowSpec, recent: int = 10, prior: int = 20) -> Column:
    a = gated(F.stddev_samp, ret, w, recent)
    b = gated(F.stddev_samp, ret, w, prior, -recent)
    return F.when(b != 0, a / b)


def realized_vol(log_ret: Column, w: WindowSpec, n: int = 20) -> Column:
    return gated(F.stddev_samp, log_ret, w, n) * F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR)))


def volume_pattern(volume: Column, w: WindowSpec, vol_ratio: Column) -> Column:
    """Dry-up (15 bars against the 30 before) and pickup: 1.0 both, 0.5 one, else 0."""
    return pattern(gated(F.avg, volume, w, 15, -5), gated(F.avg, volume, w, 30, -20), vol_ratio)


def pattern(recent: Column, older: Column, vol_ratio: Column) -> Column:
    dry = F.coalesce((older > 0) & (recent < older), F.lit(False))
    pickup = F.coalesce(vol_ratio.between(0.9, 2.0), F.lit(False))
    return F.when(dry & pickup, 1.0).when(dry | pickup, 0.5).otherwise(0.0)


def frame_sums(df: DataFrame, w: WindowSpec, value: Column, name: str) -> tuple[DataFrame, Callable[[int, int], Column]]:
    """Sums of whole numbers over many frames from one running sum and count: the work per row does not grow with the frames.

    Gives `df` with two columns more and a function of (n, end) for the sum of the n rows ending `end` rows back, NULL
    if fewer than n values. Both helper columns start with `name`.
    """
    until = _frame(w, Window.unboundedPreceding, 0)
    total, count = f"{name}_sum", f"{name}_count"
    out = df.withColumns({total: F.coalesce(F.sum(value).over(until), F.lit(0)), count: F.count(value).over(until)})

    def over(n: int, end: int = 0) -> Column:
        upto = lambda c, k: F.lag(c, k, 0).over(w) if k else F.col(c)
        part = lambda c: upto(c, -end) - upto(c, n - end)
        return F.when(part(count) >= n, part(total))

    return out, over


def short_extremes(df: DataFrame, w: WindowSpec, value: Column, name: str) -> DataFrame:
    """Adds the maximum and minimum of the last 16 rows, `name`_hi and `name`_lo, of which `extremes` puts longer frames together."""
    f = _frame(w, -15, 0)
    return df.withColumns({f"{name}_hi": F.max(value).over(f), f"{name}_lo": F.min(value).over(f)})


def extremes(w: WindowSpec, name: str, n: int = 252) -> tuple[Column, Column]:
    """Maximum and minimum of the last n (more than 16) rows: about n/16 steps a row, not n."""
    at = [*range(0, n - 16, 16), n - 16]
    part = lambda c: [F.lag(c, k).over(w) if k else F.col(c) for k in at]
    return F.greatest(*part(f"{name}_hi")), F.least(*part(f"{name}_lo"))


def wilder_averages(
    df: DataFrame, values: dict[str, Column], keys=("ticker",), order="date", index: str = "obs",
    period: int = 14,
) -> DataFrame:
    """Wilder-smoothed averages at every row, without a recursive fold.

    `index` is the 1-based number of the observation. The smoothed value is a weighted sum with
    weight q^(n - max(i, period)) / period, q = 1 - 1/period, so a running sum of x * q^-i gives it.
    The sum restarts every `block` rows, q^-block being 1e250 whatever the period, to stay within double
    range, and carries the previous block's end value; what lies two blocks back weighs 1e-250. With a period of 1 the
    average is the value itself.
    """
    if period == 1:
        return df.withColumns({k: F.when(F.col(index) >= 1, v) for k, v in values.items()})
    q = 1.0 - 1.0 / period
    block = max(int(250 / math.log10(1.0 / q)), period + 1)
    i = F.col(index)
    blk = F.floor(i / block)
    age = i - blk * block
    inside = (
        Window.partitionBy(*keys, "_wb").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    scale = F.pow(F.lit(1.0 / q), F.greatest(i, F.lit(period)) - blk * block)
    out = df.withColumn("_wb", blk)
    out = out.withColumns({f"_l_{k}": F.sum(v * scale).over(inside) for k, v in values.items()})
    shrink = F.pow(F.lit(q), age)
    ends = {
        f"_e_{k}": F.last(F.when(age == block - 1, F.col(f"_l_{k}") * shrink), True).over(before)
        for k in values
    }
    out = out.withColumns(ends)
    done = {
        k: F.when(
            i >= period,
            (F.col(f"_l_{k}") * shrink + F.coalesce(F.col(f"_e_{k}"), F.lit(0.0)) * shrink * q) / period,
        )
        for k in values
    }
    return out.withColumns(done).drop("_wb", *[f"_l_{k}" for k in values], *[f"_e_{k}" for k in values])


def rsi_from_averages(gain: Column, loss: Column) -> Column:
    return (
        F.when(gain.isNull(), None)
        .when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0))
        .otherwise(100 - 100 / (1 + gain / loss))
    )

