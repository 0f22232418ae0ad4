"""Calendar arithmetic as columns. The as-of date is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed


def _weekdays_before(d: Column) -> Column:
    """Weekdays from Monday 1970-01-05 through `d`, in closed form."""
    k = F.datediff(d, F.lit("1970-01-05").cast("date"))
    return 5 * F.floor(k / 7) + F.least(F.pmod(k, F.lit(7)) + 1, F.lit(5))


def business_days(start: Column, end: Column) -> Column:
    """Monday-Friday days in (start, end]; 0 when end is not after start. No holidays."""
    return F.when(end <= start, 0).otherwise(_weekdays_before(end) - _weekdays_before(start)).cast("int")


def business_day_after(start: Column, days: Column) -> Column:
    """The first date with `days` (at least one) business days since `start`, in closed form."""
    m = _weekdays_before(start) + days - 1
    return F.date_add(F.lit("1970-01-05").cast("date"), (7 * F.floor(m / 5) + F.pmod(m, F.lit(5))).cast("int"))


def weekday_dates(start: Column, end: Column, step: int = 1) -> Column:
    """Dates from start to end every `step` calendar days, weekends dropped after stepping."""
    days = F.sequence(start, end, F.expr(f"INTERVAL {int(step)} DAYS"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def timeframe_days(timeframe: Column, calendar: bool = False) -> Column:
    table = fixed.CALENDAR_DAYS if calendar else fixed.TRADING_DAYS
    out = F.lit(30 if calendar else None).cast("int")
    for k, n in table.items():
        out = F.when(timeframe == k, n).otherwise(out)
    return out


def local_date(ts: Column, market: Column) -> Column:
    """Exchange-local calendar date of an instant."""
    zone = F.when(market == "KR", "Asia/Seoul").otherwise("America/New_York")
    return F.to_date(F.from_utc_timestamp(ts, zone))


def market_open(ts: Column, market: Column, grace_minutes: int = 30) -> Column:
    """Weekday session test on exchange-local time; the US close has a grace period."""
    zone = F.when(market == "KR", "Asia/Seoul").otherwise("America/New_York")
    t = F.from_utc_timestamp(ts, zone)
    # to the microsecond: a close at 15:30:00 does not hold 15:30:00.5
    minute = F.hour(t) * 60 + F.minute(t) + F.date_part(F.lit("second"), t) / 60
    us = minute.between(9 * 60 + 30, 16 * 60 + grace_minutes)
    kr = minute.between(9 * 60, 15 * 60 + 30)
    return (F.weekday(t) < 5) & F.when(market == "KR", kr).otherwise(us)


def rfc822(raw: Column) -> Column:
    """RFC-822 date to an instant; no zone means UTC; NULL when unparseable."""
    s = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    s = F.regexp_replace(s, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    s = F.when(s.rlike(r"[+-]\d{4}$"), s).otherwise(F.concat(s, F.lit(" +0000")))
    return F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss xx"))


def compact_utc(raw: Column) -> Column:
    """YYYYMMDDTHHMMSSZ to an instant."""
    return F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))


def timespan_days(raw: Column) -> Column:
    """'24hours', '2d', '3w', '1month' to whole days, at least 1; 2 when unparseable."""
    s = F.lower(F.trim(raw))
    n = F.regexp_replace(s, "[^0-9]", "").try_cast("bigint")
    u = F.regexp_replace(s, "[^a-z]", "")
    days = (
        F.when(u.startswith("min"), F.lit(1))
        .when(u.isin("h", "hour", "hours"), F.ceil(n / 24))
        .when(u.isin("w", "week", "weeks"), n * 7)
        .when(u.isin("m", "month", "months"), n * 30)
        .when(u.isin("y", "year", "years"), n * 365)
        .otherwise(n)
    )
    return F.when(n.isNull() | (n == 0), 2).otherwise(F.greatest(days, F.lit(1))).cast("int")


def since_days(raw: Column) -> Column:
    """'30d', '30', '4w', '2m' to days."""
    s = F.lower(F.trim(raw))
    n = F.regexp_extract(s, "^([0-9]+)", 1).try_cast("int")
    return n * F.when(s.endswith("w"), 7).when(s.endswith("m"), 30).otherwise(1)
