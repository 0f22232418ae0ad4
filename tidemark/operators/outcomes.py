"""Closing predictions against prices, and the guards that new predictions pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as fd

DUP_KEY = ["ticker", "market", "direction", "timeframe", "source"]


def latest_price(bars: DataFrame, asof=None) -> DataFrame:
    b = bars if asof is None else bars.where(F.col("date") <= F.lit(asof).cast("date"))
    return b.groupBy("ticker").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("price_date"))


def outcome(preds: DataFrame, asof, hit: float = 0.03, miss: float = 0.05) -> DataFrame:
    """New status and position return of OPEN rows at `price`; MISS before HIT, NULL stays open.

    A target or stop of 0 counts as absent. NEUTRAL can only hit at expiry.
    """
    c = F.col
    e, p, d = c("entry_price"), c("price"), c("direction")
    change = F.try_divide(p - e, e)
    sign = F.when(d == "BEAR", -1.0).otherwise(1.0)
    level = lambda name, pct: F.when(F.coalesce(c(name), F.lit(0.0)) != 0, c(name)).otherwise(e * (1 + pct))
    due = fd.business_days(fd.local_date(c("created_at"), c("market")), F.lit(asof).cast("date")) >= fd.timeframe_days(c("timeframe"))
    missed = (
        F.when(d == "BULL", p <= level("stop_price", -miss)).when(d == "BEAR", p >= level("stop_price", miss))
        .otherwise(F.abs(change) > hit)
    )
    reached = (
        F.when(d == "BULL", p >= level("target_price", hit)).when(d == "BEAR", p <= level("target_price", -hit))
        .otherwise((F.abs(change) <= hit) & due)
    )
    status = F.when(missed, "MISS").when(reached, "HIT").when(due, "EXPIRED")
    ok = (e > 0) & p.isNotNull()
    return preds.withColumns(
        {"new_status": F.when(ok, status), "new_return": F.when(ok, F.round(sign * change * 100, 2)), "price_missing": p.isNull()}
    )


def track_outcomes(preds: DataFrame, prices: DataFrame, asof) -> DataFrame:
    """Every OPEN prediction evaluated at its ticker's latest price; unpriced rows are flagged."""
    return outcome(preds.where("status = 'OPEN'").join(prices.select("ticker", "price"), "ticker", "left"), asof)


def apply_outcomes(preds: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge (id, new_status, new_return, new_date): only OPEN rows change; of several updates of an id the first by date."""
    first = F.min(F.struct("new_date", "new_status", "new_return")).alias("u")
    u = updates.where("new_status IS NOT NULL").groupBy("id").agg(first).select("id", "u.*")
    j = preds.join(u, "id", "left")
    hit = (F.col("status") == "OPEN") & F.col("new_status").isNotNull()
    return j.withColumns(
        {
            "status": F.when(hit, F.col("new_status")).otherwise(F.col("status")),
            "outcome_return": F.when(hit, F.col("new_return")).otherwise(F.col("outcome_return")),
            "outcome_date": F.when(hit, F.col("new_date")).otherwise(F.col("outcome_date")),
        }
    ).drop("new_status", "new_return", "new_date")


def cancel(preds: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_x")).distinct()
    out = preds.join(hit, "id", "left")
    gone = (F.col("status") == "OPEN") & F.coalesce("_x", F.lit(False))
    return out.withColumn("status", F.when(gone, "CANCELLED").otherwise(F.col("status"))).drop("_x")


def validation_errors() -> Column:
    """Error codes of a raw prediction row with string-typed fields; empty when valid."""
    c = F.col
    required = ["ticker", "market", "direction", "confidence", "timeframe", "reasoning", "entry_price"]
    missing = [F.when(F.coalesce(c(n), F.lit("")) == "", F.lit(f"missing {n}")) for n in required]
    enum = lambda n, vals: F.when(c(n).isNotNull() & ~c(n).isin(*vals), F.lit(f"invalid {n}"))
    conf = c("confidence").try_cast("double")

    def price(n):
        v = c(n).try_cast("double")
        return [
            F.when(c(n).isNotNull() & v.isNull(), F.lit(f"{n} not numeric")),
            F.when(v.isNotNull() & (F.isnan(v) | (v == float("inf")) | (v <= 0)), F.lit(f"{n} must be finite and positive")),
        ]

    return F.array_compact(
        F.array(
            *missing, enum("market", ("US", "KR")), enum("direction", ("BULL", "BEAR", "NEUTRAL")),
            enum("timeframe", ("1W", "2W", "1M", "3M", "6M", "1Y")),
            F.when(c("confidence").isNotNull() & conf.isNull(), F.lit("confidence not numeric")),
            F.when(F.isnan(conf) | ~conf.between(0, 1), F.lit("confidence out of range")),
            *price("entry_price"), *price("target_price"), *price("stop_price"),
        )
    )


def overextended(components: Column) -> Column:
    """EXTREME level, or a numeric (or numeric-string) trailing month above 20 %; booleans ignored."""
    v = F.try_parse_json(components)
    r = F.try_variant_get(v, "$.return_1m", "variant")
    is_bool = F.coalesce(F.schema_of_variant(r) == "BOOLEAN", F.lit(False))
    num = F.when(~is_bool, F.try_variant_get(r, "$", "string").try_cast("double"))
    extreme = F.try_variant_get(v, "$.overextension", "string") == "EXTREME"
    return F.coalesce(extreme, F.lit(False)) | F.coalesce(num > 0.20, F.lit(False))


def insert_reasons(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Reason each new row is rejected for, NULL when it may be inserted.

    Guard order: LIVE BEAR, LIVE 1Y, overextended LIVE BULL, same-day duplicate of an OPEN row,
    duplicate of an earlier accepted row of the batch. The batch duplicates compare with a per-key
    minimum, so a key repeated in a third of the batch still aggregates map-side.
    """
    live = F.col("source") == "LIVE"
    guard = (
        F.when(live & (F.col("direction") == "BEAR"), "live_bear")
        .when(live & (F.col("timeframe") == "1Y"), "live_1y")
        .when(live & (F.col("direction") == "BULL") & overextended(F.col("components")), "overextended")
    )
    b = batch.withColumns({"_g": guard, "_day": F.to_date("created_at")})
    have = existing.where("status = 'OPEN'").select(*DUP_KEY, F.to_date("created_at").alias("_day")).distinct().withColumn("_x", F.lit(True))
    b = b.join(have, [*DUP_KEY, "_day"], "left")
    first = b.where("_g IS NULL AND _x IS NULL").groupBy(*DUP_KEY, "_day").agg(F.min_by("id", F.struct("created_at", "id")).alias("_first"))
    b = b.join(first, [*DUP_KEY, "_day"], "left")
    reason = F.when(F.col("_g").isNotNull(), F.col("_g")).when(F.col("_x"), "duplicate_open").when(F.col("id") != F.col("_first"), "duplicate_batch")
    return b.withColumn("reject_reason", reason).drop("_g", "_day", "_x", "_first")


def macro_skip_reason(risk_level: Column) -> Column:
    """Reason codes of the scheduled logger, in its order, for rows stored as LIVE."""
    c = F.col
    return (
        F.when(F.size("errors") > 0, "invalid").when(c("timeframe") == "1Y", "live_1y")
        .when((risk_level == "RISK_OFF") & (c("direction") == "BULL"), "macro_risk_off")
        .when(c("direction") == "BEAR", "live_bear")
    )


def low_edge(direction: Column, source: Column, raw: Column, band=(0.60, 0.70)) -> Column:
    return (direction == "BULL") & (source == "LIVE") & raw.between(*band)


def fill_components(preds: DataFrame, metrics: DataFrame) -> DataFrame:
    """Inject overextension and return_1m from metrics where the JSON lacks them; never overwrite."""
    m = metrics.select("ticker", F.col("overextension_level").alias("_o"), F.col("return_1m").alias("_r"))
    j = preds.join(m, "ticker", "left")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>"))
    have = F.coalesce(F.try_variant_get(F.try_parse_json("components"), "$", "map<string,variant>"), none)
    fresh = F.try_variant_get(
        F.try_parse_json(F.to_json(F.struct(F.col("_o").alias("overextension"), F.col("_r").alias("return_1m")))),
        "$", "map<string,variant>",
    )
    extra = F.map_filter(fresh, lambda k, v: ~F.map_contains_key(have, k))
    return j.withColumn("components", F.to_json(F.map_concat(have, F.coalesce(extra, none)))).drop("_o", "_r")


def dedup_keep_first(preds: DataFrame) -> DataFrame:
    """Earliest OPEN row per same-day key and one of each exact resolved duplicate."""
    day = F.to_date("created_at")
    key = F.when(
        F.col("status") == "OPEN", F.to_json(F.struct(*DUP_KEY, day.alias("d")))
    ).otherwise(F.to_json(F.struct(*DUP_KEY, day.alias("d"), "entry_price", "status", "outcome_return")))
    k = preds.withColumn("_k", key)
    first = k.groupBy("_k").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    return preds.join(first.select("id"), "id", "left_semi")


def fix_returns(preds: DataFrame) -> DataFrame:
    """Dedup, then turn raw price changes of BEAR rows into position returns."""
    flip = F.when(F.col("direction") == "BEAR", F.round(-F.col("outcome_return"), 2)).otherwise(F.col("outcome_return"))
    return dedup_keep_first(preds).withColumn("outcome_return", flip)
