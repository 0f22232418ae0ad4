"""Positions, reports and advice over a transactions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import ordered_blocks

CHUNK = 4096


def _compose(acc: Column, m: Column) -> Column:
    """Apply map m after map acc. A map sends (avg, pnl) to (a*avg + b, pnl + c + d*avg)."""
    return F.struct(
        (acc["a"] * m["a"]).alias("a"),
        (m["a"] * acc["b"] + m["b"]).alias("b"),
        (acc["c"] + m["c"] + m["d"] * acc["b"]).alias("c"),
        (acc["d"] + m["d"] * acc["a"]).alias("d"),
    )


def _identity() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))


def _fold(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Compose each key's maps in `order`; the caller bounds the number of maps per key."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("m").alias("m"))))
    g = df.groupBy(*keys).agg(items.alias("_i"))
    return g.select(*keys, F.aggregate("_i", _identity(), lambda acc, x: _compose(acc, x["m"])).alias("m"))


def positions(tx: DataFrame, keys: list[str], order: list[str], open_only: bool = True, blocks: int | None = None) -> DataFrame:
    """Quantity, moving-average cost and realised P&L per key.

    The history fold is order-dependent, but given the running quantity each trade is an affine map
    of the average cost, and such maps compose. The table is cut into range blocks in (key, time)
    order, so a key with a third of all trades spans many tasks; each block is folded in chunks of
    at most CHUNK trades, chunks into blocks, blocks into keys.
    """
    sell = F.col("side") == "SELL"
    signed = F.when(sell, -F.col("quantity")).otherwise(F.col("quantity"))
    cols = [*keys, *[c for c in order if c not in keys], "side", "quantity", "price"]
    cut = ordered_blocks(tx.select(*dict.fromkeys(cols)), [*keys, *order], blocks)
    in_block = Window.partitionBy("_block", *keys).orderBy(*order)
    cut = cut.withColumns({"_rn": F.row_number().over(in_block) - 1, "_signed": signed})
    per_block = cut.groupBy("_block", *keys).agg(F.sum("_signed").alias("_q"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("_block", *keys, F.coalesce(F.sum("_q").over(before), F.lit(0.0)).alias("_q0"))
    run = F.sum("_signed").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = cut.withColumn("_run", run).join(starts, ["_block", *keys])
    after = F.col("_q0") + F.col("_run")
    held, q, p = after - F.col("_signed"), F.col("quantity"), F.col("price")
    averages = ~sell & (after > 0)
    step = F.struct(
        F.when(averages, held / after).otherwise(1.0).alias("a"),
        F.when(averages, q * p / after).otherwise(0.0).alias("b"),
        F.when(sell, p * q).otherwise(0.0).alias("c"),
        F.when(sell, -q).otherwise(0.0).alias("d"),
    )
    rows = rows.select("_block", *keys, F.col("_rn"), F.floor(F.col("_rn") / CHUNK).alias("_chunk"), step.alias("m"))
    chunks = _fold(rows, ["_block", *keys, "_chunk"], "_rn")
    by_block = _fold(chunks, ["_block", *keys], "_chunk")
    total = _fold(by_block, keys, "_block")
    qty = per_block.groupBy(*keys).agg(F.sum("_q").alias("quantity"))
    out = total.join(qty, keys).select(
        *keys, "quantity", F.col("m.b").alias("avg_price"), (F.col("quantity") * F.col("m.b")).alias("total_cost"),
        F.col("m.c").alias("realized_pnl"),
    )
    return out.where("quantity > 0") if open_only else out


def holdings_report(pos: DataFrame, prices: DataFrame) -> DataFrame:
    """Per holding: market value and unrealised P&L, NULL without a price."""
    j = pos.join(prices.select("ticker", F.col("price").alias("current_price")), "ticker", "left")
    mv = F.col("quantity") * F.col("current_price")
    un = mv - F.col("total_cost")
    pct = F.when(F.col("current_price").isNotNull(), F.coalesce(F.try_divide(un, F.col("total_cost")) * 100, F.lit(0.0)))
    return j.withColumns({"market_value": mv, "unrealized_pnl": un, "unrealized_pnl_pct": F.round(pct, 2)})


def report_totals(report: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per portfolio; unpriced holdings count in cost and realised P&L only."""
    g = report.groupBy(*keys).agg(
        F.sum("total_cost").alias("total_cost"),
        F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("total_market_value"),
        F.coalesce(F.sum("unrealized_pnl"), F.lit(0.0)).alias("total_unrealized_pnl"),
        F.sum("realized_pnl").alias("total_realized_pnl"),
    )
    ret = F.col("total_unrealized_pnl") + F.col("total_realized_pnl")
    return g.withColumn("total_return_pnl", ret).withColumn(
        "total_return_pct", F.round(F.coalesce(F.try_divide(ret, F.col("total_cost")) * 100, F.lit(0.0)), 2)
    )


def risk_weights(pos: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of each holding in its portfolio; a missing price falls back to average cost.

    Totals are aggregated and joined back, so a large portfolio is not one window task.
    """
    j = pos.join(prices.select("ticker", F.col("price").alias("_p")), "ticker", "left")
    j = j.withColumn("market_value", F.col("quantity") * F.coalesce("_p", "avg_price")).drop("_p")
    tot = j.groupBy(*keys).agg(F.sum("market_value").alias("total_value"))
    w = F.round(F.coalesce(F.try_divide("market_value", "total_value") * 100, F.lit(0.0)), 2)
    return j.join(tot, keys).withColumn("weight_pct", w)


def risk_summary(weights: DataFrame, keys: list[str], limit_pct: float = 30.0) -> DataFrame:
    return weights.groupBy(*keys).agg(
        F.round(F.sum(F.pow("weight_pct", F.lit(2)))).cast("bigint").alias("hhi"),
        F.count(F.lit(1)).alias("position_count"),
        F.max("total_value").alias("total_value"),
        F.count_if(F.col("weight_pct") > limit_pct).alias("warnings"),
    )


def sector_weights(weights: DataFrame, sectors: DataFrame, keys: list[str]) -> DataFrame:
    j = weights.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    g = j.groupBy(*keys, "sector").agg(F.sum("market_value").alias("_v"), F.max("total_value").alias("_t"))
    return g.select(*keys, "sector", F.round(F.coalesce(F.try_divide("_v", "_t") * 100, F.lit(0.0)), 2).alias("weight_pct"))


def vs_predictions(held: DataFrame, preds: DataFrame, last_n: int = 5) -> DataFrame:
    """Newest predictions per held ticker; an OPEN BEAR call on a holding is a mismatch."""
    w = Window.partitionBy("ticker").orderBy(F.desc("created_at"), F.desc("id"))
    mine = preds.join(held.select("ticker").distinct(), "ticker", "left_semi")
    out = mine.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last_n).drop("_r")
    return out.withColumn("mismatch", (F.col("direction") == "BEAR") & (F.col("status") == "OPEN"))


def advice(pos: DataFrame, prices: DataFrame, averages: DataFrame, stop_pct: float = -10.0) -> DataFrame:
    """Stop-loss flag and position against the 50/200-bar means; unpriced holdings give no row."""
    j = pos.join(prices.select("ticker", F.col("price").alias("current_price")), "ticker").join(
        averages.select("ticker", "ma50", "ma200"), "ticker", "left"
    )
    pnl = F.coalesce(F.try_divide(F.col("current_price") - F.col("avg_price"), F.col("avg_price")) * 100, F.lit(0.0))
    return j.withColumns(
        {
            "pnl_pct": F.round(pnl, 2),
            "stop_loss": pnl <= stop_pct,
            "above_ma50": F.col("current_price") > F.col("ma50"),
            "above_ma200": F.col("current_price") > F.col("ma200"),
        }
    )


def linked_predictions(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Latest OPEN prediction and latest of any status per ticker, in one map-side aggregate."""
    keys = keys or ["ticker"]
    body = F.struct("id", "direction", "status", "target_price", "stop_price")
    at = F.struct("created_at", "id")
    return preds.groupBy(*keys).agg(
        F.max_by(body, F.when(F.col("status") == "OPEN", at)).alias("open_pred"),
        F.max_by(body, at).alias("latest_pred"),
    )


def exit_actions(holdings: DataFrame, atr_mult: float = 3.0, tp_rr: float = 2.0) -> DataFrame:
    """Advisory action per long: EXIT, TRIM, WATCH (no data), ADD, WATCH (bear link), HOLD, WATCH.

    Needs price, ma20, ma50, ma200, rsi14, overextension_level, swing_high, atr14, open_pred,
    latest_pred. Only a BULL link supplies stop and target.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    price, avg = c("price"), c("avg_price")
    bull = yes(c("open_pred.direction") == "BULL")
    bear = yes(c("open_pred.direction") == "BEAR")
    d = holdings.withColumns(
        {
            "trailing_stop": c("swing_high") - atr_mult * c("atr14"),
            "_stop": F.when(bull, c("open_pred.stop_price")),
            "_target": F.when(bull, c("open_pred.target_price")),
            "_pnl": F.when(avg != 0, (price - avg) / avg * 100),
        }
    )
    stop_eff = F.greatest("_stop", "trailing_stop")
    rr = F.when(avg - stop_eff > 0, (price - avg) / (avg - stop_eff))
    level = F.upper(F.coalesce("overextension_level", F.lit("NONE")))
    exits = F.array_compact(
        F.array(
            F.when(price < c("_stop"), "below linked stop"),
            F.when((c("latest_pred.status") == "MISS") & (c("latest_pred.direction") == "BULL"), "thesis missed"),
            F.when(price < c("ma200"), "below MA200"),
            F.when(price < c("trailing_stop"), "below trailing stop"),
        )
    )
    trims = F.array_compact(
        F.array(
            F.when(rr >= tp_rr, "take-profit multiple reached"),
            F.when((level == "EXTREME") & (c("_pnl") > 20.0), "blow-off with gain"),
            F.when((c("ma20") < c("ma50")) & (c("_pnl") > 0), "MA20 below MA50 while profitable"),
        )
    )
    add = (
        (level == "NONE") & yes(c("rsi14").between(45.0, 65.0))
        & yes((c("ma20") > c("ma50")) & (c("ma50") > c("ma200")))
        & yes(c("_pnl").between(0.0, 20.0)) & (c("open_pred").isNull() | bull)
    )
    hold = yes(price > c("ma200")) & (c("trailing_stop").isNull() | yes(price >= c("trailing_stop")))
    action = (
        F.when(price.isNull(), "WATCH").when(F.size(exits) > 0, "EXIT").when(F.size(trims) > 0, "TRIM")
        .when(c("ma200").isNull(), "WATCH").when(add, "ADD").when(bear, "WATCH").when(hold, "HOLD").otherwise("WATCH")
    )
    one = lambda s: F.array(F.lit(s))
    reasons = (
        F.when(price.isNull(), one("no current price")).when(F.size(exits) > 0, exits).when(F.size(trims) > 0, trims)
        .when(c("ma200").isNull(), one("insufficient metrics")).when(add, one("trend intact, modest gain"))
        .when(bear, one("bear link contradicts the long")).when(hold, one("trend intact")).otherwise(one("mixed signals"))
    )
    span = c("_target") - c("_stop")
    return d.select(
        "*", action.alias("action"), reasons.alias("reasons"), bear.alias("bear_contradiction"),
        F.round("_pnl", 2).alias("pnl_pct"),
        F.round(F.when(span != 0, (price - c("_stop")) / span), 3).alias("rr_progress"),
    ).drop("_stop", "_target", "_pnl")


def reconcile(broker: DataFrame, local: DataFrame, keys: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Synthetic trades that bring local positions to the broker's snapshot.

    New and increased lots price at the broker's average, decreases at its current price, closed
    positions at the local average.
    """
    b = broker.select(*keys, F.col("quantity").alias("_bq"), F.col("average_price").alias("_ba"), F.col("current_price").alias("_bc"))
    l = local.select(*keys, F.col("quantity").alias("_lq"), F.col("avg_price").alias("_la"))
    j = b.join(l, keys, "full_outer")
    delta = F.col("_bq") - F.col("_lq")
    case = (
        F.when(F.col("_lq").isNull(), "new").when(F.col("_bq").isNull(), "closed")
        .when(F.abs(delta) < tolerance, None).when(delta > 0, "increased").otherwise("decreased")
    )
    out = j.withColumn("note", case).where("note IS NOT NULL")
    n = F.col("note")
    return out.select(
        *keys, "note", F.when(n.isin("new", "increased"), "BUY").otherwise("SELL").alias("side"),
        F.when(n == "new", F.col("_bq")).when(n == "closed", F.col("_lq")).otherwise(F.abs(delta)).alias("quantity"),
        F.when(n == "closed", F.col("_la")).when(n == "decreased", F.col("_bc")).otherwise(F.col("_ba")).alias("price"),
    )


def last_transactions(tx: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows per key (the limit is applied map-side before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return tx.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def minmax(value: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    """0-100 between a group's lowest and highest value; NULL passes, a flat group scores 100."""
    s = F.try_divide(value - lo, hi - lo) * 100
    return F.when(value.isNull(), None).when(hi == lo, 100.0).otherwise(F.round(100 - s if invert else s, 4))


def etf_scores(etf: DataFrame, keys: list[str]) -> DataFrame:
    """Cost and liquidity scores relative to the comparison group.

    Group bounds are aggregated and joined back, so a large group is not one window task. Without a
    fee the composite is liquidity alone; without a deviation its weight is shared out.
    """
    dims = {
        "fee": F.col("fee"), "aum": F.col("aum").cast("double"), "val": F.col("traded_value").cast("double"),
        "dev": F.abs(F.col("deviation")),
    }
    bounds = etf.groupBy(*keys).agg(*[f(v).alias(f"_{n}_{k}") for k, v in dims.items() for n, f in (("lo", F.min), ("hi", F.max))])
    d = etf.join(bounds, keys)
    score = lambda k, inv=False: minmax(dims[k], F.col(f"_lo_{k}"), F.col(f"_hi_{k}"), inv)
    d = d.withColumns({"cost_score": score("fee", True), "_a": score("aum"), "_v": score("val"), "_d": score("dev", True)})
    liq = F.round(
        F.when(F.col("_d").isNull(), (0.5 * F.col("_a") + 0.3 * F.col("_v")) / 0.8).otherwise(
            0.5 * F.col("_a") + 0.3 * F.col("_v") + 0.2 * F.col("_d")
        ), 4,
    )
    d = d.withColumn("liquidity_score", liq)
    comp = F.when(F.col("cost_score").isNull(), F.col("liquidity_score")).otherwise(
        F.round(0.5 * F.col("cost_score") + 0.5 * F.col("liquidity_score"), 4)
    )
    return d.withColumn("composite", comp).drop("_a", "_v", "_d", *[f"_{n}_{k}" for k in dims for n in ("lo", "hi")])


def top_etfs(scored: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Best `top` per group: composite, then lower fee, larger size, code."""
    w = Window.partitionBy(*keys).orderBy(
        F.col("composite").desc_nulls_last(), F.col("fee").asc_nulls_last(), F.col("aum").desc_nulls_last(), "code"
    )
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def class_values(pos: DataFrame, prices: DataFrame, code_class: DataFrame, keys: list[str]) -> DataFrame:
    """Value per asset class; positions of no class are listed under NULL and left out of totals."""
    j = pos.join(code_class, "ticker", "left").join(prices.select("ticker", F.col("price").alias("_p")), "ticker", "left")
    v = F.col("quantity") * F.coalesce("_p", "avg_price")
    return j.groupBy(*keys, "asset_class").agg(F.sum(v).alias("value"), F.count(F.lit(1)).alias("n_positions"))


def net_contributions(tx: DataFrame, keys: list[str]) -> DataFrame:
    cash = F.col("quantity") * F.col("price")
    v = F.when(F.col("side") == "BUY", cash).when(F.col("side") == "SELL", -cash).otherwise(0.0)
    # exact decimal sum, so that a half is a half before it is rounded to even
    return tx.groupBy(*keys).agg(F.bround(F.sum(v.cast("decimal(28,6)")), 0).cast("bigint").alias("contributions"))


def target_status(values: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Class weights and since-inception return; NULL return when nothing was contributed."""
    t = values.where("asset_class IS NOT NULL").groupBy(*keys).agg(F.sum("value").alias("total"))
    j = t.join(contributions, keys)
    n = F.col("contributions")
    return j.withColumn("return_pct", F.round(F.when(n > 0, (F.col("total") - n) / n * 100), 2))


def effective_targets(targets: DataFrame, keys: list[str], cap: float = 10.0) -> DataFrame:
    """Tilts clamped to the cap, floored at zero and renormalised to 100; all-zero ignores the tilt.

    A portfolio has a handful of classes, so the windows stay small.
    """
    w = Window.partitionBy(*keys)
    tilt = F.coalesce(F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("tilt"))), F.lit(0.0))
    d = targets.withColumn("_e", F.greatest(F.lit(0.0), F.col("target") + tilt))
    tot = F.sum("_e").over(w)
    base = F.sum("target").over(w)
    eff = F.when(tot <= 0, F.try_divide(F.col("target") * 100, base)).otherwise(F.try_divide(F.col("_e") * 100, tot))
    return d.withColumn("effective", eff).drop("_e")


def allocate(targets: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Integer contribution per class toward the deficits, by largest remainder, exact in total."""
    w = Window.partitionBy(*keys)
    e = effective_targets(targets, keys)
    value = F.coalesce("value", F.lit(0.0))
    after = F.sum(value).over(w) + F.col(amount)
    e = e.withColumn("_d", F.greatest(F.lit(0.0), after * F.col("effective") / 100 - value))
    ds = F.sum("_d").over(w)
    raw = F.when(ds > 0, F.try_divide(F.col(amount) * F.col("_d"), ds)).otherwise(F.col(amount) * F.col("effective") / 100)
    e = e.withColumn("_raw", raw).withColumn("_f", F.floor("_raw"))
    e = e.withColumn("_left", F.col(amount) - F.sum("_f").over(w))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("_raw") - F.col("_f")), "asset_class")
    buy = F.col("_f") + F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)
    return e.withColumn("buy", buy).drop("_d", "_raw", "_f", "_left")


def drift(values: DataFrame, targets: DataFrame, keys: list[str], band: float = 5.0) -> DataFrame:
    """Weight minus target over the union of classes; a breach is decided on the rounded value."""
    v = values.where("asset_class IS NOT NULL").select(*keys, "asset_class", "value")
    t = targets.select(*keys, "asset_class", "target")
    j = v.join(t, [*keys, "asset_class"], "full_outer")
    tot = F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy(*keys))
    weight = F.coalesce(F.when(tot > 0, F.coalesce("value", F.lit(0.0)) / tot * 100), F.lit(0.0))
    d = F.round(weight - F.coalesce("target", F.lit(0.0)), 3)
    return j.withColumns({"drift_pp": d, "breach": (F.abs(d) > band) & (tot > 0)})


def target_errors(allocation: Column, codes: Column, tolerance: float = 0.01) -> Column:
    """Errors of a target (maps class->weight, class->code); empty when it may be saved."""
    w = F.map_values(allocation)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    a, b = F.map_keys(allocation), F.map_keys(codes)
    return F.array_compact(
        F.array(
            F.when(F.exists(w, lambda x: (x < 0) | (x > 100)), "weight out of range"),
            F.when(F.abs(total - 100) > tolerance, "weights do not sum to 100"),
            F.when((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0), "class sets differ"),
            F.when(F.size(F.array_distinct(F.map_values(codes))) < F.size(codes), "duplicate codes"),
        )
    )
