"""Queries over transactions, positions, funds and paper trades."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, rd, rd_sql, round_printed_sql, text
from tidemark.catalog.series import metrics_cte
from tidemark.functions import dates as fd
from tidemark.operators import outcomes as oc
from tidemark.operators import paper as pp
from tidemark.operators import portfolio as pf
from tidemark.operators import series
from tidemark.session import stable

KEYS, ORDER = ["portfolio", "ticker"], ["date", "l_orderkey", "l_linenumber", "l_partkey"]
T = ("transactions",)

POS = """
hist AS (SELECT portfolio, ticker, list({'s': side, 'q': quantity, 'p': price, 'qty': 0.0::DOUBLE, 'avg': 0.0::DOUBLE, 'pnl': 0.0::DOUBLE} ORDER BY date, l_orderkey, l_linenumber, l_partkey) AS h
  FROM transactions GROUP BY ALL),
fold AS (SELECT portfolio, ticker, list_reduce(list_concat([{'s': 'NONE', 'q': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'qty': 0.0::DOUBLE, 'avg': 0.0::DOUBLE, 'pnl': 0.0::DOUBLE}], h),
  lambda a, x: {'s': x.s, 'q': x.q, 'p': x.p, 'qty': CASE WHEN x.s = 'BUY' THEN a.qty + x.q ELSE a.qty - x.q END,
    'avg': CASE WHEN x.s = 'BUY' AND a.qty + x.q > 0 THEN (a.qty * a.avg + x.q * x.p) / (a.qty + x.q) ELSE a.avg END,
    'pnl': CASE WHEN x.s = 'SELL' THEN a.pnl + (x.p - a.avg) * x.q ELSE a.pnl END}) AS f FROM hist),
allpos AS (SELECT portfolio, ticker, f.qty AS quantity, f.avg AS avg_price, f.qty * f.avg AS total_cost, f.pnl AS realized_pnl FROM fold),
pos AS (SELECT * FROM allpos WHERE quantity > 0),
px AS (SELECT ticker, arg_max(close, date) AS price FROM bars WHERE ticker % 9 <> 0 GROUP BY ticker)"""
TB = ("transactions", "bars")


def positions(v):
    return pf.positions(v.transactions, KEYS, ORDER)


def prices(v):
    return oc.latest_price(v.bars.where("ticker % 9 <> 0"))


@query("win_positions", POS + f" SELECT portfolio, ticker, quantity, {rd_sql('avg_price')} AS avg_price, {rd_sql('total_cost', 4)} AS total_cost, {rd_sql('realized_pnl', 4)} AS realized_pnl FROM pos", TB)
def win_positions(v):
    return positions(v).select(*KEYS, "quantity", *rd("avg_price"), *rd("total_cost", "realized_pnl", n=4))


@query("flt_transactions", "SELECT CAST(date AS VARCHAR) AS date, l_orderkey, l_linenumber, side, quantity, price FROM transactions WHERE portfolio = 7 AND ticker = 3 ORDER BY date, l_orderkey", T)
def flt_transactions(v):
    return v.transactions.where("portfolio = 7 AND ticker = 3").orderBy("date", "l_orderkey").select(*text("date"), "l_orderkey", "l_linenumber", "side", "quantity", "price")


@query("win_last_n", """SELECT portfolio, CAST(date AS VARCHAR) AS date, l_orderkey, l_linenumber, l_partkey, ticker FROM (SELECT *, row_number() OVER (PARTITION BY portfolio
  ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, ticker DESC) AS rn FROM transactions) WHERE rn <= 10""", T)
def win_last_n(v):
    out = pf.last_transactions(v.transactions, ["portfolio"], [*ORDER, "ticker"], 10)
    return out.select("portfolio", *text("date"), "l_orderkey", "l_linenumber", "l_partkey", "ticker")


REP = """,
rep AS (SELECT pos.*, price AS current_price, quantity * price AS market_value, quantity * price - total_cost AS unrealized_pnl FROM pos LEFT JOIN px USING (ticker)),
tot AS (SELECT portfolio, sum(total_cost) AS total_cost, coalesce(sum(market_value), 0) AS total_market_value, coalesce(sum(unrealized_pnl), 0) AS total_unrealized_pnl, sum(realized_pnl) AS total_realized_pnl FROM rep GROUP BY portfolio)"""


@query("agg_report", POS + REP + """
SELECT portfolio, round(total_cost, 2) AS total_cost, round(total_market_value, 2) AS total_market_value, round(total_unrealized_pnl, 2) AS total_unrealized_pnl,
  round(total_realized_pnl, 2) AS total_realized_pnl, round((total_unrealized_pnl + total_realized_pnl) / total_cost * 100, 2) AS total_return_pct FROM tot""", TB)
def agg_report(v):
    t = pf.report_totals(pf.holdings_report(positions(v), prices(v)), ["portfolio"])
    r2 = [F.round(c, 2).alias(c) for c in ("total_cost", "total_market_value", "total_unrealized_pnl", "total_realized_pnl")]
    return t.select("portfolio", *r2, "total_return_pct")


@query("agg_report_holdings", POS + REP + """
SELECT portfolio, ticker, current_price, round(market_value, 2) AS market_value, round(unrealized_pnl / total_cost * 100, 2) AS unrealized_pnl_pct FROM rep""", TB)
def agg_report_holdings(v):
    r = pf.holdings_report(positions(v), prices(v))
    return r.select(*KEYS, "current_price", F.round("market_value", 2).alias("market_value"), "unrealized_pnl_pct")


RISK = """,
rv AS (SELECT pos.*, quantity * coalesce(price, avg_price) AS mv FROM pos LEFT JOIN px USING (ticker)),
rw AS (SELECT *, round(mv / sum(mv) OVER (PARTITION BY portfolio) * 100, 2) AS weight_pct, sum(mv) OVER (PARTITION BY portfolio) AS tv FROM rv)"""


@query("agg_risk", POS + RISK + """
SELECT portfolio, CAST(round(sum(weight_pct * weight_pct)) AS BIGINT) AS hhi, count(*) AS position_count, round(max(tv), 2) AS total_value, count(*) FILTER (weight_pct > 30) AS warnings FROM rw GROUP BY portfolio""", TB)
def agg_risk(v):
    s = pf.risk_summary(pf.risk_weights(positions(v), prices(v), ["portfolio"]), ["portfolio"])
    return s.withColumn("total_value", F.round("total_value", 2))


@query("agg_risk_sectors", POS + RISK + """
SELECT portfolio, coalesce(sector, 'Unknown') AS sector, round(sum(mv) / max(tv) * 100, 2) AS weight_pct FROM rw LEFT JOIN (SELECT * FROM sector_map WHERE ticker % 10 <> 3) USING (ticker) GROUP BY ALL""", (*TB, "sector_map"))
def agg_risk_sectors(v):
    return pf.sector_weights(pf.risk_weights(positions(v), prices(v), ["portfolio"]), v.sector_map.where("ticker % 10 <> 3"), ["portfolio"])


@query("join_vs_predictions", POS + """
SELECT ticker, id, direction, status, CAST(direction = 'BEAR' AND status = 'OPEN' AS INTEGER) AS mismatch FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, id DESC) AS rn FROM predictions WHERE ticker IN (SELECT ticker FROM pos WHERE portfolio = 3)) WHERE rn <= 5""", (*TB, "predictions"))
def join_vs_predictions(v):
    out = pf.vs_predictions(positions(v).where("portfolio = 3"), v.predictions)
    return out.select("ticker", "id", "direction", "status", F.col("mismatch").cast("int").alias("mismatch"))


LASTM = metrics_cte("bars") + """,
lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM metrics) WHERE rn = 1)"""


@query("rule_advice", POS + ",\n" + LASTM + """
SELECT portfolio, pos.ticker, round((price - avg_price) / avg_price * 100, 2) AS pnl_pct, CAST((price - avg_price) / avg_price * 100 <= -10 AS INTEGER) AS stop_loss,
  CAST(price > ma50 AS INTEGER) AS above_ma50, CAST(price > ma200 AS INTEGER) AS above_ma200 FROM pos JOIN px USING (ticker) LEFT JOIN lm ON lm.ticker = pos.ticker""", TB)
def rule_advice(v):
    m = series.horizon_metrics(v.bars)
    a = pf.advice(positions(v), prices(v), m)
    return a.select(*KEYS, "pnl_pct", *[F.col(c).cast("int").alias(c) for c in ("stop_loss", "above_ma50", "above_ma200")])


LINK = """
link AS (SELECT ticker, arg_max({'id': id, 'direction': direction, 'status': status, 'target': target_price, 'stop': stop_price}, row(created_at, id)) FILTER (status = 'OPEN') AS op,
  arg_max({'id': id, 'direction': direction, 'status': status}, row(created_at, id)) AS lp FROM predictions GROUP BY ticker)"""


@query("join_linked_prediction", LINK + " SELECT ticker, op.id AS open_id, op.direction AS open_direction, lp.id AS latest_id, lp.status AS latest_status FROM link", ("predictions",))
def join_linked_prediction(v):
    l = pf.linked_predictions(v.predictions)
    return l.select(
        "ticker", F.col("open_pred.id").alias("open_id"), F.col("open_pred.direction").alias("open_direction"),
        F.col("latest_pred.id").alias("latest_id"), F.col("latest_pred.status").alias("latest_status"),
    )


# half-up on the printed digits, as in the query
PNL, TRAIL = round_printed_sql("pnl", 2), round_printed_sql("tstop", 4)
PROGRESS = round_printed_sql("(price - st) / nullif(tg - st, 0)", 3)


@query("rule_exit_ladder", POS + ",\n" + LASTM + ",\n" + LINK.strip() + """,
at0 AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
at1 AS (SELECT *, max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS swing,
  sum(CASE WHEN i > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) ELSE 0 END * pow(14.0::DOUBLE / 13.0, greatest(i, 14))) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) * pow(13.0::DOUBLE / 14.0, i) / 14 AS atr,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM at0),
j AS (SELECT pos.*, price, ma20, ma50, ma200, rsi14, overextension_level AS lvl, swing - 3 * atr AS tstop, op, lp,
   CASE WHEN op.direction = 'BULL' THEN op.stop END AS st, CASE WHEN op.direction = 'BULL' THEN op.target END AS tg, (price - avg_price) / avg_price * 100 AS pnl
  FROM pos LEFT JOIN px USING (ticker) LEFT JOIN lm ON lm.ticker = pos.ticker LEFT JOIN at1 ON at1.ticker = pos.ticker AND at1.rn = 1 LEFT JOIN link ON link.ticker = pos.ticker),
k AS (SELECT *, CASE WHEN st IS NULL THEN tstop WHEN tstop IS NULL THEN st ELSE greatest(st, tstop) END AS es FROM j),
a AS (SELECT *, CASE WHEN price IS NULL THEN 'WATCH'
  WHEN coalesce(price < st, false) OR coalesce(lp.status = 'MISS' AND lp.direction = 'BULL', false) OR coalesce(price < ma200, false) OR coalesce(price < tstop, false) THEN 'EXIT'
  WHEN coalesce(avg_price - es > 0 AND (price - avg_price) / nullif(avg_price - es, 0) >= 2, false) OR coalesce(lvl = 'EXTREME' AND pnl > 20, false) OR coalesce(ma20 < ma50 AND pnl > 0, false) THEN 'TRIM'
  WHEN ma200 IS NULL THEN 'WATCH'
  WHEN lvl = 'NONE' AND coalesce(rsi14 BETWEEN 45 AND 65 AND ma20 > ma50 AND ma50 > ma200 AND pnl BETWEEN 0 AND 20, false) AND (op IS NULL OR op.direction = 'BULL') THEN 'ADD'
  WHEN coalesce(op.direction = 'BEAR', false) THEN 'WATCH' WHEN price > ma200 AND (tstop IS NULL OR price >= tstop) THEN 'HOLD' ELSE 'WATCH' END AS action FROM k)
SELECT portfolio, ticker, action, """ + f"{PNL} AS pnl_pct, {TRAIL} AS trailing_stop, {PROGRESS} AS rr_progress FROM a", (*TB, "predictions"))
def rule_exit_ladder(v):
    b = v.bars
    m = series.horizon_metrics(b).select("ticker", "ma20", "ma50", "ma200", "rsi14", "overextension_level")
    from tidemark.functions.windows import series_window

    s = series.atr(b).withColumn("swing_high", F.max("high").over(series_window().rowsBetween(-21, 0)))
    s = series.last_rows(s).select("ticker", "atr14", "swing_high")
    h = positions(v).join(prices(v).select("ticker", "price"), "ticker", "left").join(m, "ticker", "left").join(s, "ticker", "left")
    h = h.join(pf.linked_predictions(v.predictions), "ticker", "left")
    a = pf.exit_actions(h)
    return a.select(*KEYS, "action", "pnl_pct", F.round("trailing_stop", 4).alias("trailing_stop"), "rr_progress")


@query("join_reconcile", POS + """,
bk AS (SELECT portfolio, ticker, CASE WHEN ticker % 5 = 0 THEN quantity + 3 WHEN ticker % 5 = 1 THEN quantity - 1 WHEN ticker % 5 = 2 THEN quantity + 0.00001::DOUBLE ELSE quantity END AS q, 90.0::DOUBLE AS ap, 110.0::DOUBLE AS cp
   FROM allpos WHERE ticker % 5 <> 4),
lc AS (SELECT * FROM pos WHERE ticker % 7 <> 0),
j AS (SELECT coalesce(b.portfolio, l.portfolio) AS portfolio, coalesce(b.ticker, l.ticker) AS ticker, b.q AS bq, ap, cp, l.quantity AS lq, l.avg_price AS la FROM bk b FULL JOIN lc l ON l.portfolio = b.portfolio AND l.ticker = b.ticker),
k AS (SELECT *, CASE WHEN lq IS NULL THEN 'new' WHEN bq IS NULL THEN 'closed' WHEN abs(bq - lq) < 0.0001 THEN NULL WHEN bq > lq THEN 'increased' ELSE 'decreased' END AS note FROM j)
SELECT portfolio, ticker, note, CASE WHEN note IN ('new','increased') THEN 'BUY' ELSE 'SELL' END AS side, round(CASE note WHEN 'new' THEN bq WHEN 'closed' THEN lq ELSE abs(bq - lq) END, 6) AS quantity,
  round(CASE note WHEN 'closed' THEN la WHEN 'decreased' THEN cp ELSE ap END, 6) AS price FROM k WHERE note IS NOT NULL""", TB)
def join_reconcile(v):
    allpos = pf.positions(v.transactions, KEYS, ORDER, open_only=False)
    t = F.col("ticker") % 5
    q = F.when(t == 0, F.col("quantity") + 3).when(t == 1, F.col("quantity") - 1).when(t == 2, F.col("quantity") + 0.00001).otherwise(F.col("quantity"))
    broker = allpos.where(t != 4).select(*KEYS, q.alias("quantity"), F.lit(90.0).alias("average_price"), F.lit(110.0).alias("current_price"))
    out = pf.reconcile(broker, allpos.where("quantity > 0 AND ticker % 7 <> 0"), KEYS)
    return out.select(*KEYS, "note", "side", *r6("quantity", "price"))


ISA = POS + """,
cv AS (SELECT portfolio, sector AS asset_class, sum(quantity * coalesce(price, avg_price)) AS value, count(*) AS n_positions FROM pos LEFT JOIN px USING (ticker)
  LEFT JOIN (SELECT * FROM sector_map WHERE ticker % 10 <> 3) USING (ticker) GROUP BY ALL),
tg AS (SELECT portfolio, asset_class, value, 20.0::DOUBLE AS target, CAST((portfolio * 3 + row_number() OVER (PARTITION BY portfolio ORDER BY asset_class)) % 31 - 15 AS DOUBLE) AS tilt, 1000000 + portfolio * 7 AS amount
  FROM cv WHERE asset_class IS NOT NULL)"""
IV = (*TB, "sector_map")


def classes(v):
    cc = v.sector_map.where("ticker % 10 <> 3").select("ticker", F.col("sector").alias("asset_class"))
    return pf.class_values(positions(v), prices(v), cc, ["portfolio"])


def targets(v, values=None):
    """Targets of the classes held; `values` takes `classes(v)` where that is there already."""
    from pyspark.sql.window import Window

    c = (classes(v) if values is None else values).where("asset_class IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("portfolio").orderBy("asset_class"))
    return c.select(
        "portfolio", "asset_class", "value", F.lit(20.0).alias("target"),
        ((F.col("portfolio") * 3 + n) % 31 - 15).cast("double").alias("tilt"), (1000000 + F.col("portfolio") * 7).alias("amount"),
    )


@query("agg_class_values", ISA + " SELECT portfolio, asset_class, round(value, 2) AS value, n_positions FROM cv", IV)
def agg_class_values(v):
    return classes(v).withColumn("value", F.round("value", 2))


@query("agg_isa_status", ISA + """,
ct AS (SELECT portfolio, CAST(round_even(sum(CAST(CASE WHEN side = 'BUY' THEN quantity * price ELSE -quantity * price END AS DECIMAL(28,6))), 0) AS BIGINT) AS contributions FROM transactions GROUP BY portfolio),
tt AS (SELECT portfolio, sum(value) AS total FROM cv WHERE asset_class IS NOT NULL GROUP BY portfolio)
SELECT portfolio, round(total, 2) AS total, contributions, round(CASE WHEN contributions > 0 THEN (total - contributions) / contributions * 100 END, 2) AS return_pct FROM tt JOIN ct USING (portfolio)""", IV)
def agg_isa_status(v):
    s = pf.target_status(classes(v), pf.net_contributions(v.transactions, ["portfolio"]), ["portfolio"])
    return s.select("portfolio", F.round("total", 2).alias("total"), "contributions", "return_pct")


EFF = ISA + """,
e0 AS (SELECT *, greatest(0, target + greatest(-10, least(10, tilt))) AS e FROM tg),
ef AS (SELECT *, CASE WHEN sum(e) OVER w <= 0 THEN target * 100 / sum(target) OVER w ELSE e * 100 / sum(e) OVER w END AS effective FROM e0 WINDOW w AS (PARTITION BY portfolio))"""


@query("fn_tilt", EFF + " SELECT portfolio, asset_class, round(effective, 6) AS effective FROM ef", IV)
def fn_tilt(v):
    return pf.effective_targets(targets(v), ["portfolio"]).select("portfolio", "asset_class", *r6("effective"))


@query("agg_allocate", EFF + """,
d AS (SELECT *, greatest(0, (sum(value) OVER w + amount) * effective / 100 - value) AS df FROM ef WINDOW w AS (PARTITION BY portfolio)),
r AS (SELECT *, CASE WHEN sum(df) OVER w > 0 THEN amount * df / sum(df) OVER w ELSE amount * effective / 100 END AS raw FROM d WINDOW w AS (PARTITION BY portfolio)),
f AS (SELECT *, CAST(floor(raw) AS BIGINT) AS fl, amount - CAST(sum(floor(raw)) OVER (PARTITION BY portfolio) AS BIGINT) AS lf, row_number() OVER (PARTITION BY portfolio ORDER BY raw - floor(raw) DESC, asset_class) AS rn FROM r)
SELECT portfolio, asset_class, fl + CASE WHEN rn <= lf THEN 1 ELSE 0 END AS buy FROM f""", IV)
def agg_allocate(v):
    return pf.allocate(targets(v), ["portfolio"], "amount").select("portfolio", "asset_class", "buy")


@query("agg_drift", ISA + """,
dr AS (SELECT portfolio, coalesce(c.asset_class, t.asset_class) AS asset_class, coalesce(c.value, 0) AS value, coalesce(t.target, 0) AS target
  FROM (SELECT * FROM cv WHERE asset_class IS NOT NULL) c FULL JOIN (SELECT portfolio, asset_class, target FROM tg WHERE asset_class <> 'ASIA') t USING (portfolio, asset_class)),
w AS (SELECT *, round(value / sum(value) OVER (PARTITION BY portfolio) * 100 - target, 3) AS drift_pp FROM dr)
SELECT portfolio, asset_class, drift_pp, CAST(abs(drift_pp) > 5 AS INTEGER) AS breach FROM w""", IV)
def agg_drift(v):
    c = stable(classes(v))  # a few rows a portfolio, read on both sides: the positions are folded once
    d = pf.drift(c, targets(v, c).where("asset_class <> 'ASIA'"), ["portfolio"])
    return d.select("portfolio", "asset_class", "drift_pp", F.col("breach").cast("int").alias("breach"))


@query("set_coverage_diff", """
c AS (SELECT DISTINCT o_custkey % 50 AS portfolio, sector FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN sector_map ON ticker = l_suppkey),
t AS (SELECT portfolio, sector FROM (SELECT DISTINCT portfolio FROM c) CROSS JOIN (VALUES ('ASIA'), ('EUROPE'), ('ATLANTIS')) v(sector))
SELECT 'missing' AS side, portfolio, sector FROM (SELECT portfolio, sector FROM t EXCEPT SELECT portfolio, sector FROM c)
UNION ALL SELECT 'extra', portfolio, sector FROM (SELECT portfolio, sector FROM c EXCEPT SELECT portfolio, sector FROM t)""", ("lines", "sector_map"))
def set_coverage_diff(v):
    c = v.transactions.join(v.sector_map, "ticker").select("portfolio", "sector").distinct()
    t = c.select("portfolio").distinct().withColumn("sector", F.explode(F.array(*[F.lit(x) for x in ("ASIA", "EUROPE", "ATLANTIS")])))
    miss = t.exceptAll(c).select(F.lit("missing").alias("side"), "portfolio", "sector")
    return miss.unionByName(c.exceptAll(t).select(F.lit("extra").alias("side"), "portfolio", "sector"))


@query("val_isa_target", """
x AS (SELECT s_suppkey, 50.0 + s_suppkey % 3 AS a, 50.0 - s_suppkey % 2 AS b, s_suppkey % 5 = 0 AS dup, s_suppkey % 7 = 0 AS miss FROM supplier)
SELECT s_suppkey, CAST((CASE WHEN abs(a + b - 100) > 0.01 THEN 1 ELSE 0 END) + CASE WHEN miss THEN 1 ELSE 0 END + CASE WHEN dup AND NOT miss THEN 1 ELSE 0 END AS INTEGER) AS n_errors FROM x""")
def val_isa_target(v):
    k = F.col("s_suppkey")
    alloc = F.create_map(F.lit("a"), 50.0 + k % 3, F.lit("b"), 50.0 - k % 2)
    codes = F.when(k % 7 == 0, F.create_map(F.lit("a"), F.lit("x"))).otherwise(
        F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.when(k % 5 == 0, "x").otherwise("y"))
    )
    return v.table("supplier").select("s_suppkey", F.size(pf.target_errors(alloc, codes)).alias("n_errors"))


ETF = f"""
bd AS (SELECT *, min(fee) OVER w AS f0, max(fee) OVER w AS f1, min(aum) OVER w AS a0, max(aum) OVER w AS a1, min(traded_value) OVER w AS v0, max(traded_value) OVER w AS v1,
  min(abs(deviation)) OVER w AS d0, max(abs(deviation)) OVER w AS d1 FROM etf WINDOW w AS (PARTITION BY "group")),
sc AS (SELECT *, CASE WHEN f1 = f0 THEN 100.0 ELSE {round_printed_sql("100 - (fee - f0) / (f1 - f0) * 100", 4)} END AS cost_score,
  {round_printed_sql("(aum - a0) / (a1 - a0)::DOUBLE * 100", 4)} AS sa, {round_printed_sql("(traded_value - v0) / (v1 - v0) * 100", 4)} AS sv, {round_printed_sql("100 - (abs(deviation) - d0) / (d1 - d0) * 100", 4)} AS sd FROM bd),
sl AS (SELECT *, {round_printed_sql("CASE WHEN sd IS NULL THEN (0.5::DOUBLE * sa + 0.3::DOUBLE * sv) / 0.8::DOUBLE ELSE 0.5::DOUBLE * sa + 0.3::DOUBLE * sv + 0.2::DOUBLE * sd END", 4)} AS liquidity_score FROM sc),
es AS (SELECT *, {round_printed_sql("0.5::DOUBLE * cost_score + 0.5::DOUBLE * liquidity_score", 4)} AS composite FROM sl)"""


@query("rule_etf_score", ETF + " SELECT code, cost_score, liquidity_score FROM es", ("etf",))
def rule_etf_score(v):
    return pf.etf_scores(v.etf, ["group"]).select("code", "cost_score", "liquidity_score")


@query("topk_etf", ETF + """ SELECT "group", code, rank FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY composite DESC NULLS LAST, fee, aum DESC NULLS LAST, code) AS rank FROM es) WHERE rank <= 10""", ("etf",))
def topk_etf(v):
    return pf.top_etfs(pf.etf_scores(v.etf, ["group"]), ["group"], 10).select("group", "code", "rank")


@query("fn_minmax", """SELECT p_partkey, CASE WHEN max(p_size) OVER w = min(p_size) OVER w THEN 100.0::DOUBLE ELSE round(100 - (p_size - min(p_size) OVER w) / (max(p_size) OVER w - min(p_size) OVER w)::DOUBLE * 100, 4) END AS score
FROM part WINDOW w AS (PARTITION BY p_brand)""")
def fn_minmax(v):
    p = v.table("part")
    b = p.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return p.join(b, "p_brand").select("p_partkey", pf.minmax(F.col("p_size"), F.col("lo"), F.col("hi"), True).alias("score"))


@query("flt_etf", """SELECT code, aum FROM etf WHERE NOT leverage AND aum >= 500 AND "group" = 'ECONOMY' ORDER BY aum DESC, code""", ("etf",))
def flt_etf(v):
    return v.etf.where("NOT leverage AND aum >= 500").where(F.col("group") == "ECONOMY").orderBy(F.desc("aum"), "code").select("code", "aum")


@query("flt_etf_query", "SELECT code, name FROM etf WHERE contains(lower(replace(name, ' ', '')), 'redw') ORDER BY code LIMIT 15", ("etf",))
def flt_etf_query(v):
    n = F.lower(F.replace("name", F.lit(" "), F.lit("")))
    return v.etf.where(F.contains(n, F.lower(F.replace(F.lit("Red W"), F.lit(" "), F.lit(""))))).orderBy("code").limit(15).select("code", "name")


@query("flt_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(s_name, '42') ORDER BY s_suppkey LIMIT 20")
def flt_search(v):
    return v.table("supplier").where(F.contains("s_name", F.lit("42"))).orderBy("s_suppkey").limit(20).select("s_suppkey", "s_name")


# --- paper trading -------------------------------------------------------------------------

LOCAL = "CAST(created_at AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN market = 'KR' THEN 'Asia/Seoul' ELSE 'America/New_York' END AS DATE)"
TFC = "CASE timeframe WHEN '1W' THEN 7 WHEN '2W' THEN 14 WHEN '1M' THEN 30 WHEN '3M' THEN 90 WHEN '6M' THEN 180 WHEN '1Y' THEN 365 ELSE 30 END"
TFT = "CASE timeframe WHEN '1W' THEN 5 WHEN '2W' THEN 10 WHEN '1M' THEN 21 WHEN '3M' THEN 63 WHEN '6M' THEN 126 WHEN '1Y' THEN 252 END"


@query("fn_local_date", f"SELECT id, CAST({LOCAL} AS VARCHAR) AS local_date FROM predictions", ("predictions",))
def fn_local_date(v):
    return v.predictions.select("id", fd.local_date(F.col("created_at"), F.col("market")).cast("string").alias("local_date"))


@query("fn_horizon_end", f"SELECT id, CAST(created_date + {TFC} AS VARCHAR) AS horizon_end FROM predictions", ("predictions",))
def fn_horizon_end(v):
    return v.predictions.select("id", F.date_add("created_date", fd.timeframe_days(F.col("timeframe"), True)).cast("string").alias("horizon_end"))


@query("flt_session", """
x AS (SELECT event_id, user_id, ts AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN user_id % 2 = 1 THEN 'Asia/Seoul' ELSE 'America/New_York' END AS t FROM events)
SELECT event_id FROM x WHERE isodow(t) <= 5 AND CASE WHEN user_id % 2 = 1 THEN CAST(t AS TIME) BETWEEN TIME '09:00:00' AND TIME '15:30:00' ELSE CAST(t AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:30:00' END""")
def flt_session(v):
    m = F.when(F.col("user_id") % 2 == 1, "KR").otherwise("US")
    return v.table("events").where(fd.market_open(F.col("ts").cast("timestamp"), m)).select("event_id")


CAL = "cal AS (SELECT DISTINCT market, date FROM benchmark_bars)"
BULLW = f"""
{CAL},
bw AS (SELECT p.*, {LOCAL} AS local_date, (SELECT min(date) FROM cal c WHERE c.market = p.market AND c.date >= {LOCAL}) AS entry_date FROM predictions p
  WHERE source = 'LIVE' AND direction = 'BULL' AND status <> 'CANCELLED'),
bull AS (SELECT * FROM bw WHERE entry_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')"""
PB = ("predictions", "benchmark_bars")


def bull(v):
    return pp.bull_window(v.predictions, v.benchmark_bars, "1997-01-01", "1999-12-31")


@query("flt_bull_window", BULLW + " SELECT id, CAST(local_date AS VARCHAR) AS local_date, CAST(entry_date AS VARCHAR) AS entry_date FROM bull", PB)
def flt_bull_window(v):
    return bull(v).select("id", *text("local_date", "entry_date"))


@query("join_asof_forward", f"""
{CAL}, p AS (SELECT id, market, {LOCAL} AS d FROM predictions)
SELECT id, CAST((SELECT min(date) FROM cal c WHERE c.market = p.market AND c.date >= p.d) AS VARCHAR) AS session FROM p""", PB)
def join_asof_forward(v):
    p = v.predictions.withColumn("day", fd.local_date(F.col("created_at"), F.col("market")))
    return pp.next_session(p, v.benchmark_bars, "day").select("id", *text("session"))


@query("join_calendar", f"{CAL} SELECT b.market, CAST(b.date AS VARCHAR) AS date, count(*) AS n FROM bars b SEMI JOIN cal USING (market, date) WHERE b.date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ALL", ("bars", "benchmark_bars"))
def join_calendar(v):
    b = v.bars.where("date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
    return b.join(v.benchmark_bars, ["market", "date"], "left_semi").groupBy("market", "date").agg(F.count(F.lit(1)).alias("n")).select("market", *text("date"), "n")


@query("join_carry_forward", f"""
{CAL},
g AS (SELECT t.ticker, t.market, c.date FROM (SELECT ticker, market, min(date) AS f FROM bars GROUP BY ALL) t JOIN cal c ON c.market = t.market AND c.date >= t.f)
SELECT g.ticker, CAST(g.date AS VARCHAR) AS date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date) AS mark, CAST(b.close IS NULL AS INTEGER) AS carried FROM g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date""", ("bars", "benchmark_bars"))
def join_carry_forward(v):
    return pp.carry_forward(v.bars, v.benchmark_bars).select("ticker", *text("date"), "mark", F.col("carried").cast("int").alias("carried"))


@query("topk_day_candidates", BULLW + f"""
SELECT market, CAST(entry_date AS VARCHAR) AS entry_date, ticker, id, CAST(entry_date + {TFC} AS VARCHAR) AS horizon_end FROM (SELECT *, row_number() OVER (PARTITION BY market, entry_date, ticker ORDER BY confidence DESC, created_at, id) AS rn FROM bull) WHERE rn = 1""", PB)
def topk_day_candidates(v):
    return pp.day_candidates(bull(v)).select("market", *text("entry_date"), "ticker", "id", *text("horizon_end"))


@query("flt_low_edge", "SELECT id FROM predictions WHERE NOT (direction = 'BULL' AND source = 'LIVE' AND raw_confidence BETWEEN 0.60 AND 0.70)", ("predictions",))
def flt_low_edge(v):
    tag = oc.low_edge(F.col("direction"), F.col("source"), F.col("raw_confidence"))
    p = v.predictions.withColumn("components", F.when(tag, '{"low_edge_band": true}').when(F.col("id") % 2 == 0, "not json").otherwise(F.col("components")))
    return pp.low_edge_filter(p).select("id")


@query("tag_low_edge", "SELECT id, CAST(direction = 'BULL' AND source = 'LIVE' AND raw_confidence BETWEEN 0.60 AND 0.70 AS INTEGER) AS low_edge FROM predictions", ("predictions",))
def tag_low_edge(v):
    return v.predictions.select("id", oc.low_edge(F.col("direction"), F.col("source"), F.col("raw_confidence")).cast("int").alias("low_edge"))


@query("fn_trade_costs", f"""
x AS (SELECT *, ticker % 2 = 1 AS kr, side = 'BUY' AS b, price * CASE WHEN side = 'BUY' THEN 1 + 0.0005::DOUBLE ELSE 1 - 0.0005::DOUBLE END AS fill FROM transactions),
y AS (SELECT *, quantity * fill AS gross, quantity * fill * CASE WHEN kr THEN 0.00015::DOUBLE ELSE 0 END AS fees, CASE WHEN NOT b AND kr THEN quantity * fill * 0.0018::DOUBLE ELSE 0 END AS tax FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, ticker, {rd_sql('fill')} AS fill_price, {rd_sql('fees')} AS fees, {rd_sql('tax')} AS tax,
  {rd_sql('CASE WHEN b THEN -(gross + fees) ELSE gross - fees - tax END')} AS net_cash_delta FROM y""", T)
def fn_trade_costs(v):
    m = F.when(F.col("ticker") % 2 == 1, "KR").otherwise("US")
    c = pp.trade_costs(F.col("side"), m, F.col("quantity"), F.col("price"))
    return v.transactions.withColumns(c).select("l_orderkey", "l_linenumber", "l_partkey", "ticker", *rd("fill_price", "fees", "tax", "net_cash_delta"))


@query("fn_risk_sizing", """
x AS (SELECT id, price, CASE WHEN stop_price > 0 AND stop_price < price THEN stop_price ELSE price * (1 - 0.08::DOUBLE) END AS st, target_price FROM predictions JOIN (SELECT ticker, arg_max(close, date) AS price FROM bars GROUP BY ticker) USING (ticker))
SELECT id, CAST(floor(least(100000.0 * 0.01::DOUBLE / (price - st), 100000.0 * 0.1::DOUBLE / price)) AS BIGINT) AS qty, CASE WHEN target_price > price THEN target_price END AS target FROM x""", ("predictions", "bars"))
def fn_risk_sizing(v):
    j = v.predictions.join(oc.latest_price(v.bars), "ticker")
    q = pp.risk_quantity(F.col("price"), F.col("stop_price"), F.lit(100000.0), 0.01, 0.1)
    return j.select("id", q.alias("qty"), pp.fresh_target(F.col("target_price"), F.col("price")).alias("target"))


@query("rule_exit_signals", f"""
l AS (SELECT id, ticker, stop_price, target_price, created_date AS en, created_date + 30 AS he FROM predictions WHERE direction = 'BULL' AND status = 'OPEN'),
j AS (SELECT l.*, b.date, b.high, b.low, b.close FROM l JOIN bars b ON b.ticker = l.ticker AND b.date > l.en),
r AS (SELECT *, CASE WHEN low <= stop_price THEN 'stop_hit' WHEN high >= target_price THEN 'target_hit' WHEN date >= he THEN 'horizon_exit' END AS reason FROM j)
SELECT id, CAST(date AS VARCHAR) AS date, reason, CASE reason WHEN 'stop_hit' THEN stop_price WHEN 'target_hit' THEN target_price ELSE close END AS exit_price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS rn FROM r WHERE reason IS NOT NULL) WHERE rn = 1""", ("predictions", "bars"))
def rule_exit_signals(v):
    lots = v.predictions.where("direction = 'BULL' AND status = 'OPEN'").select("id", "ticker", "stop_price", "target_price", F.col("created_date").alias("entry_date"), F.date_add("created_date", 30).alias("horizon_end"))
    return pp.exit_signals(lots, v.bars).select("id", *text("date"), "reason", "exit_price")


TRADES = """
bx AS (SELECT ticker, market, date, close, lead(close, 5) OVER w AS c5, coalesce(lag(date) OVER w, DATE '1900-01-01') AS pd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
en AS (SELECT p.id, p.confidence, b.*, 1 + p.id % 100 AS q, (['target_hit','stop_hit','horizon_exit'])[p.id % 3 + 1] AS reason FROM predictions p JOIN bx b ON b.ticker = p.ticker AND p.created_date > b.pd AND p.created_date <= b.date WHERE direction = 'BULL'),
bu AS (SELECT *, q * (close * (1 + 0.0005::DOUBLE)) AS gross, market = 'KR' AS kr FROM en),
se AS (SELECT *, q * (c5 * (1 - 0.0005::DOUBLE)) AS sgross FROM bu),
rt AS (SELECT id AS prediction_id, ticker, confidence, reason AS exit_reason, gross + gross * CASE WHEN kr THEN 0.00015::DOUBLE ELSE 0 END AS buy_cost,
   sgross - sgross * CASE WHEN kr THEN 0.00015::DOUBLE ELSE 0 END - CASE WHEN kr THEN sgross * 0.0018::DOUBLE ELSE 0 END AS proceeds FROM se WHERE c5 IS NOT NULL AND id % 4 <> 0),
re AS (SELECT *, proceeds - buy_cost AS pnl, (proceeds - buy_cost) / buy_cost AS ret FROM rt)"""


def trades(v):
    """Entry at the first bar on or after creation, exit five bars later, except every fourth id."""
    w = series_w()
    b = v.bars.withColumns({"c5": F.lead("close", 5).over(w), "pd": F.coalesce(F.lag("date", 1).over(w), F.date_sub("date", 1))})
    days = b.withColumn("day", F.explode(F.sequence(F.date_add("pd", 1), F.col("date"))))
    p = v.predictions.where("direction = 'BULL'").select("id", "ticker", "created_date", "confidence")
    # calls before a ticker's first bar enter at that bar
    first = v.bars.groupBy("ticker").agg(F.min("date").alias("first"))
    p = p.join(first, "ticker").withColumn("day", F.greatest("created_date", "first"))
    e = p.join(days.select("ticker", "day", "market", "close", "c5"), ["ticker", "day"])
    k = F.col("id")
    why = F.element_at(F.array(*[F.lit(x) for x in ("target_hit", "stop_hit", "horizon_exit")]), (k % 3 + 1).cast("int"))
    legs = F.array_compact(
        F.array(
            F.struct((k * 2).alias("trade_id"), F.lit("BUY").alias("side"), F.col("close").alias("raw"), F.lit("entry").alias("reason")),
            F.when(F.col("c5").isNotNull() & (k % 4 != 0), F.struct((k * 2 + 1).alias("trade_id"), F.lit("SELL").alias("side"), F.col("c5").alias("raw"), why.alias("reason"))),
        )
    )
    t = e.select(k.alias("prediction_id"), "ticker", "market", "confidence", (1 + k % 100).alias("qty"), F.inline(legs))
    return t.withColumns(pp.trade_costs(F.col("side"), F.col("market"), F.col("qty"), F.col("raw")))


def series_w():
    from tidemark.functions.windows import series_window

    return series_window()


TP = ("predictions", "bars")


@query("join_round_trip", TRADES + f" SELECT prediction_id, ticker, exit_reason, {rd_sql('buy_cost', 4)} AS buy_cost, {rd_sql('pnl', 4)} AS pnl, {rd_sql('ret')} AS ret FROM re", TP)
def join_round_trip(v):
    r = pp.round_trips(trades(v))
    return r.select("prediction_id", "ticker", "exit_reason", *rd("buy_cost", "pnl", n=4), *rd("ret"))


WS = "count(*) AS n, count(*) FILTER (pnl > 0) AS wins, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE, 6) AS win_rate, round(avg(ret), 6) AS avg_ret, round(sum(pnl), 2) AS total_pnl"


@query("agg_win_stats", TRADES + f" SELECT exit_reason, {WS} FROM (SELECT 'ALL' AS exit_reason, pnl, ret FROM re UNION ALL SELECT exit_reason, pnl, ret FROM re) GROUP BY exit_reason", TP)
def agg_win_stats(v):
    return pp.win_stats(pp.round_trips(trades(v))).select("exit_reason", "n", "wins", *r6("win_rate", "avg_ret"), F.round("total_pnl", 2).alias("total_pnl"))


BAND = "CASE WHEN confidence >= 0.6 AND confidence < 0.7 THEN '0.60-0.70' WHEN confidence >= 0.7 AND confidence < 0.8 THEN '0.70-0.80' WHEN confidence >= 0.8 AND confidence < 0.9 THEN '0.80-0.90' WHEN confidence >= 0.9 AND confidence < 1.01 THEN '0.90-1.00' END"


@query("agg_by_confidence", TRADES + f" SELECT band, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(avg(ret), 6) AS avg_ret, round(sum(pnl), 2) AS total_pnl FROM (SELECT *, {BAND} AS band FROM re) WHERE band IS NOT NULL GROUP BY band", TP)
def agg_by_confidence(v):
    conf = v.predictions.select(F.col("id").alias("prediction_id"), "confidence")
    return pp.by_confidence(pp.round_trips(trades(v)), conf).select("band", "n", *r6("win_rate", "avg_ret"), F.round("total_pnl", 2).alias("total_pnl"))


@query("agg_frictions", TRADES + """,
lg AS (SELECT market, gross * CASE WHEN kr THEN 0.00015::DOUBLE ELSE 0 END + q * abs(close * (1 + 0.0005::DOUBLE) - close) AS f FROM se
 UNION ALL SELECT market, sgross * CASE WHEN kr THEN 0.00015::DOUBLE ELSE 0 END + CASE WHEN kr THEN sgross * 0.0018::DOUBLE ELSE 0 END + q * abs(c5 * (1 - 0.0005::DOUBLE) - c5) FROM se WHERE c5 IS NOT NULL AND id % 4 <> 0)
SELECT market, round(sum(f), 2) AS frictions, round(sum(f) / 1000000, 6) AS share_of_initial FROM lg GROUP BY market""", TP)
def agg_frictions(v):
    return pp.frictions(trades(v), ["market"], 1_000_000.0).select("market", F.round("frictions", 2).alias("frictions"), *r6("share_of_initial"))


@query("agg_review_flags", TRADES + f""",
s AS (SELECT count(*) FILTER (exit_reason='stop_hit') > count(*) FILTER (exit_reason='target_hit') AS a, count(*) FILTER (pnl > 0) / count(*)::DOUBLE < 0.5 AND count(*) >= 10 AS b FROM re),
bd AS (SELECT coalesce(bool_or(n >= 5 AND r < 0), false) AS c FROM (SELECT band, count(*) AS n, avg(ret) AS r FROM (SELECT *, {BAND} AS band FROM re) WHERE band IS NOT NULL GROUP BY band))
SELECT 'stops_exceed_targets' AS rule, CAST(a AS INTEGER) AS fires FROM s UNION ALL SELECT 'below_coin_flip', CAST(b AS INTEGER) FROM s UNION ALL SELECT 'negative_band', CAST(c AS INTEGER) FROM bd""", TP)
def agg_review_flags(v):
    r = pp.round_trips(trades(v))
    conf = v.predictions.select(F.col("id").alias("prediction_id"), "confidence")
    return pp.review_flags(pp.win_stats(r), pp.by_confidence(r, conf)).withColumn("fires", F.col("fires").cast("int"))


@query("agg_book_metrics", """
d AS (SELECT *, nav / max(nav) OVER (PARTITION BY market ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, nav / lag(nav) OVER (PARTITION BY market ORDER BY date) - 1 AS r FROM nav)
SELECT market, count(*) AS days, arg_max(nav, date) AS final_nav, round(arg_max(nav, date) / arg_min(nav, date) - 1, 6) AS cumulative_return, round(least(min(dd), 0), 6) AS max_drawdown,
  round(avg(r) / stddev_samp(r) * sqrt(252.0), 6) AS sharpe, round(arg_max(benchmark_nav, date) / arg_min(benchmark_nav, date) - 1, 6) AS benchmark_return FROM d GROUP BY market""", ("nav",))
def agg_book_metrics(v):
    m = pp.book_metrics(v.nav.withColumn("cumulative_return", F.lit(None).cast("double")), ["market"])
    return m.select("market", "days", "final_nav", *r6("cumulative_return", "max_drawdown", "sharpe", "benchmark_return"))
