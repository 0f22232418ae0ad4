"""Queries for guards, outcomes, watch levels, edge tables, memory and the scorecard."""

from pyspark.sql import functions as F

from tidemark.catalog import portfolio as cp
from tidemark.catalog.registry import query, r6, rd, rd_sql, text
from tidemark.catalog.screen import last_cte
from tidemark.catalog.series import avg_sql, f_, metrics_cte
from tidemark.catalog.sources import through_csv
from tidemark.functions import dates as fd
from tidemark.operators import gold as gd
from tidemark.operators import graph as gr
from tidemark.operators import outcomes as oc
from tidemark.operators import series, similar
from tidemark.operators import watchlist as wl
from tidemark.operators.ranks import order_statistics

P = ("predictions",)
PB = ("predictions", "bars")
ASOF = "2001-08-15"
OVER = """coalesce(json_extract_string(components, '$.overextension') = 'EXTREME', false)"""


# --- guards --------------------------------------------------------------------------------


@query("val_prediction", """
SELECT o_orderkey, CAST((CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END)
  + (CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_errors FROM orders""")
def val_prediction(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(
        "o_orderkey",
        F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("ticker"), F.lit("US").alias("market"),
        F.when(k % 5 == 0, "UP").otherwise("BULL").alias("direction"),
        F.when(k % 11 == 0, "1.7").otherwise("0.7").alias("confidence"), F.lit("1W").alias("timeframe"),
        F.col("o_orderpriority").alias("reasoning"), F.when(k % 13 == 0, "NaN").otherwise("10").alias("entry_price"),
        F.when(k % 17 == 0, "x").alias("target_price"), F.lit(None).cast("string").alias("stop_price"),
    )
    return rows.select("o_orderkey", F.size(oc.validation_errors()).alias("n_errors"))


@query("gate_overextension", f"SELECT id, CAST(source = 'LIVE' AND direction = 'BULL' AND {OVER} AS INTEGER) AS rejected FROM predictions", P)
def gate_overextension(v):
    r = (F.col("source") == "LIVE") & (F.col("direction") == "BULL") & oc.overextended(F.col("components"))
    return v.predictions.select("id", r.cast("int").alias("rejected"))


GATE = f"""
g AS (SELECT *, CASE WHEN source = 'LIVE' AND direction = 'BEAR' THEN 'live_bear' WHEN source = 'LIVE' AND timeframe = '1Y' THEN 'live_1y'
   WHEN source = 'LIVE' AND direction = 'BULL' AND {OVER} THEN 'overextended' END AS g FROM (SELECT * REPLACE ((DATE '1995-01-01' + CAST(id % 20 AS INTEGER))::TIMESTAMP AS created_at, ticker % 10 AS ticker) FROM predictions) p),
ex AS (SELECT DISTINCT ticker, market, direction, timeframe, source, created_at FROM g WHERE id % 2 = 0 AND status = 'OPEN'),
b AS (SELECT g.*, ex.ticker IS NOT NULL AS dup FROM g LEFT JOIN ex USING (ticker, market, direction, timeframe, source, created_at) WHERE id % 2 = 1),
f AS (SELECT *, min(CASE WHEN g IS NULL AND NOT dup THEN id END) OVER (PARTITION BY ticker, market, direction, timeframe, source, created_at) AS first_id FROM b)
SELECT id, CASE WHEN g IS NOT NULL THEN g WHEN dup THEN 'duplicate_open' WHEN id <> first_id THEN 'duplicate_batch' END AS reject_reason FROM f"""


@query("gate_insert", GATE, P)
def gate_insert(v):
    p = v.predictions.withColumn("created_at", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 20).cast("int")).cast("timestamp"))
    p = p.withColumn("ticker", F.col("ticker") % 10)
    return oc.insert_reasons(p.where("id % 2 = 1"), p.where("id % 2 = 0")).select("id", "reject_reason")


@query("join_anti_dup", "SELECT id FROM predictions p WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM predictions e WHERE e.id % 2 = 0 AND e.status = 'OPEN' AND e.ticker = p.ticker AND e.direction = p.direction AND e.timeframe = p.timeframe AND e.source = p.source AND month(e.created_date) = month(p.created_date))", P)
def join_anti_dup(v):
    p = v.predictions.withColumn("m", F.month("created_date"))
    key = ["ticker", "direction", "timeframe", "source", "m"]
    held = p.where("id % 2 = 0 AND status = 'OPEN'").select(*key).distinct()
    return p.where("id % 2 = 1").join(held, key, "left_anti").select("id")


@query("gate_macro_skip", """SELECT id, CASE WHEN id % 19 = 0 THEN 'invalid' WHEN timeframe = '1Y' THEN 'live_1y' WHEN created_date % 2 = 0 AND direction = 'BULL' THEN 'macro_risk_off' WHEN direction = 'BEAR' THEN 'live_bear' END AS reason
  FROM (SELECT *  REPLACE (date_diff('day', DATE '1970-01-01', created_date) AS created_date) FROM predictions)""", P)
def gate_macro_skip(v):
    level = F.when(F.datediff("created_date", F.lit("1970-01-01").cast("date")) % 2 == 0, "RISK_OFF").otherwise("NORMAL")
    p = v.predictions.withColumn("errors", F.when(F.col("id") % 19 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")))
    return p.select("id", oc.macro_skip_reason(level).alias("reason"))


@query("fill_components", metrics_cte("bars") + """,
lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM metrics) WHERE rn = 1)
SELECT id, coalesce(json_extract_string(components, '$.overextension'), overextension_level) AS overextension, json_extract_string(components, '$.algo') AS algo,
  round(lm.return_1m, 6) AS return_1m FROM predictions LEFT JOIN lm USING (ticker)""", PB)
def fill_components(v):
    m = series.horizon_metrics(v.bars)
    out = oc.fill_components(v.predictions, m)
    g = lambda p: F.get_json_object("components", p)
    return out.select("id", g("$.overextension").alias("overextension"), g("$.algo").alias("algo"), F.round(g("$.return_1m").cast("double"), 6).alias("return_1m"))


# --- outcomes ------------------------------------------------------------------------------

BDAYS = f"len(list_filter(range({cp.LOCAL} + INTERVAL 1 DAY, DATE '{ASOF}' + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) <= 5))"
OUT = f"""
px AS (SELECT ticker, arg_max(close, date) AS price FROM bars WHERE ticker % 9 <> 0 GROUP BY ticker),
j AS (SELECT p.*, price, (price - entry_price) / entry_price AS ch, {BDAYS} >= {cp.TFT} AS due,
  CASE WHEN coalesce(stop_price, 0) <> 0 THEN stop_price WHEN direction = 'BEAR' THEN entry_price * (1 + 0.05::DOUBLE) ELSE entry_price * (1 - 0.05::DOUBLE) END AS st,
  CASE WHEN coalesce(target_price, 0) <> 0 THEN target_price WHEN direction = 'BEAR' THEN entry_price * (1 - 0.03::DOUBLE) ELSE entry_price * (1 + 0.03::DOUBLE) END AS tg
  FROM predictions p LEFT JOIN px USING (ticker) WHERE status = 'OPEN'),
o AS (SELECT *, CASE WHEN price IS NULL THEN NULL WHEN direction = 'BULL' AND price <= st THEN 'MISS' WHEN direction = 'BEAR' AND price >= st THEN 'MISS' WHEN direction = 'NEUTRAL' AND abs(ch) > 0.03 THEN 'MISS'
   WHEN direction = 'BULL' AND price >= tg THEN 'HIT' WHEN direction = 'BEAR' AND price <= tg THEN 'HIT' WHEN direction = 'NEUTRAL' AND due THEN 'HIT' WHEN due THEN 'EXPIRED' END AS new_status,
   round(CASE WHEN direction = 'BEAR' THEN -ch ELSE ch END * 100, 2) AS new_return FROM j)"""


def tracked(v):
    return oc.track_outcomes(v.predictions, oc.latest_price(v.bars.where("ticker % 9 <> 0")), ASOF)


@query("rule_outcome", OUT + " SELECT id, new_status, new_return, CAST(price IS NULL AS INTEGER) AS price_missing FROM o", PB)
def rule_outcome(v):
    return tracked(v).select("id", "new_status", "new_return", F.col("price_missing").cast("int").alias("price_missing"))


@query("upd_outcome", OUT + """
SELECT p.id, coalesce(o.new_status, CASE WHEN p.status = 'OPEN' AND p.id % 10 = 0 THEN 'CANCELLED' ELSE p.status END) AS status, CASE WHEN o.new_status IS NOT NULL THEN o.new_return ELSE p.outcome_return END AS outcome_return FROM predictions p LEFT JOIN o USING (id)""", PB)
def upd_outcome(v):
    u = tracked(v).withColumn("new_date", F.lit(ASOF).cast("timestamp"))
    done = oc.apply_outcomes(v.predictions, u)
    return oc.cancel(done, v.predictions.where("id % 10 = 0").select("id")).select("id", "status", "outcome_return")


@query("src_latest_price", "SELECT ticker, arg_max(close, date) AS price, CAST(max(date) AS VARCHAR) AS price_date FROM bars WHERE date <= DATE '2000-01-31' GROUP BY ticker", ("bars",))
def src_latest_price(v):
    return oc.latest_price(v.bars, "2000-01-31").select("ticker", "price", *text("price_date"))


DUPS = """
d AS (SELECT * REPLACE ((DATE '1995-01-01' + CAST(id % 20 AS INTEGER))::TIMESTAMP AS created_at, ticker % 10 AS ticker, floor(outcome_return / 10) * 10 AS outcome_return) FROM predictions),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, market, direction, timeframe, source, created_at, status = 'OPEN', CASE WHEN status <> 'OPEN' THEN status END,
   CASE WHEN status <> 'OPEN' THEN outcome_return END ORDER BY id) AS rn FROM d)"""


def coarse(v):
    p = v.predictions.withColumn("created_at", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 20).cast("int")).cast("timestamp"))
    return p.withColumns({"ticker": F.col("ticker") % 10, "outcome_return": (F.floor(F.col("outcome_return") / 10) * 10).cast("double")})


@query("set_dedup_keep_first", DUPS + " SELECT id FROM k WHERE rn = 1", P)
def set_dedup_keep_first(v):
    return oc.dedup_keep_first(coarse(v)).select("id")


@query("fix_returns", DUPS + " SELECT id, CASE WHEN direction = 'BEAR' THEN round(-outcome_return, 2) ELSE outcome_return END AS outcome_return FROM k WHERE rn = 1", P)
def fix_returns(v):
    return oc.fix_returns(coarse(v)).select("id", "outcome_return")


# --- watch levels --------------------------------------------------------------------------

SAVED = """
rk AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
saved AS (SELECT user_id AS ticker, CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'KR' END AS market, CASE WHEN user_id % 5 = 0 THEN 'BEAR' ELSE 'BULL' END AS direction,
  max(value) FILTER (r = ceil(n * 0.45::DOUBLE)) AS entry_low, max(value) FILTER (r = ceil(n * 0.55::DOUBLE)) AS entry_high, max(value) FILTER (r = ceil(n * 0.2::DOUBLE)) AS stop,
  max(value) FILTER (r = ceil(n * 0.8::DOUBLE)) AS target, CASE WHEN user_id % 3 = 0 THEN max(value) FILTER (r = ceil(n * 0.5::DOUBLE)) END AS reentry FROM rk GROUP BY user_id)"""


def saved(v):
    """Levels at value ranks of each user's ticks."""
    t = F.col("ticker")
    return order_statistics(v.ticks, "ticker", "price", {"entry_low": 0.45, "entry_high": 0.55, "stop": 0.2, "target": 0.8, "_r": 0.5}).select(
        "ticker", F.when(t % 2 == 0, "US").otherwise("KR").alias("market"), F.when(t % 5 == 0, "BEAR").otherwise("BULL").alias("direction"),
        "entry_low", "entry_high", "stop", "target", F.when(t % 3 == 0, F.col("_r")).alias("reentry"),
    )


@query("flt_watches", SAVED + " SELECT ticker, entry_low, entry_high, stop, target, reentry FROM saved WHERE market = 'US' ORDER BY ticker")
def flt_watches(v):
    return saved(v).where("market = 'US'").orderBy("ticker").select("ticker", "entry_low", "entry_high", "stop", "target", "reentry")


@query("set_unified_watchlist", cp.POS + ",\n" + SAVED.strip() + f""",
pt AS (SELECT * FROM (SELECT ticker, market, CASE WHEN direction IN ('BULL','BEAR') THEN direction ELSE 'BULL' END AS direction, entry_price AS el, stop_price AS st, 'prediction' AS source, 1 AS prec,
  row_number() OVER (PARTITION BY ticker, market ORDER BY created_at DESC, id DESC) AS rn FROM predictions WHERE status = 'OPEN') WHERE rn = 1),
ps AS (SELECT * FROM (SELECT ticker, CASE WHEN ticker % 2 = 0 THEN 'US' ELSE 'KR' END AS market, 'BULL' AS direction, avg_price AS el, round(avg_price * 0.92::DOUBLE, 4) AS st, 'position' AS source, 2 AS prec,
  row_number() OVER (PARTITION BY ticker ORDER BY portfolio) AS rn FROM pos WHERE avg_price > 0) WHERE rn = 1),
u AS (SELECT ticker, market, direction, entry_low AS el, stop AS st, 'saved' AS source, 0 AS prec FROM saved WHERE ticker % 4 = 1 UNION ALL SELECT ticker, market, direction, el, st, source, prec FROM pt WHERE ticker % 3 <> 0
  UNION ALL SELECT ticker, market, direction, el, st, source, prec FROM ps)
SELECT ticker, market, source, direction, round(el, 4) AS entry_low, round(st, 3) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY ticker, market ORDER BY prec) AS rn FROM u) WHERE rn = 1""", ("transactions", "bars", "predictions"))
def set_unified_watchlist(v):
    pos = cp.positions(v).withColumn("market", F.when(F.col("ticker") % 2 == 0, "US").otherwise("KR"))
    u = wl.unified(saved(v).where("ticker % 4 = 1"), v.predictions.where("ticker % 3 <> 0"), pos)
    return u.select("ticker", "market", "source", "direction", F.round("entry_low", 4).alias("entry_low"), F.round("stop", 3).alias("stop"))


TRIG = SAVED + """,
j AS (SELECT e.event_id, e.ts, e.value AS price, s.* FROM events e JOIN saved s ON s.ticker = e.user_id),
tr AS (SELECT *, price BETWEEN CASE WHEN entry_low = entry_high THEN entry_high * (1 - 0.01::DOUBLE) ELSE entry_low END AND CASE WHEN entry_low = entry_high THEN entry_high * (1 + 0.01::DOUBLE) ELSE entry_high END AS en,
  CASE WHEN direction = 'BEAR' THEN price >= stop ELSE price <= stop END AS st, CASE WHEN direction = 'BEAR' THEN price <= target ELSE price >= target END AS tg, coalesce(price >= reentry, false) AS re FROM j)"""


@query("rule_triggers", TRIG + """ SELECT event_id, array_to_string(list_filter([CASE WHEN en THEN 'ENTRY' END, CASE WHEN st THEN 'STOP' END, CASE WHEN tg THEN 'TARGET' END, CASE WHEN re THEN 'REENTRY' END], lambda x: x IS NOT NULL), ',') AS hits FROM tr""")
def rule_triggers(v):
    j = v.ticks.join(saved(v), "ticker")
    return j.select("event_id", F.array_join(wl.satisfied(F.col("price")), ",").alias("hits"))


@query("join_entry_zone", TRIG + " SELECT event_id FROM tr WHERE en")
def join_entry_zone(v):
    return v.ticks.join(saved(v), "ticker").where(wl.trigger_conditions(F.col("price"))["ENTRY"]).select("event_id")


EDGE = TRIG + """,
ob AS (SELECT 'saved:' || ticker || ':' || market || ':' || t AS key, ts, event_id, s FROM (
  SELECT ticker, market, ts, event_id, 'ENTRY' AS t, en AS s FROM tr UNION ALL SELECT ticker, market, ts, event_id, 'STOP', st FROM tr UNION ALL
  SELECT ticker, market, ts, event_id, 'TARGET', tg FROM tr UNION ALL SELECT ticker, market, ts, event_id, 'REENTRY', re FROM tr)),
ed AS (SELECT * FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY key ORDER BY ts, event_id), false) AS p FROM ob) WHERE s AND NOT p)"""


def obs(v):
    return wl.observations(v.ticks, saved(v).withColumn("source", F.lit("saved")))


@query("st_edge_rising", EDGE + " SELECT key, event_id FROM ed")
def st_edge_rising(v):
    return wl.edges(obs(v)).select("key", "event_id")


@query("st_edge_alert", EDGE + """,
ls AS (SELECT key, list({'t': epoch_us(ts), 'e': event_id} ORDER BY ts, event_id) AS l FROM ed GROUP BY key),
fo AS (SELECT key, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1].t - a[len(a)].t >= 21600000000 THEN list_concat(a, x) ELSE a END) AS k FROM ls)
SELECT key, unnest(list_transform(k, lambda x: x.e)) AS event_id FROM fo""")
def st_edge_alert(v):
    return wl.fire(wl.edges(obs(v))).select("key", "event_id")


# --- edge tables and memory ----------------------------------------------------------------

LINKS = "links AS (SELECT DISTINCT l_suppkey AS ticker, p_brand AS theme FROM lines JOIN part ON l_partkey = p_partkey)"


def links(v):
    li = v.lines.select("l_suppkey", "l_partkey")
    return li.join(v.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("ticker"), F.col("p_brand").alias("theme")
    ).distinct()


@query("join_similar_by_theme", f"""
{LINKS},
g AS (SELECT a.ticker AS input, b.ticker, count(*) AS shared_count, array_to_string(list_sort(list(DISTINCT b.theme)), ',') AS shared_themes FROM links a JOIN links b ON a.theme = b.theme AND a.ticker <> b.ticker WHERE a.ticker < 3 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY shared_count DESC, ticker) AS rank FROM g) WHERE rank <= 10""", ("lines",))
def join_similar_by_theme(v):
    l = links(v)
    out = gr.similar_by_theme(l, l.where("ticker < 3").select("ticker").distinct())
    return out.withColumn("shared_themes", F.array_join("shared_themes", ","))


@query("join_theme_winners", f"""
{LINKS}
SELECT theme, count(*) AS total, count(*) FILTER (status='HIT') AS wins, round(count(*) FILTER (status='HIT') / count(*)::DOUBLE, 6) AS win_rate FROM predictions JOIN links USING (ticker)
WHERE status IN ('HIT','MISS','EXPIRED') AND created_at <= TIMESTAMP '2001-06-30' AND created_at >= TIMESTAMP '2001-06-30' - INTERVAL 364 DAY GROUP BY theme HAVING count(*) >= 3""", ("lines", "predictions"))
def join_theme_winners(v):
    return gr.theme_winners(v.predictions, links(v), "2001-06-30", 52).select("theme", "total", "wins", *r6("win_rate"))


@query("join_negative_news", """
m AS (SELECT ticker, headline, min(row(date, doc_id)) AS pos FROM news WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-30' AND (contains(lower(headline), 'probe') OR contains(lower(headline), 'cut') OR contains(lower(headline), '급락')) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS rn FROM m)
SELECT ticker, count(*) AS news_count, array_to_string(list(headline ORDER BY pos) FILTER (rn <= 5), '|') AS samples FROM r GROUP BY ticker""", ("news",))
def join_negative_news(v):
    out = gr.negative_news(v.news, ["Probe", "cut", "급락"], "2024-01-30", 20)
    return out.select("ticker", "news_count", F.array_join("sample_headlines", "|").alias("samples"))


@query("graph_upsert", """
e AS (SELECT id, status, confidence, CASE WHEN id % 2 = 0 THEN 'old' END AS note FROM predictions WHERE id % 3 <> 0 OR id % 5 <> 0),
i AS (SELECT id, 'HIT' AS status, 0.9::DOUBLE AS confidence, CASE WHEN id % 4 = 1 THEN 'new' END AS note FROM predictions WHERE id % 5 = 0)
SELECT coalesce(e.id, i.id) AS id, coalesce(i.status, e.status) AS status, coalesce(i.confidence, e.confidence) AS confidence, coalesce(i.note, e.note) AS note FROM e FULL JOIN i ON e.id = i.id""", P)
def graph_upsert(v):
    p = v.predictions
    old = p.where("id % 3 <> 0 OR id % 5 <> 0").select("id", "status", "confidence", F.when(F.col("id") % 2 == 0, "old").alias("note"))
    new = p.where("id % 5 = 0").select(
        "id", F.lit("HIT").alias("status"), F.lit(0.9).alias("confidence"), F.when(F.col("id") % 4 == 1, "new").alias("note"), F.col("created_at").alias("_seq")
    )
    blank = new.limit(1).withColumn("id", F.lit(None).cast("bigint"))
    return gr.upsert(old, new.unionByName(blank), ["id"], ["status", "confidence"], ["note"])


COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query("topk_semantic", f"""
e AS (SELECT vec_id, label % 5 AS category, embedding AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, e.category, {COS.format(a='e.v', b='q.v')} / (sqrt({COS.format(a='e.v', b='e.v')}) * sqrt({COS.format(a='q.v', b='q.v')})) AS similarity FROM e JOIN e q ON q.category = e.category AND q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, category, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def topk_semantic(v):
    m = v.table("embeddings").select("vec_id", (F.col("label") % 5).alias("category"), "embedding")
    q = m.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "category", "embedding")
    return similar.semantic_topk(m, q).select("query_id", "vec_id", "category", "rank", *r6("similarity"))


@query("agg_memory_stats", "SELECT c AS category, count(vec_id) AS n FROM unnest(range(0, 6)) t(c) LEFT JOIN embeddings ON label % 5 = c GROUP BY c")
def agg_memory_stats(v):
    m = v.table("embeddings").select((F.col("label") % 5).cast("bigint").alias("category"))
    return gr.memory_stats(m, v.spark.range(6).withColumnRenamed("id", "category"))


# --- scorecard -----------------------------------------------------------------------------

GOLD = f"""
chg AS (SELECT *, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
g AS (SELECT *, count(d) OVER {f_(14)} AS nd, avg(greatest(d, 0)) OVER {f_(14)} AS ag, avg(greatest(-d, 0)) OVER {f_(14)} AS al, {avg_sql('close', 50)} AS ma50, {avg_sql('close', 200)} AS ma200,
  (close / max(close) OVER {f_(252)} - 1) * 100 AS dd FROM chg),
h AS (SELECT *, CASE WHEN nd < 14 THEN 50.0::DOUBLE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + ag / al) END AS rsi, coalesce(ma200 > lag(ma200, 20) OVER (PARTITION BY ticker ORDER BY date), false) AS up FROM g),
sc AS (SELECT *, CASE WHEN ma200 IS NOT NULL THEN CASE WHEN close >= ma200 AND up THEN 100 WHEN close >= ma200 THEN 60 ELSE 30 END WHEN close >= ma50 THEN 60 ELSE 30 END AS trend,
  CASE WHEN dd > -5 THEN 40 WHEN dd > -20 THEN 100 WHEN dd > -35 THEN 70 ELSE 30 END AS pullback, CASE WHEN rsi < 30 THEN 100 WHEN rsi < 45 THEN 80 WHEN rsi < 60 THEN 60 WHEN rsi <= 70 THEN 40 ELSE 15 END AS momentum FROM h),
tech AS (SELECT *, 0.4::DOUBLE * trend + 0.3::DOUBLE * pullback + 0.3::DOUBLE * momentum AS technical_score FROM sc)"""


@query("rule_gold_subscores", GOLD + " SELECT ticker, CAST(date AS VARCHAR) AS date, trend, pullback, momentum, round(technical_score, 4) AS technical_score FROM tech", ("bars",))
def rule_gold_subscores(v):
    t = gd.technical(v.bars)
    return t.select("ticker", *text("date"), *[F.col(c).cast("int").alias(c) for c in ("trend", "pullback", "momentum")], F.round("technical_score", 4).alias("technical_score"))


FACT = """
fac AS (SELECT event_id, (value * 10) % 1200 AS t4, event_id % 5 * 1.0 AS ry, 45 + event_id % 25 AS rs, 1000 + event_id % 300 AS fx FROM events),
ms AS (SELECT *, CASE WHEN t4 >= 900 THEN 100 WHEN t4 >= 650 THEN 70 WHEN t4 >= 500 THEN 50 ELSE 30 END AS cb, CASE WHEN ry <= 1 THEN 100 WHEN ry >= 2 THEN 25 ELSE 60 END AS rr, ry > 1 AND ry >= 3.5 AS pun,
  CASE WHEN rs < 55 THEN 70 WHEN rs <= 60 THEN 55 ELSE 40 END AS dl, CASE WHEN (fx / 1150.0 - 1) * 100 > 5 THEN 30 WHEN (fx / 1150.0 - 1) * 100 >= -5 THEN 60 ELSE 80 END AS fs FROM fac),
mt AS (SELECT *, (0.35 * cb + 0.30 * rr + 0.20 * dl + 0.15 * fs)::DOUBLE AS macro_score FROM ms)"""


@query("rule_macro_scorecard", FACT + """ SELECT event_id, round(macro_score, 4) AS macro_score, CASE WHEN event_id % 90 > 75 OR pun OR event_id % 50 = 0 THEN 'PAUSE' WHEN macro_score >= 55 AND event_id % 100 >= 50 THEN 'ACCUMULATE' ELSE 'HOLD' END AS verdict FROM mt""")
def rule_macro_scorecard(v):
    k = F.col("event_id")
    f = v.table("events").select(
        "event_id", (F.col("value") * 10 % 1200).alias("trailing_4q_tonnes"), (k % 5).cast("double").alias("real_yield_pct"),
        (45 + k % 25).alias("reserve_share_pct"), (1000 + k % 300).cast("double").alias("fx"), F.lit(1150.0).alias("fx_ma200"),
    )
    m = gd.macro(gd.merge_config(f))
    vd = gd.verdict((k % 90).cast("double"), (k % 100).cast("double"), F.col("macro_score"), F.col("punitive"), k % 50 == 0)
    return m.select("event_id", F.round("macro_score", 4).alias("macro_score"), vd.alias("verdict"))


@query("src_config_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 700.0::DOUBLE ELSE 500.0::DOUBLE END AS baseline_tonnes, 3.5::DOUBLE AS punitive_above_pct FROM events")
def src_config_merge(v):
    o = v.table("events").select("event_id", F.when(F.col("event_id") % 2 == 0, 700.0).alias("baseline_tonnes"))
    return gd.merge_config(o).select("event_id", "baseline_tonnes", "punitive_above_pct")


@query("src_fx_gold_levels", f"""
o AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd, {avg_sql('close', 200)} AS m2, avg(close) OVER (PARTITION BY ticker) AS ma,
  (close / lag(close, 62) OVER w - 1) * 100 AS r3, (close / lag(close, 125) OVER w - 1) * 100 AS r6 FROM (SELECT * FROM bars WHERE ticker % 3 <> 0 OR date < DATE '1995-06-01') WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, close AS last, {rd_sql('coalesce(m2, ma)')} AS ma200, round(CASE WHEN n > 63 THEN r3 END, 6) AS ret_3m, round(CASE WHEN n > 126 THEN r6 END, 6) AS ret_6m FROM o WHERE rd = 1 AND n >= 5""", ("bars",))
def src_fx_gold_levels(v):
    b = v.bars.where("ticker % 3 <> 0 OR date < DATE '1995-06-01'")
    return gd.levels(b).select("ticker", F.col("close").alias("last"), *rd("ma200"), *r6("ret_3m", "ret_6m"))


@query("src_series_csv", "SELECT user_id AS series, coalesce(arg_max(value, event_id) FILTER (event_id % 3 = 0), 1.9::DOUBLE) AS value, CAST(count(*) FILTER (event_id % 3 = 0) = 0 AS INTEGER) AS estimated FROM events GROUP BY user_id")
def src_series_csv(v):
    k = F.col("event_id")
    rows = v.table("events").select(
        F.col("user_id").alias("series"), k.alias("date"), F.when(k % 3 == 0, F.col("value").cast("string")).when(k % 3 == 1, ".").otherwise("").alias("value")
    )
    rows = through_csv(v, rows, "series long, date long, value string")
    return gd.last_numeric(rows, F.lit(1.9)).withColumn("estimated", F.col("estimated").cast("int"))


@query("fn_position_value", """SELECT event_id, round(value * 1300 / 31.1035::DOUBLE, 6) AS krw_per_g, round((value * 1300 / 31.1035::DOUBLE / (500 + event_id % 100) - 1) * 100, 6) AS pnl_pct,
  round(value * 1300 / 31.1035::DOUBLE * (event_id % 10), 5) AS value_krw FROM events""")
def fn_position_value(v):
    c = gd.position_value(F.col("event_id") % 10, 500 + F.col("event_id") % 100, F.col("value"), F.lit(1300))
    return v.table("events").withColumns(c).select("event_id", *r6("krw_per_g", "pnl_pct"), F.round("value_krw", 5).alias("value_krw"))


@query("win_wow_delta", GOLD + """,
w AS (SELECT ticker, date_trunc('week', date) AS wk, arg_max(technical_score, date) AS t, arg_max(pullback, date) AS m, max(date) AS report_date FROM tech GROUP BY ALL)
SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, CAST(round_even(t - lag(t) OVER x, 0) AS INTEGER) AS d_technical, CAST(m - lag(m) OVER x AS INTEGER) AS d_macro FROM w WINDOW x AS (PARTITION BY ticker ORDER BY wk)""", ("bars",))
def win_wow_delta(v):
    t = gd.technical(v.bars).withColumn("wk", F.date_trunc("week", F.col("date").cast("timestamp")))
    w = t.groupBy("ticker", "wk").agg(
        F.max_by("technical_score", "date").alias("technical_score"), F.max_by("pullback", "date").alias("macro_score"), F.max("date").alias("report_date")
    )
    return gd.week_deltas(w).select("ticker", *text("report_date"), "d_technical", "d_macro")


@query("agg_gold_context", GOLD + """,
l AS (SELECT * FROM (SELECT *, (close / lag(close, 62) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS r3, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM tech) WHERE rd = 1)
SELECT ticker, round(CASE WHEN ticker % 4 <> 0 AND r3 IS NOT NULL THEN ticker * 0.5::DOUBLE END, 6) AS decomp_usd, round(CASE WHEN ticker % 4 <> 0 THEN r3 END, 6) AS decomp_krw, round(coalesce((close / ma200 - 1) * 100, 0), 6) AS ma200_gap_pct,
  CAST((CASE WHEN ticker % 4 = 0 THEN 1 ELSE 0 END) + CASE WHEN ticker % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_notes FROM l""", ("bars",))
def agg_gold_context(v):
    from tidemark.functions import windows as fw

    t = gd.technical(v.bars).withColumn("ret_3m", fw.pct_return(F.col("close"), fw.series_window(), 62))
    t = series.last_rows(t)
    ids = v.table("supplier").select(F.col("s_suppkey").alias("ticker"))
    usd = ids.where("ticker % 4 <> 0").withColumn("ret_3m", F.col("ticker") * 0.5)
    fx = ids.where("ticker % 5 <> 0").withColumn("last", F.lit(1300.0))
    c = gd.context(t, usd, fx)
    return c.select("ticker", *r6("decomp_usd", "decomp_krw", "ma200_gap_pct"), F.size("notes").alias("n_notes"))
