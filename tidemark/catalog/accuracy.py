"""Queries over the predictions table."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, text
from tidemark.operators import accuracy as acc
from tidemark.plans import reports as rp

P = ("predictions",)
ASOF = "2000-06-30"
CLOSED = "status IN ('HIT', 'MISS')"
REC = """count(*) AS total, count(*) FILTER (status='HIT') AS wins, count(*) FILTER (status='MISS') AS losses,
  count(*) FILTER (status='EXPIRED') AS expired,
  round(count(*) FILTER (status='HIT') / nullif(count(*) FILTER (status IN ('HIT','MISS')), 0)::DOUBLE, 6) AS win_rate,
  round(avg(outcome_return), 6) AS avg_return,
  round(avg(CASE WHEN status='HIT' THEN (confidence-1)*(confidence-1) WHEN status='MISS' THEN confidence*confidence END), 6) AS brier_score"""
RESOLVED = "status IN ('HIT','MISS','EXPIRED')"


def window_sql(days, asof=ASOF):
    return (f"outcome_date >= TIMESTAMP '{asof}' - INTERVAL {days} DAY AND outcome_date <= TIMESTAMP '{asof}'")


def rec(df):
    return df.select(
        *[c for c in df.columns if c not in ("win_rate", "avg_return", "brier_score")],
        *r6("win_rate", "avg_return", "brier_score"),
    )


@query("flt_predictions", """SELECT id, ticker, market, status, CAST(created_date AS VARCHAR) AS created_date FROM predictions
WHERE status = 'OPEN' AND market = 'US' AND source = 'LIVE' ORDER BY created_at DESC, id DESC LIMIT 50""", P)
def flt_predictions(v):
    p = v.predictions.where("status = 'OPEN' AND market = 'US' AND source = 'LIVE'")
    return p.orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "ticker", "market", "status", *text("created_date"))


@query("flt_closed_window", f"""SELECT id, status, CAST(CAST(outcome_date AS DATE) AS VARCHAR) AS outcome_day FROM predictions
WHERE {CLOSED} AND {window_sql(90)}""", P)
def flt_closed_window(v):
    return acc.closed(v.predictions, days=90, asof=ASOF).select("id", "status", F.to_date("outcome_date").cast("string").alias("outcome_day"))


@query("flt_by_id", "SELECT id, ticker, status, direction FROM predictions WHERE id = 77", P)
def flt_by_id(v):
    return v.predictions.where("id = 77").select("id", "ticker", "status", "direction")


@query("agg_track_record", f"""
s AS (SELECT * FROM predictions WHERE {RESOLVED}),
k AS (SELECT *, row_number() OVER w AS rn,
        sum(CASE WHEN status <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY market, timeframe
          ORDER BY outcome_date DESC, created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS ch
      FROM (SELECT *, lag(status) OVER w2 AS prev FROM s WHERE {CLOSED}
            WINDOW w2 AS (PARTITION BY market, timeframe ORDER BY outcome_date DESC, created_at DESC, id DESC))
      WINDOW w AS (PARTITION BY market, timeframe ORDER BY outcome_date DESC, created_at DESC, id DESC)),
st AS (SELECT market, timeframe, CAST(sum(CASE WHEN status='HIT' THEN 1 ELSE -1 END) AS BIGINT) AS current_streak FROM k WHERE ch = 0 GROUP BY ALL)
SELECT a.*, coalesce(current_streak, 0) AS current_streak FROM (SELECT market, timeframe, {REC} FROM s GROUP BY ALL) a
LEFT JOIN st USING (market, timeframe)""", P)
def agg_track_record(v):
    return rec(acc.track_record(v.predictions, ["market", "timeframe"]))


@query("agg_track_record_window", f"SELECT {REC} FROM predictions WHERE {RESOLVED} AND {window_sql(30)}", P)
def agg_track_record_window(v):
    return rec(acc.track_record(v.predictions, [], with_streak=False, days=30, asof=ASOF))


@query("agg_streak", f"""
s AS (SELECT *, lag(status) OVER w AS prev FROM predictions WHERE {CLOSED}
      WINDOW w AS (PARTITION BY ticker ORDER BY outcome_date DESC, created_at DESC, id DESC)),
c AS (SELECT *, sum(CASE WHEN status <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY ticker
      ORDER BY outcome_date DESC, created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS ch FROM s)
SELECT ticker, CAST(sum(CASE WHEN status='HIT' THEN 1 ELSE -1 END) AS BIGINT) AS current_streak FROM c WHERE ch = 0 GROUP BY ticker""", P)
def agg_streak(v):
    return acc.streaks(v.predictions, ["ticker"])


@query("agg_by_source", f"""SELECT coalesce(source, 'ALL') AS source, {REC} FROM predictions WHERE {RESOLVED}
GROUP BY GROUPING SETS ((), (source))""", P)
def agg_by_source(v):
    return rec(acc.track_record_by_source(v.predictions))


def cal_sql(conf, keys="", where=CLOSED, src="predictions", buckets=5):
    step = 0.5 / buckets
    case = " ".join(
        f"WHEN c >= {0.5 + i * step!r}::DOUBLE AND c {'<=' if i == buckets - 1 else '<'} {0.5 + (i + 1) * step!r}::DOUBLE THEN '{0.5 + i * step:.2f}-{0.5 + (i + 1) * step:.2f}'"
        for i in range(buckets)
    )
    return f"""SELECT {keys} confidence_range, round(avg(c), 3) AS predicted_confidence,
      round(count(*) FILTER (status='HIT') / count(*)::DOUBLE, 3) AS actual_accuracy, count(*) AS count
      FROM (SELECT *, CASE {case} END AS confidence_range FROM (SELECT *, {conf} AS c FROM {src} WHERE {where}))
      WHERE confidence_range IS NOT NULL GROUP BY ALL"""


RAW = "coalesce(raw_confidence, confidence)"


@query("agg_calibration", cal_sql(RAW, "source, timeframe,"), P)
def agg_calibration(v):
    return acc.calibration(v.predictions, ["source", "timeframe"])


@query("agg_calibration_logged", cal_sql("confidence", buckets=10), P)
def agg_calibration_logged(v):
    return acc.calibration(v.predictions, buckets=10, use_raw=False)


@query("agg_overconfident", f"SELECT * FROM ({cal_sql('confidence', 'market,')}) WHERE count >= 3 AND predicted_confidence - actual_accuracy >= 0.10", P)
def agg_overconfident(v):
    return acc.overconfident_buckets(acc.calibration(v.predictions, ["market"], use_raw=False))


@query("agg_drift_status", f"""SELECT *, CASE WHEN actual_accuracy > predicted_confidence + 0.05 THEN 'UNDERCONFIDENT'
  WHEN actual_accuracy < predicted_confidence - 0.05 THEN 'OVERCONFIDENT' ELSE 'OK' END AS drift_status
  FROM ({cal_sql(RAW)})""", P)
def agg_drift_status(v):
    return acc.drift_status(acc.calibration(v.predictions))


BINOM = """CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (SELECT sum(exp(lp)) FROM (SELECT
   lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + {n} * ln(0.5::DOUBLE) AS lp FROM unnest(range(0, {n} + 1)) t(i))
   WHERE lp <= lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0) + {n} * ln(0.5::DOUBLE) + 1e-9)) END"""


def binom_list(k, n):
    """Exact two-sided p as a list expression."""
    pmf = lambda i: f"(lgamma({n} + 1.0::DOUBLE) - lgamma({i} + 1.0::DOUBLE) - lgamma({n} - {i} + 1.0::DOUBLE) + {n} * ln(0.5::DOUBLE))"
    return (f"least(1.0::DOUBLE, list_sum(list_transform(range(0, {n} + 1), lambda i: CASE WHEN {pmf('i')} <= {pmf(k)} + 1e-9 "
            f"THEN exp({pmf('i')}) ELSE 0.0::DOUBLE END)))")


SIG_PERF = f"""
sg AS (SELECT unnest(signals) AS signal, status FROM predictions WHERE {{where}}),
gr AS (SELECT signal, count(*) AS total, count(*) FILTER (status='HIT') AS wins FROM sg GROUP BY signal HAVING count(*) >= {{mc}}),
pv AS (SELECT *, {binom_list('wins', 'total')} AS p FROM gr),
perf AS (SELECT signal, total, wins, round(wins / total::DOUBLE, 3) AS win_rate, round(p, 4) AS p_value,
  CASE WHEN p >= 0.05 THEN 'weak' WHEN wins / total::DOUBLE > 0.5 THEN 'alive' ELSE 'dead' END AS verdict FROM pv)"""


@query("agg_signal_perf", SIG_PERF.format(where=CLOSED, mc=10) + " SELECT * FROM perf", P)
def agg_signal_perf(v):
    return acc.signal_performance(v.predictions)


@query("agg_worst_signals", SIG_PERF.format(where=CLOSED + " AND " + window_sql(365), mc=3)
       + " SELECT * FROM perf WHERE verdict = 'dead' OR (total >= 5 AND win_rate < 0.4)", P)
def agg_worst_signals(v):
    return acc.worst_signals(acc.signal_performance(v.predictions, 3, days=365, asof=ASOF))


@query("stat_binomial", f"""
g AS (SELECT ticker, count(*) AS n, count(*) FILTER (status='HIT') AS k FROM predictions WHERE {CLOSED} GROUP BY ticker)
SELECT ticker, n, k, round({binom_list('k', 'n')}, 6) AS p FROM g""", P)
def stat_binomial(v):
    from tidemark.functions.stats import binomial_p_half

    g = acc.closed(v.predictions).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "HIT").alias("k")
    )
    return g.withColumn("p", F.round(binomial_p_half(F.col("k"), F.col("n")), 6))


def verdict_sql(k, n):
    return (f"CASE WHEN {n} = 0 OR {binom_list(k, n)} >= 0.05 THEN 'weak' WHEN {k} / {n}::DOUBLE > 0.5 THEN 'alive' ELSE 'dead' END")


SPLIT = f"""
o AS (SELECT *, row_number() OVER (ORDER BY outcome_date, created_at, id) - 1 AS ix, count(*) OVER () AS n
      FROM predictions WHERE {CLOSED} AND outcome_date IS NOT NULL),
sp AS (SELECT *, ix >= least(greatest(floor(n * 0.7::DOUBLE), 0), n - 1) AS is_test FROM o)"""


@query("win_split_index", SPLIT + " SELECT id, ix AS row_idx, CAST(is_test AS INTEGER) AS is_test FROM sp", P)
def win_split_index(v):
    s = acc.split_index(acc.closed(v.predictions).select(*acc.ORDER))
    return s.select("id", "row_idx", F.col("is_test").cast("int").alias("is_test"))


DECAY = SPLIT + f""",
e AS (SELECT unnest(signals) AS signal, is_test, status FROM sp),
d AS (SELECT signal, count(*) FILTER (NOT is_test) AS train_total, count(*) FILTER (NOT is_test AND status='HIT') AS train_wins,
   count(*) FILTER (is_test) AS test_total, count(*) FILTER (is_test AND status='HIT') AS test_wins FROM e GROUP BY signal HAVING count(*) >= 10),
dv AS (SELECT *, {verdict_sql('train_wins', 'train_total')} AS train_verdict, {verdict_sql('test_wins', 'test_total')} AS test_verdict FROM d),
decay AS (SELECT *, CASE WHEN train_total = 0 OR test_total = 0 THEN 'insufficient_oos' WHEN test_verdict = 'dead' THEN 'reversed'
  WHEN train_verdict = 'alive' AND test_verdict = 'alive' THEN 'confirmed_alive' WHEN train_verdict = 'alive' THEN 'train_only' ELSE 'noise' END AS label FROM dv)"""


@query("agg_signal_decay", DECAY + " SELECT * FROM decay", P)
def agg_signal_decay(v):
    return acc.signal_decay(v.predictions)


@query("agg_decaying_signals", DECAY + " SELECT * FROM decay WHERE label IN ('train_only', 'reversed')", P)
def agg_decaying_signals(v):
    return acc.decaying_signals(acc.signal_decay(v.predictions))


@query("win_walk_forward", f"""
o AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS ix, count(*) OVER () AS n FROM predictions WHERE {CLOSED})
SELECT id, ix AS row_idx, CASE WHEN ix >= 500 THEN CAST(least((ix - 500) // ((n - 500) // 5), 4) AS INTEGER) END AS fold FROM o""", P)
def win_walk_forward(v):
    return acc.walk_forward_folds(acc.closed(v.predictions).select("created_at", "id"), 5, 500).select("id", "row_idx", "fold")


@query("agg_component", f"""
c AS (SELECT id, status, unnest(json_keys(components)) AS pillar, components FROM predictions WHERE {CLOSED} AND components IS NOT NULL),
t AS (SELECT *, json_extract(components, '$.' || pillar) AS v, json_type(components, '$.' || pillar) AS ty FROM c),
b AS (SELECT status, pillar, CASE
   WHEN ty IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CASE WHEN CAST(v AS DOUBLE) > 0 THEN 'positive' WHEN CAST(v AS DOUBLE) < 0 THEN 'negative' ELSE 'zero' END
   WHEN ty = 'BOOLEAN' THEN CASE WHEN CAST(v AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END
   WHEN ty = 'NULL' THEN 'None' ELSE json_extract_string(components, '$.' || pillar) END AS bucket
   FROM t WHERE ty NOT IN ('OBJECT', 'ARRAY'))
SELECT pillar, bucket, count(*) AS n, count(*) FILTER (status='HIT') AS wins, round(count(*) FILTER (status='HIT') / count(*)::DOUBLE, 3) AS win_rate
FROM b GROUP BY ALL HAVING count(*) >= 8""", P)
def agg_component(v):
    return acc.component_contribution(v.predictions)


@query("agg_component_rows", f"SELECT count(*) AS n_with_components FROM predictions WHERE {CLOSED} AND components IS NOT NULL", P)
def agg_component_rows(v):
    return acc.rows_with_components(v.predictions)


@query("agg_news_tags", f"""
p AS (SELECT id, status, json_extract(components, '$.news_signal') AS s FROM predictions WHERE {CLOSED} AND components IS NOT NULL),
t AS (SELECT DISTINCT id, status, 'tag' AS kind, trim(x) AS name FROM (SELECT id, status, unnest(CAST(json_extract(s, '$.event_tags') AS VARCHAR[])) AS x FROM p)
  WHERE trim(x) <> ''),
a AS (SELECT status, kind, name FROM t
  UNION ALL SELECT status, 'catalyst', 'positive' FROM p WHERE json_type(s, '$.has_positive_catalyst') = 'BOOLEAN' AND CAST(json_extract(s, '$.has_positive_catalyst') AS VARCHAR) = 'true'
  UNION ALL SELECT status, 'catalyst', 'negative' FROM p WHERE json_type(s, '$.has_negative_catalyst') = 'BOOLEAN' AND CAST(json_extract(s, '$.has_negative_catalyst') AS VARCHAR) = 'true')
SELECT kind, name, count(*) AS n, count(*) FILTER (status='HIT') AS wins, round(count(*) FILTER (status='HIT') / count(*)::DOUBLE, 3) AS win_rate
FROM a GROUP BY ALL HAVING count(*) >= 8""", P)
def agg_news_tags(v):
    return acc.news_tag_performance(v.predictions)


# max over j<=i of min over k>=i of the weighted mean, from window-free self joins over a few anchors
ISO = f"""
cal AS ({cal_sql(RAW, 'source,')}),
an AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY predicted_confidence) AS i, predicted_confidence AS x, actual_accuracy AS y, count AS w FROM cal),
seg AS (SELECT a.source, a.i AS j, b.i AS k, (SELECT sum(y * w) / sum(w) FROM an c WHERE c.source = a.source AND c.i BETWEEN a.i AND b.i) AS m
   FROM an a JOIN an b ON a.source = b.source AND a.i <= b.i),
lo AS (SELECT p.source, p.i, s.j, min(s.m) AS mn FROM an p JOIN seg s ON s.source = p.source AND s.j <= p.i AND s.k >= p.i GROUP BY ALL),
iso AS (SELECT l.source, l.i, any_value(x) AS x, max(mn) AS y FROM lo l JOIN an p ON p.source = l.source AND p.i = l.i GROUP BY ALL)"""


@query("stat_isotonic", ISO + " SELECT source, round(x, 6) AS x, round(y, 6) AS y FROM iso", P)
def stat_isotonic(v):
    m = acc.recalibration_map(acc.calibration(v.predictions, ["source"]), ["source"])
    return m.select("source", F.inline("anchors")).select("source", *r6("x", "y"))


@query("stat_recalibrate", ISO + """,
sgm AS (SELECT source, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, min(x) OVER (PARTITION BY source) AS xmin,
   max(x) OVER (PARTITION BY source) AS xmax, i FROM iso WINDOW w AS (PARTITION BY source ORDER BY x)),
ed AS (SELECT source, min(x) AS xmin, max(x) AS xmax, arg_min(y, x) AS ymin, arg_max(y, x) AS ymax FROM iso GROUP BY source)
SELECT p.id, round(CASE WHEN e.xmin IS NULL THEN raw_confidence WHEN raw_confidence <= e.xmin THEN ymin WHEN raw_confidence >= e.xmax THEN ymax
  ELSE y0 + (raw_confidence - x0) / (x1 - x0) * (y1 - y0) END, 6) AS recalibrated
FROM predictions p LEFT JOIN ed e ON e.source = p.source
LEFT JOIN sgm g ON g.source = p.source AND raw_confidence > e.xmin AND raw_confidence < e.xmax AND raw_confidence >= x0 AND raw_confidence < x1""", P)
def stat_recalibrate(v):
    return acc.recalibrate(v.predictions, v.predictions).select("id", *r6("recalibrated"))


H = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), {s}, 8) AS BIGINT)"
REPS = f"""
b AS (SELECT id, CASE WHEN status='HIT' THEN 1 ELSE 0 END AS y, confidence AS c, {H.format(k='id', s=1)} AS a, {H.format(k='id', s=9)} AS b
      FROM predictions WHERE {CLOSED}),
x AS (SELECT *, (a * rep + b) % 2147483647 AS u FROM b, unnest(range(1, {{reps}} + 1)) t(rep))"""


def _cuts():
    from tidemark.functions.stats import POISSON1_CUTS

    return " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in POISSON1_CUTS)


BOOT = REPS.format(reps=1000) + f""",
w AS (SELECT rep, {_cuts()} AS w, y, pow(c - y, 2) AS e FROM x),
r AS (SELECT rep, sum(w * y) / sum(w)::DOUBLE AS wr, sum(w * e) / sum(w) AS br FROM w GROUP BY rep),
k AS (SELECT *, row_number() OVER (ORDER BY wr) AS rw, row_number() OVER (ORDER BY br) AS rb, count(*) OVER () AS m FROM r)
SELECT (SELECT count(*) FROM b) AS n, (SELECT round(avg(y), 4) FROM b) AS win_rate, (SELECT round(avg(pow(c - y, 2)), 4) FROM b) AS brier_score,
  round(max(wr) FILTER (rw = ceil(0.025 * m)), 4) AS win_rate_lo, round(max(wr) FILTER (rw = ceil(0.975 * m)), 4) AS win_rate_hi,
  round(max(br) FILTER (rb = ceil(0.025 * m)), 4) AS brier_lo, round(max(br) FILTER (rb = ceil(0.975 * m)), 4) AS brier_hi,
  round(avg(CASE WHEN wr > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS prob_better_than_coin FROM k"""


@query("stat_bootstrap_ci", BOOT, P)
def stat_bootstrap_ci(v):
    return acc.bootstrap_ci(acc.closed(v.predictions), resamples=1000)


PERM = REPS.format(reps=1000) + """,
t AS (SELECT count(*) AS n, sum(y) AS nh, sum(c) AS sc, sum(c * y) AS hc FROM b),
rk AS (SELECT rep, c, row_number() OVER (PARTITION BY rep ORDER BY u, id) AS r FROM x),
ph AS (SELECT rep, sum(c) AS s FROM rk, t WHERE r <= nh GROUP BY rep),
o AS (SELECT n, nh, sc, hc / nh - (sc - hc) / (n - nh) AS obs FROM t)
SELECT n, round(any_value(obs), 4) AS observed_diff, round((count(*) FILTER (abs(s / nh - (sc - s) / (n - nh)) >= abs(obs) - 1e-12) + 1) / 1001.0::DOUBLE, 4) AS p_value
FROM o, ph GROUP BY n"""


@query("stat_permutation", PERM, P)
def stat_permutation(v):
    return acc.permutation_test(acc.closed(v.predictions), permutations=1000)


@query("agg_brier_auc", f"""
b AS (SELECT raw_confidence AS s, CASE WHEN status='HIT' THEN 1 ELSE 0 END AS y FROM predictions WHERE {CLOSED}),
g AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM b GROUP BY s),
c AS (SELECT *, sum(q) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cq FROM g)
SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round((SELECT avg(pow(s - y, 2)) FROM b), 6) AS brier,
  round(sum(p * (cq - 0.5 * q))::DOUBLE / (sum(p) * sum(q))::DOUBLE, 6) AS auc FROM c""", P)
def agg_brier_auc(v):
    rows = acc.closed(v.predictions).select("raw_confidence", (F.col("status") == "HIT").cast("int").alias("y"))
    return acc.brier_auc(rows, "raw_confidence", "y").select("n_pos", "n_neg", *r6("brier", "auc"))


MET = """count(*) AS n, CAST(sum(y) AS BIGINT) AS wins, round(avg(y), 6) AS win_rate, round(avg(pow(c - y, 2)), 6) AS brier,
 round(avg(outcome_return), 6) AS avg_return"""
CB = f"cb AS (SELECT *, CASE WHEN status='HIT' THEN 1 ELSE 0 END AS y, {RAW} AS c FROM predictions WHERE {CLOSED} AND outcome_date IS NOT NULL)"


def met(df):
    return df.select(*[c for c in df.columns if c not in ("win_rate", "brier", "avg_return")], *r6("win_rate", "brier", "avg_return"))


@query("ab_metrics", f"{CB} SELECT direction, {MET} FROM cb GROUP BY direction", P)
def ab_metrics(v):
    rows = acc.closed(v.predictions).where("outcome_date IS NOT NULL")
    return met(acc.outcome_metrics(rows, F.coalesce("raw_confidence", "confidence"), ["direction"]))


@query("ab_recalibration", f"""
o AS (SELECT *, {RAW} AS c, row_number() OVER (ORDER BY outcome_date, created_at, id) - 1 AS ix, count(*) OVER () AS n
      FROM predictions WHERE {CLOSED} AND outcome_date IS NOT NULL AND timeframe = '1W'),
sp AS (SELECT * EXCLUDE (c), c AS raw0, ix >= least(greatest(floor(n * 0.7::DOUBLE), 1), n - 1) AS is_test FROM o),
""" + ISO.replace("FROM predictions WHERE", "FROM (SELECT * REPLACE ('x' AS source) FROM sp WHERE NOT is_test) WHERE").strip() + """,
ed AS (SELECT min(x) AS xmin, max(x) AS xmax, arg_min(y, x) AS ymin, arg_max(y, x) AS ymax FROM iso),
sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM iso),
te AS (SELECT CASE WHEN status='HIT' THEN 1 ELSE 0 END AS y, outcome_return, raw0,
  CASE WHEN raw0 <= xmin THEN ymin WHEN raw0 >= xmax THEN ymax ELSE y0 + (raw0 - x0) / (x1 - x0) * (y1 - y0) END AS rc
  FROM sp CROSS JOIN ed LEFT JOIN sg ON raw0 > xmin AND raw0 < xmax AND raw0 >= x0 AND raw0 < x1 WHERE is_test),
ar AS (SELECT 'raw' AS arm, y, outcome_return, raw0 AS c FROM te UNION ALL SELECT 'recalibrated', y, outcome_return, rc FROM te)
SELECT arm, """ + MET + " FROM ar GROUP BY arm", P)
def ab_recalibration(v):
    return met(acc.eval_recalibration(v.predictions, timeframe="1W"))


@query("ab_dead_signals", f"""{CB},
d AS (SELECT *, list_has_any(signals, ['valuation', 'cycle']) AS hd FROM cb)
SELECT slice, {MET} FROM (SELECT 'overall' AS slice, * FROM d UNION ALL SELECT CASE WHEN hd THEN 'with_dead' ELSE 'without_dead' END, * FROM d) GROUP BY slice""", P)
def ab_dead_signals(v):
    return met(acc.eval_dead_signals(v.predictions, ("valuation", "cycle")))


@query("ab_regime_window", f"{CB} SELECT {MET} FROM cb WHERE direction = 'BULL' AND created_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'", P)
def ab_regime_window(v):
    return met(acc.eval_regime_window(v.predictions, "1998-01-01", "1998-03-31"))


@query("agg_windows_report", f"""
w AS (SELECT * FROM predictions, (VALUES (7), (30), (90)) t(days) WHERE {RESOLVED}
  AND outcome_date <= TIMESTAMP '{ASOF}' AND outcome_date >= TIMESTAMP '{ASOF}' - days * INTERVAL 1 DAY)
SELECT days, {REC} FROM w GROUP BY days""", P)
def agg_windows_report(v):
    return rec(acc.windows_explode(v.predictions, ASOF).groupBy("days").agg(*acc._record_columns()))


def each_window(sql, windows=(7, 30, 90)):
    """A statement over closed rows, repeated for the rows of every look-back window."""
    parts = (f"SELECT {d} AS days, * FROM ({sql.replace(CLOSED, CLOSED + ' AND ' + window_sql(d))})" for d in windows)
    return " UNION ALL ".join(parts)


@query("agg_weekly_buckets", f"SELECT curve, days, confidence_range, predicted_confidence, actual_accuracy, count, CAST(count >= 3 AND predicted_confidence - actual_accuracy >= 0.10 AS INTEGER) AS overconfident FROM ("
       f"SELECT 'raw' AS curve, * FROM ({each_window(cal_sql(RAW))}) UNION ALL SELECT 'logged', * FROM ({each_window(cal_sql('confidence'))}))", P)
def agg_weekly_buckets(v):
    w, key = rp.weekly_curves(v.predictions, ASOF), ["days", "confidence_range"]
    out = []
    for curve, part, over in (("raw", "buckets", "overconfident_buckets_raw"), ("logged", "buckets_recal", "overconfident_buckets")):
        flag = w[over].select(*key, F.lit(1).alias("o"))
        out.append(w[part].join(flag, key, "left").select(
            F.lit(curve).alias("curve"), *key, "predicted_confidence", "actual_accuracy", "count", F.coalesce("o", F.lit(0)).alias("overconfident")))
    return out[0].unionByName(out[1])


@query("agg_weekly_signals", "SELECT *, CAST(verdict = 'dead' OR (total >= 5 AND win_rate < 0.4) AS INTEGER) AS worst FROM ("
       + each_window("WITH " + SIG_PERF.format(where=CLOSED, mc=3) + " SELECT * FROM perf") + ")", P)
def agg_weekly_signals(v):
    w = rp.weekly_signals(v.predictions, ASOF)
    worst = w["worst_signals"].select("days", "signal", F.lit(1).alias("w"))
    return w["signals"].join(worst, ["days", "signal"], "left").withColumn("worst", F.coalesce("w", F.lit(0))).drop("w")


@query("agg_weekly_robustness", f"SELECT c.*, p.observed_diff, p.p_value FROM ({each_window('WITH ' + BOOT)}) c JOIN ({each_window('WITH ' + PERM)}) p ON c.days = p.days", P)
def agg_weekly_robustness(v):
    return rp.robustness(v.predictions, ASOF)


@query("agg_readiness", f"""SELECT count(*) FILTER (components IS NOT NULL) AS closed_with_components, count(*) AS closed,
  CAST(count(*) FILTER (components IS NOT NULL) >= 100 AS INTEGER) AS ready FROM predictions WHERE {CLOSED}""", P)
def agg_readiness(v):
    return acc.readiness(v.predictions).withColumn("ready", F.col("ready").cast("int"))


@query("agg_signals_context", SIG_PERF.format(where=CLOSED, mc=5) + f""",
c AS ({cal_sql(RAW)})
SELECT 'record' AS part, 'last30' AS name, total AS n, win_rate AS value FROM (SELECT {REC} FROM predictions WHERE {RESOLVED} AND {window_sql(30)})
UNION ALL SELECT 'calibration', confidence_range, count, actual_accuracy FROM c
UNION ALL SELECT 'signal', signal, total, win_rate FROM (SELECT * FROM perf ORDER BY win_rate DESC, signal LIMIT 5)""", P)
def agg_signals_context(v):
    return rp.signals_context(v.predictions, ASOF)
