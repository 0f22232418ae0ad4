"""Queries over headlines, pages, calendar events and scalar helpers."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, text
from tidemark.functions import dates as fd
from tidemark.functions import fixed
from tidemark.functions import text as ft
from tidemark.operators import events as ev
from tidemark.operators import news as nw

N = ("news",)
ASOF = "2024-01-31"
NORM = "trim(regexp_replace(regexp_replace(lower(headline), '[^a-z0-9가-힣 ]', ' ', 'g'), ' +', ' ', 'g'))"


def kw_sql(words, h="lower(headline)"):
    a = [w.replace("+", "\\+") for w in words if w.isascii()]
    o = [w for w in words if not w.isascii()]
    parts = []
    if a:
        parts.append(rf"regexp_matches({h}, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(a)})($|[^\p{{L}}\p{{N}}_])')")
    if o:
        parts.append(f"regexp_matches({h}, '{'|'.join(o)}')")
    return "(" + " OR ".join(parts) + ")"


def sub_sql(words, h="lower(headline)"):
    return f"regexp_matches({h}, '{'|'.join(w.replace('+', chr(92) + '+') for w in words)}')"


TAGS = "list_filter([" + ", ".join(
    f"CASE WHEN {kw_sql(k)} THEN '{c}' END" for c, k in sorted(fixed.EVENT_KEYWORDS.items())
) + "], lambda x: x IS NOT NULL)"
POS, NEG = kw_sql(fixed.POSITIVE_CATALYSTS), kw_sql(fixed.NEGATIVE_CATALYSTS)
EMERGENCY = (f"({sub_sql(fixed.EMERGENCY_PHRASES)} AND ({kw_sql(fixed.CENTRAL_BANK_WORDS)} OR {sub_sql(fixed.CENTRAL_BANK_SUBSTRINGS)}))")
BUCKET = "CASE " + " ".join(
    f"WHEN {sub_sql(w)}{' OR ' + EMERGENCY if n == 'emergency_central_bank' else ''} THEN '{n}'" for n, _, w in fixed.MACRO_RISK_BUCKETS
) + " END"
WEIGHT = "CASE bucket " + " ".join(f"WHEN '{n}' THEN {w}" for n, w, _ in fixed.MACRO_RISK_BUCKETS) + " ELSE 0 END"


@query("fn_normalize_headline", f"SELECT doc_id, {NORM} AS norm FROM news", N)
def fn_normalize_headline(v):
    return v.news.select("doc_id", ft.normalize_headline(F.col("headline")).alias("norm"))


@query("fn_normalize_title", r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS title FROM documents")
def fn_normalize_title(v):
    return v.table("documents").select("doc_id", ft.normalize_title(F.col("text")).alias("title"))


@query("fn_contains_keyword", f"SELECT doc_id, CAST({kw_sql(('probe', 'fine', 'on', '감자'), 'lower(text)')} AS INTEGER) AS hit FROM documents")
def fn_contains_keyword(v):
    return v.table("documents").select("doc_id", ft.has_keyword(F.col("text"), ("probe", "fine", "on", "감자")).cast("int").alias("hit"))


@query("fn_event_tags", f"SELECT doc_id, array_to_string({TAGS}, ',') AS tags FROM news", N)
def fn_event_tags(v):
    return v.news.select("doc_id", F.array_join(ft.event_tags(F.col("headline")), ",").alias("tags"))


@query("fn_catalyst_flags", f"SELECT doc_id, CAST({POS} AS INTEGER) AS pos, CAST({NEG} AS INTEGER) AS neg FROM news", N)
def fn_catalyst_flags(v):
    h = F.col("headline")
    return v.news.select(
        "doc_id", ft.has_keyword(h, fixed.POSITIVE_CATALYSTS).cast("int").alias("pos"),
        ft.has_keyword(h, fixed.NEGATIVE_CATALYSTS).cast("int").alias("neg"),
    )


def dedup_cte(key):
    return f"""
nn AS (SELECT *, {NORM} AS norm FROM news),
ls AS (SELECT {key} AS grp, list(norm ORDER BY date, doc_id) AS l FROM nn WHERE norm <> '' GROUP BY ALL),
kp AS (SELECT grp, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
   CASE WHEN len(list_filter(acc, lambda k: k = x[1]
     OR (len(string_split(x[1], ' ')) >= 5 AND starts_with(k || ' ', x[1] || ' '))
     OR (len(string_split(k, ' ')) >= 5 AND starts_with(x[1] || ' ', k || ' ')))) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM ls),
ku AS (SELECT grp, unnest(kept) AS norm FROM kp),
ded AS (SELECT n.* FROM (SELECT *, {key} AS grp, row_number() OVER (PARTITION BY {key}, norm ORDER BY date, doc_id) AS rn FROM nn WHERE norm <> '') n
   JOIN ku USING (grp, norm) WHERE rn = 1)"""


@query("fn_dedup_prefix", dedup_cte("doc_id // 10000000 % 4") + " SELECT grp, doc_id, headline FROM ded", N)
def fn_dedup_prefix(v):
    n = v.news.withColumn("grp", F.floor(F.col("doc_id") / 10_000_000) % 4)  # a quarter of the documents, with all their lines
    return nw.dedup_headlines(n, ["grp"], ["date", "doc_id"]).select("grp", "doc_id", "headline")


SIG = dedup_cte("ticker") + f""",
ev AS (SELECT ticker, count(*) AS raw_count, """ + ", ".join(
    f"bool_or({kw_sql(k)}) AS t_{c}" for c, k in sorted(fixed.EVENT_KEYWORDS.items())
) + f""", bool_or({POS}) AS p, bool_or({NEG}) AS ng FROM news GROUP BY ticker),
sv AS (SELECT ticker, count(*) AS unique_count, avg(sentiment) AS ms,
   sum(pow(0.5::DOUBLE, greatest(date_diff('day', date, DATE '{ASOF}'), 0) / 3.0::DOUBLE) * sentiment)
   / sum(CASE WHEN sentiment IS NOT NULL THEN pow(0.5::DOUBLE, greatest(date_diff('day', date, DATE '{ASOF}'), 0) / 3.0::DOUBLE) END) AS rs FROM ded GROUP BY ticker)"""


@query("agg_news_signal", SIG + """
SELECT ticker, raw_count, coalesce(unique_count, 0) AS unique_count, round(ms, 6) AS mean_sentiment, round(rs, 6) AS recency_weighted_sentiment,
  array_to_string(list_filter([""" + ", ".join(f"CASE WHEN t_{c} THEN '{c}' END" for c in sorted(fixed.EVENT_KEYWORDS)) + """], lambda x: x IS NOT NULL), ',') AS tags,
  CAST(p AS INTEGER) AS pos, CAST(ng AS INTEGER) AS neg FROM ev LEFT JOIN sv USING (ticker)""", N)
def agg_news_signal(v):
    s = nw.news_signal(v.news, ["ticker"], ["date", "doc_id"], F.lit(ASOF).cast("date"))
    return s.select(
        "ticker", "raw_count", "unique_count", *r6("mean_sentiment", "recency_weighted_sentiment"),
        F.array_join("event_tags", ",").alias("tags"),
        F.col("has_positive_catalyst").cast("int").alias("pos"), F.col("has_negative_catalyst").cast("int").alias("neg"),
    )


@query("fn_signal_json", SIG + """
SELECT ticker, coalesce(unique_count, 0) AS unique_count, CAST(ms IS NULL AS INTEGER) AS sentiment_null, round(ms, 6) AS mean_sentiment, round(rs, 6) AS weighted, CAST(p AS VARCHAR) AS pos FROM ev LEFT JOIN sv USING (ticker)""", N)
def fn_signal_json(v):
    s = nw.signal_json(nw.news_signal(v.news, ["ticker"], ["date", "doc_id"], F.lit(ASOF).cast("date")))
    g = lambda p: F.get_json_object("news_signal", p)
    return s.select(
        "ticker", g("$.unique_count").cast("bigint").alias("unique_count"),
        g("$.mean_sentiment").isNull().cast("int").alias("sentiment_null"), F.round(g("$.mean_sentiment").cast("double"), 6).alias("mean_sentiment"),
        F.round(g("$.recency_weighted_sentiment").cast("double"), 6).alias("weighted"), g("$.has_positive_catalyst").alias("pos"),
    )


@query("fn_recency_weight", f"""SELECT doc_id, round(pow(0.5::DOUBLE, greatest(date_diff('day', date, DATE '2024-01-20'), 0) / 3.0::DOUBLE), 6) AS w FROM news""", N)
def fn_recency_weight(v):
    w = ft.recency_weight(F.col("date"), F.lit("2024-01-20").cast("date"))
    return v.news.select("doc_id", F.round(w, 6).alias("w"))


@query("fn_risk_bucket", f"SELECT doc_id, {BUCKET} AS bucket FROM news", N)
def fn_risk_bucket(v):
    return v.news.select("doc_id", ft.risk_bucket(F.col("headline")).alias("bucket"))


MACRO = rf"""
tt AS (SELECT *, regexp_replace(lower(headline), '[^\p{{L}}\p{{N}}]', '', 'g') AS title FROM news),
t1 AS (SELECT *, row_number() OVER (PARTITION BY date, CASE WHEN title = '' THEN '#' || doc_id ELSE title END ORDER BY doc_id) AS rn FROM tt),
mt AS (SELECT *, {BUCKET} AS bucket FROM t1 WHERE rn = 1),
mm AS (SELECT *, {WEIGHT} AS weight FROM mt WHERE bucket IS NOT NULL)"""


@query("agg_macro_risk", MACRO + """,
s AS (SELECT date, CAST(sum(weight) AS BIGINT) AS sc, count(*) AS m FROM mm GROUP BY date),
d AS (SELECT DISTINCT date, day(date) % 10 = 0 AS stale FROM news)
SELECT CAST(date AS VARCHAR) AS date, CASE WHEN stale THEN 0 ELSE coalesce(sc, 0) END AS risk_score, CASE WHEN stale THEN 0 ELSE coalesce(m, 0) END AS matched,
 CASE WHEN stale THEN 'NORMAL' WHEN sc >= 6 THEN 'RISK_OFF' WHEN sc >= 2 THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_level FROM d LEFT JOIN s USING (date)""", N)
def agg_macro_risk(v):
    out = nw.macro_risk(v.news, ["date"], ["doc_id"], "doc_id", F.dayofmonth("date") % 10 == 0)
    return out.select(*text("date"), "risk_score", "matched", "risk_level")


@query("agg_macro_evidence", MACRO + " SELECT CAST(date AS VARCHAR) AS date, doc_id, bucket, weight FROM mm", N)
def agg_macro_evidence(v):
    return nw.macro_matches(v.news, ["date"], ["doc_id"], "doc_id").select(*text("date"), "doc_id", "bucket", "weight")


@query("agg_news_audit", f"""
a AS (SELECT len({TAGS}) > 0 AS e, {NEG} AS n, {POS} AS p, {BUCKET} IS NOT NULL AS m FROM news)
SELECT count(*) AS headlines, count(*) FILTER (e OR n OR p OR m) AS matched, count(*) FILTER (e) AS event_tags, count(*) FILTER (n) AS neg_catalyst,
  count(*) FILTER (p) AS pos_catalyst, count(*) FILTER (m) AS macro_bucket FROM a""", N)
def agg_news_audit(v):
    return nw.audit(v.news)


@query("agg_news_sample", """
r AS (SELECT ticker, max(created_at) AS l FROM predictions WHERE created_at <= TIMESTAMP '2000-06-30' AND created_at >= TIMESTAMP '2000-06-23'
      GROUP BY ticker ORDER BY l DESC, ticker LIMIT 12),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, doc_id DESC) AS rn FROM news WHERE ticker IN (SELECT ticker FROM r))
SELECT 'ticker:' || ticker AS origin, doc_id, headline FROM o WHERE rn <= 5 AND headline <> ''
UNION ALL SELECT 'macro', doc_id, headline FROM (SELECT * FROM news ORDER BY date DESC, doc_id DESC LIMIT 20) WHERE headline <> ''""", ("news", "predictions"))
def agg_news_sample(v):
    return nw.sample_headlines(v.predictions, v.news, v.news, "2000-06-30")


@query("agg_news_count", "SELECT s_suppkey AS ticker, count(doc_id) AS news_count_7d FROM supplier LEFT JOIN news ON ticker = s_suppkey GROUP BY s_suppkey", N)
def agg_news_count(v):
    return nw.news_counts(v.table("supplier").select(F.col("s_suppkey").alias("ticker")), v.news)


STOP = ", ".join(f"'{w}'" for w in fixed.KO_STOPWORDS + fixed.EN_STOPWORDS)
TOK = ("list_filter(list_transform(regexp_extract_all({h}, '[A-Za-z가-힣0-9]+'), lambda t: lower(t)), "
       f"lambda t: length(t) >= 2 AND NOT list_contains([{STOP}], t))")


def gram_sql(t, n):
    return f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string(list_slice({t}, i, i + {n} - 1), ' ')) ELSE [] END"


@query("fn_tokenize_ngrams", f"""
t AS (SELECT doc_id, {TOK.format(h='text')} AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, len(list_distinct({gram_sql('t', 2)})) AS n_bigrams, array_to_string(list_slice({gram_sql('t', 3)}, 1, 2), '|') AS head FROM t""")
def fn_tokenize_ngrams(v):
    d = v.table("documents").select("doc_id", ft.tokens(F.col("text")).alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(ft.ngrams(F.col("t"), 2))).cast("bigint").alias("n_bigrams"),
        F.array_join(F.slice(ft.ngrams(F.col("t"), 3), 1, 2), "|").alias("head"),
    )


@query("agg_themes", f"""
tk AS (SELECT doc_id, ticker, date, trim(headline) AS h, CASE WHEN trim(url) <> '' THEN trim(url) ELSE trim(headline) END AS article, {TOK.format(h='headline')} AS t
   FROM news WHERE trim(headline) <> ''),
g AS (SELECT doc_id, ticker, article, h, unnest(list_distinct(list_concat({gram_sql('t', 2)}, {gram_sql('t', 3)}))) AS gram FROM tk),
c AS (SELECT gram, count(DISTINCT ticker) AS n_tickers, count(*) AS headline_count, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS tickers
   FROM g GROUP BY gram HAVING count(DISTINCT ticker) >= 3 AND count(DISTINCT article) >= 2)
SELECT gram, n_tickers, headline_count, tickers FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.tickers = a.tickers
   AND len(string_split(b.gram, ' ')) > len(string_split(a.gram, ' ')) AND contains(' ' || b.gram || ' ', ' ' || a.gram || ' '))
ORDER BY n_tickers DESC, headline_count DESC, len(string_split(gram, ' ')) DESC, gram LIMIT 8""", N)
def agg_themes(v):
    t = nw.themes(v.news, ["date", "doc_id"])
    return t.select("gram", "n_tickers", "headline_count", F.array_join(F.transform("tickers", lambda x: x.cast("string")), ",").alias("tickers"))


@query("fn_clean_html", r"""
s AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
  '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS txt FROM s""")
def fn_clean_html(v):
    return v.table("pages").select("page_id", ft.clean_html(F.col("html")).alias("txt"))


@query("fn_domain", r"""SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '') AS domain FROM pages""")
def fn_domain(v):
    return v.table("pages").select("page_id", ft.domain(F.col("url")).alias("domain"))


@query("fn_parse_dates", """SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS rss, CAST(date_trunc('second', ts) AS VARCHAR) AS compact,
  CAST(date_trunc('second', ts) - INTERVAL 9 HOUR AS VARCHAR) AS kst FROM events""")
def fn_parse_dates(v):
    t = F.col("ts").cast("timestamp")
    fmt = lambda p: F.date_format(t, p)
    rss = F.concat(fmt("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    kst = F.concat(fmt("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0900"))
    compact = F.concat(fmt("yyyyMMdd'T'HHmmss"), F.lit("Z"))
    out = {"rss": fd.rfc822(rss), "compact": fd.compact_utc(compact), "kst": fd.rfc822(kst)}
    return v.table("events").select("event_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(k) for k, c in out.items()])


UNITS = ["min", "hours", "d", "weeks", "months", "years", ""]


@query("fn_timespan_days", f"""
x AS (SELECT event_id, event_id % 50 AS n, ({UNITS!r})[event_id % 7 + 1] AS u FROM events)
SELECT event_id, CAST(CASE WHEN n = 0 THEN 2 WHEN u = 'min' THEN 1 WHEN u = 'hours' THEN greatest(1, ceil(n / 24.0::DOUBLE)) WHEN u = 'weeks' THEN n * 7
  WHEN u = 'months' THEN n * 30 WHEN u = 'years' THEN n * 365 ELSE greatest(n, 1) END AS INTEGER) AS days FROM x""")
def fn_timespan_days(v):
    u = F.element_at(F.array(*[F.lit(x) for x in UNITS]), (F.col("event_id") % 7 + 1).cast("int"))
    raw = F.concat((F.col("event_id") % 50).cast("string"), u)
    return v.table("events").select("event_id", fd.timespan_days(raw).alias("days"))


@query("fn_since_days", "SELECT event_id, CAST(event_id % 50 * ([1, 1, 7, 30])[event_id % 4 + 1] AS INTEGER) AS days FROM events")
def fn_since_days(v):
    u = F.element_at(F.array(*[F.lit(x) for x in ("", "d", "W", "m ")]), (F.col("event_id") % 4 + 1).cast("int"))
    return v.table("events").select("event_id", fd.since_days(F.concat((F.col("event_id") % 50).cast("string"), u)).alias("days"))


@query("fn_parse_signals", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n FROM orders""")
def fn_parse_signals(v):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('["news", "'), F.col("o_orderpriority"), F.lit('"]'))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"a": "'), F.col("o_orderpriority"), F.lit('"}'))
    ).otherwise(F.concat(F.lit('["'), F.col("o_orderpriority")))
    return v.table("orders").select("o_orderkey", F.size(ft.parse_signals(raw)).alias("n"))


@query("fn_codes", """SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, upper(trim(s_name)) AS us_code, CAST(s_suppkey AS VARCHAR) || 'a' AS kr_code FROM supplier""")
def fn_codes(v):
    k = F.col("s_suppkey").cast("string")
    return v.table("supplier").select(
        "s_suppkey", ft.zero_pad_code(k).alias("code"), ft.watch_ticker(F.col("s_name")).alias("us_code"),
        ft.watch_ticker(F.concat(k, F.lit("a"))).alias("kr_code"),
    )


@query("fn_kv_list", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, o_orderpriority AS b, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS bad FROM orders""")
def fn_kv_list(v):
    raw = F.concat(F.lit(" a = "), F.col("o_custkey"), F.lit(",, b="), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 4 == 0, ",oops").otherwise(""))
    m = ft.kv_map(raw)
    return v.table("orders").select(
        "o_orderkey", F.element_at(m, F.lit("a")).alias("a"), F.element_at(m, F.lit("b")).alias("b"), F.size(ft.kv_bad_parts(raw)).alias("bad")
    )


@query("fn_business_days", """
SELECT o_orderkey, CAST(len(list_filter(range(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 60 AS INTEGER) + INTERVAL 1 DAY, INTERVAL 1 DAY),
  lambda d: isodow(d) <= 5)) AS INTEGER) AS days FROM orders""")
def fn_business_days(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", fd.business_days(d, F.date_add(d, (F.col("o_orderkey") % 60 + 1).cast("int"))).alias("days"))


@query("fn_weekday_dates", """
SELECT o_orderkey, CAST(len(list_filter(range(CAST(o_orderdate AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP) + INTERVAL 91 DAY, INTERVAL 5 DAY), lambda d: isodow(d) <= 5)) AS INTEGER) AS n FROM orders""")
def fn_weekday_dates(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", F.size(fd.weekday_dates(d, F.date_add(d, 90), 5)).alias("n"))


@query("fn_redact", "SELECT page_id, regexp_replace(url || '&apikey=k' || page_id || '&x=1', 'apikey=[^&]+', 'apikey=***') AS msg FROM pages")
def fn_redact(v):
    raw = F.concat("url", F.lit("&apikey=k"), F.col("page_id"), F.lit("&x=1"))
    return v.table("pages").select("page_id", ft.redact_key(raw).alias("msg"))


E = ("calendar_events",)
TIMING = "CASE WHEN lower(time) = 'bmo' THEN 'BMO' WHEN lower(time) = 'after-market' THEN 'AMC' ELSE 'TAS' END"
IS_MACRO = "(name IN ('US CPI', 'Fed Interest Rate Decision', 'Nonfarm Payrolls') AND country = 'US' AND impact = 'High')"
EV_ASOF = "1998-05-14"
BD = "len(list_filter(range(DATE '{a}' + INTERVAL 1 DAY, event_date + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) <= 5))"


@query("fn_timing", f"SELECT event_id, {TIMING} AS timing FROM calendar_events", E)
def fn_timing(v):
    return v.calendar_events.select("event_id", ev.timing(F.col("time")).alias("timing"))


@query("fn_macro_event", f"SELECT event_id, CAST({IS_MACRO} AS INTEGER) AS is_macro FROM calendar_events", E)
def fn_macro_event(v):
    c = ev.is_macro_event(F.col("name"), F.col("country"), F.col("impact"))
    return v.calendar_events.select("event_id", c.cast("int").alias("is_macro"))


@query("rule_timeline", f"""
SELECT CASE WHEN kind = 'macro' THEN NULL ELSE ticker END AS ticker, CASE WHEN kind = 'macro' THEN 'GLOBAL' ELSE market END AS market, kind, name,
  CAST(event_date AS VARCHAR) AS event_date, CASE WHEN kind <> 'macro' THEN {TIMING} END AS timing,
  CAST({BD.format(a=EV_ASOF)} AS INTEGER) AS trading_days_until
FROM calendar_events WHERE event_date >= DATE '{EV_ASOF}' AND (kind <> 'macro' OR {IS_MACRO})""", E)
def rule_timeline(v):
    return ev.timeline(v.calendar_events, EV_ASOF).select("ticker", "market", "kind", "name", *text("event_date"), "timing", "trading_days_until")


@query("rule_event_gate", f"""
l AS (SELECT *, {BD.format(a=EV_ASOF)} AS td FROM calendar_events WHERE event_date >= DATE '{EV_ASOF}' AND event_date < DATE '{EV_ASOF}' + 400),
e AS (SELECT ticker, min(td) AS td, arg_min(event_date, row(td, event_date)) AS d FROM l WHERE kind = 'earnings' GROUP BY ticker),
m AS (SELECT count(*) AS n FROM l WHERE kind = 'macro' AND {IS_MACRO} AND td <= 2),
t AS (SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM supplier)
SELECT t.ticker, market, CASE WHEN market = 'US' AND td <= 2 THEN 'WATCH' END AS cap_label,
  CASE WHEN market = 'US' AND td > 2 AND td <= 5 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS confidence_trim,
  CASE WHEN market = 'US' THEN CAST(d AS VARCHAR) END AS next_earnings_date,
  CASE WHEN n > 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS macro_trim, 0 AS gate_unavailable
FROM t LEFT JOIN e USING (ticker) CROSS JOIN m""", E)
def rule_event_gate(v):
    k = F.col("s_suppkey")
    t = v.table("supplier").select(k.alias("ticker"), F.when(k % 2 == 0, "US").otherwise("KR").alias("market"))
    g = ev.event_gate(t, v.calendar_events, EV_ASOF)
    return g.select("ticker", "market", "cap_label", "confidence_trim", *text("next_earnings_date"), "macro_trim", F.col("gate_unavailable").cast("int").alias("gate_unavailable"))


@query("join_event_interval", f"""
l AS (SELECT ticker, {BD.format(a=EV_ASOF)} AS td FROM calendar_events WHERE kind = 'earnings' AND event_date >= DATE '{EV_ASOF}' AND event_date < DATE '{EV_ASOF}' + 60)
SELECT ticker, CAST(min(td) AS INTEGER) AS nearest_td, count(*) AS n_events FROM l WHERE td <= 5 GROUP BY ticker""", E)
def join_event_interval(v):
    line = ev.timeline(v.calendar_events, EV_ASOF).where("kind = 'earnings' AND trading_days_until <= 5")
    return line.groupBy("ticker").agg(F.min("trading_days_until").alias("nearest_td"), F.count(F.lit(1)).alias("n_events"))


@query("src_earnings_dates", f"""SELECT ticker, CAST(min(event_date) FILTER (event_date >= DATE '{EV_ASOF}') AS VARCHAR) AS next_date,
  CAST(bool_or(event_id % 501 = 0) AS INTEGER) AS lookup_failed FROM calendar_events WHERE kind = 'earnings' GROUP BY ticker""", E)
def src_earnings_dates(v):
    zoned = F.col("event_id") % 2 == 0
    # a zoned instant late in the New York evening falls on the next UTC day
    p = v.calendar_events.where("kind = 'earnings'").select(
        "ticker",
        F.when(zoned, F.to_utc_timestamp(F.col("event_date").cast("timestamp") + F.expr("INTERVAL 21 HOURS"), "America/New_York")).alias("instant"),
        F.when(~zoned, F.col("event_date")).alias("plain_date"),
        (F.col("event_id") % 501 == 0).alias("failed"),
    )
    out = ev.next_earnings(p, EV_ASOF)
    return out.select("ticker", *text("next_date"), F.col("lookup_failed").cast("int").alias("lookup_failed"))
