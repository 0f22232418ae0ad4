"""Queries that build payloads from the given tables, parse them back and compare."""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, text
from tidemark.session import checkpoint_root
from tidemark.sources import files as fl
from tidemark.sources import payloads as pl
from tidemark.sources import sinks as sk

B = ("bars",)


def new_path(v, kind):
    """A new path below the folder that all executors share."""
    return f"{checkpoint_root(v.spark)}/{kind}-{uuid.uuid4().hex}"


def through_csv(v, df, schema):
    """The rows written as CSV files and read back strictly."""
    return fl.read_csv(v.spark, fl.write_csv(df, new_path(v, "csv")), schema, strict=True)


def pick(key, xs):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(key) % len(xs) + 1).cast("int"))


@query("src_bars", """SELECT ticker, CAST(date AS VARCHAR) AS date, close, CASE WHEN date_diff('day', DATE '1970-01-01', date) % 7 = 0 THEN 0 ELSE volume END AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars WHERE date_diff('day', DATE '1970-01-01', date) % 5 <> 0) WHERE rn <= 35""", B)
def src_bars(v):
    n = F.datediff("date", F.lit("1970-01-01").cast("date"))
    raw = v.bars.withColumns({"close": F.when(n % 5 != 0, F.col("close")), "volume": F.when(n % 7 != 0, F.col("volume"))})
    return fl.clean_bars(raw, 35).select("ticker", *text("date"), "close", "volume")


@query("src_priority_fallback", """
o AS (SELECT user_id AS ticker, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS prio, event_type AS source FROM events WHERE NOT (user_id % 3 = 0 AND event_type = 'click') AND NOT (user_id % 6 = 0 AND event_type = 'view'))
SELECT ticker, event_id, source FROM (SELECT *, min(prio) OVER (PARTITION BY ticker) AS m FROM o) WHERE prio = m""")
def src_priority_fallback(v):
    o = v.table("events").where("NOT (user_id % 3 = 0 AND event_type = 'click') AND NOT (user_id % 6 = 0 AND event_type = 'view')").select(
        F.col("user_id").alias("ticker"), "event_id", F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2).alias("prio"),
        F.col("event_type").alias("source"),
    )
    return fl.first_source(o, ["ticker"]).select("ticker", "event_id", "source")


@query("src_freshness", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'empty' WHEN ts >= TIMESTAMP '2024-01-05' THEN 'live' WHEN epoch(TIMESTAMP '2024-01-05') - floor(epoch(ts)) <= 21600 THEN 'cache' ELSE 'stale-cache' END AS freshness FROM events""")
def src_freshness(v):
    r = v.table("events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")).alias("fetched_at"))
    return fl.freshness(r, F.lit("2024-01-05").cast("timestamp"), 21600).select("event_id", "freshness")


@query("src_universe_csv", """SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ticker, 'KR' AS market FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT s_suppkey, 'AB' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)), 'US' FROM supplier WHERE s_suppkey % 3 <> 0""")
def src_universe_csv(v):
    k = F.col("s_suppkey")
    s = v.table("supplier")
    kr = s.select("s_suppkey", F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), k.cast("string"))).alias("ticker"))
    us = s.select("s_suppkey", F.concat(F.lit("ab"), F.char(97 + k % 26), F.when(k % 3 == 0, "-12").otherwise("")).alias("ticker"))
    kr, us = (through_csv(v, x, "s_suppkey long, ticker string") for x in (kr, us))
    return fl.universe(kr, "KR").withColumn("market", F.lit("KR")).unionByName(fl.universe(us, "US").withColumn("market", F.lit("US")))


@query("src_sector_map", "SELECT n_name AS sector, s_suppkey::VARCHAR AS ticker FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0")
def src_sector_map(v):
    s = v.table("supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.col("s_suppkey").cast("string"))), " ; ").alias("constituents"))
    rows = v.table("nation").join(s, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("sector"), F.when(F.col("n_nationkey") % 5 != 0, "PX").otherwise(" ").alias("proxy_etf"), "constituents"
    )
    return fl.sector_map(through_csv(v, rows, "sector string, proxy_etf string, constituents string")).select("sector", "ticker")


@query("src_csv_rows", """SELECT event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 11 = 0) AS corrupt, count(*) FILTER (event_id % 11 <> 0 AND event_id % 7 = 0) AS blank,
  round(sum(CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN value END), 4) AS total FROM events GROUP BY event_type""")
def src_csv_rows(v):
    """Rows whose value is no number are counted as corrupt, not read as missing."""
    k = F.col("event_id")
    value = F.when(k % 11 == 0, F.concat(F.lit("n/a "), k.cast("string"))).when(k % 7 != 0, F.col("value").cast("string"))
    path = fl.write_csv(v.table("events").select(F.col("event_type").alias("kind"), k, value.alias("value")), new_path(v, "csv"))
    rows = fl.read_csv(v.spark, path, "kind string, event_id long, value double", corrupt="line")
    bad = F.col("line").isNotNull()
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("corrupt"), F.count_if(~bad & F.col("value").isNull()).alias("blank"), F.round(F.sum("value"), 4).alias("total"))


@query("src_etf_json", """
SELECT CASE WHEN valid THEN code END AS code, name, valid, price, deviation, aum, asset_class, leverage, tax_type, hedged FROM (
SELECT lpad(p_partkey::VARCHAR, 6, '0') AS code, p_name || CASE WHEN p_partkey % 9 = 0 THEN ' 레버리지' WHEN p_partkey % 4 = 0 THEN '(H)' ELSE '' END AS name, CAST(p_partkey % 11 <> 0 AND p_partkey < 1000000 AS INTEGER) AS valid,
  CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 11 <> 0 AND p_partkey < 1000000 AND p_partkey % 6 <> 0 THEN round((p_retailprice - (p_retailprice + p_size)) / (p_retailprice + p_size) * 100, 3) END AS deviation,
  p_size AS aum, (['domestic_equity','domestic_sector','domestic_derivative','overseas_equity','commodity','bond','other'])[p_partkey % 7 + 1] AS asset_class,
  CAST(p_partkey % 9 = 0 OR p_partkey % 7 = 2 AS INTEGER) AS leverage, CASE WHEN p_partkey % 7 IN (0, 1) AND p_partkey % 9 <> 0 THEN 'domestic_equity_type' ELSE 'other_type' END AS tax_type,
  CAST(p_partkey % 4 = 0 AND p_partkey % 9 <> 0 AS INTEGER) AS hedged FROM part)""")
def src_etf_json(v):
    k = F.col("p_partkey")
    item = F.struct(
        k.cast("string").alias("itemcode"),
        F.concat("p_name", F.when(k % 9 == 0, " 레버리지").when(k % 4 == 0, "(H)").otherwise("")).alias("itemname"),
        F.when(k % 11 != 0, F.col("p_retailprice").cast("string")).otherwise("").alias("nowVal"),
        F.when(k % 6 == 0, "0").otherwise((F.col("p_retailprice") + F.col("p_size")).cast("string")).alias("nav"),
        (k % 7 + 1).cast("string").alias("etfTabCode"), F.col("p_size").cast("string").alias("marketSum"),
    )
    body = F.to_json(F.struct(F.struct(F.array(item).alias("etfItemList")).alias("result")))
    out = pl.etf_universe(v.table("part").select(body.alias("body")))
    i = lambda c: F.col(c).cast("int").alias(c)
    return out.select(
        F.when(F.col("valid"), F.col("code")).alias("code"), "name", i("valid"), "price",
        F.when(F.col("valid"), F.col("deviation")).alias("deviation"), "aum", "asset_class", i("leverage"), "tax_type", i("hedged"),
    )


@query("src_etf_detail", """SELECT p_partkey AS code, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 100.0::DOUBLE END AS fund_pay_pct, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS base_index,
  CAST((CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_notes FROM part""")
def src_etf_detail(v):
    return pl.etf_detail(_details(v)).select("code", "fund_pay_pct", "base_index", F.size("notes").alias("n_notes"))


def _details(v):
    k = F.col("p_partkey")
    kv = lambda c, x: F.struct(F.lit(c).alias("code"), x.alias("value"))
    fee = F.when(k % 5 == 0, "n/a").otherwise(F.concat((F.col("p_size") / 100.0).cast("string"), F.lit("%")))
    body = F.to_json(F.struct(F.array(kv("fundPay", fee), kv("etfBaseIdx", F.when(k % 3 == 0, "").otherwise(F.col("p_brand")))).alias("totalInfos")))
    return v.table("part").select(k.alias("code"), F.col("p_type").alias("group"), body.alias("body"))


@query("agg_base_index_mismatch", """SELECT p_type AS "group", count(DISTINCT CASE WHEN p_partkey % 3 <> 0 THEN p_brand END) AS n_indexes, CAST(count(DISTINCT CASE WHEN p_partkey % 3 <> 0 THEN p_brand END) > 1 AS INTEGER) AS mismatch FROM part GROUP BY p_type""")
def agg_base_index_mismatch(v):
    d = _details(v)
    j = pl.etf_detail(d).join(d.select("code", "group"), "code")
    return pl.base_index_mismatch(j).withColumn("mismatch", F.col("mismatch").cast("int"))


@query("src_rss", """
x AS (SELECT event_id, ts, event_id // 3 AS lk, 'headline ' || event_id AS h, event_id % 13 = 0 AS bad, event_id % 17 = 0 AS blank FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY event_id) AS rn FROM x WHERE NOT bad AND NOT blank AND date_trunc('second', ts) >= TIMESTAMP '2024-01-05' - INTERVAL 2 DAY)
SELECT 'http://n/' || lk AS url, h AS headline, CAST(date_trunc('second', ts) AS VARCHAR) AS ts FROM r WHERE rn = 1""")
def src_rss(v):
    k = F.col("event_id")
    date = F.when(k % 13 == 0, "yesterday").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    xml = F.concat(
        F.lit("<rss><channel><item><title>"), F.when(k % 17 != 0, F.concat(F.lit("headline "), k)).otherwise(" "),
        F.lit("</title><link>http://n/"), F.floor(k / 3).cast("string"), F.lit("</link><pubDate>"), date, F.lit("</pubDate></item></channel></rss>"),
    )
    feeds = v.table("events").select(F.lit("wire").alias("publisher"), k.alias("feed_id"), xml.alias("body"))
    out = pl.rss(feeds, "2024-01-05", 2, limit=None)
    return out.select("url", "headline", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("src_gdelt", "SELECT 'h' || event_id AS headline, CASE WHEN event_id % 5 <> 0 THEN CAST(date_trunc('second', ts) AS VARCHAR) END AS ts FROM events WHERE event_id % 7 <> 0")
def src_gdelt(v):
    k = F.col("event_id")
    art = F.struct(
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("h"), k)).alias("title"), F.lit("u").alias("url"),
        F.when(k % 5 == 0, "soon").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss"), F.lit("Z"))).alias("seendate"),
    )
    body = F.to_json(F.struct(F.array(art).alias("articles")))
    return pl.article_list(v.table("events").select(body.alias("body"))).select("headline", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("src_news_search", "SELECT event_id::VARCHAR AS headline, CASE WHEN event_id % 4 <> 0 THEN 'p.example.com' ELSE 'search' END AS source FROM events WHERE event_id % 3 <> 0 AND (event_id % 5 = 0 OR date_trunc('second', ts + INTERVAL 1 SECOND) >= TIMESTAMP '2024-01-05' - INTERVAL 3 DAY)")
def src_news_search(v):
    k = F.col("event_id")
    ts = F.date_trunc("second", F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 SECOND"))
    item = F.struct(
        F.concat(F.lit("<b>"), k.cast("string"), F.lit("</b>")).alias("title"),
        F.when(k % 3 == 0, "other").otherwise("about &quot;Acme&quot; today").alias("description"),
        F.when(k % 5 == 0, "bad").otherwise(F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).alias("pubDate"),
        F.when(k % 4 != 0, "https://www.p.example.com/a").otherwise("").alias("originallink"), F.lit("").alias("link"),
    )
    rows = v.table("events").select(F.lit("Acme").alias("company"), F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    return pl.news_search(rows, "2024-01-05", 3).select("headline", "source")


@query("src_news_html", """SELECT event_id AS page_id, 'T ' || event_id AS headline, CASE WHEN event_id % 2 = 0 THEN 'http://x/' || event_id ELSE 'https://base/' || event_id END AS url,
  CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN event_id % 3 = 1 THEN '2023-' || strftime(ts, '%m-%d') END AS date FROM events WHERE event_id % 7 <> 0""")
def src_news_html(v):
    k = F.col("event_id")
    t = F.col("ts").cast("timestamp")
    date = F.when(k % 3 == 0, F.date_format(t, "yyyy.MM.dd HH:mm")).when(k % 3 == 1, F.date_format(t, "MM.dd HH:mm")).otherwise("today")
    link = F.concat(F.when(k % 2 == 0, "http://x/").otherwise("/"), k.cast("string"))
    title = F.when(k % 7 == 0, "<td class=\"title\">no link</td>").otherwise(F.concat(F.lit('<td class="title"> <a class="tit" href="'), link, F.lit('"> T '), k.cast("string"), F.lit("</a></td>")))
    html = F.concat(F.lit('<table class="type5"><tr>'), title, F.lit('<td class="info">src</td><td class="date">'), date, F.lit("</td></tr></table>"))
    out = pl.news_listing(v.table("events").select(k.alias("page_id"), html.alias("html")), "2023-06-01", "https://base")
    return out.select("page_id", "headline", "url", *text("date"))


@query("src_finnhub", """SELECT ticker, headline, date FROM (SELECT user_id AS ticker, 'h' || event_id AS headline, CASE WHEN event_id % 6 = 0 THEN '2024-02-01' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 6 = 0 THEN DATE '2024-02-01' ELSE CAST(ts AS DATE) END DESC, event_id) AS rn FROM events) WHERE rn <= 5""")
def src_finnhub(v):
    k = F.col("event_id")
    e = v.table("events")
    item = F.struct(
        F.concat(F.lit("h"), k).alias("headline"), F.lit("s").alias("source"),
        F.when(k % 6 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("datetime"), F.lit("u").alias("url"), k.alias("k"),
    )
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("o"), item.alias("i")))), lambda x: x["i"]))
    p = e.groupBy(F.col("user_id").alias("ticker")).agg(body.alias("body"))
    return pl.epoch_news(p, "2024-02-01", 5).select("ticker", "headline", *text("date"))


@query("src_corp_codes", "SELECT s_suppkey::VARCHAR AS corp_code, s_name AS corp_name, lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code FROM supplier WHERE s_suppkey % 3 <> 0")
def src_corp_codes(v):
    k = F.col("s_suppkey")
    xml = F.concat(
        F.lit("<result><list><corp_code> "), k.cast("string"), F.lit("</corp_code><corp_name>"), F.col("s_name"), F.lit("</corp_name><stock_code>"),
        F.when(k % 3 != 0, F.lpad(k.cast("string"), 6, "0")).otherwise(" "), F.lit("</stock_code><modify_date>20240101</modify_date></list></result>"),
    )
    return pl.corp_codes(v.table("supplier").select(xml.alias("body"))).select("corp_code", "corp_name", "stock_code")


@query("src_corp_lookup", """SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') AS ticker, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::VARCHAR END AS corp_code
FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def src_corp_lookup(v):
    """Codes by ticker, from the mapping read out of its XML; two files list every entity."""
    codes = src_corp_codes(v)
    wanted = v.table("part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("ticker"))
    return pl.corp_code_of(wanted, codes.unionByName(codes)).select("p_partkey", "ticker", "corp_code")


@query("src_disclosures", """SELECT o_custkey AS ticker, o_orderkey::VARCHAR AS rcept_no, o_orderpriority AS report_nm, strftime(o_orderdate, '%Y-%m-%d') AS rcept_date,
  CASE WHEN o_orderkey = 0 THEN '' ELSE 'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || o_orderkey END AS url FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey <> 0""")
def src_disclosures(v):
    k = F.col("o_orderkey")
    item = F.struct(k.cast("string").alias("rcept_no"), F.col("o_orderpriority").alias("report_nm"), F.lit("f").alias("flr_nm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))
    status = F.when(k % 4 < 2, "000").when(k % 4 == 2, "013").otherwise("020")
    body = F.to_json(F.struct(status.alias("status"), F.when(k % 4 != 2, F.array(item)).alias("list")))
    p = v.table("orders").where("o_orderkey <> 0").select(F.col("o_custkey").alias("ticker"), body.alias("body"))
    return pl.disclosures(p).select("ticker", "rcept_no", "report_nm", *text("rcept_date"), "url")


@query("src_fundamentals_variants", "SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS pe_ratio, CAST(s_nationkey AS DOUBLE) AS pb_ratio FROM (SELECT *  REPLACE (nullif(s_nationkey, 0) AS s_nationkey) FROM supplier)")
def src_fundamentals_variants(v):
    k = F.col("s_suppkey")
    rows = v.table("supplier").select(k.alias("ticker"), F.when(k % 4 == 0, 0).otherwise(F.col("s_acctbal")).alias("PER"), F.col("s_nationkey").alias("PBR"), F.lit(1.0).alias("배당수익률"))
    return fl.fundamentals(rows).select("ticker", "pe_ratio", "pb_ratio")


@query("src_tx_csv", """
x AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 13 = 0 THEN 'HOLD' ELSE 'buy' END AS side, CASE WHEN o_orderkey % 17 = 0 THEN 'abc' ELSE (o_custkey % 3)::VARCHAR END AS q, (o_custkey % 20) AS p, o_orderkey % 19 = 0 AS badt FROM orders),
e AS (SELECT *, (CASE WHEN side = 'HOLD' THEN 1 ELSE 0 END) + (CASE WHEN q = 'abc' OR q = '0' THEN 1 ELSE 0 END) + (CASE WHEN p = 0 THEN 1 ELSE 0 END) + (CASE WHEN badt THEN 1 ELSE 0 END) AS n FROM x)
SELECT line, CAST(n AS INTEGER) AS n_errors, CAST(n = 0 AND row_number() OVER (PARTITION BY n = 0, q, p ORDER BY line) > 1 AS INTEGER) AS duplicate FROM e""")
def src_tx_csv(v):
    k = F.col("o_orderkey")
    lines = v.table("orders").select(
        k.alias("line"), F.lit(" 2024-01-01").alias("date"), F.when(k % 19 == 0, "B4D").otherwise("ABC ").alias("ticker"),
        F.when(k % 13 == 0, "HOLD").otherwise("buy").alias("side"), F.when(k % 17 == 0, "abc").otherwise((F.col("o_custkey") % 3).cast("string")).alias("quantity"),
        (F.col("o_custkey") % 20).cast("string").alias("price"),
    )
    out = fl.parse_transactions(lines, "US")
    return out.select("line", F.size("errors").alias("n_errors"), F.col("duplicate").cast("int").alias("duplicate"))


@query("src_broker_positions", """SELECT s_nationkey AS account, CASE WHEN s_suppkey % 4 IN (0, 2) THEN 'US' ELSE 'KR' END AS market, s_suppkey::VARCHAR AS ticker, CASE WHEN s_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END AS quantity,
  CASE WHEN s_suppkey % 4 IN (0, 2) THEN 10.5::DOUBLE END AS average_price_usd FROM supplier WHERE s_suppkey % 7 <> 0""")
def src_broker_positions(v):
    k = F.col("s_suppkey")
    h = F.struct(
        F.when(k % 7 == 0, "JP").when(k % 4 == 0, "us").when(k % 4 == 1, "KR").alias("marketCountry"),
        F.when(k % 7 == 0, "JPY").when(k % 4 == 2, "USD").when(k % 4 == 3, "krw").alias("currency"),
        F.concat(F.when((k % 4).isin(1, 3), "A").otherwise(""), k.cast("string")).alias("symbol"),
        F.when(k % 5 != 0, 3.0).alias("quantity"), F.lit(10.5).alias("averagePurchasePrice"),
    )
    p = v.table("supplier").select(F.col("s_nationkey").alias("account"), F.to_json(F.struct(F.array(h).alias("items"))).alias("body"))
    return pl.broker_positions(p).select("account", "market", "ticker", "quantity", "average_price_usd")


def responses(v):
    """Assistant turns with JSON blocks appended by templates keyed on the conversation."""
    return v.table("conversations").where("role = 'assistant'").withColumn("response_id", F.col("conv_id") * 1000 + F.col("turn"))


@query("src_predictions_text", """
a AS (SELECT conv_id * 1000 + turn AS response_id, conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT response_id, 'T' || conv_id AS ticker, 0.7::DOUBLE AS confidence FROM a UNION ALL SELECT response_id, 'U' || conv_id, 0.5::DOUBLE FROM a UNION ALL SELECT response_id, 'V' || turn, NULL FROM a""")
def src_predictions_text(v):
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    fence = lambda *p: F.concat(F.lit("\n```json\n"), *p, F.lit("\n```\n"))
    body = F.concat(
        F.col("text"), fence(F.lit('[{"ticker": "T'), c, F.lit('", "confidence": 0.7}, {"ticker": "U'), c, F.lit('", "confidence": 0.5}]')),
        fence(F.lit('{"broken": ')), fence(F.lit('{"ticker": "V'), t, F.lit('"}')),
    )
    out = pl.predictions_text(responses(v).withColumn("text", body))
    return out.select("response_id", "ticker", "confidence")


@query("src_deep_dive_text", """SELECT conv_id * 1000 + turn AS response_id, CASE WHEN turn % 2 = 0 THEN 3.0::DOUBLE ELSE -1.5::DOUBLE END AS context_score, CASE WHEN turn % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS conviction, 6 AS n_risks
FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0""")
def src_deep_dive_text(v):
    c = F.col("conv_id").cast("string")
    fence = lambda *p: F.concat(F.lit("\n```json\n"), *p, F.lit("\n```\n"))
    risks = F.lit('"risks": ["a","b","c","d","e","f",1], ')
    good = F.concat(F.lit('{"ticker": "t'), c, F.lit('", '), risks, F.when(F.col("turn") % 2 == 0, '"context_score": 9, "conviction": "HIGH"}').otherwise('"context_score": -1.5, "conviction": "MAYBE"}'))
    wrong = F.concat(F.lit('{"ticker": "ZZ", "context_score": 1}'))
    old = F.concat(F.lit('{"ticker": "T'), c, F.lit('", "context_score": 0.5}'))
    body = F.when(F.col("conv_id") % 5 == 0, F.concat(F.col("text"), fence(wrong))).when(
        F.col("conv_id") % 5 == 1, F.concat(F.lit("Result: "), good, F.lit(" end"))
    ).otherwise(F.concat(F.col("text"), fence(old), fence(good), fence(wrong)))
    r = responses(v).withColumns({"text": body, "ticker": F.concat(F.lit("T"), c)})
    return pl.deep_dive_text(r).select("response_id", "context_score", "conviction", F.size("risks").alias("n_risks"))


@query("src_transmission", """SELECT (CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE 'T' || o_custkey END) || ' BUY composite=' || o_orderkey || ': TECH: up; NEWS: ' || o_orderpriority || '; RISK: —' AS content FROM orders""")
def src_transmission(v):
    k = F.col("o_orderkey")
    pk = F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("T"), F.col("o_custkey"))).alias("ticker"), F.lit("BUY").alias("label"), k.alias("composite"),
        F.struct(F.lit("up").alias("tech"), F.col("o_orderpriority").alias("news")).alias("transmission_chain"),
    )
    body = F.to_json(F.struct(k.cast("string").alias("run_id"), F.array(pk).alias("picks")))
    return pl.transmission(v.table("orders").select(body.alias("body"))).select("content")


@query("src_memory_records", """
h AS (SELECT *, ticker || ' (' || market || ') ' || direction || ' @' || printf('%.2f', confidence + 1e-9) || ' ' || timeframe AS head FROM predictions)
SELECT id, 'predictions' AS category, head || ' entry=100.0' AS content, status FROM h UNION ALL SELECT id, 'outcomes', head || CASE WHEN status = 'HIT' THEN ' matched' ELSE ' missed' END || ': return=' || CAST(outcome_return AS VARCHAR), status FROM h WHERE status <> 'OPEN'""", ("predictions",))
def src_memory_records(v):
    # half-up on the printed digit in both engines
    p = v.predictions.withColumn("confidence", F.col("confidence") + 1e-9)
    return pl.memory_records(p).select("id", "category", "content", F.element_at("metadata", F.lit("status")).alias("status"))


@query("src_incremental", """SELECT 'predictions' AS kind, count(*) AS n, CAST(max(created_at) AS VARCHAR) AS watermark FROM predictions WHERE created_at > TIMESTAMP '2000-01-01'
UNION ALL SELECT 'outcomes', count(*), CAST(max(outcome_date) AS VARCHAR) FROM predictions WHERE outcome_date > TIMESTAMP '2000-06-01'""", ("predictions",))
def src_incremental(v):
    def one(kind, col, wm):
        return fl.since(v.predictions, col, wm).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.date_format(F.max(col), "yyyy-MM-dd HH:mm:ss").alias("watermark"))

    return one("predictions", "created_at", "2000-01-01").unionByName(one("outcomes", "outcome_date", "2000-06-01"))


@query("src_schema_evolve", "SELECT id, ticker, CASE WHEN id % 2 = 0 THEN raw_confidence END AS raw_confidence FROM predictions", ("predictions",))
def src_schema_evolve(v):
    p = v.predictions.select("id", "ticker", "raw_confidence")
    return fl.evolve(p.where("id % 2 = 1").drop("raw_confidence"), p.where("id % 2 = 0"))


@query("src_etf_cache", "SELECT p_partkey AS code, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS nav, CAST(p_partkey % 2 = 0 AS INTEGER) AS hedged FROM part")
def src_etf_cache(v):
    k = F.col("p_partkey")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 3 != 0, F.col("p_retailprice").cast("string")).otherwise(""), F.when(k % 2 == 0, "1").otherwise("0"))
    out = fl.etf_cache(v.table("part").select(line.alias("line")), "code BIGINT, nav DOUBLE, hedged INT")
    return out


@query("join_url_fallback", """
s AS (SELECT ticker, doc_id, url, (doc_id % 7) / 7.0::DOUBLE AS score FROM news WHERE doc_id % 3 = 0),
m AS (SELECT ticker, avg(score) AS m FROM s GROUP BY ticker),
u AS (SELECT ticker, url, arg_max(score, doc_id) AS score FROM s WHERE url <> '' GROUP BY ALL)
SELECT n.doc_id, round(coalesce(u.score, n.sentiment, m), 6) AS sentiment, CASE WHEN u.score IS NOT NULL THEN 'url' WHEN n.sentiment IS NULL AND m IS NOT NULL THEN 'ticker_mean' END AS matched_by
FROM news n LEFT JOIN u ON u.ticker = n.ticker AND u.url = n.url LEFT JOIN m ON m.ticker = n.ticker""", ("news",))
def join_url_fallback(v):
    s = v.news.where("doc_id % 3 = 0").select("ticker", "url", ((F.col("doc_id") % 7) / 7.0).alias("score"), F.lit("x").alias("label"), F.col("doc_id").alias("seq"))
    return fl.merge_sentiment(v.news, s).select("doc_id", *r6("sentiment"), "matched_by")


@query("agg_batch_coverage", "SELECT count(*) AS requested, count(*) FILTER (s_suppkey IN (SELECT DISTINCT o_custkey % 200 FROM orders)) AS resolved FROM supplier")
def agg_batch_coverage(v):
    return fl.coverage(v.table("supplier").select(F.col("s_suppkey").alias("ticker")), v.table("orders").select((F.col("o_custkey") % 200).alias("ticker")))


@query("join_lookup", "SELECT p.id, s_name AS name, r_name AS sector FROM predictions p LEFT JOIN supplier ON s_suppkey = ticker LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey", ("predictions",))
def join_lookup(v):
    # no hint: the planner broadcasts the dimension only while its measured size allows
    names = v.table("supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"))
    return v.predictions.join(names, "ticker", "left").join(v.sector_map, "ticker", "left").select("id", "name", "sector")


@query("set_ticker_union", "SELECT DISTINCT ticker::VARCHAR AS ticker FROM predictions UNION SELECT DISTINCT ticker::VARCHAR FROM bars UNION SELECT 'IDX_' || market FROM bars", ("predictions", "bars"))
def set_ticker_union(v):
    t = lambda df, c="ticker": df.select(F.col(c).cast("string").alias("ticker"))
    return t(v.predictions).union(t(v.bars)).union(t(v.benchmark_bars)).distinct()


@query("val_debate", """
x AS (SELECT o_orderkey AS k, o_orderkey % 13 - 6 AS s, o_orderkey % 4 = 0 AS flip, o_orderkey % 5 = 0 AS nobear, o_orderkey % 3 = 0 AS uncited FROM orders)
SELECT k AS debate_id, CAST((CASE WHEN s < -5 OR s > 3 THEN 1 ELSE 0 END) + (CASE WHEN flip THEN CASE WHEN s <= 0 THEN 1 ELSE 0 END ELSE 0 END) + (CASE WHEN nobear THEN 1 ELSE 0 END)
  + (CASE WHEN abs(s) >= 2 AND ((s > 0 AND uncited) OR (s < 0 AND (uncited OR nobear))) THEN 1 ELSE 0 END) AS INTEGER) AS n_issues, CAST(greatest(-5, least(3, s)) AS DOUBLE) AS score FROM x""")
def val_debate(v):
    k = F.col("o_orderkey")
    s = k % 13 - 6
    win = F.when(k % 4 == 0, "bull").when(s > 0, "bull").when(s < 0, "bear").otherwise("neutral")
    point = lambda: F.concat(F.lit('[{"claim": "c", "evidence": "'), F.when(k % 3 == 0, " ").otherwise("e"), F.lit('", "signal_type": "macro"}]'))
    body = F.concat(
        F.lit('{"score": '), s.cast("string"), F.lit(', "winner": "'), win, F.lit('", "bull_points": '), point(),
        F.lit(', "bear_points": '), F.when(k % 5 == 0, "[]").otherwise(point()), F.lit("}"),
    )
    out = pl.debate_issues(v.table("orders").select(k.alias("debate_id"), body.alias("body")))
    return out.select("debate_id", F.size("issues").alias("n_issues"), "score")


# --- table merges behind the sinks ---------------------------------------------------------


@query("sink_upsert_nav", """SELECT market, CAST(date AS VARCHAR) AS date, CASE WHEN day(date) = 1 THEN nav + 2 ELSE nav END AS nav FROM nav""", ("nav",))
def sink_upsert_nav(v):
    n = v.nav.select("market", "date", "nav")
    fix = n.where("day(date) = 1")
    twice = fix.withColumns({"nav": F.col("nav") + 1, "seq": F.lit(1)}).unionByName(fix.withColumns({"nav": F.col("nav") + 2, "seq": F.lit(2)}))
    return sk.upsert(n, twice, ["market", "date"]).select("market", *text("date"), "nav")


@query("sink_rolling_history", """SELECT market, CAST(date AS VARCHAR) AS report_date, nav FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS rn FROM (
  SELECT market, date, CASE WHEN date = DATE '2001-06-29' THEN 0.5::DOUBLE ELSE nav END AS nav FROM nav WHERE date <= DATE '2001-06-29')) WHERE rn <= 12""", ("nav",))
def sink_rolling_history(v):
    n = v.nav.where("date <= DATE '2001-06-29'").select("market", F.col("date").alias("report_date"), "nav")
    new = n.where("report_date = DATE '2001-06-29'").withColumn("nav", F.lit(0.5))
    return sk.rolling_history(n, new, ["market"]).select("market", *text("report_date"), "nav")


@query("sink_nav_daily", """SELECT market, CAST(date AS VARCHAR) AS date, CASE WHEN year(date) >= 2001 THEN nav + 1 ELSE nav END AS nav, CASE WHEN year(date) = 2001 AND month(date) < 6 THEN 'replaced same-day snapshot' END AS note FROM nav""", ("nav",))
def sink_nav_daily(v):
    n = v.nav.select("market", "date", "nav")
    old = n.where("year(date) < 2001 OR month(date) < 6")
    today = n.where("year(date) >= 2001").withColumn("nav", F.col("nav") + 1)
    return sk.nav_daily(old, today, ["market", "date"]).select("market", *text("date"), "nav", "note")


@query("sink_append_log", "SELECT id, status FROM predictions ORDER BY id DESC LIMIT 25", ("predictions",))
def sink_append_log(v):
    """Two appends to one log; the newest rows of both are read back."""
    path, rows = new_path(v, "log"), v.predictions.select("id", "status")
    for part in (0, 1):
        sk.append_log(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path)
    return sk.read_log(v.spark, path, 25)


@query("sink_active_target", """t AS (SELECT * FROM supplier ORDER BY s_suppkey DESC LIMIT 1)
SELECT s_suppkey AS id, 'equity' AS asset, round(s_nationkey / 100.0::DOUBLE, 6) AS weight, 'E' || s_nationkey AS fund FROM t
UNION ALL SELECT s_suppkey, 'bond', round(1 - s_nationkey / 100.0::DOUBLE, 6), NULL FROM t""")
def sink_active_target(v):
    """Targets are appended in two batches; the newest is active, with its JSON maps read."""
    n, path = F.col("s_nationkey") / 100.0, new_path(v, "targets")
    rows = v.table("supplier").select(
        F.col("s_suppkey").alias("id"), F.format_string('{"equity": %s, "bond": %s}', n, 1 - n).alias("allocation"),
        F.format_string('{"equity": "E%d"}', "s_nationkey").alias("etf_map"))
    for part in (0, 1):
        sk.append_log(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path)
    t = sk.active_target(v.spark.read.parquet(path))
    return t.select("id", "etf_map", F.explode("allocation").alias("asset", "weight")).select(
        "id", "asset", *r6("weight"), F.try_element_at("etf_map", "asset").alias("fund"))


@query("sink_snapshot", "SELECT market, CAST(date AS VARCHAR) AS date, CASE WHEN market = 'US' THEN nav + 1 ELSE nav END AS nav FROM nav", ("nav",))
def sink_snapshot(v):
    """Publish both markets, then republish one: the other's files stay."""
    path = new_path(v, "snapshot")
    n = v.nav.select("market", "date", "nav")
    sk.write_snapshot(n, path)
    sk.write_snapshot(n.where("market = 'US'").withColumn("nav", F.col("nav") + 1), path)
    return v.spark.read.parquet(path).select("market", *text("date"), "nav")
