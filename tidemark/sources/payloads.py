"""Semi-structured payload columns to typed rows. Malformed rows are counted, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates as fd
from tidemark.functions import text as ft

# Fund tabs, leverage markers, report link.
TAB_CLASS = {
    1: "domestic_equity", 2: "domestic_sector", 3: "domestic_derivative", 4: "overseas_equity", 5: "commodity",
    6: "bond", 7: "other",
}
DOMESTIC_TABS = (1, 2)
LEVERAGE_TOKENS = ("레버리지", "인버스", "2X", "2x", "곱버스", "3배", "숏")
REPORT_URL = "https://dart.fss.or.kr/dsaf001/main.do?rcpNo="
# Allowed evidence types of a debate point.
SIGNAL_TYPES = ("macro", "sector", "event", "flow", "valuation", "technical", "narrative")

_ETF_ITEM = ("itemcode string, itemname string, nowVal string, nav string, etfTabCode string, marketSum string,"
             " amonut string, threeMonthEarnRate string")


def etf_universe(payloads: DataFrame) -> DataFrame:
    """Classified funds from list payloads; `valid` marks rows that parse (count the rest)."""
    s = f"struct<result:struct<etfItemList:array<struct<{_ETF_ITEM.replace(' string', ':string')}>>>>"
    rows = payloads.select(F.inline(F.from_json("body", s)["result"]["etfItemList"]))
    num = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double")
    raw = F.trim(F.coalesce("itemcode", F.lit("")))
    code = ft.zero_pad_code(raw)
    numeric = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("") | F.col(c).try_cast("double").isNotNull()
    valid = (
        (raw != "") & code.rlike("^[0-9A-Za-z가-힣]{6}$") & num("nowVal").isNotNull() & numeric("nav")
        & numeric("marketSum") & numeric("amonut") & numeric("threeMonthEarnRate") & numeric("etfTabCode")
    )
    nav = F.nullif(num("nav"), F.lit(0.0))
    tab = F.coalesce(F.nullif(num("etfTabCode").cast("int"), F.lit(0)), F.lit(7))
    lev = F.col("itemname").rlike("|".join(LEVERAGE_TOKENS)) | (tab == 3)
    cls = F.lit("other")
    for k, name in TAB_CLASS.items():
        cls = F.when(tab == k, name).otherwise(cls)
    return rows.select(
        valid.alias("valid"), F.when(F.length(raw) < 6, F.lpad(raw, 6, "0")).otherwise(raw).alias("code"),
        F.col("itemname").alias("name"), num("nowVal").alias("price"), nav.alias("nav"),
        F.round((num("nowVal") - nav) / nav * 100, 3).alias("deviation"),
        F.coalesce(num("marketSum").cast("bigint"), F.lit(0)).alias("aum"), F.coalesce(num("amonut").cast("bigint"), F.lit(0)).alias("traded_value"),
        num("threeMonthEarnRate").alias("ret_3m"), cls.alias("asset_class"), F.coalesce(lev, F.lit(False)).alias("leverage"),
        F.when(tab.isin(*DOMESTIC_TABS) & ~F.coalesce(lev, F.lit(False)), "domestic_equity_type").otherwise("other_type").alias("tax_type"),
        F.coalesce(F.rtrim("itemname").endswith("H)"), F.lit(False)).alias("hedged"),
    )


def etf_detail(payloads: DataFrame) -> DataFrame:
    """Fee and base index from code/value pairs; the last pair of a code wins."""
    infos = F.from_json("body", "struct<totalInfos:array<struct<code:string,value:string>>>")["totalInfos"]
    pick = lambda k: F.try_element_at(F.filter(infos, lambda i: i["code"] == k), F.lit(-1))["value"]
    fee = F.regexp_replace(pick("fundPay"), "[%,]", "").try_cast("double")
    base = F.nullif(pick("etfBaseIdx"), F.lit(""))
    notes = F.array_compact(F.array(F.when(fee.isNull(), "fund fee unavailable"), F.when(base.isNull(), "base index unavailable")))
    return payloads.select("code", fee.alias("fund_pay_pct"), base.alias("base_index"), notes.alias("notes"))


def base_index_mismatch(details: DataFrame) -> DataFrame:
    """Comparison groups whose funds track different indexes."""
    g = details.groupBy("group").agg(F.count_distinct("base_index").alias("n_indexes"))
    return g.withColumn("mismatch", F.col("n_indexes") > 1)


def rss(feeds: DataFrame, asof, since_days: int = 2, limit: int | None = None) -> DataFrame:
    """Items of RSS documents: dated, recent, one per link (or headline), newest first."""
    doc = F.from_xml("body", F.lit("channel struct<item array<struct<title string, link string, pubDate string>>>"))
    d = feeds.select("publisher", "feed_id", F.posexplode(doc["channel"]["item"]).alias("pos", "i"))
    link, head = F.trim(F.coalesce("i.link", F.lit(""))), F.trim(F.coalesce("i.title", F.lit("")))
    d = d.select("publisher", "feed_id", "pos", head.alias("headline"), link.alias("url"), fd.rfc822(F.col("i.pubDate")).alias("ts"))
    cut = F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {since_days} DAYS")
    d = d.where((F.col("headline") != "") & (F.col("ts") >= cut))
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.col("headline"))
    first = d.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct("publisher", "headline", "url", "ts"), F.struct("feed_id", "pos")).alias("r"))
    out = first.select("r.*")
    return out if limit is None else out.orderBy(F.desc("ts"), "url", "headline").limit(limit)


def article_list(payloads: DataFrame) -> DataFrame:
    """Article-list payloads with compact UTC dates; blank titles dropped, a bad date stays NULL."""
    arts = F.from_json("body", "struct<articles:array<struct<title:string,url:string,seendate:string,domain:string>>>")["articles"]
    d = payloads.select(F.inline(arts))
    return d.where(F.trim(F.coalesce("title", F.lit(""))) != "").select(
        F.trim("title").alias("headline"), "url", "domain", fd.compact_utc(F.col("seendate")).alias("ts")
    )


def news_search(payloads: DataFrame, asof, since_days: int) -> DataFrame:
    """Search results naming the company in title or summary; an unparseable date is kept."""
    items = F.from_json("body", "struct<items:array<struct<title:string,description:string,pubDate:string,originallink:string,link:string>>>")["items"]
    d = payloads.select("company", F.inline(items))
    head, summ = ft.clean_html(F.col("title")), ft.clean_html(F.coalesce("description", F.lit("")))
    url = F.coalesce(F.nullif("originallink", F.lit("")), "link", F.lit(""))
    d = d.select("company", head.alias("headline"), summ.alias("summary"), fd.rfc822(F.col("pubDate")).alias("ts"), url.alias("url"))
    named = F.contains("headline", "company") | F.contains("summary", "company")
    cut = F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {since_days} DAYS")
    d = d.where((F.col("headline") != "") & named & (F.col("ts").isNull() | (F.col("ts") >= cut)))
    return d.withColumn("source", F.coalesce(F.nullif(ft.domain(F.col("url")), F.lit("")), F.lit("search")))


def listing_date(raw: Column, asof: Column) -> Column:
    """'2026.05.10 13:42', '2026-05-10' or '05.10 13:42' (year of `asof`) to a date."""
    t = F.trim(raw)
    full = F.regexp_replace(F.regexp_extract(t, r"^(\d{4}[.\-]\d{2}[.\-]\d{2})", 1), r"\.", "-")
    short = F.regexp_replace(F.regexp_extract(t, r"^(\d{2}[.\-]\d{2})\s", 1), r"\.", "-")
    return F.coalesce(
        F.nullif(full, F.lit("")).try_cast("date"),
        F.when(short != "", F.concat(F.year(asof).cast("string"), F.lit("-"), short)).try_cast("date"),
    )


def news_listing(pages: DataFrame, asof, base_url: str) -> DataFrame:
    """Rows of a listing table in HTML: linked title, source and date cells."""
    rows = F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    d = pages.select("page_id", F.explode(rows).alias("r"))
    cell = lambda cls: F.regexp_extract("r", rf'(?s)<td[^>]*class="{cls}"[^>]*>(.*?)</td>', 1)
    href = F.regexp_extract(cell("title"), r'<a[^>]*href="([^"]*)"', 1)
    title, date = ft.clean_html(cell("title")), ft.clean_html(cell("date"))
    d = d.where((F.regexp_extract("r", r'class="title"[^>]*>\s*(<a)', 1) != "") & (cell("date") != ""))
    return d.select(
        "page_id", title.alias("headline"), ft.clean_html(cell("info")).alias("source"),
        F.when(href.startswith("http") | (href == ""), href).otherwise(F.concat(F.lit(base_url), href)).alias("url"),
        listing_date(date, F.lit(asof).cast("date")).alias("date"),
    )


def epoch_news(payloads: DataFrame, window_end, limit: int) -> DataFrame:
    """News with epoch dates, newest first per ticker; a missing epoch takes the window's end."""
    items = F.from_json("body", "array<struct<headline:string,source:string,datetime:bigint,url:string>>")
    d = payloads.select("ticker", F.posexplode(items).alias("pos", "i")).select("ticker", "pos", "i.*")
    date = F.coalesce(F.to_date(F.timestamp_seconds("datetime")), F.lit(window_end).cast("date"))
    d = d.withColumn("date", date)
    w = Window.partitionBy("ticker").orderBy(F.desc("date"), "pos")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).select(
        "ticker", F.trim("headline").alias("headline"), F.coalesce("source", F.lit("feed")).alias("source"), "date", "url"
    )


def disclosures(payloads: DataFrame) -> DataFrame:
    """Filing lists; status 013 is an empty list, any other non-zero status is an error row apart."""
    p = F.from_json("body", "struct<status:string,list:array<struct<rcept_no:string,report_nm:string,flr_nm:string,rcept_dt:string>>>")
    d = payloads.select("ticker", p["status"].alias("status"), p["list"].alias("list"))
    ok = d.where("status IN ('000', '013')").select("ticker", F.inline("list"))
    url = F.when(F.coalesce("rcept_no", F.lit("")) != "", F.concat(F.lit(REPORT_URL), "rcept_no")).otherwise("")
    return ok.select("ticker", "rcept_no", "report_nm", "flr_nm", F.to_date("rcept_dt", "yyyyMMdd").alias("rcept_date"), url.alias("url"))


def corp_codes(docs: DataFrame) -> DataFrame:
    """Corporate-code mapping from XML; only listed entities (a stock code) are kept."""
    rows = F.from_xml("body", F.lit("list array<struct<corp_code string, corp_name string, stock_code string, modify_date string>>"))["list"]
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    return docs.select(F.inline(rows)).select(t("corp_code"), t("corp_name"), t("stock_code"), t("modify_date")).where("stock_code <> ''")


def corp_code_of(tickers: DataFrame, codes: DataFrame) -> DataFrame:
    """`tickers` (column ticker) with the corporate code of the listed entity, null where there is none.

    Codes are kept per stock code by a map-side minimum, so a mapping with repeated rows adds none.
    """
    first = codes.groupBy(F.trim("stock_code").alias("ticker")).agg(F.min("corp_code").alias("corp_code"))
    return tickers.join(first, "ticker", "left")


def broker_positions(payloads: DataFrame) -> DataFrame:
    """Holdings of all accounts: market from country, else currency, else dropped; null numbers are 0."""
    item = "marketCountry:string,currency:string,symbol:string,name:string,quantity:double,averagePurchasePrice:double,lastPrice:double"
    d = payloads.select("account", F.inline(F.from_json("body", f"struct<items:array<struct<{item}>>>")["items"]))
    country, cur = F.upper(F.coalesce("marketCountry", F.lit(""))), F.upper(F.coalesce("currency", F.lit("")))
    market = F.when(country.isin("KR", "US"), country).when(cur == "KRW", "KR").when(cur == "USD", "US")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    d = d.withColumn("market", market).where("market IS NOT NULL")
    strip = F.when((F.col("market") == "KR") & F.col("symbol").startswith("A"), F.expr("substring(symbol, 2)")).otherwise(F.col("symbol"))
    us = F.col("market") == "US"
    return d.select(
        "account", strip.alias("ticker"), F.coalesce("name", "symbol").alias("name"), "market", z("quantity").alias("quantity"),
        z("averagePurchasePrice").alias("average_price"), z("lastPrice").alias("current_price"),
        F.when(us, z("averagePurchasePrice")).alias("average_price_usd"), F.when(us, z("lastPrice")).alias("current_price_usd"),
    )


_FENCE = r"(?s)```json\s*(.*?)```"


def predictions_text(responses: DataFrame) -> DataFrame:
    """Prediction objects in the fenced JSON blocks of responses; a bad block is skipped."""
    blocks = F.regexp_extract_all("text", F.lit(_FENCE), F.lit(1))
    d = responses.select("response_id", F.posexplode(blocks).alias("block", "b"))
    v = F.try_parse_json(F.trim("b"))
    many = F.try_variant_get(v, "$", "array<variant>")
    one = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    d = d.select("response_id", "block", F.posexplode(F.coalesce(many, one)).alias("pos", "p"))
    g = lambda k, t="string": F.try_variant_get("p", f"$.{k}", t).alias(k)
    return d.select("response_id", "block", "pos", g("ticker"), g("market"), g("direction"), g("confidence", "double"), g("timeframe"), g("entry_price", "double"))


def deep_dive_text(responses: DataFrame, score_range=(-5.0, 3.0), max_items: int | None = None, max_text: int | None = None) -> DataFrame:
    """The last valid block of each dive about its own ticker, sanitised; no row without one.

    `max_items` and `max_text` (characters) limit lists and texts where a caller wants that.
    """
    cut = lambda c: c if max_text is None else F.substring(c, 1, max_text)
    fenced = F.regexp_extract_all("text", F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1))
    outer = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    cands = F.when(F.size(fenced) > 0, fenced).when(outer != "", F.array(outer)).otherwise(F.array().cast("array<string>"))
    vs = F.transform(cands, lambda c: F.try_parse_json(c))

    def ok(v):
        score = F.try_variant_get(v, "$.context_score", "variant")
        kind = F.regexp_extract(F.coalesce(F.schema_of_variant(score), F.lit("")), "^([A-Z]+)", 1)
        return (F.upper(F.try_variant_get(v, "$.ticker", "string")) == F.upper("ticker")) & kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")

    last = F.try_element_at(F.filter(vs, lambda v: F.coalesce(ok(v), F.lit(False))), F.lit(-1))
    d = responses.withColumn("_v", last).where("_v IS NOT NULL")
    s = F.try_variant_get("_v", "$.context_score", "double")
    conv = F.try_variant_get("_v", "$.conviction", "string")

    def strings(k):
        items = F.filter(F.try_variant_get("_v", f"$.{k}", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        texts = F.transform(items, lambda x: cut(F.try_variant_get(x, "$", "string")))
        texts = F.coalesce(texts, F.array().cast("array<string>"))
        return (texts if max_items is None else F.slice(texts, 1, max_items)).alias(k)

    return d.select(
        "response_id", "ticker", F.greatest(F.lit(score_range[0]), F.least(F.lit(score_range[1]), s)).alias("context_score"),
        F.when(conv.isin("HIGH", "MEDIUM", "LOW"), conv).otherwise("LOW").alias("conviction"), strings("risks"), strings("catalysts"),
        cut(F.coalesce(F.try_variant_get("_v", "$.summary", "string"), F.lit(""))).alias("summary"),
    )


def transmission(sidecars: DataFrame) -> DataFrame:
    """One memory row per pick with its chain narrative; missing parts get placeholders."""
    pick = "ticker:string,market:string,label:string,composite:string,transmission_chain:struct<tech:string,news:string,risk:string>"
    p = F.from_json("body", f"struct<run_id:string,generated_at:string,picks:array<struct<{pick}>>>")
    d = sidecars.select(p["run_id"].alias("run_id"), p["generated_at"].alias("generated_at"), F.inline(p["picks"]))
    q = lambda c: F.coalesce(c, F.lit("?"))
    dash = lambda c: F.coalesce(f"transmission_chain.{c}", F.lit("—"))
    content = F.concat(
        q("ticker"), F.lit(" "), q("label"), F.lit(" composite="), q("composite"), F.lit(": TECH: "), dash("tech"),
        F.lit("; NEWS: "), dash("news"), F.lit("; RISK: "), dash("risk"),
    )
    meta = F.create_map(*[x for k in ("ticker", "market", "label", "composite", "run_id", "generated_at") for x in (F.lit(k), F.col(k))])
    return d.select(F.lit("transmission_chains").alias("category"), content.alias("content"), meta.alias("metadata"))


def memory_records(preds: DataFrame) -> DataFrame:
    """Prediction and outcome narratives with a metadata map; HIT is matched, anything else missed."""
    head = F.format_string("%s (%s) %s @%.2f %s", F.col("ticker").cast("string"), F.col("market"), F.col("direction"), F.col("confidence"), F.col("timeframe"))
    meta = F.create_map(*[x for k in ("id", "ticker", "market", "status") for x in (F.lit(k), F.col(k).cast("string"))])
    p = preds.select("id", F.lit("predictions").alias("category"), F.concat(head, F.lit(" entry="), F.col("entry_price").cast("string")).alias("content"), meta.alias("metadata"))
    o = preds.where("status IN ('HIT', 'MISS', 'EXPIRED')").select(
        "id", F.lit("outcomes").alias("category"),
        F.concat(head, F.lit(" "), F.when(F.col("status") == "HIT", "matched").otherwise("missed"), F.lit(": return="), F.col("outcome_return").cast("string")).alias("content"),
        meta.alias("metadata"),
    )
    return p.unionByName(o)


def debate_issues(debates: DataFrame, low: float = -5.0, high: float = 3.0, strong: float = 2.0) -> DataFrame:
    """Rigor violations and clamped score of structured debates (a data-quality job)."""
    v = F.try_parse_json("body")
    sv = F.try_variant_get(v, "$.score", "variant")
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant(sv), F.lit("")), "^([A-Z]+)", 1)
    score = F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(sv, "$", "double"))
    winner = F.try_variant_get(v, "$.winner", "string")
    want = F.when(score > 0, "bull").when(score < 0, "bear").otherwise("neutral")
    none = F.array().cast("array<variant>")
    side = lambda s: F.coalesce(F.try_variant_get(v, f"$.{s}_points", "array<variant>"), none)
    text_of = lambda p, k: F.when(F.schema_of_variant(F.try_variant_get(p, f"$.{k}", "variant")) == "STRING", F.trim(F.try_variant_get(p, f"$.{k}", "string")))
    claim = F.exists(side("bear"), lambda p: F.coalesce(text_of(p, "claim") != "", F.lit(False)))
    cited = lambda p: F.coalesce((text_of(p, "evidence") != "") & text_of(p, "signal_type").isin(*SIGNAL_TYPES), F.lit(False))
    backed = F.when(score > 0, F.exists(side("bull"), cited)).when(score < 0, F.exists(side("bear"), cited)).otherwise(True)
    is_list = lambda s: F.try_variant_get(v, f"$.{s}_points", "array<variant>").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(score.isNull(), "score must be a number").when((score < low) | (score > high), "score out of range"),
            F.when(~F.coalesce(winner.isin("bull", "bear", "neutral"), F.lit(False)), "bad winner")
            .when(score.isNotNull() & (winner != want), "winner contradicts score"),
            F.when(~is_list("bull"), "bull_points must be a list"), F.when(~is_list("bear"), "bear_points must be a list"),
            F.when(~claim, "no real bear claim"),
            F.when((F.abs(score) >= strong) & ~backed, "strong score lacks cited evidence"),
        )
    )
    return debates.select("debate_id", issues.alias("issues"), F.greatest(F.lit(low), F.least(F.lit(high), score)).alias("_c"), score.isNull().alias("_n")).select(
        "debate_id", "issues", F.when(~F.col("_n"), F.col("_c")).alias("score")
    )
