"""File-shaped inputs: bars, universes, sector maps, transaction files, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


US_TICKER = r"^[A-Z]{1,5}(?:[.\-][A-Z])?$"


def clean_bars(raw: DataFrame, last_n: int | None = None, asof=None) -> DataFrame:
    """Drop rows without a close, read a missing volume as 0, keep each ticker's last n bars."""
    b = raw.where("close IS NOT NULL").withColumn("volume", F.coalesce("volume", F.lit(0)))
    if asof is not None:
        b = b.where(F.col("date") <= F.lit(asof).cast("date"))
    if last_n is None:
        return b
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return b.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last_n).drop("_r")


def read_bars(spark: SparkSession, path: str, market: str | None = None, **kw) -> DataFrame:
    """Bars stored as parquet partitioned by market; the market filter prunes partitions."""
    raw = spark.read.parquet(path)
    return clean_bars(raw if market is None else raw.where(F.col("market") == market), **kw)


def universe(rows: DataFrame, market: str) -> DataFrame:
    """Valid tickers of a ticker,name file; bad rows are dropped."""
    t = F.trim("ticker")
    if market == "KR":
        code = F.when(t.rlike("^[0-9]{1,6}$"), F.lpad(t, 6, "0"))
    else:
        code = F.when(F.upper(t).rlike(US_TICKER), F.upper(t))
    return rows.withColumn("ticker", code).where("ticker IS NOT NULL")


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV files in a folder, one per partition."""
    df.write.option("header", True).csv(path)
    return path


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, strict: bool = False, null: str = "", corrupt: str | None = None,
) -> DataFrame:
    """Header CSV; all strings unless a schema is given.

    A row is corrupt if a value does not fit its type or the row has another number of values than the header.
    `strict` fails on the first; else `corrupt` names a column that holds the whole line of such a row and is null in
    others. Their values that do fit are kept, those that do not are null.
    """
    r = spark.read.option("header", True).option("nullValue", null)
    if corrupt:
        if not schema:
            raise ValueError("corrupt rows are known by a schema only")
        schema = f"{schema}, `{corrupt}` string"
        r = r.option("columnNameOfCorruptRecord", corrupt)
    if schema:
        r = r.schema(schema)
    return r.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)


def sector_map(rows: DataFrame) -> DataFrame:
    """One row per (sector, constituent) from a ';'-separated list; rows lacking sector or proxy are skipped."""
    ok = rows.where((F.trim("sector") != "") & (F.trim("proxy_etf") != ""))
    parts = F.filter(F.transform(F.split("constituents", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return ok.select(F.trim("sector").alias("sector"), F.trim("proxy_etf").alias("proxy_etf"), F.explode(parts).alias("ticker"))


def tx_errors(market: str) -> Column:
    q, p = F.col("quantity").try_cast("double"), F.col("price").try_cast("double")
    pattern = "^[0-9]{6}$" if market == "KR" else "^[A-Za-z]{1,5}$"
    return F.array_compact(
        F.array(
            F.when(~F.upper(F.coalesce("side", F.lit(""))).isin("BUY", "SELL"), "bad side"),
            F.when(q.isNull(), "quantity not a number").when(q <= 0, "quantity not positive"),
            F.when(p.isNull(), "price not a number").when(p <= 0, "price not positive"),
            F.when(~F.trim(F.coalesce("ticker", F.lit(""))).rlike(pattern), "bad ticker"),
        )
    )


def parse_transactions(lines: DataFrame, market: str) -> DataFrame:
    """All-string rows to typed ones with `errors` and `duplicate` columns.

    A duplicate repeats (date, ticker, side, quantity, price) as text; the first line is kept. The
    first line per key is an aggregate, so a key repeated across the file is not one task.
    """
    d = lines.withColumn("errors", tx_errors(market))
    key = F.concat_ws("|", F.trim("date"), F.trim("ticker"), F.upper(F.trim("side")), F.trim("quantity"), F.trim("price"))
    d = d.withColumn("_k", F.when(F.size("errors") == 0, key))
    first = d.where("_k IS NOT NULL").groupBy("_k").agg(F.min("line").alias("_first"))
    d = d.join(first, "_k", "left")
    return d.select(
        "line", F.trim("date").alias("date"), F.trim("ticker").alias("ticker"), F.upper(F.trim("side")).alias("side"),
        F.col("quantity").try_cast("double").alias("quantity"), F.col("price").try_cast("double").alias("price"),
        "errors", F.coalesce(F.col("line") != F.col("_first"), F.lit(False)).alias("duplicate"),
    )


def fundamentals(rows: DataFrame) -> DataFrame:
    """Resolve the column-name variants present; 0 means missing."""
    for per, pbr, div in (("PER", "PBR", "DIV"), ("PER", "PBR", "배당수익률"), ("per", "pbr", "div")):
        if {per, pbr, div} <= set(rows.columns):
            nz = lambda c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(0.0))
            return rows.select("ticker", nz(per).alias("pe_ratio"), nz(pbr).alias("pb_ratio"), nz(div).alias("dividend_yield"))
    raise ValueError("no known fundamentals columns")


def etf_cache(lines: DataFrame, schema: str) -> DataFrame:
    """Typed rows from cached CSV text; '' is NULL, '1'/'0' are booleans; any corrupt row fails the read."""
    parsed = lines.select(F.from_csv("line", schema, {"mode": "FAILFAST", "nullValue": ""}).alias("r")).select("r.*")
    return parsed


def first_source(options: DataFrame, key: list[str]) -> DataFrame:
    """Whole-source fallback: per key keep all rows of the best-priority source that has any.

    `options` carries `prio` and `source`. The winning priority per key is an aggregate joined back.
    """
    best = options.groupBy(*key).agg(F.min("prio").alias("_p"))
    return options.join(best, key).where(F.col("prio") == F.col("_p")).drop("_p")


def freshness(rows: DataFrame, asof: Column, ttl_seconds: int) -> DataFrame:
    """live, cache, stale-cache or empty per fetch; stale rows are context, never a risk signal."""
    age = F.unix_timestamp(asof) - F.unix_timestamp("fetched_at")
    state = (
        F.when(F.col("fetched_at").isNull(), "empty").when(age <= 0, "live").when(age <= ttl_seconds, "cache").otherwise("stale-cache")
    )
    return rows.withColumns({"freshness": state, "usable_as_risk": state.isin("live", "cache")})


def evolve(old: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of both schemas: shared columns kept, columns only in one side NULL on the other."""
    return current.unionByName(old, allowMissingColumns=True)


def merge_sentiment(news: DataFrame, scores: DataFrame) -> DataFrame:
    """Sentiment by url; an unmatched item without a score takes its ticker's mean, label NULL."""
    by_url = scores.where("url <> ''").groupBy("ticker", "url").agg(F.max_by(F.struct("score", "label"), "seq").alias("_s"))
    mean = scores.groupBy("ticker").agg(F.avg("score").alias("_m"))
    j = news.join(by_url, ["ticker", "url"], "left").join(mean, "ticker", "left")
    own = F.col("_s").isNotNull()
    return j.withColumns(
        {
            "sentiment": F.when(own, F.col("_s.score")).otherwise(F.coalesce("sentiment", "_m")),
            "label": F.when(own, F.col("_s.label")),
            "matched_by": F.when(own, "url").when(F.col("sentiment").isNull() & F.col("_m").isNotNull(), "ticker_mean"),
        }
    ).drop("_s", "_m")


def since(rows: DataFrame, column: str, watermark) -> DataFrame:
    """Rows newer than a stored high-water mark (all rows when there is none)."""
    return rows if watermark is None else rows.where(F.col(column) > F.lit(watermark).cast("timestamp"))


def coverage(requested: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requested against resolved tickers of a batch; a missing ticker does not fail it."""
    have = resolved.select("ticker").distinct().withColumn("_h", F.lit(True))
    j = requested.join(have, "ticker", "left")
    return j.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("_h")).alias("resolved"))


