"""Domain views over the TPC-H-like test tables, in Spark and as SQL text for the oracle.

The two halves of each view state the same binding. All price arithmetic is in integer cents and
divided once, so both engines produce identical doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases appended to derived headlines by doc_id % 16, so that every matcher meets real hits.
PHRASES = (
    "", "earnings beats estimates", "guidance cut", "", "merger probe widens", "fda approval", "유상증자 급락",
    "missile strike", "", "fed holds emergency meeting", "oil prices surge", "new tariffs", "market crash",
    "q3 outlook, price target", "", "ceo resign",
)
HEADLINES = 10_000_000  # numbers per document
TASK_LINES = 300_000  # of lineitem to a task that sorts series
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def line_price() -> Column:
    days = F.datediff(F.col("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    return (10000 + cents("l_extendedprice") % 1000 + days * (F.col("l_suppkey") % 7 - 2)) / F.lit(100.0)


class Views:
    """Lazily built DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        # the bindings treat the tables' zone-less timestamps as UTC instants
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return (
            self.table("lineitem")
            .withColumn("date", F.to_date("l_shipdate"))
            .withColumn("px", line_price())
        )

    @cached_property
    def bars(self) -> DataFrame:
        order = F.struct(*LINE_ORDER)
        # dealt by ticker, in tasks whose number follows the rows: bars and every series over them need this one exchange
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.n_lines // TASK_LINES)
        return (
            self.lines.repartition(parts, "l_suppkey").groupBy(F.col("l_suppkey").alias("ticker"), "date")
            .agg(
                F.min_by("px", order).alias("open"),
                F.max("px").alias("high"),
                F.min("px").alias("low"),
                F.max_by("px", order).alias("close"),
                F.sum("l_quantity").cast("bigint").alias("volume"),
            )
            .withColumn("market", F.when(F.col("ticker") % 2 == 0, "US").otherwise("KR"))
        )

    @cached_property
    def n_lines(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def sector_map(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))
        )

    @cached_property
    def benchmark_bars(self) -> DataFrame:
        """One index proxy per market: mean close in whole cents, total volume."""
        return _index_bars(self.bars, ["market"], F.concat(F.lit("IDX_"), F.col("market")))

    @cached_property
    def sector_bars(self) -> DataFrame:
        """One proxy fund per (market, sector)."""
        b = self.bars.join(self.sector_map, "ticker")
        return _index_bars(b, ["market", "sector"], F.concat_ws("_", F.lit("ETF"), "market", "sector"))

    @cached_property
    def n_tickers(self) -> Column:
        return self.table("supplier").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def predictions(self) -> DataFrame:
        k = F.col("o_orderkey")
        raw = (500 + (k * 7919) % 500) / F.lit(1000.0)
        conf = (450 + (k * 7919) % 500) / F.lit(1000.0)
        status = (
            F.when(F.col("o_orderstatus") == "O", "OPEN")
            .when(k % 11 == 0, "EXPIRED")
            .when(F.col("o_orderstatus") == "F", "HIT")
            .otherwise("MISS")
        )
        names = ["technical", "news", "momentum", "cycle", "valuation"]
        sig = F.filter(
            F.array(*[F.when(k.bitwiseAND(1 << i) > 0, F.lit(n)) for i, n in enumerate(names)]),
            lambda x: x.isNotNull(),
        )
        tf = F.element_at(F.array(*[F.lit(x) for x in ["1W", "2W", "1M", "3M", "6M", "1Y"]]), (k % 6 + 1).cast("int"))
        src = F.element_at(F.array(*[F.lit(x) for x in ["LIVE", "INTERACTIVE", "BACKTEST"]]), (k % 3 + 1).cast("int"))
        level = F.element_at(F.array(*[F.lit(x) for x in ["NONE", "ELEVATED", "EXTREME"]]), (k % 7 % 3 + 1).cast("int"))
        comp = F.concat(
            F.lit('{"algo": '), (k % 9 - 2).cast("string"),
            F.lit(', "news": '), (k % 3 - 1).cast("string"),
            F.lit(', "overextension": "'), level,
            F.lit('", "regime_ok": '), F.when(k % 2 == 0, "true").otherwise("false"),
            F.lit(', "news_signal": {"event_tags": ["'), F.col("o_orderpriority"), F.lit('", " '),
            F.col("o_orderpriority"), F.lit(' ", "mod'), (k % 4).cast("string"),
            F.lit('"], "has_positive_catalyst": '), F.when(k % 5 == 0, "true").otherwise("false"),
            F.lit(', "has_negative_catalyst": '), F.when(k % 7 == 0, '"true"').otherwise("true"),
            F.lit("}}"),
        )
        created = F.to_date("o_orderdate")
        return (
            self.table("orders")
            .select(
                k.alias("id"),
                (F.col("o_custkey") % self.n_tickers).alias("ticker"),
                created.alias("created_date"),
                created.cast("timestamp").alias("created_at"),
                F.when(k % 5 <= 2, "BULL").when(k % 5 == 3, "BEAR").otherwise("NEUTRAL").alias("direction"),
                tf.alias("timeframe"),
                src.alias("source"),
                status.alias("status"),
                raw.alias("raw_confidence"),
                conf.alias("confidence"),
                F.lit(100.0).alias("entry_price"),
                F.when((k % 5 == 4) | (k % 4 == 0), None).when(k % 4 == 1, 0.0)
                .when(k % 5 == 3, 95.0 - k % 20).otherwise(105.0 + k % 20).alias("target_price"),
                F.when((k % 5 == 4) | (k % 3 == 0), None)
                .when(k % 5 == 3, 110.0 + k % 15).otherwise(80.0 + k % 15).alias("stop_price"),
                F.when(status != "OPEN", F.date_add(created, (1 + k % 45).cast("int")))
                .cast("timestamp").alias("outcome_date"),
                F.when(status != "OPEN", (cents("o_totalprice") % 4000 - 2000) / F.lit(100.0)).alias("outcome_return"),
                sig.alias("signals"),
                F.when(k % 13 != 0, comp).alias("components"),
                F.col("o_orderpriority").alias("priority"),
            )
            .withColumn("market", F.when(F.col("ticker") % 2 == 0, "US").otherwise("KR"))
        )

    @cached_property
    def transactions(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return self.lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("o_custkey") % 50).alias("portfolio"),
            F.col("l_suppkey").alias("ticker"),
            "date",
            *LINE_ORDER[:3],
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").alias("quantity"),
            F.col("px").alias("price"),
        )

    @cached_property
    def news(self) -> DataFrame:
        """One headline per line of every whole text; `doc_id` numbers headlines: document * 10^7 + line."""
        d = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
        phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("doc_id") + F.col("line")) % 16 + 1).cast("int"))
        lab = self.table("labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment"))
        return d.join(lab, "doc_id", "left").select(
            (F.col("doc_id") * HEADLINES + F.col("line")).alias("doc_id"),
            (F.col("doc_id") % self.n_tickers).alias("ticker"),
            F.trim(F.concat_ws(" ", F.trim(F.regexp_replace("raw", r"\s+", " ")), phrase)).alias("headline"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
            F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("url"),
            "sentiment",
        )

    @cached_property
    def calendar_events(self) -> DataFrame:
        k = F.col("o_orderkey")
        pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
        return (
            self.table("orders")
            .select(
                k.alias("event_id"),
                (F.col("o_custkey") % self.n_tickers).alias("ticker"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "macro").otherwise("earnings").alias("kind"),
                pick(["US CPI", "Fed Interest Rate Decision", "Retail Sales", "Nonfarm Payrolls"]).alias("name"),
                F.when(k % 3 == 0, "UK").otherwise("US").alias("country"),
                F.when(k % 7 == 0, "Low").otherwise("High").alias("impact"),
                pick(["bmo", "After-Market", "", "dmh"]).alias("time"),
                F.to_date("o_orderdate").alias("event_date"),
            )
            .withColumn("market", F.when(F.col("ticker") % 2 == 0, "US").otherwise("KR"))
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("ticker"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("price"),
            F.col("event_type").alias("feed"),
        )

    @cached_property
    def etf(self) -> DataFrame:
        part = self.table("part")
        li = self.lines.groupBy("l_partkey").agg(
            F.sum("l_quantity").cast("bigint").alias("aum"),
            F.sum(cents("l_extendedprice")).alias("traded_cents"),
        )
        k = F.col("p_partkey")
        return part.join(li, k == F.col("l_partkey"), "left").select(
            k.alias("code"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("group"),
            (F.col("p_size") / F.lit(100.0)).alias("fee"),
            F.col("aum"),
            (F.col("traded_cents") / F.lit(100.0)).alias("traded_value"),
            F.when(k % 10 != 0, ((k * 37) % 200 - 100) / F.lit(100.0)).alias("deviation"),
            F.concat(F.lit("IDX"), (k % 3).cast("string")).alias("base_index"),
            (k % 8 == 0).alias("leverage"),
        )

    @cached_property
    def nav(self) -> DataFrame:
        """Per market and day, in whole cents: nav from closes, benchmark from opens."""
        c = F.sum(F.round(F.col("close") * 100).cast("bigint"))
        o = F.sum(F.round(F.col("open") * 100).cast("bigint"))
        n = F.count(F.lit(1))
        return self.bars.groupBy("market", "date").agg(
            (F.floor(1000 * c / n) / F.lit(100.0)).alias("nav"),
            (F.floor(1000 * o / n) / F.lit(100.0)).alias("benchmark_nav"),
        )


def _index_bars(bars: DataFrame, keys: list[str], ticker: Column) -> DataFrame:
    c = F.sum(F.round(F.col("close") * 100).cast("bigint"))
    return (
        bars.groupBy(*keys, "date")
        .agg((F.floor(c / F.count(F.lit(1))) / F.lit(100.0)).alias("close"), F.sum("volume").alias("volume"))
        .withColumn("ticker", ticker)
    )


_SIG = ", ".join(
    f"CASE WHEN (o_orderkey & {1 << i}) > 0 THEN '{n}' END"
    for i, n in enumerate(["technical", "news", "momentum", "cycle", "valuation"])
)

# name -> (views it needs, SQL body)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
        SELECT *, CAST(l_shipdate AS DATE) AS date,
          (10000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 1000
            + date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * (l_suppkey % 7 - 2)) / 100.0::DOUBLE AS px
        FROM lineitem"""),
    "bars": (("lines",), """
        SELECT l_suppkey AS ticker, date,
          arg_min(px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open,
          max(px) AS high, min(px) AS low,
          arg_max(px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close,
          CAST(sum(l_quantity) AS BIGINT) AS volume,
          CASE WHEN l_suppkey % 2 = 0 THEN 'US' ELSE 'KR' END AS market
        FROM lines GROUP BY l_suppkey, date"""),
    "sector_map": ((), """
        SELECT s_suppkey AS ticker, r_name AS sector FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "benchmark_bars": (("bars",), """
        SELECT market, date, floor(sum(CAST(round(close*100) AS BIGINT)) / count(*)) / 100.0 AS close,
          CAST(sum(volume) AS BIGINT) AS volume, 'IDX_' || market AS ticker
        FROM bars GROUP BY market, date"""),
    "sector_bars": (("bars", "sector_map"), """
        SELECT market, sector, date, floor(sum(CAST(round(close*100) AS BIGINT)) / count(*)) / 100.0 AS close,
          CAST(sum(volume) AS BIGINT) AS volume, 'ETF_' || market || '_' || sector AS ticker
        FROM bars JOIN sector_map USING (ticker) GROUP BY market, sector, date"""),
    "predictions": ((), f"""
        SELECT p.*, CASE WHEN ticker % 2 = 0 THEN 'US' ELSE 'KR' END AS market FROM (
        SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS ticker,
          CAST(o_orderdate AS DATE) AS created_date, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS created_at,
          CASE WHEN o_orderkey % 5 <= 2 THEN 'BULL' WHEN o_orderkey % 5 = 3 THEN 'BEAR' ELSE 'NEUTRAL' END AS direction,
          (['1W','2W','1M','3M','6M','1Y'])[o_orderkey % 6 + 1] AS timeframe,
          (['LIVE','INTERACTIVE','BACKTEST'])[o_orderkey % 3 + 1] AS source, s AS status,
          (500 + (o_orderkey * 7919) % 500) / 1000.0::DOUBLE AS raw_confidence,
          (450 + (o_orderkey * 7919) % 500) / 1000.0::DOUBLE AS confidence,
          100.0::DOUBLE AS entry_price,
          CAST(CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0
            WHEN o_orderkey % 5 = 3 THEN 95 - o_orderkey % 20 ELSE 105 + o_orderkey % 20 END AS DOUBLE) AS target_price,
          CAST(CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 3 = 0 THEN NULL
            WHEN o_orderkey % 5 = 3 THEN 110 + o_orderkey % 15 ELSE 80 + o_orderkey % 15 END AS DOUBLE) AS stop_price,
          CASE WHEN s <> 'OPEN' THEN CAST(CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 45 AS INTEGER) AS TIMESTAMP) END AS outcome_date,
          CASE WHEN s <> 'OPEN' THEN (CAST(round(o_totalprice*100) AS BIGINT) % 4000 - 2000) / 100.0::DOUBLE END AS outcome_return,
          list_filter([{_SIG}], lambda x: x IS NOT NULL) AS signals,
          CASE WHEN o_orderkey % 13 <> 0 THEN
          '{{"algo": ' || (o_orderkey % 9 - 2) || ', "news": ' || (o_orderkey % 3 - 1) || ', "overextension": "'
            || (['NONE','ELEVATED','EXTREME'])[o_orderkey % 7 % 3 + 1] || '", "regime_ok": '
            || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END
            || ', "news_signal": {{"event_tags": ["' || o_orderpriority || '", " ' || o_orderpriority || ' ", "mod'
            || (o_orderkey % 4) || '"], "has_positive_catalyst": '
            || CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END || ', "has_negative_catalyst": '
            || CASE WHEN o_orderkey % 7 = 0 THEN '"true"' ELSE 'true' END || '}}}}' END AS components,
          o_orderpriority AS priority
        FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderkey % 11 = 0 THEN 'EXPIRED'
              WHEN o_orderstatus = 'F' THEN 'HIT' ELSE 'MISS' END AS s FROM orders)) p"""),
    "transactions": (("lines",), """
        SELECT o_custkey % 50 AS portfolio, l_suppkey AS ticker, date, l_orderkey, l_linenumber, l_partkey,
          CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, px AS price
        FROM lines JOIN orders ON l_orderkey = o_orderkey"""),
    "news": ((), r"""
        SELECT d.doc_id * 10000000 + line AS doc_id, d.doc_id % (SELECT count(*) FROM supplier) AS ticker,
          trim(trim(regexp_replace(raw, '\s+', ' ', 'g')) || ' ' || (@PHRASES@)[(d.doc_id + line) % 16 + 1]) AS headline,
          DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER) AS date,
          CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE CAST(d.doc_id AS VARCHAR) END AS url,
          CAST(quality - toxic AS DOUBLE) AS sentiment
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "calendar_events": ((), """
        SELECT o_orderkey AS event_id, o_custkey % (SELECT count(*) FROM supplier) AS ticker,
          CASE WHEN o_custkey % (SELECT count(*) FROM supplier) % 2 = 0 THEN 'US' ELSE 'KR' END AS market,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'macro' ELSE 'earnings' END AS kind,
          (['US CPI','Fed Interest Rate Decision','Retail Sales','Nonfarm Payrolls'])[o_orderkey % 4 + 1] AS name,
          CASE WHEN o_orderkey % 3 = 0 THEN 'UK' ELSE 'US' END AS country, CASE WHEN o_orderkey % 7 = 0 THEN 'Low' ELSE 'High' END AS impact,
          (['bmo','After-Market','','dmh'])[o_orderkey % 4 + 1] AS time, CAST(o_orderdate AS DATE) AS event_date FROM orders"""),
    "ticks": ((), "SELECT event_id, user_id AS ticker, ts, value AS price, event_type AS feed FROM events"),
    "etf": (("lines",), """
        SELECT p_partkey AS code, p_name AS name, p_type AS "group", p_size / 100.0::DOUBLE AS fee, aum,
          traded_cents / 100.0::DOUBLE AS traded_value,
          CASE WHEN p_partkey % 10 <> 0 THEN ((p_partkey * 37) % 200 - 100) / 100.0::DOUBLE END AS deviation,
          'IDX' || (p_partkey % 3) AS base_index, p_partkey % 8 = 0 AS leverage
        FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS aum,
            CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS traded_cents
          FROM lines GROUP BY l_partkey) ON p_partkey = l_partkey"""),
    "nav": (("bars",), """
        SELECT market, date, floor(1000 * sum(CAST(round(close*100) AS BIGINT)) / count(*)) / 100.0 AS nav,
          floor(1000 * sum(CAST(round(open*100) AS BIGINT)) / count(*)) / 100.0 AS benchmark_nav
        FROM bars GROUP BY market, date"""),
}


SQL_VIEWS["news"] = (
    (), SQL_VIEWS["news"][1].replace("@PHRASES@", "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"),
)


def with_views(views: tuple[str, ...], body: str) -> str:
    """Prefix `body` with the WITH clause for the views it names, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in SQL_VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in order)
    body = body.strip()
    if not ctes:
        return body if body.upper().startswith("SELECT") else f"WITH {body}"
    return f"WITH {ctes}\n{body}" if body.upper().startswith("SELECT") else f"WITH {ctes},\n{body}"
