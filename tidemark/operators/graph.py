"""Edge tables as joins: themes, winners, negative news and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def similar_by_theme(links: DataFrame, inputs: DataFrame, limit: int = 10) -> DataFrame:
    """Stocks sharing most themes with each input ticker.

    Only the inputs' own edges are expanded; stocks are never paired with each other wholesale.
    """
    own = links.join(inputs.select("ticker"), "ticker", "left_semi").select(F.col("ticker").alias("input"), "theme")
    pairs = own.join(links, "theme").where(F.col("ticker") != F.col("input"))
    g = pairs.groupBy("input", "ticker").agg(
        F.count(F.lit(1)).alias("shared_count"), F.array_sort(F.collect_set("theme")).alias("shared_themes")
    )
    w = Window.partitionBy("input").orderBy(F.desc("shared_count"), "ticker")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def theme_winners(preds: DataFrame, links: DataFrame, asof, weeks: int = 8, min_total: int = 3, limit: int | None = None) -> DataFrame:
    """Hit rate per theme of recently made, resolved predictions; EXPIRED counts in the total.

    Predictions are reduced to one row per ticker before the many-to-many join.
    """
    t = F.lit(asof).cast("timestamp")
    recent = preds.where(
        F.col("status").isin("HIT", "MISS", "EXPIRED") & (F.col("created_at") <= t)
        & (F.col("created_at") >= t - F.expr(f"INTERVAL {7 * weeks} DAYS"))
    )
    per = recent.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "HIT").alias("w"))
    g = per.join(links, "ticker").groupBy("theme").agg(F.sum("n").alias("total"), F.sum("w").alias("wins"))
    out = g.where(F.col("total") >= min_total).withColumn("win_rate", F.col("wins") / F.col("total"))
    return out if limit is None else out.orderBy(F.desc("win_rate"), F.desc("total"), "theme").limit(limit)


def negative_news(news: DataFrame, keywords: list[str], asof, days: int, samples: int = 5) -> DataFrame:
    """Distinct matching headlines per ticker within the window, with a few samples."""
    h = F.lower("headline")
    hit = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(h, k))
    d = F.lit(asof).cast("date")
    m = news.where(F.col("date").between(F.date_sub(d, days), d) & hit)
    u = m.groupBy("ticker", "headline").agg(F.min(F.struct("date", "doc_id")).alias("pos"))
    n = u.groupBy("ticker").agg(F.count(F.lit(1)).alias("news_count"))
    w = Window.partitionBy("ticker").orderBy("pos")
    s = u.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    s = s.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "headline"))), lambda x: x["headline"]).alias("sample_headlines"))
    return n.join(s, "ticker")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], always: list[str], if_present: list[str]) -> DataFrame:
    """Merge by natural key: a match updates `always`, and `if_present` only where the new value is set.

    Rows without a key are skipped; repeats in the batch keep the last by `_seq`.
    """
    cols = [*always, *if_present]
    ok = incoming.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    last = ok.groupBy(*key).agg(F.max_by(F.struct(*cols), "_seq").alias("_n"))
    j = existing.join(last, key, "full_outer")
    extra = [c for c in existing.columns if c not in key and c not in cols]
    return j.select(
        *key,
        *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in always],
        *[F.coalesce(F.col(f"_n.{c}"), F.col(c)).alias(c) for c in if_present],
        *extra,
    )


def memory_stats(memory: DataFrame, categories: DataFrame) -> DataFrame:
    n = memory.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories.join(n, "category", "left").fillna(0, ["n"])
