"""Writing results so that readers see whole snapshots, and the table merges behind each sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_snapshot(df: DataFrame, path: str, partition: str = "market") -> None:
    """Replace only the partitions present in `df`; other partitions keep their files."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append-only audit rows."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, limit: int) -> DataFrame:
    return newest(spark.read.parquet(path), limit)


def newest(log: DataFrame, limit: int, order: str = "id") -> DataFrame:
    return log.orderBy(F.desc(order)).limit(limit)


def active_target(targets: DataFrame) -> DataFrame:
    """Latest target row with its JSON maps parsed."""
    m = "map<string,double>"
    g = targets.agg(F.max_by(F.struct(*targets.columns), "id").alias("t")).select("t.*")
    return g.withColumns({"allocation": F.from_json("allocation", m), "etf_map": F.from_json("etf_map", "map<string,string>")})


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: new rows win; the last by `seq` when a batch repeats a key."""
    cols = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*cols).alias("r"), F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("s"))
    b = new.select(*keys, F.struct(*cols).alias("r"), F.lit(1).alias("p"), F.col("seq").cast("bigint").alias("s"))
    g = a.unionByName(b).groupBy(*keys).agg(F.max_by("r", F.struct("p", "s")).alias("r"))
    return g.select(*keys, "r.*")


def rolling_history(history: DataFrame, report: DataFrame, keys: list[str], date: str = "report_date", keep: int = 12) -> DataFrame:
    """Replace rows of the same date, then keep the newest `keep` per key (limited before the shuffle)."""
    old = history.join(report.select(*keys, date), [*keys, date], "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.desc(date))
    u = old.unionByName(report)
    return u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def nav_daily(existing: DataFrame, today: DataFrame, keys: list[str]) -> DataFrame:
    """Same-day rerun replaces the row and notes that it did."""
    was = existing.select(*keys, F.lit(True).alias("_w"))
    t = today.join(was, keys, "left").withColumn("note", F.when(F.col("_w"), "replaced same-day snapshot")).drop("_w")
    return existing.join(today.select(*keys), keys, "left_anti").unionByName(t, allowMissingColumns=True)
