"""Session set-up and the few physical-plan helpers the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_session(app: str = "tidemark", cpus: str | int = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: the session's `spark.checkpoint.dir`.

    Only a local session may fall back to a fresh folder under /tmp.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so later plans read the same rows.

    Used where a result must not change between two reads (range blocks, iterative joins).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def ordered_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """Range-partition by `order` and tag each row with `_block`, its contiguous slice.

    A window over the whole table without PARTITION BY runs in one task. Here each slice is one
    task, and only per-slice totals are combined afterwards (see `running_totals`).
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id())
    return stable(tagged)


def running_totals(
    df: DataFrame, order: list[str], sums: dict[str, Column], blocks: int | None = None
) -> DataFrame:
    """Add inclusive running sums over one global order without a single-task window.

    `order` must identify rows uniquely. The second window is over one row per block.
    """
    cut = ordered_blocks(df, order, blocks)
    totals = cut.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_block",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, "_block")
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(inside) + F.col(f"_o_{k}"))
    return out.drop("_block", *[f"_o_{k}" for k in sums])


def row_index(df: DataFrame, order: list[str], name: str = "row_idx", blocks: int | None = None) -> DataFrame:
    """0-based position of each row in one global order."""
    out = running_totals(df, order, {name: F.lit(1).cast("bigint")}, blocks)
    return out.withColumn(name, F.col(name) - 1)


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column aggregate used as a value (an uncorrelated scalar subquery)."""
    return df.scalar()
