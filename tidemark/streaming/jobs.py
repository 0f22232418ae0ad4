"""Structured Streaming jobs: alerts, outcome closing, ingestion, sliding news counts, late data."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as fd
from tidemark.operators import outcomes as oc
from tidemark.operators import watchlist as wl
from tidemark.session import checkpoint_root
from tidemark.streaming.processors import ACK, CHANGE, PREDICTION, TICK, OutcomeCloser, ThresholdOnce, WatchEdges

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files named `name` arriving in a folder; the checkpoint remembers what was read."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def tick_stream(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """events rows as price ticks with an instant and a watermark."""
    t = raw.select(
        "event_id", F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), F.col("event_type").alias("feed"),
    )
    return t.withWatermark("ts", delay)


def edge_alerts(
    ticks: DataFrame, watch: DataFrame, cooldown_hours: int = 6, ttl_days: int | None = None,
    acks: DataFrame | None = None, changes: DataFrame | None = None,
) -> DataFrame:
    """Alert rows (key, ts, event_id, price); key plus ts identifies an alert for at-least-once sinks.

    `acks` streams (key, event_id, delivered) of alerts; an alert that is not acknowledged when the next ticks of its
    target come is armed again. `changes` streams (target_key, watched) of the watch table; `watched` false removes the
    target's state. `ttl_days` lets the state of unwatched targets expire. Expiry needs processing time, which keeps a
    query asking for another batch, so it belongs to continuously running jobs, not to run_once.
    """
    stateful_session(ticks.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    trigger = F.array_position(F.lit(list(wl.TRIGGERS)), F.element_at(F.split("key", ":"), -1)) - 1
    rows = wl.trigger_bits(ticks, watch).select("target_key", F.lit(TICK).alias("kind"), "ts", "event_id", "price", "bits", none("boolean").alias("ok"))
    side = lambda df, kind, key, event, bits, ok: df.select(key.alias("target_key"), F.lit(kind).alias("kind"), none("timestamp").alias("ts"), event.alias("event_id"), none("double").alias("price"), bits.cast("int").alias("bits"), ok.alias("ok"))
    if acks is not None:
        rows = rows.unionByName(side(acks, ACK, F.regexp_replace("key", ":[A-Z]+$", ""), F.col("event_id"), trigger, F.col("delivered")))
    if changes is not None:
        rows = rows.unionByName(side(changes, CHANGE, F.col("target_key"), none("bigint"), none("int"), F.col("watched")))
    return rows.groupBy("target_key").transformWithStateInPandas(
        WatchEdges(wl.TRIGGERS, cooldown_hours, ttl_days, acks is not None), "key string, ts timestamp, event_id bigint, price double", "Append",
        "None" if ttl_days is None else "ProcessingTime",
    )


def open_levels(preds: DataFrame, hit: float = 0.03, miss: float = 0.05) -> DataFrame:
    """id, ticker, created_at, due_at and the prices at or beyond which a prediction is decided before it is due."""
    c = F.col
    level = lambda name, pct: F.when(F.coalesce(c(name), F.lit(0.0)) != 0, c(name)).otherwise(c("entry_price") * (1 + pct))
    d, e = c("direction"), c("entry_price")
    low = F.when(d == "BULL", level("stop_price", -miss)).when(d == "BEAR", level("target_price", -hit)).otherwise(e * (1 - hit * (1 + 1e-12)))
    high = F.when(d == "BULL", level("target_price", hit)).when(d == "BEAR", level("stop_price", miss)).otherwise(e * (1 + hit * (1 + 1e-12)))
    due = fd.business_day_after(fd.local_date(c("created_at"), c("market")), fd.timeframe_days(c("timeframe")))
    return preds.where(e > 0).select("id", "ticker", "created_at", due.cast("timestamp").alias("due_at"), low.alias("low"), high.alias("high"))


def deciding_ticks(ticks: DataFrame, preds: DataFrame, salts: int = 4, buckets: int = 64) -> DataFrame:
    """id, ts, price: what decides each prediction of a stream of open predictions, once.

    Predictions of a ticker are dealt to `salts` parts, which all see its ticks, so one ticker is no single task. Parts
    go by hash into `buckets` keys, each worked on in one piece; both numbers are fixed for the life of a checkpoint.
    """
    stateful_session(ticks.sparkSession)
    none = lambda *kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    bucket = F.pmod(F.hash("ticker", "salt"), F.lit(buckets)).alias("bucket")
    t = ticks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        bucket, "ticker", F.lit(TICK).alias("kind"), "ts", "event_id", "price", *none(("id", "bigint"), ("created_at", "timestamp"), ("due_at", "timestamp"), ("low", "double"), ("high", "double")))
    p = open_levels(preds).withColumn("salt", F.pmod(F.hash("id"), F.lit(salts)).cast("int")).select(
        bucket, "ticker", F.lit(PREDICTION).alias("kind"), *none(("ts", "timestamp"), ("event_id", "bigint"), ("price", "double")), "id", "created_at", "due_at", "low", "high")
    return t.unionByName(p).groupBy("bucket").transformWithStateInPandas(
        OutcomeCloser(dict(ticks.dtypes)["ticker"]), "id bigint, ts timestamp, price double", "Append", "EventTime")


def close_outcomes(decided: DataFrame, preds: DataFrame) -> DataFrame:
    """Status and return of decided predictions by the outcome rule at the deciding price and day."""
    j = decided.select("id", "ts", "price").join(preds, "id")
    return oc.outcome(j, F.to_date("ts")).select("id", F.col("new_status").alias("status"), F.col("new_return").alias("ret"), "ts", "price")


def notify_once(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    stateful_session(rows.sparkSession)
    k = rows.select(F.col(key).cast("string").alias("key"))
    return k.groupBy("key").transformWithStateInPandas(
        ThresholdOnce(threshold), "key string, threshold bigint", "Append", "None"
    )


def sliding_counts(rows: DataFrame, key: str, length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Rows per key in every sliding window, emitted when the watermark passes its end."""
    g = rows.groupBy(F.window("ts", length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def split_late(batch: DataFrame, high_water: DataFrame, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch against the stored high-water mark."""
    mark = high_water.agg(F.max("ts")).scalar()
    late = F.coalesce(F.unix_timestamp("ts") < F.unix_timestamp(mark) - delay_seconds, F.lit(False))
    return batch.where(~late), batch.where(late)


def new_rows_only(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key is not in the table yet, the least one per key: a rerun appends nothing."""
    b = batch.groupBy(*keys).agg(F.min(F.struct(*[c for c in batch.columns if c not in keys])).alias("r")).select(*keys, "r.*")
    return b.join(table.select(*keys), keys, "left_anti")


def run_once(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Process everything available into parquet in the shared folder and read it back."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{root}/out", checkpoint or f"{root}/ckpt"
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at `path`; empty before its first write. Any other read error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def idempotent_day(stream: DataFrame, path: str, checkpoint: str, keys: list[str], day: str = "date"):
    """foreachBatch sink writing each key once; a replayed batch is a no-op.

    The table is partitioned by `day`, a column that the keys determine (a day, or a month where days are small),
    and a batch is compared with the partitions it touches only.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        have = _table(spark, path, batch.schema).join(batch.select(day).distinct(), day, "left_semi")
        new_rows_only(batch, have, keys).write.mode("append").partitionBy(day).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late_stream(stream: DataFrame, path: str, checkpoint: str, delay_seconds: int):
    """foreachBatch sink with a side table: rows behind the high-water mark of earlier batches go to `path`/late.

    Every batch writes its rows and its mark under its own number and replaces them if it runs again.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        marks = _table(spark, f"{path}/marks", "ts timestamp, batch bigint").where(F.col("batch") < number)
        sides = split_late(batch, marks, delay_seconds)
        for name, rows in zip(("on_time", "late"), sides, strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
