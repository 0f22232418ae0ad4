"""Watch levels: merge of sources, triggers at a price, and the batch form of edge alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import ordered_blocks, stable

TRIGGERS = ("ENTRY", "STOP", "TARGET", "REENTRY")
LEVELS = ["direction", "entry_low", "entry_high", "stop", "target", "reentry"]


def prediction_targets(preds: DataFrame) -> DataFrame:
    """Newest OPEN prediction per (ticker, market); NEUTRAL is watched as BULL."""
    body = F.struct(
        F.when(F.col("direction").isin("BULL", "BEAR"), F.col("direction")).otherwise("BULL").alias("direction"),
        F.col("entry_price").alias("entry_low"), F.col("entry_price").alias("entry_high"),
        F.col("stop_price").alias("stop"), F.col("target_price").alias("target"), F.lit(None).cast("double").alias("reentry"),
        F.concat(F.lit("prediction:"), F.col("id")).alias("label"),
    )
    g = preds.where("status = 'OPEN'").groupBy("ticker", "market").agg(F.max_by(body, F.struct("created_at", "id")).alias("b"))
    return g.select("ticker", "market", "b.*", F.lit("prediction").alias("source"), F.lit(1).alias("prec"))


def position_targets(pos: DataFrame, stop_pct: float = 0.92) -> DataFrame:
    """Average cost as entry and a default stop under it; the first portfolio wins a ticker."""
    null = F.lit(None).cast("double")
    p = pos.where("avg_price > 0").select(
        "ticker", "market", F.lit("BULL").alias("direction"), F.col("avg_price").alias("entry_low"),
        F.col("avg_price").alias("entry_high"), F.round(F.col("avg_price") * stop_pct, 4).alias("stop"),
        null.alias("target"), null.alias("reentry"), F.lit("position").alias("label"),
        F.lit("position").alias("source"), F.lit(2).alias("prec"), "portfolio",
    )
    cols = [c for c in p.columns if c not in ("ticker", "market", "portfolio")]
    g = p.groupBy("ticker", "market").agg(F.min_by(F.struct(*cols), "portfolio").alias("b"))
    return g.select("ticker", "market", "b.*")


def saved_targets(saved: DataFrame) -> DataFrame:
    return saved.select(
        "ticker", "market", *LEVELS, F.lit("saved").alias("label"), F.lit("saved").alias("source"), F.lit(0).alias("prec")
    )


def unified(saved: DataFrame, predictions: DataFrame, positions: DataFrame) -> DataFrame:
    """One target per (ticker, market): saved over prediction over position."""
    u = saved_targets(saved).unionByName(prediction_targets(predictions)).unionByName(position_targets(positions))
    cols = [c for c in u.columns if c not in ("ticker", "market", "prec")]
    g = u.groupBy("ticker", "market").agg(F.min_by(F.struct(*cols), "prec").alias("b"))
    return g.select("ticker", "market", "b.*")


def trigger_conditions(price: Column, band: float = 0.01) -> dict[str, Column]:
    """Whether each trigger is satisfied at a price; levels come from the row's columns."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    bear = c("direction") == "BEAR"
    point = c("entry_low") == c("entry_high")
    low = F.when(point, c("entry_high") * (1 - band)).otherwise(c("entry_low"))
    high = F.when(point, c("entry_high") * (1 + band)).otherwise(c("entry_high"))
    return {
        "ENTRY": yes(price.between(low, high)),
        "STOP": yes(F.when(bear, price >= c("stop")).otherwise(price <= c("stop"))),
        "TARGET": yes(F.when(bear, price <= c("target")).otherwise(price >= c("target"))),
        "REENTRY": yes(price >= c("reentry")),
    }


def satisfied(price: Column) -> Column:
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in trigger_conditions(price).items()]))


def trigger_bits(ticks: DataFrame, watch: DataFrame) -> DataFrame:
    """One row per tick and watched target, with the satisfied triggers as bits in the order of TRIGGERS."""
    on = ["ticker", "market"] if "market" in ticks.columns and "market" in watch.columns else ["ticker"]
    conds = trigger_conditions(F.col("price"))
    bits = sum((conds[t].cast("int") * (1 << i) for i, t in enumerate(TRIGGERS)), F.lit(0))
    return ticks.join(watch, on).select(F.concat_ws(":", "source", F.col("ticker").cast("string"), "market").alias("target_key"), "ts", "event_id", "price", bits.alias("bits"))


def observations(ticks: DataFrame, watch: DataFrame) -> DataFrame:
    """One row per tick, watched level set and trigger, satisfied or not (leaving must be seen)."""
    on = ["ticker", "market"] if "market" in ticks.columns and "market" in watch.columns else ["ticker"]
    j = ticks.join(watch, on)
    conds = trigger_conditions(F.col("price"))
    obs = F.array(*[F.struct(F.lit(k).alias("trigger"), v.alias("satisfied")) for k, v in conds.items()])
    return j.select(
        F.concat_ws(":", "source", F.col("ticker").cast("string"), "market").alias("target_key"),
        "ts", "event_id", "price", F.inline(obs),
    ).withColumn("key", F.concat_ws(":", "target_key", "trigger"))


def edges(obs: DataFrame) -> DataFrame:
    """Rising edges per key, before the cooldown.

    The observations are cut into range blocks in (key, time) order, so one key with a third of the
    ticks spans many tasks; a block takes the state the key had at the end of its previous block.
    """
    order = ["key", "ts", "event_id"]
    cut = ordered_blocks(obs, order)
    inside = Window.partitionBy("_block", "key").orderBy("ts", "event_id")
    ends = cut.groupBy("_block", "key").agg(F.max_by("satisfied", F.struct("ts", "event_id")).alias("_s"))
    carried = F.lag("_s", 1).over(Window.partitionBy("key").orderBy("_block"))
    starts = ends.select("_block", "key", F.coalesce(carried, F.lit(False)).alias("_c"))
    prev = F.coalesce(F.lag("satisfied", 1).over(inside), F.col("_c"))
    return cut.join(starts, ["_block", "key"]).withColumn("_p", prev).where(F.col("satisfied") & ~F.col("_p")).drop("_p", "_c", "_block")


#: A time of last alert before all others, and how many neighbouring blocks are folded into one at a time.
NEVER, FAN = -(1 << 62), 16


def _alerts(t: np.ndarray, since: int, limit: int) -> list[int]:
    """Places of the edges at times `t` that fire after a last alert at `since`."""
    out, i = [], int(np.searchsorted(t, since + limit))
    while i < len(t):
        out.append(i)
        i = int(np.searchsorted(t, t[i] + limit))
    return out


def _step_map(t: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The last alert after the edges `t` as a monotone step function of the last alert before them.

    From each of the returned times on it has the value beside it; NEVER stands for the time itself, when no edge fires.
    """
    then = np.searchsorted(t, t + limit)
    last = np.where(then < len(t), then, np.arange(len(t)))
    while (last[last] != last).any():
        last = last[last]
    start = np.concatenate([[NEVER], t - limit + 1])  # who was last at t[i-1] - limit + 1 or later lets edge i fire first
    value = np.concatenate([t[last], [NEVER]])
    same = np.concatenate([start[1:] == start[:-1], [False]])
    first = np.flatnonzero(~same & (start <= t[0]))  # of equal starts the last holds; none before is later than t[0]
    start, value = start[first], value[first]
    keep = np.concatenate([[True], value[1:] != value[:-1]])
    return start[keep], value[keep]


def _apply(start: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = value[np.searchsorted(start, x, "right") - 1]
    return np.where(y == NEVER, x, y)


def _incoming(maps: DataFrame, fan: int) -> DataFrame:
    """Time of last alert before each (key, block), from the blocks' step maps, in groups of at most `fan` blocks.

    Neighbouring maps are composed into one, which has no more steps than its first, until a key has one group left;
    then the times go back down. No group holds more than `fan` maps.
    """
    most = maps.agg(F.max("place")).first()[0]
    out = "key string, place bigint, since bigint"

    def walk(b: pd.DataFrame, since: int) -> pd.DataFrame:
        rows = []
        for place, m in b.sort_values(["place", "start"]).groupby("place"):
            rows.append((b["key"].iloc[0], place, since))
            since = int(_apply(m["start"].to_numpy(), m["value"].to_numpy(), np.array([since]))[0])
        return pd.DataFrame(rows, columns=["key", "place", "since"])

    if most is None or most < fan:
        return maps.groupBy("key").applyInPandas(lambda b: walk(b, NEVER), out)

    def compose(b: pd.DataFrame) -> pd.DataFrame:
        parts = [(m["start"].to_numpy(), m["value"].to_numpy()) for _, m in b.sort_values(["place", "start"]).groupby("place")]
        start, value = parts[0]
        for s, v in parts[1:]:
            # where the composed map passes times through, the next map's own steps show
            through = start[value == NEVER]
            more = s[s > through[0]] if len(through) else s[:0]
            x = np.union1d(start, more)
            y = value[np.searchsorted(start, x, "right") - 1]
            z = v[np.searchsorted(s, np.where(y == NEVER, x, y), "right") - 1]
            value = np.where(z == NEVER, y, z)
            keep = np.concatenate([[True], value[1:] != value[:-1]])
            start, value = x[keep], value[keep]
        return pd.DataFrame({"key": b["key"].iloc[0], "place": int(b["place"].iloc[0]) // fan, "start": start, "value": value})

    above = F.floor(F.col("place") / fan).cast("bigint")
    upper = stable(maps.groupBy("key", above).applyInPandas(compose, "key string, place bigint, start bigint, value bigint"))
    known = _incoming(upper, fan)

    def down(b: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        return walk(b, int(k["since"].iloc[0]))

    return maps.groupBy("key", above).cogroup(known.groupBy("key", "place")).applyInPandas(down, out)


def fire(edge_rows: DataFrame, cooldown_hours: int = 6, fan: int = FAN, blocks: int | None = None) -> DataFrame:
    """Alerts that survive the cooldown: the first edge at least `cooldown_hours` after the last alert.

    Which edges survive depends on the alerts before them. The edges are cut into range blocks in (key, time) order. For
    a key that spans blocks, each block gives its step map from the last alert before it to the last alert after it;
    composed over blocks these give where every block starts, and all blocks then mark their alerts at once. A key that
    never pauses, whatever its share of the edges, is in no window, array or group as a whole.
    """
    limit = cooldown_hours * 3_600_000_000
    cut = ordered_blocks(edge_rows.select("key", "ts", "event_id", "price", F.unix_micros("ts").alias("t")), ["key", "t", "event_id"], blocks)
    inside = cut.groupBy("key", "_block").agg(F.count(F.lit(1)).alias("n"))
    span = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_block").alias("first")).where("n > 1")  # fewer keys than blocks

    def step_map(b: pd.DataFrame) -> pd.DataFrame:
        start, value = _step_map(np.sort(b["t"].to_numpy()), limit)
        return pd.DataFrame({"key": b["key"].iloc[0], "place": int(b["place"].iloc[0]), "start": start, "value": value})

    spanning = cut.join(F.broadcast(span.select("key", "first")), "key").select("key", (F.col("_block") - F.col("first")).cast("bigint").alias("place"), "first", "t")
    maps = stable(spanning.groupBy("key", "place").applyInPandas(step_map, "key string, place bigint, start bigint, value bigint"))
    since = _incoming(maps, fan).join(span.select("key", "first"), "key").select("key", (F.col("place") + F.col("first")).cast("int").alias("_block"), "since")

    def mark(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["key", "t", "event_id"], kind="stable")
        t, edge = b["t"].to_numpy(), np.flatnonzero((b["key"] != b["key"].shift()).to_numpy())
        at = [a + i for a, z in zip(edge, np.append(edge[1:], len(b)), strict=True) for i in _alerts(t[a:z], int(b["since"].iloc[a]), limit)]
        return b.iloc[at][["key", "ts", "event_id", "price"]]

    rows = cut.join(since, ["key", "_block"], "left").withColumn("since", F.coalesce("since", F.lit(NEVER)))
    return rows.groupBy("_block").applyInPandas(mark, "key string, ts timestamp, event_id bigint, price double")
