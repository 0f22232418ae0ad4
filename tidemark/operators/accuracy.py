"""Forecast accuracy over the predictions table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import stats
from tidemark.session import row_index, running_totals

ORDER = ["outcome_date", "created_at", "id"]


def _is(status: str) -> Column:
    return F.col("status") == status


def in_window(asof, days: int | None) -> Column:
    """outcome_date within `days` before `asof`, compared as instants; later outcomes are unknown."""
    if days is None:
        return F.lit(True)
    t = F.lit(asof).cast("timestamp")
    return (F.col("outcome_date") >= t - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("outcome_date") <= t)


def closed(
    preds: DataFrame, market=None, source=None, timeframe=None, days: int | None = None, asof=None,
    statuses=("HIT", "MISS"),
) -> DataFrame:
    """Resolved predictions with optional conjunctive filters; all reach the scan."""
    out = preds.where(F.col("status").isin(*statuses))
    for name, value in (("market", market), ("source", source), ("timeframe", timeframe)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.where(in_window(asof, days)) if days is not None else out


def streaks(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Signed length of the latest run of equal outcomes per key.

    The run is every row after the newest row of the other outcome: two aggregates, no sort of a
    whole key, so a key holding a third of the table still aggregates map-side first.
    """
    pos = F.struct(*ORDER)
    r = resolved.where(F.col("status").isin("HIT", "MISS"))
    last = r.groupBy(*keys).agg(
        F.max(F.when(_is("HIT"), pos)).alias("_h"), F.max(F.when(_is("MISS"), pos)).alias("_m")
    )
    last = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.when(F.col("_m").isNull() | (F.col("_h") > F.col("_m")), "HIT").otherwise("MISS").alias("_win"),
        F.when(F.col("_m").isNull() | (F.col("_h") > F.col("_m")), F.col("_m")).otherwise(F.col("_h")).alias("_other"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    run = (
        r.join(last, on)
        .where((F.col("status") == F.col("_win")) & (F.col("_other").isNull() | (pos > F.col("_other"))))
    )
    sign = F.when(_is("HIT"), 1).otherwise(-1)
    return run.groupBy(*keys).agg(F.sum(sign).alias("current_streak"))


def _record_columns() -> list[Column]:
    hits, misses = F.count_if(_is("HIT")), F.count_if(_is("MISS"))
    outcome = F.when(_is("HIT"), 1.0).when(_is("MISS"), 0.0)
    err = F.col("confidence") - outcome
    return [
        F.count(F.lit(1)).alias("total"),
        hits.alias("wins"),
        misses.alias("losses"),
        F.count_if(_is("EXPIRED")).alias("expired"),
        F.when(hits + misses > 0, hits / (hits + misses)).alias("win_rate"),
        F.avg("outcome_return").alias("avg_return"),
        F.avg(err * err).alias("brier_score"),
    ]


def track_record(preds: DataFrame, keys: list[str], with_streak: bool = True, **filters) -> DataFrame:
    """Totals, win rate, mean return, Brier score and streak per key (one row for no keys)."""
    rows = closed(preds, statuses=("HIT", "MISS", "EXPIRED"), **filters)
    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    out = rows.groupBy(*by).agg(*_record_columns())
    if with_streak:
        out = out.join(streaks(rows, by), by, "left").fillna(0, ["current_streak"])
    return out.drop("_all")


def track_record_by_source(preds: DataFrame, **filters) -> DataFrame:
    """Overall row plus one per source in a single grouped pass."""
    rows = closed(preds, statuses=("HIT", "MISS", "EXPIRED"), **filters)
    out = rows.groupingSets([[], ["source"]], "source").agg(*_record_columns())
    return out.withColumn("source", F.coalesce("source", F.lit("ALL")))


def bucket_edges(buckets: int) -> list[tuple[float, float]]:
    step = 0.5 / buckets
    return [(0.5 + i * step, 0.5 + (i + 1) * step) for i in range(buckets)]


def confidence_bucket(c: Column, buckets: int) -> Column:
    """Label of the left-closed bucket over [0.5, 1]; the last one is closed. NULL below 0.5."""
    out = None
    edges = bucket_edges(buckets)
    for i, (lo, hi) in enumerate(edges):
        inside = (c >= lo) & ((c <= hi) if i == buckets - 1 else (c < hi))
        label = f"{lo:.2f}-{hi:.2f}"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def calibration(
    preds: DataFrame, keys: list[str] | None = None, buckets: int = 5, use_raw: bool = True,
    resolved: DataFrame | None = None, **filters,
) -> DataFrame:
    """Predicted against realised accuracy per confidence bucket."""
    keys = keys or []
    rows = closed(preds, **filters) if resolved is None else resolved
    c = F.coalesce("raw_confidence", "confidence") if use_raw else F.col("confidence")
    rows = rows.withColumns({"_c": c, "confidence_range": confidence_bucket(c, buckets)})
    return (
        rows.where("confidence_range IS NOT NULL")
        .groupBy(*keys, "confidence_range")
        .agg(
            F.round(F.avg("_c"), 3).alias("predicted_confidence"),
            F.round(F.count_if(_is("HIT")) / F.count(F.lit(1)), 3).alias("actual_accuracy"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def drift_status(cal: DataFrame, band: float = 0.05) -> DataFrame:
    p, a = F.col("predicted_confidence"), F.col("actual_accuracy")
    status = F.when(a > p + band, "UNDERCONFIDENT").when(a < p - band, "OVERCONFIDENT").otherwise("OK")
    return cal.withColumn("drift_status", status)


def overconfident_buckets(cal: DataFrame, drift: float = 0.10, min_count: int = 3) -> DataFrame:
    return cal.where(
        (F.col("count") >= min_count) & (F.col("predicted_confidence") - F.col("actual_accuracy") >= drift)
    )


def signal_performance(
    preds: DataFrame, min_count: int = 10, keys: list[str] | None = None, resolved=None, **filters
) -> DataFrame:
    """Hit rate per signal with an exact binomial test; a signal listed twice counts twice."""
    keys = keys or []
    rows = closed(preds, **filters) if resolved is None else resolved
    g = (
        rows.select(*keys, "status", F.explode("signals").alias("signal"))
        .groupBy(*keys, "signal")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(_is("HIT")).alias("wins"))
        .where(F.col("total") >= min_count)
    )
    p = stats.binomial_p_half(F.col("wins"), F.col("total"))
    return g.withColumn("_p", p).select(
        *keys, "signal", "total", "wins",
        F.round(F.col("wins") / F.col("total"), 3).alias("win_rate"),
        F.round("_p", 4).alias("p_value"),
        stats.signal_verdict(F.col("wins"), F.col("total"), F.col("_p")).alias("verdict"),
    )


def worst_signals(perf: DataFrame, min_predictions: int = 5, max_win_rate: float = 0.40) -> DataFrame:
    return perf.where(
        (F.col("verdict") == "dead")
        | ((F.col("total") >= min_predictions) & (F.col("win_rate") < max_win_rate))
    )


def split_index(rows: DataFrame, oos_fraction: float = 0.3, min_train: int = 0, order=None) -> DataFrame:
    """Tag the newest share of rows as test, by position in one total order, not by date."""
    order = order or ORDER
    idx = row_index(rows, order)
    n = idx.agg(F.count(F.lit(1))).scalar()
    cut = F.least(F.greatest(F.floor(n * (1 - oos_fraction)), F.lit(min_train)), n - 1)
    return idx.withColumn("is_test", F.col("row_idx") >= cut)


def signal_decay(preds: DataFrame, min_count: int = 10, oos_fraction: float = 0.3) -> DataFrame:
    rows = closed(preds).where("outcome_date IS NOT NULL").select(*ORDER, "status", "signals")
    s = split_index(rows, oos_fraction).select("is_test", "status", F.explode("signals").alias("signal"))
    test, hit = F.col("is_test"), _is("HIT")
    g = (
        s.groupBy("signal")
        .agg(
            F.count_if(~test).alias("train_total"), F.count_if(~test & hit).alias("train_wins"),
            F.count_if(test).alias("test_total"), F.count_if(test & hit).alias("test_wins"),
        )
        .where(F.col("train_total") + F.col("test_total") >= min_count)
    )
    for side in ("train", "test"):
        k, n = F.col(f"{side}_wins"), F.col(f"{side}_total")
        g = g.withColumn(f"{side}_verdict", stats.signal_verdict(k, n, stats.binomial_p_half(k, n)))
    return g.withColumn(
        "label",
        stats.decay_label(*[F.col(c) for c in ("train_verdict", "test_verdict", "train_total", "test_total")]),
    )


def decaying_signals(decay: DataFrame) -> DataFrame:
    return decay.where(F.col("label").isin("train_only", "reversed"))


def _pillars(preds: DataFrame) -> DataFrame:
    """Closed rows with their components as map<string, variant>; bad or non-object JSON is dropped."""
    rows = closed(preds).where("components IS NOT NULL")
    return rows.withColumn("_m", F.try_variant_get(F.try_parse_json("components"), "$", "map<string,variant>")).where(
        "_m IS NOT NULL"
    )


def _variant_type(v: Column) -> Column:
    """Type head: BIGINT, DOUBLE, DECIMAL, BOOLEAN, STRING, OBJECT, ARRAY or VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def component_contribution(preds: DataFrame, min_count: int = 8) -> DataFrame:
    """Hit rate per scalar pillar: numbers by sign, booleans and strings by value, nested skipped."""
    rows = _pillars(preds).select("status", F.explode("_m").alias("pillar", "_v"))
    t = _variant_type(F.col("_v"))
    rows = rows.withColumn("_t", t).where(~F.col("_t").isin("OBJECT", "ARRAY"))
    num = F.try_variant_get("_v", "$", "double")
    bucket = (
        F.when(F.col("_t").isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
               F.when(num > 0, "positive").when(num < 0, "negative").otherwise("zero"))
        .when(F.col("_t") == "BOOLEAN", F.initcap(F.try_variant_get("_v", "$", "string")))
        .when(F.col("_t") == "VOID", "None")
        .otherwise(F.try_variant_get("_v", "$", "string"))
    )
    return _win_table(rows.withColumn("bucket", bucket), ["pillar", "bucket"], min_count)


def rows_with_components(preds: DataFrame) -> DataFrame:
    """Count of closed rows that carry at least one scalar pillar."""
    scalar = F.exists(F.map_values("_m"), lambda v: ~_variant_type(v).isin("OBJECT", "ARRAY"))
    return _pillars(preds).agg(F.count_if(scalar).alias("n_with_components"))


def _win_table(rows: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(_is("HIT")).alias("wins"))
        .where(F.col("n") >= min_count)
        .withColumn("win_rate", F.round(F.col("wins") / F.col("n"), 3))
    )


def news_tag_performance(preds: DataFrame, min_count: int = 8) -> DataFrame:
    """Hit rate per event tag (once per row, trimmed, strings only) and per hard-catalyst flag."""
    sig = F.try_variant_get(F.try_parse_json("components"), "$.news_signal", "map<string,variant>")
    rows = closed(preds).where("components IS NOT NULL").withColumn("_s", sig).where("_s IS NOT NULL")
    tags = F.try_variant_get(F.element_at("_s", F.lit("event_tags")), "$", "array<variant>")
    words = F.transform(
        F.filter(tags, lambda v: _variant_type(v) == "STRING"),
        lambda v: F.trim(F.try_variant_get(v, "$", "string")),
    )
    words = F.array_distinct(F.filter(words, lambda s: s != ""))

    def flag(name):
        v = F.element_at("_s", F.lit(name))
        on = (_variant_type(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean")
        return F.when(F.coalesce(on, F.lit(False)), F.array(F.lit(name.split("_")[1])))

    none = F.array().cast("array<string>")
    items = F.concat(
        F.transform(F.coalesce(words, none), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name"))),
        *[
            F.transform(F.coalesce(flag(f), none), lambda t: F.struct(F.lit("catalyst").alias("kind"), t.alias("name")))
            for f in ("has_positive_catalyst", "has_negative_catalyst")
        ],
    )
    out = rows.select("status", F.inline(items))
    return _win_table(out, ["kind", "name"], min_count)


def recalibration_map(cal: DataFrame, keys: list[str], min_count: int = 1) -> DataFrame:
    """Monotone anchors per key from a calibration table: one short array per key."""
    pts = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("predicted_confidence").alias("x"),
                F.col("actual_accuracy").alias("y"),
                F.col("count").cast("double").alias("w"),
            )
        )
    )
    g = cal.where(F.col("count") >= min_count).groupBy(*keys).agg(pts.alias("_p"))
    return g.select(*keys, stats.isotonic_fit(F.col("_p")).alias("anchors"))


def recalibrate(preds: DataFrame, history: DataFrame, min_closed: int = 30, buckets: int = 5) -> DataFrame:
    """Map raw confidence through its source's curve; fewer than `min_closed` rows leaves it as is."""
    cal = calibration(history, ["source"], buckets)
    maps = recalibration_map(cal, ["source"])
    n = closed(history).groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    usable = maps.join(n, "source").where(F.col("_n") >= min_closed).select("source", "anchors")
    out = preds.join(usable, "source", "left")
    raw = F.coalesce("raw_confidence", "confidence")
    return out.withColumns(
        {
            "recalibrated": stats.interpolate(raw, F.col("anchors")),
            "applied": F.col("anchors").isNotNull(),
        }
    ).drop("anchors")


def bootstrap_ci(rows: DataFrame, resamples: int = 1000, alpha: float = 0.05, key: str = "id") -> DataFrame:
    """Poisson bootstrap of win rate and Brier score.

    Every row draws its own weight per replicate from a hash of its key, so the draws never move: a task adds up its rows in
    blocks, replicates by rows, and sends one row a replicate.
    """
    hit = _is("HIT").cast("int")
    a, b = stats.hash_pair(F.col(key))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = rows.where("confidence IS NOT NULL").select(
        key, hit.alias("y"), F.pow(F.col("confidence") - hit, 2).alias("e"), a.alias("a"), b.alias("b")).repartition(parts, key)

    def draw(batches):
        sums = np.zeros((resamples, 3))
        reps = np.arange(1, resamples + 1)[:, None]
        for t in batches:
            for k in range(0, t.num_rows, 512):
                y, e, a_, b_ = (t[c].slice(k, 512).to_numpy() for c in ("y", "e", "a", "b"))
                w = stats.poisson1_draws((a_ * reps + b_) % stats.HASH_PRIME)
                sums += w @ np.stack([np.ones(len(y)), y, e], axis=1)
        if sums.any():
            yield pa.RecordBatch.from_pydict({"rep": reps[:, 0], "n": sums[:, 0], "k": sums[:, 1], "s": sums[:, 2]})

    per = (
        base.mapInArrow(draw, "rep long, n double, k double, s double").groupBy("rep")
        .agg(*[F.sum(c).alias(c) for c in ("n", "k", "s")])
        .where("n > 0")
        .select((F.col("k") / F.col("n")).alias("wr"), (F.col("s") / F.col("n")).alias("br"))
    )
    # at most `resamples` rows from here on
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = per.select(
        "*", m.alias("m"),
        F.row_number().over(Window.partitionBy().orderBy("wr")).alias("rw"),
        F.row_number().over(Window.partitionBy().orderBy("br")).alias("rb"),
    )
    lo, hi = stats.nearest_rank(alpha / 2, F.col("m")), stats.nearest_rank(1 - alpha / 2, F.col("m"))
    ci = ranked.agg(
        F.round(F.max(F.when(F.col("rw") == lo, F.col("wr"))), 4).alias("win_rate_lo"),
        F.round(F.max(F.when(F.col("rw") == hi, F.col("wr"))), 4).alias("win_rate_hi"),
        F.round(F.max(F.when(F.col("rb") == lo, F.col("br"))), 4).alias("brier_lo"),
        F.round(F.max(F.when(F.col("rb") == hi, F.col("br"))), 4).alias("brier_hi"),
        F.round(F.avg((F.col("wr") > 0.5).cast("double")), 4).alias("prob_better_than_coin"),
    )
    point = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(hit), 4).alias("win_rate"),
        F.round(F.avg(F.pow(F.col("confidence") - hit, 2)), 4).alias("brier_score"),
    )
    one = F.lit(1).alias("_j")
    return point.select("*", one).join(ci.select("*", one), "_j").drop("_j")


def permutation_test(rows: DataFrame, permutations: int = 1000, cells: int = 256, key: str = "id") -> DataFrame:
    """Two-sided permutation p-value of mean(confidence | HIT) - mean(confidence | MISS).

    A permutation labels as HIT the n_hit rows with the smallest hashed uniforms. Sorting every row
    for every replicate is avoided: counts and sums per (replicate, uniform cell) locate the cell
    holding rank n_hit, and only that cell's rows are ranked. The result is the exact selection.
    """
    prime = stats.HASH_PRIME
    width = prime // cells + 1
    hit = _is("HIT").cast("int")
    a, b = stats.hash_pair(F.col(key))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = rows.select(
        key, hit.alias("y"), F.col("confidence").alias("c"), a.alias("a"), b.alias("b")
    ).repartition(n_parts, key)
    tot = base.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_hit"), F.sum("c").alias("sum_c"),
        F.sum(F.col("c") * F.col("y")).alias("hit_c"),
    ).select(
        "*",
        (
            F.try_divide("hit_c", "n_hit")
            - F.try_divide(F.col("sum_c") - F.col("hit_c"), F.col("n") - F.col("n_hit"))
        ).alias("obs"),
    )
    u = stats.rep_uniform(F.col("a"), F.col("b"), F.col("rep"))
    rep = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("u", u)
    rep = rep.withColumn("cell", F.floor(F.col("u") / width).cast("int"))
    hist = rep.groupBy("rep", "cell").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("s"))
    w = Window.partitionBy("rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    n_hit = tot.select("n_hit").scalar()
    hist = hist.select(
        "*", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s_before")
    )
    edge = hist.where((F.col("before") < n_hit) & (F.col("before") + F.col("k") >= n_hit)).select(
        F.col("rep").alias("e_rep"), F.col("cell").alias("e_cell"), (n_hit - F.col("before")).alias("need"), "s_before"
    )
    # `edge` has exactly one row per replicate, a bound the caller sets, so it may be broadcast
    inner = rep.join(F.broadcast(edge), (F.col("rep") == F.col("e_rep")) & (F.col("cell") == F.col("e_cell")))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("u", key))
    part = (
        inner.withColumn("r", rank).where(F.col("r") <= F.col("need"))
        .groupBy("rep").agg(F.sum("c").alias("s_in"), F.first("s_before").alias("s_before"))
        .select("rep", (F.col("s_in") + F.col("s_before")).alias("perm_hit"), F.lit(1).alias("_j"))
    )
    t = tot.withColumn("_j", F.lit(1))
    ph = F.col("perm_hit")
    stat = F.try_divide(ph, F.col("n_hit")) - F.try_divide(F.col("sum_c") - ph, F.col("n") - F.col("n_hit"))
    joined = t.join(part, "_j", "left")
    out = joined.groupBy("n", "n_hit", "obs").agg(
        F.count_if(F.abs(stat) >= F.abs(F.col("obs")) - 1e-12).alias("extreme")
    )
    defined = (F.col("n_hit") > 0) & (F.col("n_hit") < F.col("n"))
    return out.select(
        "n",
        F.when(defined, F.round("obs", 4)).otherwise(0.0).alias("observed_diff"),
        F.when(defined, F.round((F.col("extreme") + 1) / F.lit(permutations + 1), 4)).otherwise(1.0).alias("p_value"),
    )


def brier_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Brier score and rank AUC (ties count half) without pairing rows.

    Scores are grouped first, then one running sum over distinct scores gives the misses below.
    """
    g = rows.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q")
    )
    c = running_totals(g, ["_s"], {"_below": F.col("_q")})
    p, q = F.sum("_p"), F.sum("_q")
    return c.agg(
        p.alias("n_pos"), q.alias("n_neg"),
        (F.sum(F.pow(F.col("_s") - 1, 2) * F.col("_p") + F.pow(F.col("_s"), 2) * F.col("_q")) / (p + q)).alias("brier"),
        F.when((p > 0) & (q > 0), F.sum(F.col("_p") * (F.col("_below") - 0.5 * F.col("_q"))) / (p * q)).alias("auc"),
    )


def outcome_metrics(rows: DataFrame, confidence: Column, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    hit = _is("HIT").cast("int")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("wins"), F.avg(hit).alias("win_rate"),
        F.avg(F.pow(confidence - hit, 2)).alias("brier"), F.avg("outcome_return").alias("avg_return"),
    )
    return agg


def eval_recalibration(preds: DataFrame, oos_fraction: float = 0.3, timeframe=None, buckets: int = 5) -> DataFrame:
    """Raw against recalibrated Brier on the newest slice, the map fitted on the older slice only."""
    rows = closed(preds, timeframe=timeframe).where("outcome_date IS NOT NULL")
    rows = rows.select(*ORDER, "status", "outcome_return", F.coalesce("raw_confidence", "confidence").alias("confidence"))
    s = split_index(rows, oos_fraction, min_train=1).withColumn("raw_confidence", F.col("confidence"))
    cal = calibration(s, ["_j"], buckets, resolved=s.where("NOT is_test").withColumn("_j", F.lit(1)))
    anchors = recalibration_map(cal, ["_j"]).select("anchors").scalar()
    test = s.where("is_test").withColumn("anchors", anchors)
    test = test.withColumn("_r", stats.interpolate(F.col("confidence"), F.col("anchors")))
    arms = test.select(
        "status", "outcome_return",
        F.explode(F.array(
            F.struct(F.lit("raw").alias("arm"), F.col("confidence").alias("c")),
            F.struct(F.lit("recalibrated").alias("arm"), F.col("_r").alias("c")),
        )).alias("x"),
    ).select("status", "outcome_return", "x.*")
    return outcome_metrics(arms, F.col("c"), ["arm"])


def eval_dead_signals(preds: DataFrame, dead: tuple[str, ...]) -> DataFrame:
    """Overall, with any dead signal, without: one pass over two grouping sets."""
    has = F.arrays_overlap("signals", F.array(*[F.lit(d) for d in dead]))
    rows = closed(preds).where("outcome_date IS NOT NULL").withColumn("uses_dead", has)
    hit = _is("HIT").cast("int")
    c = F.coalesce("raw_confidence", "confidence")
    out = rows.groupingSets([[], ["uses_dead"]], "uses_dead").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("wins"), F.avg(hit).alias("win_rate"),
        F.avg(F.pow(c - hit, 2)).alias("brier"), F.avg("outcome_return").alias("avg_return"),
        F.grouping("uses_dead").alias("_g"),
    )
    slice_ = F.when(F.col("_g") == 1, "overall").when(F.col("uses_dead"), "with_dead").otherwise("without_dead")
    return out.withColumn("slice", slice_).drop("_g", "uses_dead")


def eval_regime_window(preds: DataFrame, start: str, end: str, direction: str = "BULL") -> DataFrame:
    rows = closed(preds).where(
        (F.col("direction") == direction)
        & F.to_date("created_at").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    return outcome_metrics(rows, F.coalesce("raw_confidence", "confidence"))


def windows_explode(preds: DataFrame, asof, windows=(7, 30, 90)) -> DataFrame:
    """Repeat each closed row once per look-back window that contains it (column `days`)."""
    t = F.lit(asof).cast("timestamp")
    rows = preds.where(
        F.col("status").isin("HIT", "MISS", "EXPIRED") & (F.col("outcome_date") <= t)
        & (F.col("outcome_date") >= t - F.expr(f"INTERVAL {max(windows)} DAYS"))
    )
    age = (F.unix_timestamp(t) - F.unix_timestamp("outcome_date")) / 86400.0
    return rows.withColumn("days", F.explode(F.filter(F.array(*[F.lit(d) for d in windows]), lambda d: age <= d)))


def readiness(preds: DataFrame, threshold: int = 100) -> DataFrame:
    """Closed rows whose components hold a non-null `algo`, and whether they reach the threshold."""
    rows = closed(preds)
    has = F.get_json_object("components", "$.algo").isNotNull()
    return rows.agg(F.count_if(has).alias("closed_with_components"), F.count(F.lit(1)).alias("closed")).withColumn(
        "ready", F.col("closed_with_components") >= threshold
    )


def walk_forward_folds(rows: DataFrame, folds: int = 3, min_train: int = 50, order=None) -> DataFrame:
    """Fold number of each test row in one total order (NULL in the initial training block)."""
    idx = row_index(rows, order or ["created_at", "id"])
    n = idx.agg(F.count(F.lit(1))).scalar()
    size = F.floor((n - min_train) / folds)
    fold = F.least(F.floor((F.col("row_idx") - min_train) / size), F.lit(folds - 1)).cast("int")
    return idx.withColumn("fold", F.when((F.col("row_idx") >= min_train) & (n >= min_train + folds), fold))
