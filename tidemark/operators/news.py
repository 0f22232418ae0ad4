"""News tables: near-duplicate removal, per-ticker signals, macro risk, themes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import fixed
from tidemark.functions import grams as gr
from tidemark.functions import text as ft
from tidemark.session import stable

MIN_PREFIX_WORDS = 5
FIRST_CELLS = 256  # whose grams `themes` counts first


def _key_hash(keys: list[str], *more) -> Column:
    return F.xxhash64(*keys, *[F.col(k).isNull() for k in keys], *more)  # a hash passes over nulls


def _prefix_edges(items: DataFrame, keys: list[str], min_words: int, first: DataFrame | None = None) -> DataFrame:
    """Pairs (early, late) of distinct headlines, by `_id`, where one is a word-prefix of the other.

    Candidates share their first `min_words` words and differ in their number of words. A prefix is known by a running hash of
    its words and their places, so a long headline costs no more per word; the words are read again where they lie, and of their
    prefixes only those leave it that bitmaps of fixed size take for a headline. Pairs come from an equi-join of hashes. With copies
    among the items, `first` has a row for each headline: `_id`, the items' `_at` and what `line_ends` gives.
    """
    lines = items.select(F.array_join("_w", " ").alias("norm"), _key_hash(keys).alias("k"), F.col("_id" if first is None else "_at").alias("_at"))
    if first is None:
        first = gr.line_ends(lines, min_words, ("_at",)).withColumn("_id", F.col("_at"))
    long = first.where(F.col("n") >= min_words).select("_id", "n", "head", "whole")
    several = long.groupBy("head").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo < hi")
    short = stable(long.join(several, "head").where("n < hi").select("_id", "n", "head", "whole"))
    heads, wholes = (gr.bitmap(short.select(F.col(c).alias("h"))) for c in ("head", "whole"))
    found = gr.line_prefixes(lines, heads, wholes, min_words, ("_at",)).distinct().join(short.select("n", "whole", "_id"), ["n", "whole"])
    pairs = found.join(first.select("_at", F.col("_id").alias("_id2")), "_at")
    return pairs.select(F.least("_id", "_id2").alias("early"), F.greatest("_id", "_id2").alias("late"))


def _greedy_dropped(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Headlines a first-seen-first-kept pass drops, by rounds over the conflict pairs.

    A headline with no undecided earlier partner is kept; its later partners are dropped; a dropped
    headline no longer blocks anything. Each round settles every current head of a chain.
    """
    edges = stable(edges)
    dropped = edges.select(*keys, F.col("late").alias("_id")).limit(0)
    while not edges.isEmpty():
        late = edges.select(*keys, F.col("late").alias("early")).distinct()
        kept = edges.select(*keys, "early").distinct().join(late, [*keys, "early"], "left_anti")
        out = stable(edges.join(kept, [*keys, "early"], "left_semi").select(*keys, "late").distinct())
        dropped = dropped.unionByName(out.withColumnRenamed("late", "_id"))
        edges = edges.join(kept, [*keys, "early"], "left_anti")
        edges = edges.join(out, [*keys, "late"], "left_anti")
        edges = stable(edges.join(out.withColumnRenamed("late", "early"), [*keys, "early"], "left_anti"))
    return dropped


def dedup_headlines(
    news: DataFrame, keys: list[str], order: list[str], min_words: int = MIN_PREFIX_WORDS
) -> DataFrame:
    """Rows surviving near-duplicate removal within `keys`, first seen in `order` kept.

    Headlines are known by 128 bits of hash of keys and text, and only ids and hashes are dealt to find the first of copies and
    the prefixes. A group of copies holding a third of the table costs one row per task. Then a bitmap of fixed size tells, where they
    lie, the rows that have no copy and no earlier partner; only the others move with their texts.
    """
    # a text of which something is left; said of the headline, as a filter on the result would make it twice
    some = F.lower("headline").rlike("[a-z0-9가-힣]")
    n = news.where(some).withColumn("_norm", ft.normalize_headline(F.col("headline"))).withColumns(
        {"_at": F.struct(_key_hash(keys, "_norm").alias("i"), _key_hash(keys, "_norm", F.lit(1)).alias("j")), "_pos": F.struct(*order)})
    lines = n.select(F.col("_norm").alias("norm"), _key_hash(keys).alias("k"), "_at", "_pos")
    first = gr.line_ends(lines, min_words, ("_at", "_pos")).groupBy("_at").agg(
        F.min("_pos").alias("pos"), F.count(F.lit(1)).alias("c"), *[F.max(x).alias(x) for x in ("n", "head", "whole")])
    # read several times below, so written once; a headline's id is its place and, should two share a place, its hashes
    first = stable(first.withColumn("_id", F.struct("pos", F.col("_at").alias("at"))).drop("pos"))
    edges = _prefix_edges(n.select(*keys, "_at", F.split("_norm", " ").alias("_w")), keys, min_words, first)
    dropped = stable(_greedy_dropped(edges, []).select(F.col("_id.at").alias("_at")))
    cells = gr.bit_cells(first.where("c > 1").select(F.col("_at.i").alias("h")).union(dropped.select(F.col("_at.i").alias("h"))))
    told = n.withColumn("_cell", gr.bit_cell(F.col("_at.i"))).join(F.broadcast(cells.withColumnsRenamed({"cell": "_cell", "bits": "_bits"})), "_cell", "left")
    clear = F.coalesce(F.getbit("_bits", gr.bit_of(F.col("_at.i"))), F.lit(0)) == 0
    payload = [c for c in news.columns if c not in keys]
    rest = told.where(~clear).join(dropped, "_at", "left_anti").groupBy(*keys, "_norm").agg(
        F.min(F.struct("_pos", F.struct(*payload).alias("_row"))).alias("_f"))
    return told.where(clear).select(*keys, *payload).unionByName(rest.select(*keys, "_f._row.*"))


def news_signal(news: DataFrame, keys: list[str], order: list[str], asof: Column) -> DataFrame:
    """Per key: counts, sentiment over survivors, tags and hard catalysts over ALL headlines."""
    h = F.col("headline")
    groups = {f"_t_{c}": k for c, k in fixed.EVENT_KEYWORDS.items()} | {"_pos": fixed.POSITIVE_CATALYSTS, "_neg": fixed.NEGATIVE_CATALYSTS}
    every = news.withColumn("_found", ft.keyword_groups(h, groups)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_count"), *[F.coalesce(F.max(F.array_contains("_found", g)), F.lit(False)).alias(g) for g in groups]
    )
    tags = F.array_compact(F.array(*[F.when(F.col(f"_t_{c}"), F.lit(c)) for c in sorted(fixed.EVENT_KEYWORDS)]))
    every = every.select(
        *keys, "raw_count", tags.alias("event_tags"),
        F.col("_pos").alias("has_positive_catalyst"), F.col("_neg").alias("has_negative_catalyst"),
    )
    s = F.col("sentiment")
    w = F.when(s.isNotNull(), ft.recency_weight(F.col("date"), asof))
    kept = dedup_headlines(news, keys, order).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.avg(s).alias("mean_sentiment"),
        F.try_divide(F.sum(w * s), F.sum(w)).alias("recency_weighted_sentiment"),
    )
    return every.join(kept, keys, "left").fillna(0, ["unique_count"])


def signal_json(sig: DataFrame) -> DataFrame:
    """The stored form of a news signal: raw_count omitted, non-finite sentiments null."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))
    body = F.struct(
        F.col("unique_count"),
        finite("mean_sentiment").alias("mean_sentiment"),
        finite("recency_weighted_sentiment").alias("recency_weighted_sentiment"),
        F.col("event_tags"), F.col("has_positive_catalyst"), F.col("has_negative_catalyst"),
    )
    return sig.withColumn("news_signal", F.to_json(body, {"ignoreNullFields": "false"}))


def macro_matches(items: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    """One row per distinct title (first seen) that matches a risk bucket, with its weight."""
    t = ft.normalize_title(F.col("headline"))
    title = F.when(t == "", F.concat(F.lit("#"), F.col(ident).cast("string"))).otherwise(t)
    first = items.withColumn("_t", title).groupBy(*keys, "_t").agg(
        F.min_by(F.struct("headline", ident), F.struct(*order)).alias("_r")
    )
    out = first.select(*keys, "_r.*").withColumn("bucket", ft.risk_bucket(F.col("headline")))
    return out.where("bucket IS NOT NULL").withColumn("weight", ft.risk_weight(F.col("bucket")))


def macro_risk(items: DataFrame, keys: list[str], order: list[str], ident: str, stale: Column | None = None) -> DataFrame:
    """Risk score and level per key; a stale feed never holds the gate."""
    flag = F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(False)
    groups = items.withColumn("_stale", flag).groupBy(*keys).agg(F.max("_stale").alias("_stale"))
    score = macro_matches(items, keys, order, ident).groupBy(*keys).agg(
        F.sum("weight").alias("_s"), F.count(F.lit(1)).alias("_m")
    )
    out = groups.join(score, keys, "left")
    s = F.when(F.col("_stale"), 0).otherwise(F.coalesce("_s", F.lit(0)))
    return out.select(
        *keys, s.cast("bigint").alias("risk_score"), ft.risk_level(s).alias("risk_level"),
        F.when(F.col("_stale"), 0).otherwise(F.coalesce("_m", F.lit(0))).cast("bigint").alias("matched"),
        F.when(F.col("_stale"), "macro feed stale, risk not assessed").alias("note"),
    )


def annotate(news: DataFrame) -> DataFrame:
    """Every matcher's verdict per headline."""
    h = F.col("headline")
    groups = dict(sorted(fixed.EVENT_KEYWORDS.items())) | {"_neg": fixed.NEGATIVE_CATALYSTS, "_pos": fixed.POSITIVE_CATALYSTS}
    found = news.withColumn("_found", ft.keyword_groups(h, groups))
    return found.withColumns(
        {
            "event_tags": F.array_except("_found", F.array(F.lit("_neg"), F.lit("_pos"))),
            "neg_catalyst": F.array_contains("_found", "_neg"),
            "pos_catalyst": F.array_contains("_found", "_pos"),
            "macro_bucket": ft.risk_bucket(h),
        }
    ).drop("_found")


def audit(news: DataFrame) -> DataFrame:
    """Matched share per matcher family."""
    a = annotate(news)
    fam = {
        "event_tags": F.size("event_tags") > 0, "neg_catalyst": F.col("neg_catalyst"),
        "pos_catalyst": F.col("pos_catalyst"), "macro_bucket": F.col("macro_bucket").isNotNull(),
    }
    any_ = fam["event_tags"] | fam["neg_catalyst"] | fam["pos_catalyst"] | fam["macro_bucket"]
    return a.agg(
        F.count(F.lit(1)).alias("headlines"), F.count_if(any_).alias("matched"),
        *[F.count_if(c).alias(k) for k, c in fam.items()],
    )


def sample_headlines(
    preds: DataFrame, news: DataFrame, macro: DataFrame, asof, days: int = 7,
    tickers: int = 12, per_ticker: int = 5, macro_rows: int = 20,
) -> DataFrame:
    """Audit sample: newest headlines of the most recently predicted tickers, plus macro rows."""
    t = F.lit(asof).cast("timestamp")
    recent = (
        preds.where((F.col("created_at") <= t) & (F.col("created_at") >= t - F.expr(f"INTERVAL {days} DAYS")))
        .groupBy("ticker").agg(F.max("created_at").alias("_last"))
        .orderBy(F.desc("_last"), "ticker").limit(tickers)
    )
    w = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("doc_id"))
    own = (
        news.join(recent, "ticker", "left_semi").withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= per_ticker)
        .select(F.concat(F.lit("ticker:"), F.col("ticker")).alias("origin"), "doc_id", "headline")
    )
    wire = macro.orderBy(F.desc("date"), F.desc("doc_id")).limit(macro_rows).select(
        F.lit("macro").alias("origin"), "doc_id", "headline"
    )
    return own.unionByName(wire).where("headline <> ''")


def news_counts(candidates: DataFrame, news: DataFrame) -> DataFrame:
    n = news.groupBy("ticker").agg(F.count(F.lit(1)).alias("news_count_7d"))
    return candidates.join(n, "ticker", "left").fillna(0, ["news_count_7d"])


def _samples(hits: DataFrame, samples: int) -> DataFrame:
    """Per gram its tickers in order and at most `samples` headlines, a new one of each ticker in turn."""
    heads = hits.groupBy("gram", "ticker", "headline").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("gram", "ticker").orderBy("pos")
    heads = heads.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    per_ticker = heads.groupBy("gram", "ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "headline"))), lambda x: x["headline"]).alias("hs")
    )
    lists = per_ticker.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("ticker", "hs"))).alias("_l"))
    picked = F.aggregate(
        "_l", F.array().cast("array<string>"),
        lambda acc, x: F.when(F.size(acc) >= samples, acc).otherwise(
            F.concat(acc, F.slice(F.array_except(x["hs"], acc), 1, 1))
        ),
    )
    return lists.select("gram", F.transform("_l", lambda x: x["ticker"]).alias("tickers"), picked.alias("sample_headlines"))


def _uncovered(grams: DataFrame, sizes: tuple[int, ...], min_tickers: int, min_articles: int) -> DataFrame:
    """Grams of `min_tickers` and `min_articles` or more, without those contained in a longer one of the same tickers."""
    per = grams.groupBy("gram", "ticker").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    counts = per.groupBy("gram").agg(
        F.count("ticker").alias("n_tickers"), F.sum("n").alias("headline_count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.bit_xor(F.xxhash64("ticker")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "ticker")).alias("_b"),
    ).where(F.col("n_tickers") >= min_tickers)
    if min_articles == 2:
        counts = counts.where("lo <> hi")
    elif min_articles > 2:
        far = grams.select("a", "gram").distinct()
        far = far.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_articles)
        counts = counts.join(far.select("gram"), "gram", "left_semi")
    counts = stable(counts.drop("lo", "hi")).withColumn("keywords", F.split("gram", " "))
    size, same = F.size("keywords"), ["n_tickers", "_a", "_b"]
    inner = [F.when(size > n, ft.ngrams(F.col("keywords"), n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    covered = counts.where(size > min(sizes)).select(*same, F.explode(F.concat(*inner)).alias("gram")).distinct()
    return counts.join(covered, ["gram", *same], "left_anti").drop("_a", "_b")


def themes(
    news: DataFrame, order: list[str], sizes: tuple[int, ...] = (2, 3), min_tickers: int = 3,
    min_articles: int = 2, top: int | None = 8, samples: int = 5,
) -> DataFrame:
    """Word n-grams seen at several tickers, without grams contained in a longer equal-ticker gram.

    A bound on the tickers of every gram is counted first, per cell of its hash: an array of fixed size for each task, so that no
    grams are dealt for it. The best grams stand among those of the most tickers, and a gram can only be contained in one of as many; so
    the grams of cells down to a floor are counted exactly, and the floor falls, to what the `top` best so far have, until they reach it. Whether two grams have the same
    tickers is told by their number and by two 64-bit hashes of the set that do not depend on order, so no gram's tickers are
    gathered before the top cut; tickers and sample headlines are collected for the grams that are returned.
    """
    h = F.trim("headline")
    article = F.when(F.trim(F.coalesce("url", F.lit(""))) != "", F.trim("url")).otherwise(h)
    lines = news.where(h != "").select("ticker", h.alias("headline"), article.alias("article"), F.struct(*order).alias("pos"))
    texts = lines.select("ticker", F.xxhash64("article").alias("a"), F.col("headline").alias("text"), F.xxhash64("ticker").alias("k"))
    bound = gr.bounds(texts, sizes)
    best = [F.desc("n_tickers"), F.desc("headline_count"), F.desc(F.size("keywords")), "gram"]
    cells = FIRST_CELLS
    floor = min_tickers if top is None or cells >= len(bound) else max(min_tickers, int(np.partition(bound, -cells)[-cells]))
    while True:
        found = _uncovered(gr.grams_of(texts, sizes, bound >= floor, ("ticker", "a")), sizes, min_tickers, min_articles)
        out = found.where(F.col("n_tickers") >= floor)  # below, grams of other cells are not counted yet
        if floor <= min_tickers or out.limit(top).count() == top:
            break
        reach, n = found.orderBy(F.desc("n_tickers")).limit(top).agg(F.min("n_tickers"), F.count(F.lit(1))).first()
        floor = max(min_tickers, min(reach, floor - 1)) if n == top else min_tickers
    hit = lines.select("ticker", "headline", "pos", F.col("headline").alias("text"))
    if top is None:
        hits = gr.grams_of(hit, sizes, bound >= floor, ("ticker", "headline", "pos")).join(out.select("gram"), "gram", "left_semi")
    else:
        out = stable(out.orderBy(*best).limit(top))
        names = frozenset(r.gram for r in out.select("gram").collect())  # `top` at most
        hits = gr.grams_of(hit, sizes, bound >= floor, ("ticker", "headline", "pos"), names)
    found = out.join(_samples(hits, samples), "gram").select("keywords", "gram", "tickers", "n_tickers", "headline_count", "sample_headlines")
    return found if top is None else found.orderBy(*best)
