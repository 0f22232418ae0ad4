"""Mixing sources to target weights, in DataFrame operations only.

Documents are packed into fixed-length blocks along a hashed order within their source. Every output shard draws
how many of its slots each source fills; the draws of a source are scaled to end at its target. A source's slots
map through pseudorandom permutations of its block numbers, one permutation per pass, and blocks join by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import saved, words
from tidemark.session import row_index, running_totals

ROUNDS = 12
#: Sources whose guide table every task may hold.
GUIDED = 10_000


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """Words to take per source: `share` of all words by weight, at most `most` times a source's own words.

    `sizes` has `source` and `source_size`, a row per source; `rank` (from 0), `weight` and `target` are added. Sources by code point, null last, get the weights in
    turn. What sources at their limit cannot take goes to the others by weight, again until none is above; each
    round reads two sums. Sources of no words have a target of 0.
    """
    order = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_key", F.coalesce("source", F.lit("")))
    ranked = row_index(order, ["_null", "_key"], "_i").drop("_null", "_key")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = saved(ranked.withColumn("weight", F.get(table, (F.col("_i") % len(weights)).cast("int"))).withColumnRenamed("_i", "rank"), "sources")
    limit = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, left = 0.0, None
    while True:  # ends: every round but the last fixes a source
        # A source stays at its limit once its weight times the level reaches it; the level only rises.
        full = limit <= F.col("weight") * level
        fixed, open_weight, n = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(~full, 1))).first()
        if n == 0 or n == left:
            break
        level, left = (share * total - fixed) / open_weight, n
    return ranked.withColumn("target", F.least(limit, F.col("weight") * level))


def pack(sizes: DataFrame, block: int = 64) -> DataFrame:
    """Pieces of documents in blocks: source, block, row, doc_id, first (word of the document), n (words in the block).

    `sizes` has row (unique), doc_id, source and size. Documents of a source stand in the order of a hash of
    their id. A source of n documents is cut by hash into about sqrt(n) buckets: positions are sums over buckets
    plus sums within a bucket, so neither step sees more than about sqrt(n) rows of a source in one window.
    """
    n = sizes.count()
    buckets = max(1, round(n ** 0.5))
    hashed = sizes.withColumn("_h", F.xxhash64("doc_id", "size")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy("source", "_b").agg(F.sum("size").alias("_s")).select(
        "source", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("_to", F.sum("size").over(inside)).alias("d").join(
        starts.alias("s"), F.col("d._b").eqNullSafe(F.col("s._b")) & F.col("d.source").eqNullSafe(F.col("s.source")),
    ).filter("size > 0").select("d.source", "row", "doc_id", "size", (F.col("_from") + F.col("_to") - F.col("size")).alias("_at"))
    whole = lambda c: F.floor(c / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(whole(F.col("_at")), whole(F.col("_at") + F.col("size") - 1))))
    start = F.greatest(F.col("block") * block - F.col("_at"), F.lit(0))
    return pieces.select(
        "source", "block", "row", "doc_id", start.alias("first"),
        (F.least((F.col("block") + 1) * block - F.col("_at"), F.col("size")) - start).alias("n"))


def _permuted(i: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, the same for the same key: in each round an index swaps with its
    mirror about a keyed pivot if a hash of the pair says so."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), i.cast("long"), swap)


def draw(targets: DataFrame, block: int = 64, slots_per_shard: int = 4096, seed: int = 17) -> DataFrame:
    """Slots of the mix: source, block, shard, turn (the order of slots within a shard is by turn).

    Every slot of a shard draws its source with the sources' blocks to take as chances, so the counts of a shard
    are multinomial. Along the shards a source's running count is then scaled to end at its own number of blocks:
    the mix meets its targets exactly and a shard's counts move by the draws' own error at most. A source that no
    slot drew is put into one shard. A source's k-th slot takes block k of its pass's permutation.
    """
    plan = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("take", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    plan = saved(running_totals(plan.filter("take > 0"), ["rank"], {"upto": F.col("take")}).select("rank", "blocks", "take", "upto"), "plan")
    total, n = plan.agg(F.coalesce(F.sum("take"), F.lit(0)), F.count("*")).first()
    shards = max(1, round(total / slots_per_shard))
    # A guide table: the numbers below `total` in equal cells, each with the sources whose interval meets it.
    cell = max(1, total // (4 * n) if n else 1)
    guide = plan.withColumn("lo", F.col("upto") - F.col("take")).select(
        "rank", "lo", "upto", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("upto") - 1) / cell))).alias("cell"))
    slots = plan.sparkSession.range(total).select(
        (F.col("id") % shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("u"))
    guide = F.broadcast(guide) if n <= GUIDED else guide.hint("merge")  # five rows a source at most
    drawn = slots.withColumn("cell", F.floor(F.col("u") / cell)).join(guide, "cell").filter("u >= lo and u < upto")
    counts = drawn.groupBy("rank", "shard").agg(F.count("*").alias("c"))
    # One source may have a third of all shards: running counts go over all sources in range blocks, less what lies before.
    runs = plan.join(counts, "rank", "left").select(
        "rank", "blocks", "take", F.coalesce("shard", F.pmod(F.xxhash64("rank", F.lit(seed)), F.lit(shards))).alias("shard"),
        F.coalesce("c", F.lit(1)).alias("c"))
    runs = running_totals(runs, ["rank", "shard"], {"end": F.col("c")})
    own = runs.groupBy("rank").agg(F.sum("c").alias("all"), F.min(F.col("end") - F.col("c")).alias("before"))
    runs = runs.join(own, "rank").withColumn("end", F.col("end") - F.col("before"))
    scaled = lambda c: F.when(c == F.col("all"), F.col("take")).otherwise(F.floor(c * (F.col("take") / F.col("all"))))
    spans = runs.select("rank", "blocks", "shard", scaled(F.col("end") - F.col("c")).alias("lo"), scaled(F.col("end")).alias("hi"))
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = spans.filter("hi > lo").repartition(parts, "rank", "shard").withColumn("k", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    key = F.xxhash64("rank", F.lit(seed), F.floor(F.col("k") / F.col("blocks")))
    return taken.select(
        "rank", _permuted(F.col("k") % F.col("blocks"), F.col("blocks"), key).alias("block"), "shard",
        F.xxhash64("shard", "rank", "k", F.lit(seed)).alias("turn"))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row (`row_col`, which must be unique, or made here), doc_id, source and size in words of every document, written once to the shared folder."""
    return saved(docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size")), "sizes")


def mix(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block: int = 64, slots_per_shard: int = 4096, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix and the sources: (shard, turn, source rank, block, row, doc_id, first, n), one row per piece of a
    document in a slot, and the table of `source_targets`.

    No documents or no words give an empty mix. A null source is a source of its own. Repeated rows are documents
    of their own. A document of any length spans as many blocks as it needs. Every block is drawn once per pass
    over its source, so with targets at most `most` times the source no document is taken more often than that.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(by_source, weights, share, most), "targets")
    pieces = pack(sizes, block).alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("rank", "p.*").drop("source")
    # Slots and pieces are made by `explode`, after the last exchange that tells the planner a size: it would broadcast either.
    return draw(targets, block, slots_per_shard, seed).hint("merge").join(pieces, ["rank", "block"]), targets


def mixed_words(mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix with its words: one row per piece, for ids that are unique; write it sorted by shard and turn."""
    text = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w"))
    return mixed.join(text, "doc_id").withColumn("words", F.slice("_w", (F.col("first") + 1).cast("int"), F.col("n").cast("int"))).drop("_w")


def taken_words(sizes: DataFrame, **how) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes from it."""
    mixed, targets = mix(sizes, **how)
    taken = mixed.groupBy("row").agg(F.sum("n").alias("taken"))
    return sizes.join(taken, "row", "left").alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left",
    ).select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op3_query(docs: DataFrame) -> DataFrame:
    return taken_words(document_sizes(docs)).drop("row")
