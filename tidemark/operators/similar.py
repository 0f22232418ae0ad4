"""Exact most-similar search inside a category, by blocks of queries against blocks of records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.held import beside, stream_past

#: Queries of one block, held while its records stream past, and records of one block.
QUERIES, RECORDS = 2_048, 65_536
#: Records multiplied with a block of queries at once.
STEP = 1_024
#: Candidates this close to the k-th are compared again in one fixed order of summation.
NEAR = 1e-9


def unit(v: Column) -> Column:
    """The vector over its length; null for a null, empty or zero vector or one with a null or non-finite component."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(x, lambda a: a / norm))


class Running:
    """The k best records of every held query so far."""

    def __init__(self, ids: list, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.own = {x: n for n, x in enumerate(ids)}
        self.floor = np.full(len(ids), -np.inf)  # the k-th best
        self.q, self.s, self.r = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, ids: list, vectors: np.ndarray) -> None:
        rough = self.vectors @ vectors.T
        for n, x in enumerate(ids):
            if x in self.own:
                rough[self.own[x], n] = -np.inf
        if rough.shape[1] > self.k:
            least = np.maximum(self.floor, np.partition(rough, -self.k, axis=1)[:, -self.k])
        else:
            least = self.floor
        q, c = np.nonzero((rough >= least[:, None] - NEAR) & (rough > -np.inf))
        names = np.empty(len(ids), object)
        names[:] = ids
        q, r = np.concatenate([self.q, q]), np.concatenate([self.r, names[c]])
        s = np.concatenate([self.s, (self.vectors[q[len(self.q):]] * vectors[c]).sum(axis=1)])
        order = np.lexsort((np.unique(r, return_inverse=True)[1], -s, q)) if len(q) else np.zeros(0, np.int64)
        q, s, r = q[order], s[order], r[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.s, self.r = q[keep], s[keep], r[keep]
        full = keep & (place == self.k - 1)
        self.floor[q[full]] = s[full]


def semantic_topk(memory: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERIES, records: int = RECORDS) -> DataFrame:
    """query_id, vec_id, category, similarity, rank: the k records of the query's category nearest by cosine.

    `memory` has vec_id, category and embedding, `queries` query_id instead of vec_id; a record of the query's own id is
    left out, equals go by smallest vec_id. Vectors that are null, zero or of another length have no similarity and take
    no part, nor do rows without a category. Queries and records are dealt to blocks by their ids. A pair of blocks is one group: its
    queries are held, its records stream past in steps, and the k best of every query leave it, to be merged by query.
    """
    rec = memory.select("category", F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("v")).where("category IS NOT NULL AND v IS NOT NULL")
    ask = queries.select("category", F.col("query_id").alias("id"), unit(F.col("embedding")).alias("v")).where("category IS NOT NULL AND v IS NOT NULL")
    types = dict(rec.dtypes)
    count = lambda df, name, size: df.groupBy("category", F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = count(ask, "qs", block).join(count(rec, "rs", records), ["category", "dims"])  # one row per category and length

    def dealt(df: DataFrame, side: int, mine: str, other: str) -> DataFrame:
        own, each = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        j = df.withColumn("dims", F.size("v")).join(sizes, ["category", "dims"])
        first, second = (own.alias("qb"), each.alias("rb")) if side == 0 else (each.alias("qb"), own.alias("rb"))
        return j.select("category", "dims", first, second, F.lit(side).alias("side"), "id", "v")

    key = ["category", "dims", "qb", "rb"]
    both = beside(dealt(ask, 0, "qs", "rs"), dealt(rec, 1, "rs", "qs"), key, ["id"])
    matrix = lambda t: t["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

    def hold(group, held):
        return held[0].schema, group[0], Running([i for t in held for i in t["id"].to_pylist()], np.concatenate([matrix(t) for t in held]), k)

    def meet(state, t):
        state[2].add(t["id"].to_pylist(), matrix(t))

    def done(state):
        schema, category, run = state
        kind, cat = schema.field("id").type, schema.field("category").type
        return pa.RecordBatch.from_pydict({"query_id": pa.array([run.ids[i] for i in run.q], kind), "vec_id": pa.array(run.r.tolist(), kind), "category": pa.array([category] * len(run.q), cat), "similarity": run.s})

    def part(batches):
        return stream_past(batches, key, hold, meet, done, STEP)

    found = both.mapInArrow(part, f"query_id {types['id']}, vec_id {types['id']}, category {types['category']}, similarity double")
    w = Window.partitionBy("query_id", "category").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
