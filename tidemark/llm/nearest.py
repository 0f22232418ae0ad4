"""Approximate nearest neighbours by cosine: cross-polytope hashing with several probes a table.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. A rotated vector is hashed to the signed
axis nearest to it, so a table has two cells per dimension, and more by a second rotation. A query probes the cells of
its nearest axes in order; all vectors in them are compared exactly. Vectors are indexed as classes of equal ones.

The number of cells follows the number of vectors (`CELL` of them a cell). The number of probes is measured: for at most
`SAMPLE` queries the exact neighbours are found by one scan, and the least number of probes that would have found
`RECALL` of them is taken. Every vector is indexed; nothing but this number comes from the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import saved

TABLES = 8
#: Vectors per cell, and of one cell in one block; a block's queries stream past it.
CELL, BLOCK = 256, 512
#: Queries from which the number of probes is measured, and the share of their neighbours that it must find.
SAMPLE, RECALL = 128, 0.95
#: Cells of more than a block that are sent to all tasks as (cell, number of blocks); more are joined by a shuffle.
FEW = 200_000
SEED = 20240
#: Neighbours within this of the last are compared again, row by row, in double precision.
NEAR = 1e-9


def rotated(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Rows after the pseudo-rotation number `turn` of a table, filled up to a power of two."""
    n = 1 << max(x.shape[1] - 1, 0).bit_length()
    signs = np.random.default_rng([SEED, table, turn, n]).choice([-1.0, 1.0], (3, n))
    out = np.zeros((len(x), n))
    out[:, :x.shape[1]] = x
    for s in signs:
        out *= s
        h = 1
        while h < n:
            y = out.reshape(len(x), -1, 2, h)
            out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        out /= np.sqrt(n)
    return out


def axes(count: int, dims: int, cell: int) -> list[int]:
    """How many axes each turn of a table uses, so that a cell holds about `cell` of `count` vectors."""
    out, cells, n = [], count / max(cell, 1), 1 << max(dims - 1, 0).bit_length()
    while cells > 1.5 and len(out) < 3:
        out.append(int(min(n, max(1, np.ceil(cells / 2)))))
        cells /= 2 * out[-1]
    return out


def _scores(x: np.ndarray, table: int, turns: list[int]) -> list[np.ndarray]:
    """Per turn the cosines to all signed axes used, for unit rows."""
    out = []
    for turn, a in enumerate(turns):
        y = rotated(x, table, turn)[:, :a]
        out.append(np.concatenate([y, -y], axis=1))
    return out


def cells_of(x: np.ndarray, table: int, turns: list[int]) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for s in _scores(x, table, turns):
        code = code * s.shape[1] + s.argmax(axis=1)
    return code


def probes_of(x: np.ndarray, table: int, turns: list[int], probes: int) -> np.ndarray:
    """The `probes` best cells of each row by the sum of its cosines to their axes.

    A cell whose axes are the i-th, j-th and k-th best of their turns has i * j * k - 1 cells that are no worse, so only
    combinations with a product of at most `probes` are looked at.
    """
    best, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    rank = np.ones(1, np.int64)
    for s in _scores(x, table, turns):
        order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        a, b = np.nonzero(rank[:, None] * np.arange(1, order.shape[1] + 1) <= probes)
        rank = rank[a] * (b + 1)
        score = score[:, a] + np.take_along_axis(s, order, axis=1)[:, b]
        best = best[:, a] * s.shape[1] + order[:, b]
    return np.take_along_axis(best, np.argsort(-score, axis=1, kind="stable")[:, :probes], axis=1)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that no square overflows; cosines stay the same to the last bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_length(b: pa.RecordBatch, most: int = 4_096):
    """Pieces of a batch with vectors of one length, and these vectors."""
    for a in range(0, len(b), most):
        t = b.slice(a, most)
        n = t["v"].value_lengths().to_numpy(zero_copy_only=False)
        for k in np.unique(n):
            u = t.take(pa.array(np.flatnonzero(n == k))) if (n != k).any() else t
            yield u, _scaled(u["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(u), k))


def _hashed(classes: DataFrame, ids: str, turns: list[int], tables: int) -> DataFrame:
    """The classes with `cells`, one per table; vectors of other lengths have other cells."""

    def part(batches):
        for b in batches:
            for t, v in _by_length(b):
                u, size = _unit(v), int(np.prod([2 * a for a in turns], dtype=np.int64))
                cells = np.stack([(v.shape[1] * tables + k) * size + cells_of(u, k, turns) for k in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([t["c"], t["ids"], t["v"], pa.array(list(cells), pa.list_(pa.int64()))], names=["c", "ids", "v", "cells"])

    return classes.mapInArrow(part, f"c string, ids {ids}, v array<double>, cells array<long>")


def _probed(queries: DataFrame, turns: list[int], tables: int, probes: int) -> DataFrame:
    def part(batches):
        for b in batches:
            for t, v in _by_length(b, 512):
                u, size = _unit(v), int(np.prod([2 * a for a in turns], dtype=np.int64))
                cells = np.concatenate([(v.shape[1] * tables + k) * size + probes_of(u, k, turns, probes) for k in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([t["c"], t["v"], pa.array(list(cells), pa.list_(pa.int64()))], names=["c", "v", "cells"])

    return queries.mapInArrow(part, "c string, v array<double>, cells array<long>")


def _pairs(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and candidate numbers of the `k` best candidates of every query (and equals), with their cosines."""
    rough = _unit(q) @ _unit(c).T
    if rough.shape[1] > k:
        a, b = np.nonzero(rough >= np.partition(rough, -k, axis=1)[:, -k][:, None] - NEAR)
    else:
        a, b = (x.ravel() for x in np.indices(rough.shape))
    length = np.sqrt((q * q).sum(axis=1))[a] * np.sqrt((c * c).sum(axis=1))[b]
    return a, b, (q[a] * c[b]).sum(axis=1) / length


def _measured(hashed: DataFrame, queries: DataFrame, turns: list[int], tables: int, k: int) -> int:
    """The number of probes a table that finds RECALL of the neighbours of at most SAMPLE queries."""
    sample = queries.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).collect()
    length = max(len(r.v) for r in sample)
    sample = [r for r in sample if len(r.v) == length]
    q, own = _scaled(np.array([r.v for r in sample])), [r.c for r in sample]

    def part(batches):
        for b in batches:
            for t, v in _by_length(b):
                if v.shape[1] == length:
                    a, c, s = _pairs(q, v, k + 1)
                    u = t.take(pa.array(c))
                    yield pa.RecordBatch.from_arrays([pa.array(a), u["c"], pa.array(s), u["cells"]], names=["q", "c", "s", "cells"])

    near = hashed.select("c", "v", "cells").mapInArrow(part, "q long, c string, s double, cells array<long>")
    near = near.filter(~F.element_at(F.array(*map(F.lit, own)), (F.col("q") + 1).cast("int")).eqNullSafe(F.col("c")))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))).filter(F.col("r") <= k).collect()
    u, size = _unit(q), int(np.prod([2 * a for a in turns], dtype=np.int64))
    rank = np.full(len(best), size)
    for t in range(tables):
        for i, x in enumerate(u):
            score = np.zeros(1)
            for s in _scores(x[None], t, turns):
                score = (score[:, None] + s[0][None]).ravel()
            for n, r in enumerate(best):
                if r.q == i:
                    rank[n] = min(rank[n], int((score > score[r.cells[t] - (length * tables + t) * size]).sum()) + 1)
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(RECALL * len(rank))))]) if len(rank) else size


def _blocked(rows: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    """Rows with the number of blocks of their cell."""
    out = rows.join(F.broadcast(hot) if few else hot, "cell", "left")
    return out.withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _matched(index: DataFrame, queries: DataFrame, hot: DataFrame, few: bool, ids: str, k: int) -> DataFrame:
    """q, ids, s: per query and block the nearest classes. `index` and `queries` have a row per cell."""
    cand = _blocked(index, hot, few).select("cell", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "c", "v", "ids")
    ask = _blocked(queries, hot, few).select("cell", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), F.lit(1).alias("side"), "c", "v", F.lit(None).cast(ids).alias("ids"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cand.unionByName(ask).repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "side", "c")

    def part(batches):
        group, held, block = None, [], None  # the block's candidates come first, its queries stream past them
        for b in batches:
            cell, no, side = (b[x].to_numpy() for x in ("cell", "block", "side"))
            cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (no[1:] != no[:-1]) | (side[1:] != side[:-1]), [True]]))
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                t, mine = b.slice(a, z - a), (cell[a], no[a])
                if mine != group:
                    group, held, block = mine, [], None
                if side[a] == 0:
                    held.append(t)
                elif held:
                    if block is None:
                        u = pa.Table.from_batches(held)
                        block = u["ids"].combine_chunks(), _scaled(np.concatenate([x["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in held]))
                    for y, q in _by_length(t, 1_024):
                        i, j, s = _pairs(q, block[1], k + 1)
                        yield pa.RecordBatch.from_arrays([y["c"].take(pa.array(i)), block[0].take(pa.array(j)), pa.array(s)], names=["q", "ids", "s"])

    return both.mapInArrow(part, f"q string, ids {ids}, s double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Per query its k + 1 nearest classes, pairs met in several tables once; equals by smallest id."""
    order = Window.partitionBy("q").orderBy(F.desc("s"), F.col("ids")[0])
    near = pairs.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k + 1)
    return near.groupBy("q").agg(F.collect_set(F.struct("s", "ids")).alias("near"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which `is_query` holds.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components take no part.
    Vectors of different lengths are never compared. Repeated rows count once; a row is no candidate for queries of its
    own id. A query whose probes find fewer than k candidates is compared with everything.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    same = F.concat(F.lpad(F.hex(F.xxhash64("v")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "v")), 16, "0"))  # 128 bits
    rows = vectors.filter(sound & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), is_query.alias("asks"), v.alias("v")).withColumn("c", same)
    kind = f"array<{dict(rows.dtypes)['id']}>"
    few_ids = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("c").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = saved(few_ids.groupBy("c").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v")), "classes")
    asking = rows.filter(F.coalesce("asks", F.lit(False)))
    queries = saved(asking.groupBy("c").agg(F.first("v").alias("v")), "queries")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    turns = axes(size.n, size.d or 1, cell)
    hashed = saved(_hashed(classes, kind, turns, tables), "hashed")
    one = hashed.select(F.explode("cells").alias("cell")).groupBy("cell").count().filter(F.col("count") > BLOCK)
    hot = saved(one.select("cell", F.ceil(F.col("count") / BLOCK).alias("blocks")), "hot")
    few = hot.count() <= FEW
    some = bool(turns) and bool(queries.head(1))
    probes = _measured(hashed, queries, turns, tables, k) if some else 1
    used = tables if some else 1  # a single cell needs one table
    index = hashed.select("c", "v", "ids", F.explode(F.slice("cells", 1, used)).alias("cell"))
    asked = _probed(queries, turns, tables, probes).select("c", "v", F.explode(F.slice("cells", 1, used * probes)).alias("cell"))
    best = saved(_best(_matched(index, asked, hot, few, kind, k), k), "best")
    if some:
        whole = hashed.groupBy(F.size("v").alias("d")).count()
        found = F.aggregate("near", F.lit(0), lambda n, x: n + F.size(x["ids"]))
        short = queries.join(best.select(F.col("q").alias("c"), found.alias("found")), "c", "left").filter(F.coalesce("found", F.lit(0)) <= k)
        short = saved(short.join(F.broadcast(whole) if whole.count() <= FEW else whole, F.size("v") == F.col("d")).filter(F.col("count") > F.coalesce("found", F.lit(0))).select("c", "v"), "short")
        if short.head(1):
            cells = hashed.select(F.size("v").alias("d"), F.col("cells")[0].alias("cell")).distinct()
            rest = _matched(hashed.select("c", "v", "ids", F.col("cells")[0].alias("cell")), short.join(cells, F.size("v") == F.col("d")).select("c", "v", "cell"), hot, few, kind, k)
            best = best.join(short.select(F.col("c").alias("q")), "q", "left_anti").unionByName(_best(rest, k))
    each = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["s"]).alias("s"), i.alias("id")))))
    near = asking.select("id", "c").distinct().join(best.withColumnRenamed("q", "c"), "c")
    listed = near.select("id", F.posexplode(F.slice(F.array_sort(F.filter(each, lambda x: x["id"] != F.col("id"))), 1, k)).alias("p", "x"))
    return listed.select(F.col("id").alias("query_id"), (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op12_query(vectors: DataFrame) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50; see `nearest` for rows that take no part."""
    return nearest(vectors, F.col("vec_id") % 50 == 0)
