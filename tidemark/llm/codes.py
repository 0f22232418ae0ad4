"""Vector codes: equal parts of integer vectors, each named by the nearest entry of a small codebook.

The nearest entry is found by slicing and intersecting bitmasks. Per dimension the entries' coordinates are sorted, and
the mask of the first k of them is kept for every k; a range of coordinates is then the difference of two masks. A first
radius, the distance to an entry that is near in one dimension, selects a range in every dimension; the masks of all
dimensions ANDed give every entry inside that box, the nearest among them, and only these are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become integers by this scale; beyond +-LIMIT they are held at it, so that distances are exact in 64 bits.
SCALE, LIMIT = 256, 1 << 26
#: Rows of a piece on which a task works at once.
PIECE = 8_192
#: Values with a total each that are sent to all tasks; more are joined by shuffles.
FEW = 100_000


class Codebook:
    """Up to 64 entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n, dims = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        self.first = order[:, 0]
        bits = np.uint64(1) << order.astype(np.uint64)
        self.masks = np.zeros((n + 1, dims), np.uint64)  # of the first k entries by coordinate
        for k in range(n):
            self.masks[k + 1] = self.masks[k] | bits[k]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row, the lowest of equals, and its squared distance."""
        guess = self.first[np.minimum(np.searchsorted(self.sorted[:, 0], x[:, 0]), len(self.entries) - 1)]
        best = ((x - self.entries[guess]) ** 2).sum(axis=1)
        radius = np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64) + 1
        mask = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.masks[high, d] ^ self.masks[low, d]
        entry = np.full(len(x), len(self.entries), np.int64)
        active = np.arange(len(x))
        while len(active):  # the candidates of all rows, lowest first
            m = mask[active]
            low = m & (~m + np.uint64(1))
            e = np.log2(low.astype(np.float64)).astype(np.int64)
            mask[active] = m ^ low
            dist = ((x[active] - self.entries[e]) ** 2).sum(axis=1)
            better = (dist < best[active]) | ((dist == best[active]) & (e < entry[active]))
            best[active[better]], entry[active[better]] = dist[better], e[better]
            active = active[mask[active] != 0]
        return entry, best


def integer_vectors(vectors: DataFrame, vec_col: str, parts: int) -> DataFrame:
    """All columns of the rows that are kept, with `_v`, their integer vectors.

    Dropped are rows whose vector is null, has null or non-finite components or, as they can't be cut into equal parts
    like the others, another length than most (the greater of equally frequent ones); that length must be a multiple of
    `parts`.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(sound & (F.size(v) > 0) & (F.size(v) % parts == 0))
    length = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    whole = F.transform(v, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.least(F.lit(1e12), F.greatest(F.lit(-1e12), x)) * SCALE))).cast("int"))
    return rows.filter(F.size(v) == (length.n if length else 0)).withColumn("_v", whole)


def _pieces(batches):
    for b in batches:
        for a in range(0, len(b), PIECE):
            t = b.slice(a, PIECE)
            yield t, t["_v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), -1)


def fit_codebooks(rows: DataFrame, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Per part position its entries, from the rows of the smallest ids (nulls last, then by vector) and `rounds` rounds
    of assigning all rows and moving entries to the floored mean. Sums are taken per task, then by entry; the driver sees
    parts x entries of them."""
    seeds = rows.select(F.col(f"`{id_col}`").alias("i"), "_v").orderBy(F.col("i").asc_nulls_last(), "_v").limit(entries).collect()
    if not seeds:
        return []
    books = np.split(np.array([r._v for r in seeds], np.int64), parts, axis=1)
    for _ in range(rounds):
        held = [Codebook(b) for b in books]

        def part(batches, held=held):
            size = held[0].entries.shape
            count, sums = np.zeros((parts, size[0]), np.int64), np.zeros((parts, *size), np.int64)
            for _, v in _pieces(batches):
                for p, x in enumerate(np.split(v, parts, axis=1)):
                    e, _ = held[p].nearest(x)
                    count[p] += np.bincount(e, minlength=size[0])
                    for d in range(size[1]):  # sums stay below 2^53 in a piece
                        sums[p, :, d] += np.bincount(e, x[:, d], size[0]).astype(np.int64)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.int32()), "e": pa.array(e, pa.int32()), "n": count[p, e], "s": pa.array(list(sums[p, e]), pa.list_(pa.int64()))})

        dims = held[0].entries.shape[1]
        parted = rows.select("_v").mapInArrow(part, "p int, e int, n long, s array<long>")
        total = parted.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)])
        for r in total.collect():
            books[r.p][r.e] = [r[f"s{d}"] // r.n for d in range(dims)]
    return books


def compress(rows: DataFrame, books: list[np.ndarray], keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns `keep`, the code (two hex digits a part) and the squared distance to what the code stands for."""
    held = [f"k{k}" for k in range(len(keep))]
    parts = len(books)
    given = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, held, strict=True)], "_v")

    def part(batches):
        found = [Codebook(b) for b in books]
        for t, v in _pieces(batches):
            codes, error = np.zeros((len(t), parts), np.uint8), np.zeros(len(t), np.int64)
            for p, x in enumerate(np.split(v, parts, axis=1)):
                e, dist = found[p].nearest(x)
                codes[:, p] = e
                error += dist
            yield pa.RecordBatch.from_arrays([*[t[n] for n in held], pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=[*held, "code", "error"])

    types = dict(given.dtypes)
    out = given.mapInArrow(part, ", ".join([*[f"{n} {types[n]}" for n in held], "code string, error long"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(held, keep, strict=True)], "code", "error")


def with_total(rows: DataFrame, by: str, value: str, name: str, salts: int = 32) -> DataFrame:
    """`rows` with the sum of `value` over all rows of equal `by`, nulls together; a value of `by` may hold any share.

    Few totals go to all tasks. Others are repeated per salt, so that the rows of one value are dealt to `salts` tasks.
    """
    totals = saved(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(name)), "totals")
    same = F.col(by).eqNullSafe(F.col("_by"))
    if totals.count() <= FEW:
        return rows.join(F.broadcast(totals), same).drop("_by")
    spread = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(spread, same & (F.col("_deal") == F.col("_salt"))).drop("_by", "_salt", "_deal")


def digest(books: list[np.ndarray]) -> Column:
    """SHA-256 of all entries' components in order, joined by commas."""
    return F.sha2(F.lit(",".join(str(x) for b in books for x in b.ravel().tolist())).cast("binary"), 256)


def op11_query(vectors: DataFrame) -> DataFrame:
    """One row per kept vector; repeated rows are rows of their own, an empty table gives none."""
    rows = integer_vectors(vectors.select("vec_id", "embedding", "label"), "embedding", PARTS)
    books = fit_codebooks(rows, "vec_id")
    if not books:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = saved(compress(rows, books, ("vec_id", "label")), "codes")
    return with_total(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", digest(books).alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    return f"""SELECT r, p, x, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
    SELECT a.r, a.p, a.x, b.e, list_sum(list_transform(range(1, len(a.x) + 1), lambda k: (a.x[k] - b.x[k]) * (a.x[k] - b.x[k])))::BIGINT AS d FROM parted a JOIN {books} b ON a.p = b.p) GROUP BY r, p, x"""


def _moved(books: str, assigned: str) -> str:
    return f"""SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY k) AS x FROM (
      SELECT p, e, k, floor(sum(c) / count(*))::BIGINT AS m FROM (SELECT p, e, unnest(range(len(x))) AS k, unnest(x) AS c FROM {assigned}) GROUP BY p, e, k) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"""


ORACLE = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parted AS (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS e, x FROM parted WHERE r <= 64),
a0 AS ({_assigned("b0")}), b1 AS ({_moved("b0", "a0")}), a1 AS ({_assigned("b1")}), b2 AS ({_moved("b1", "a1")}), a2 AS ({_assigned("b2")}),
coded AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM coded"""
