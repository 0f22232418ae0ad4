"""Benchmark decontamination by spaced seeds: fixed masks skip word positions, so a hit survives substitutions.

Documents are scanned once. A bitmap of fixed size, built from the benchmark's seed hashes, drops almost all
windows; only stretches of words around the rest leave the scan. Seeds join on their hash, and the words around
every hit are compared along its diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, saved

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Kept offsets of each mask. Any 15 words of which up to 3 differ hold a whole hit of one of them (see the tests).
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 5, 6, 8), (0, 1, 3, 8, 9, 10), (0, 1, 3, 4, 7, 8))
WINDOW, DIFFER = 15, 3
#: Shorter items may differ in proportion. Cut into one piece more than words may differ, one piece occurs unchanged;
#: the masks of pieces of one to four words keep all of them.
PIECES = tuple(tuple(range(n)) for n in range(1, 5))
#: log2 of the bits of the filter: 4 MB, whatever the size of the benchmark.
BITS = 25
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of ASCII letters, digits and other scripts in a text, lower-cased."""
    ws = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")
    return F.transform(ws, lambda w: F.xxhash64(w))


def seed_hashes(h: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
    """Hash of the kept words at every start at which the whole mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = h.view(np.uint64)
    out = np.full(n, k + 1, np.uint64)
    for o in mask:
        out = (out ^ h[o:o + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def item_seeds(h: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """mask number, starts and hashes of an item: every start of the spaced masks, or the pieces of a short item."""
    if len(h) >= WINDOW:
        found = [(k, seed_hashes(h, m, k)) for k, m in enumerate(MASKS)]
        return [(k, np.arange(len(s)), s) for k, s in found]
    parts = len(h) * DIFFER // WINDOW + 1
    size = len(h) // parts
    if not size:
        return []
    at, k = np.arange(parts) * size, len(MASKS) + size - 1
    return [(k, at, seed_hashes(h, PIECES[size - 1], k)[at])]


def _benchmark_seeds(items: DataFrame) -> DataFrame:
    """item_id, ipos, k and h of every item's seeds."""

    def part(batches):
        for b in batches:
            for i, h in zip(b["item_id"].to_pylist(), b["w"], strict=True):
                h = np.asarray(h.values, dtype=np.int64)
                for k, at, s in item_seeds(h):
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([i] * len(s), b.schema.field("item_id").type), "ipos": at.astype(np.int32),
                                                      "k": np.full(len(s), k, np.int32), "h": s.view(np.int64)})

    return items.mapInArrow(part, f"item_id {items.schema['item_id'].dataType.simpleString()}, ipos int, k int, h long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit per seed hash, as 64-bit words; its size is fixed, and only words that are set are sent."""
    at = f"shiftrightunsigned(h, {64 - BITS})"
    cells = seeds.selectExpr(f"shiftright({at}, 6) AS c", f"shiftleft(1L, CAST({at} % 64 AS INT)) AS b")
    out = np.zeros(1 << (BITS - 6), np.uint64)
    got = cells.groupBy("c").agg(F.bit_or("b").alias("b")).toPandas()
    out[got["c"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _stretches(docs: DataFrame, bitmap, used: list[int]) -> DataFrame:
    """_row, doc_id, start, words (hashes) and hits (pos, h) of every stretch of words around seed hits."""
    around = WINDOW - 1

    def part(batches):
        bits = bitmap.value
        one, low = np.uint64(1), np.uint64(63)
        for b in batches:
            flat = b["w"].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(b["w"].value_lengths().to_numpy(zero_copy_only=False))
            pos, found = [], []
            for k in used:
                m = (MASKS + PIECES)[k]
                s = seed_hashes(flat, m, k)
                at = s >> np.uint64(64 - BITS)
                hit = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & low)) & one)
                own = np.searchsorted(ends, hit, side="right")
                inside = hit + m[-1] < ends[np.minimum(own, len(ends) - 1)] if len(ends) else hit < 0
                pos.append(hit[inside])
                found.append(s[hit[inside]].view(np.int64))
            pos, found = np.concatenate([*pos, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])
            if not len(pos):
                continue
            order = np.argsort(pos, kind="stable")
            pos, found = pos[order], found[order]
            own = np.searchsorted(ends, pos, side="right")
            begin = np.where(own > 0, ends[own - 1], 0)
            lo = np.maximum(pos - around, begin)
            hi = np.minimum(pos + MASKS[0][-1] + 5 + around, ends[own])
            new = np.ones(len(pos), bool)
            new[1:] = (own[1:] != own[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos))
            rows = b["_row"].to_pylist()
            out = {"_row": [], "doc_id": b["doc_id"].take(pa.array(own[first])), "start": [], "words": [], "hits": []}
            for a, z in zip(first, last, strict=True):
                d = own[a]
                out["_row"].append(rows[d])
                out["start"].append(int(lo[a] - begin[a]))
                out["words"].append(flat[lo[a]:hi[a:z].max()])
                out["hits"].append([{"pos": int(p), "h": int(h)} for p, h in zip(pos[a:z] - begin[a], found[a:z], strict=True)])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("_row", pa.int64()), b.schema.field("doc_id"), *schema]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = [("start", pa.int32()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64())])))]
    return docs.mapInArrow(part, f"_row long, doc_id {kind}, start int, words array<long>, hits array<struct<pos:int,h:long>>")


def overlaps(words: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Windows of aligned words that agree enough: start and end in `words`, words that agree.

    Word i of the item stands against word i + shift. An item of fewer than 15 words is one window.
    """
    lo, hi = max(0, shift), min(len(words), len(item) + shift)
    size = min(WINDOW, len(item))
    if hi - lo < size:
        return []
    same = (words[lo:hi] == item[lo - shift:hi - shift]).astype(int)
    run = np.concatenate([[0], np.cumsum(same)])
    n = run[size:] - run[:-size]
    good = np.flatnonzero(n >= size - size * DIFFER // WINDOW)
    return [(int(lo + k), int(lo + k + size), int(n[k])) for k in good]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 1) -> DataFrame:
    """doc_id, item_id, first_word, last_word (of the overlapping stretch), n_windows, n_same (of the best window).

    A row per document and item that share 15 aligned words of which at most 3 differ; of an item of fewer
    words, all of them aligned, of which a fifth may differ (under five words none). Items of fewer than `least` words
    are left out. Null and empty texts overlap
    with nothing. Rows of one id are one document; documents without an id share the null id. Empty tables give
    no rows; other columns are not read. Texts are searched whole.
    """
    items = saved(benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("w")).filter(F.size("w") >= least), "items")
    seeds = saved(_benchmark_seeds(items), "seeds")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    used = sorted(r.k for r in seeds.select("k").distinct().collect())
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("w"))
    found = saved(_stretches(rows, bitmap, used), "stretches")
    hits = found.select("_row", "start", F.explode("hits").alias("x")).select("_row", "start", "x.*")
    pairs = hits.join(seeds.drop("k"), "h").select("_row", "start", "item_id", (F.col("pos") - F.col("start") - F.col("ipos")).alias("shift")).distinct()
    full = pairs.join(found.select("_row", "start", "doc_id", "words"), ["_row", "start"]).alias("p").join(
        items.alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select("doc_id", "start", "words", "p.item_id", "w", "shift")

    def verify(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = overlaps(np.asarray(r["words"], np.int64), np.asarray(r["w"], np.int64), r["shift"])
                if found:
                    out.append({"doc_id": r["doc_id"], "item_id": r["item_id"], "first_word": r["start"] + found[0][0], "last_word": r["start"] + found[-1][1] - 1,
                                "n_windows": len(found), "n_same": max(f[2] for f in found)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([b.schema.field("doc_id"), b.schema.field("item_id"), *[(c, pa.int64()) for c in ("first_word", "last_word", "n_windows", "n_same")]]))

    types = {c: full.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    kind = f"doc_id {types['doc_id']}, item_id {types['item_id']}, first_word long, last_word long, n_windows long, n_same long"
    return full.mapInArrow(verify, kind).groupBy("doc_id", "item_id").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.sum("n_windows").alias("n_windows"), F.max("n_same").alias("n_same"))


def op6_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)
