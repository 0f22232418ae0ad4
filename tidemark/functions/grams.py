"""Word n-grams and word prefixes of lines as 64-bit hashes, made in numpy from the words of a whole batch at once."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed

BIT_CELLS = 1 << 19  # of 64 bits: 4 MB when broadcast, at any size of the table
CELLS = 1 << 20  # of the counts of hashes: 8 MB at the driver at any size of the table
CHUNK = 1 << 16
WORD = re.compile("[A-Za-z가-힣0-9]+")
MOST = 300_000  # words worked on at once
KNOWN = 500_000  # words whose hash a task holds
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Hashes(dict):
    """Hash of a word's lower case; 0 for words that `text.tokens` leaves out."""

    stop = frozenset(fixed.KO_STOPWORDS + fixed.EN_STOPWORDS)

    def __missing__(self, word: str) -> int:
        low = word.lower()
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = 0 if len(low) < 2 or low in self.stop else xxhash.xxh3_64_intdigest(low.encode()) | 1
        return out


def _pieces(texts: list[str | None], cut=WORD.findall) -> Iterator[tuple[int, list[list[str]]]]:
    """First line and words of the lines, in pieces of about `MOST` words."""
    first, held, n = 0, [], 0
    for k, text in enumerate(texts):
        held.append(cut(text or ""))
        n += len(held[-1])
        if n >= MOST:
            yield first, held
            first, held, n = k + 1, [], 0
    if held:
        yield first, held


def line_grams(texts: list[str | None], sizes: tuple[int, ...], known: Hashes) -> Iterator[tuple]:
    """Per piece: hash, line, place and size of every gram of the texts, and the words by their places."""
    for first, held in _pieces(texts):
        flat = [w for ws in held for w in ws]
        h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        line = np.repeat(np.arange(first, first + len(held)), [len(ws) for ws in held])
        at = np.flatnonzero(h)
        h, line = h[at], line[at]
        out = []
        for n in sizes:
            count = max(len(h) - n + 1, 0)
            x = np.zeros(count, np.uint64)
            for k in range(n):
                x = _mixed(x + h[k:k + count] + np.uint64(k + 1))
            inside = np.flatnonzero(line[:count] == line[n - 1:n - 1 + count]) if count else np.zeros(0, np.int64)
            out.append((x[inside], line[inside], inside, np.full(len(inside), n)))
        yield tuple(np.concatenate(c) for c in zip(*out, strict=True)), lambda i, n, at=at, flat=flat: " ".join(flat[k].lower() for k in at[i:i + n])


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Places of one row for each combination of the keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order[new]


def _once(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """`x` of one row for each pair (x, k), by one sort; equal keys of different pairs may leave a row too many, never one too few."""
    order = np.argsort(x ^ _mixed(k.view(np.uint64) + MIX))
    x, k = x[order], k[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (k[1:] != k[:-1])
    return x[new]


def bounds(lines: DataFrame, sizes: tuple[int, ...]) -> np.ndarray:
    """Per cell of gram hashes a number that no gram in it exceeds by its tickers. `lines` has text and k (hash of its ticker).

    A task counts a gram and ticker once a piece at most, and tasks and the grams of a cell are added up. A task sends its cells as
    packed blocks, so what is dealt follows the tasks, not the grams.
    """

    def part(batches):
        cells, known = np.zeros(CELLS, np.int64), Hashes()
        for b in batches:
            ticker = b["k"].to_numpy(zero_copy_only=False)
            for (x, line, _, _), _ in line_grams(b["text"].to_pylist(), sizes, known):
                cells += np.bincount((_once(x, ticker[line]) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if cells.any():
            low = cells.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_pydict({"chunk": np.arange(len(low), dtype=np.int32), "counts": [zlib.compress(c.tobytes(), 1) for c in low]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in b["counts"])
        return pd.DataFrame({"chunk": b["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros(CELLS, np.int64)
    got = lines.select("text", "k").mapInArrow(part, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").toArrow()
    for chunk, counts in zip(got["chunk"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(counts), np.int64)
    return out


def grams_of(lines: DataFrame, sizes: tuple[int, ...], cells: np.ndarray, keep: tuple[str, ...], only: frozenset[str] | None = None) -> DataFrame:
    """The columns `keep` and `gram` of every line's distinct grams whose cell is marked, and, if given, that are among `only`."""
    held = lines.sparkSession.sparkContext.broadcast(cells)
    types = dict(lines.dtypes)

    def part(batches):
        known = Hashes()
        for b in batches:
            own = b.select(list(keep))
            for (x, line, at, size), text in line_grams(b["text"].to_pylist(), sizes, known):
                some = np.flatnonzero(held.value[(x & np.uint64(CELLS - 1)).astype(np.int64)])
                some = some[_first_of(x[some], line[some])]
                grams, which = np.unique(x[some], return_inverse=True)
                one = np.zeros(len(grams), np.int64)
                one[which] = some
                names = [text(at[i], size[i]) for i in one.tolist()]
                if only is not None:
                    right = np.array([n in only for n in names], bool)[which]
                    some, which = some[right], which[right]
                if len(some):
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(line[some])).columns, pa.array(names, pa.string()).take(pa.array(which))], [*keep, "gram"])

    return lines.select("text", *keep).mapInArrow(part, ", ".join([*[f"{c} {types[c]}" for c in keep], "gram string"]))


def bit_cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BIT_CELLS - 1))


def bit_of(h: Column) -> Column:
    return F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")


def bit_cells(keys: DataFrame) -> DataFrame:
    """cell and bits, at most BIT_CELLS rows, of the hashes in column `h`."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(F.col("h")))
    return keys.select(bit_cell(F.col("h")).alias("cell"), one.alias("bits")).groupBy("cell").agg(F.bit_or("bits").alias("bits"))


def bitmap(keys: DataFrame) -> np.ndarray:
    out, got = np.zeros(BIT_CELLS, np.uint64), bit_cells(keys).toArrow()
    out[got["cell"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h & np.uint64(BIT_CELLS - 1)).astype(np.int64)] >> (h >> np.uint64(40) & np.uint64(63)) & np.uint64(1)).astype(bool)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode())
        return out


def _running(b: pa.RecordBatch, known: WordHashes) -> Iterator[tuple[np.ndarray, ...]]:
    """Per piece of a batch with norm and k (hash of the line's keys): lines, their numbers of words, where their words begin,
    every word's place and the hash of the line's words up to it."""
    key = b["k"].to_numpy(zero_copy_only=False).view(np.uint64)
    for first, held in _pieces(b["norm"].to_pylist(), lambda t: t.split(" ")):
        n = np.array([len(ws) for ws in held], np.int64)
        h = np.fromiter((known[w] for ws in held for w in ws), np.uint64, int(n.sum()))
        start = np.cumsum(n) - n
        place = np.arange(len(h)) - np.repeat(start, n)
        run = np.bitwise_xor.accumulate(_mixed(h + (place + 1).astype(np.uint64) * MIX))
        before = np.where(start > 0, run[start - 1], np.uint64(0)) ^ key[first:first + len(n)]
        yield np.arange(first, first + len(n)), n, start, place, run ^ np.repeat(before, n)


def line_ends(lines: DataFrame, min_words: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, n (words), head (hash of the first `min_words` words, null for fewer) and whole (of all). `lines` has norm and k."""
    types = dict(lines.dtypes)

    def part(batches):
        known = WordHashes()
        for b in batches:
            for line, n, start, _, run in _running(b, known):
                long = n >= min_words
                head = run[np.where(long, start + min_words - 1, 0)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*b.select(list(keep)).slice(line[0], len(line)).columns, pa.array(n, pa.int32()), pa.array(head, mask=~long), pa.array(run[start + n - 1].view(np.int64))], [*keep, "n", "head", "whole"])

    return lines.select("norm", "k", *keep).mapInArrow(part, ", ".join([*[f"{c} {types[c]}" for c in keep], "n int, head long, whole long"]))


def line_prefixes(lines: DataFrame, heads: np.ndarray, wholes: np.ndarray, min_words: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, n and whole of the proper prefixes of `min_words` words or more that the bitmaps let through, by their head and whole."""
    sc, types = lines.sparkSession.sparkContext, dict(lines.dtypes)
    held = sc.broadcast((heads, wholes))

    def part(batches):
        known = WordHashes()
        for b in batches:
            for line, n, start, place, run in _running(b, known):
                own = n > min_words
                own[own] = _marked(held.value[0], run[start[own] + min_words - 1])
                at = np.flatnonzero(np.repeat(own, n) & (place >= min_words - 1) & (place < np.repeat(n, n) - 1))
                at = at[_marked(held.value[1], run[at])]
                if len(at):
                    rows = np.repeat(line, n)[at]
                    yield pa.RecordBatch.from_arrays([*b.select(list(keep)).take(pa.array(rows)).columns, pa.array((place[at] + 1).astype(np.int32)), pa.array(run[at].view(np.int64))], [*keep, "n", "whole"])

    return lines.select("norm", "k", *keep).mapInArrow(part, ", ".join([*[f"{c} {types[c]}" for c in keep], "n int, whole long"]))
