"""Periodic runs of words: stretches that repeat with a smallest period, at least twice over.

Baier's first suffix-sorting phase groups suffixes from the highest group down; a suffix that is moved next to a group
takes over that group's context, and when no group is left the context of a suffix is the longest Lyndon word that
starts there. Done under an order of the words and under its inverse, this gives two Lyndon arrays. Every run has a
Lyndon root in one of them, and a root is extended to its run by the longest common extensions (LCE) of its two ends.

A word of a run of at least 12 words and two periods lies in a sequence of six words that occurs again in the text
(`GRAM`), so only stretches of such words are sorted, and runs never leave their stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, slices, words

#: Runs of fewer words are not reported.
MIN_LENGTH = 12
GRAM = 6
#: Bytes of text that a task works on at once; a longer text is a piece of its own.
SLICE = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(text: list[int], inverse: bool = False) -> list[int]:
    """Length of the longest Lyndon word from each position, under the order of the values or its inverse."""
    n = len(text)
    low_to_high = sorted(set(text), reverse=inverse)
    name = {c: g for g, c in enumerate(low_to_high)}
    group = [name[c] for c in text]
    members: list[list[int]] = [[] for _ in low_to_high]
    for i, g in enumerate(group):
        members[g].append(i)
    context = [1] * len(low_to_high)
    below = [g - 1 for g in range(len(low_to_high))]
    above = [g + 1 for g in range(len(low_to_high))]
    out = [0] * n
    left = list(range(-1, n - 1))  # towards the nearest position on the left that is in a lower group
    g = len(low_to_high) - 1
    above[g:] = [-1]
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        size = context[g]
        for i in mine:
            out[i] = size
        times: dict[int, int] = {}
        for i in mine:
            j = left[i]
            while j >= 0 and out[j]:
                j = left[j]
            k = i
            while left[k] != j:  # shorten the path just walked
                left[k], k = j, left[k]
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            moved.setdefault((k, group[j]), []).append(j)
        for k, h in sorted(moved, reverse=True):
            new = len(members)
            members.append(moved[k, h])
            context.append(context[h] + k * size)
            for j in moved[k, h]:
                group[j] = new
            up = above[h]
            below.append(h)
            above.append(up)
            above[h] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions by names of all blocks of 1, 2, 4, ... values; exact."""

    def __init__(self, text: np.ndarray, longest: int):
        self.n, self.names = len(text), [np.unique(text, return_inverse=True)[1]]
        size = 1
        while 2 * size <= min(longest, self.n):
            last = self.names[-1]
            pair = last[:len(last) - size].astype(np.int64) * (int(last.max()) + 1) + last[size:]
            u, names = np.unique(pair, return_inverse=True)
            if len(u) == len(pair):  # no block of this length occurs twice
                break
            self.names.append(names)
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the values from i and from j > i agree."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            inside = np.flatnonzero(j + out < len(names))
            a = inside[names[i[inside] + out[inside]] == names[j[inside] + out[inside]]]
            out[a] += 1 << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the values before i and before j > i agree."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            inside = np.flatnonzero(i - out >= size)
            a = inside[names[i[inside] - out[inside] - size] == names[j[inside] - out[inside] - size]]
            out[a] += size
        return out


def stretches(text: np.ndarray, doc: np.ndarray, lengths: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions and ends of the stretches of words that may be in a run of `min_length` words.

    With sequences of min(6, min_length // 2) words, those of a run occur again a period on or back. Two sequences of
    the same hash count as equal, which may keep a word too many, never one too few.
    """
    size = max(1, min(GRAM, min_length // 2))
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.flatnonzero(place + size <= lengths[doc])
    h = doc[inside].astype(np.uint64)
    for k in range(size):
        h = h * BASE + text[inside + k].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(32)
    order = np.argsort(h)
    twice = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    starts = inside[np.unique(np.concatenate([order[twice], order[twice + 1]]))]
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    held = np.cumsum(step)[:-1] > 0
    edge = np.ones(len(text) + 1, bool)  # between documents, stretches end
    edge[1:-1] = (held[1:] != held[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(edge)
    a, z = cut[:-1], cut[1:]
    keep = held[a] & (z - a >= min_length) if len(a) else np.zeros(0, bool)
    return a[keep], z[keep]


def runs_of(text: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs of several documents, laid end to end: rows of document, start, length, period, in that order."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if not len(text):
        return np.zeros((0, 4), np.int64)
    first, end = stretches(text, doc, lengths, min_length)
    if not len(first):
        return np.zeros((0, 4), np.int64)
    size = end - first
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())  # place in the whole text
    held = text[at]
    low = np.repeat(np.cumsum(size) - size, size)
    high = np.repeat(np.cumsum(size), size)
    lce = Extensions(held, int(size.max()))
    found = []
    for inverse in (False, True):
        root = np.concatenate([np.array(lyndon_array(text[a:z].tolist(), inverse), np.int64) for a, z in zip(first, end, strict=True)])
        i = np.arange(len(held))
        k = np.flatnonzero(i + root < high)  # a root at the very end has no word after it, one before it may repeat
        right = np.zeros(len(held), np.int64)
        right[k] = np.minimum(lce.forward(k, k + root[k]), high[k] - k - root[k])
        left = np.minimum(lce.backward(i, i + root), i - low)
        length = left + root + right
        good = length >= np.maximum(min_length, 2 * root)
        start = (i - left)[good]
        found.append(np.stack([doc[at[start]], at[start], length[good], root[good]], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    found[:, 1] -= (np.cumsum(lengths) - lengths)[found[:, 0]]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then n_words, `runs` (start, length, period by start, then period; words from 0) and
    `collapsed`, the text without the words that a run holds after its first period, joined by one space.

    One scan without a shuffle; the memory of a task follows its longest text. A null text counts as empty: no words, no
    runs, an empty `collapsed`. Repeated rows are rows like others; kept columns named like a result get "in_" before
    their names.
    """
    held = [f"k{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, held, strict=True)], F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def part(batches):
        for b in slices(batches, "text", SLICE):
            texts = [(t or b"").split() for t in b["text"].to_pylist()]  # bytes split at exactly these six characters
            lengths = np.array([len(t) for t in texts], np.int64)
            ids = np.zeros(int(lengths.sum()), np.int64)
            at = 0
            for t in texts:
                seen: dict[bytes, int] = {}
                ids[at:at + len(t)] = [seen.setdefault(w, len(seen)) for w in t]
                at += len(t)
            runs = runs_of(ids, lengths, min_length)
            cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            for k in np.unique(runs[:, 0]).tolist():
                drop = np.zeros(len(texts[k]) + 1, np.int64)
                mine = runs[cut[k]:cut[k + 1]]
                np.add.at(drop, mine[:, 1] + mine[:, 3], 1)
                np.add.at(drop, mine[:, 1] + mine[:, 2], -1)
                texts[k] = [texts[k][i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
            each = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(one))
            yield pa.RecordBatch.from_arrays(
                [*[b[n] for n in held], pa.array(lengths), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), each), pa.array([b" ".join(t) for t in texts], pa.binary())],
                names=[*held, "n_words", "runs", "collapsed"])

    types = dict(rows.dtypes)
    out = rows.mapInArrow(part, ", ".join([*[f"{n} {types[n]}" for n in held], "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"]))
    made = ("n_words", "runs", "collapsed")
    names = [f"in_{c}" if c in made else c for c in keep]
    return out.select(*[F.col(n).alias(c) for n, c in zip(held, names, strict=True)], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def periodic_tails(doc_id: Column, text: Column) -> Column:
    """The text of op13's contract: a tenth of the documents repeat a part of theirs to their end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    return F.when(h % 10 == 0, F.when(F.size(words(text)) > 0, let(words(text), repeated)).otherwise(text)).otherwise(text)


def op13_query(docs: DataFrame) -> DataFrame:
    """One row per document, its number of runs, its longest run and digests of all runs and of the words kept.

    A null doc_id changes no words; null and empty texts have no runs and the digests of empty strings.
    """
    rows = docs.select("doc_id", periodic_tails(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = find_runs(rows).select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
