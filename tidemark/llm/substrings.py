"""Substring dedup: words covered by a window that starts anywhere else too are removed.

Matching statistics come from suffix automata of reference shards. All texts are the reference here, so the shards are
cut by content: every window of words has an anchor, the word run of least hash in it, and equal windows have equal
anchors. Runs of windows about one anchor that occur alike twice are repeated as they are; only where an anchor
occurs in different surroundings are these surroundings put into one automaton, and matched against it. An anchor
of more surroundings than one automaton should hold is split further, by window.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, saved, slices, words
from tidemark.llm.jaccard import FILTER_BITS, _batches, _bitmap, _mixed

ANCHOR = 8
#: Surroundings of one anchor beyond which its windows are compared one by one, spread over tasks.
HOT = 2_000
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


class SuffixAutomaton:
    """Of several sequences, with the number of occurrences of every subsequence."""

    def __init__(self):
        self.size, self.link, self.next, self.count = [0], [-1], [{}], [0]

    def _new(self, size: int, link: int, follow: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(follow)
        self.count.append(0)
        return len(self.size) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The part of state q that follows p by c, as a state of its own."""
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, items, times: int = 1) -> None:
        last = 0
        for c in items:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
            else:
                last = self._new(self.size[p] + 1, 0, {})
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[last] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
            self.count[last] += times

    def finish(self) -> None:
        """Occurrences of a state include those of the states whose suffix it is."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def matches(self, items, window: int):
        """For every end of a window in a sequence: how often the window occurs among the added sequences."""
        s = n = 0
        for k, c in enumerate(items):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            while s and self.size[self.link[s]] >= window:
                s = self.link[s]
                n = self.size[s]
            if k >= window - 1:
                yield self.count[s] if n >= window else 0


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in every window of `width`."""
    value, pos, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:len(value) - step], value[step:]
        later = b < a
        value, pos = np.where(later, b, a), np.where(later, pos[step:], pos[:len(pos) - step])
        have += step
    return pos


def _runs(rows: DataFrame, window: int) -> DataFrame:
    """row, first and n (windows), anchor and content hash of every run of windows about one anchor."""

    def part(batches):
        for b, flat, lengths in _batches(batches):
            h = _mixed(flat.view(np.uint64))
            total = len(h)
            if total < window:
                continue
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(total, BASE)]))
            back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(total, UNBASE)]))
            prefix = np.concatenate([[np.uint64(0)], np.add.accumulate(h * power[:total])])
            of = lambda a, z: _mixed((prefix[z] - prefix[a]) * back[a])  # noqa: E731  the same for equal words anywhere
            at = np.arange(total - ANCHOR + 1)
            gram = of(at, at + ANCHOR)
            anchor = _least(gram, window - ANCHOR + 1)
            ends = np.cumsum(lengths)
            doc = np.repeat(np.arange(len(lengths)), lengths)[:len(anchor)]
            start = np.flatnonzero(np.arange(len(anchor)) + window <= ends[doc])
            if not len(start):
                continue
            anchor, doc = anchor[start], doc[start]
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            i = np.flatnonzero(new)
            n = np.diff(np.append(i, len(start)))
            a, d = start[i], doc[i]
            key = gram[anchor[i]]
            content = _mixed(of(a, a + n + window - 1) + key * BASE + (anchor[i] - a).astype(np.uint64) * UNBASE + n.astype(np.uint64))
            yield pa.RecordBatch.from_pydict({"row": b["row"].take(pa.array(d)), "first": (a - (ends - lengths)[d]).astype(np.int32), "n": n.astype(np.int32),
                                              "anchor": key.view(np.int64), "content": content.view(np.int64)})

    return rows.mapInArrow(part, "row long, first int, n int, anchor long, content long")


def _surroundings(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, content, times, n, hot and the words (joined by spaces) of the wanted runs; wanted: row, runs."""
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.col("row").alias("t"))))

    def some(batches):
        for b in batches:
            at = _mixed(b["row"].to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)
            yield b.filter(pa.array(((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)))

    word = re.compile(WORD)

    def part(batches):
        for b in slices(batches, "text"):
            out = []
            for text, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True):
                ws = word.findall(text)
                out += [{**r, "words": " ".join(ws[r["first"]:r["first"] + r["n"] + window - 1])} for r in runs]
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[k:k + 10_000], schema)

    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("times", pa.int64()), ("n", pa.int32()), ("hot", pa.bool_()), ("words", pa.string())])
    texts = rows.select("row", "text").mapInArrow(some, "row long, text string")
    return texts.join(wanted, "row").select("text", "runs").mapInArrow(part, "anchor long, content long, times long, n int, hot boolean, words string")


def _by_automaton(parts: DataFrame, window: int) -> DataFrame:
    """content and mask (bit k: its window k occurs twice or more) from one automaton per anchor."""

    def group(rows: list[dict]):
        sam, seqs = SuffixAutomaton(), [r["words"].split(" ") for r in rows]
        for r, s in zip(rows, seqs, strict=True):
            sam.add(s, r["times"])
        sam.finish()
        for r, s in zip(rows, seqs, strict=True):
            yield r["content"], sum(1 << k for k, times in enumerate(sam.matches(s, window)) if times > 1)

    def part(batches):
        own: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if own and own[0]["anchor"] != r["anchor"]:
                    out += group(own)
                    own = []
                own.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["content", "mask"])
        out = list(group(own)) if own else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["content", "mask"])

    cols = parts.select("anchor", "content", "times", "words")
    return cols.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(part, "content long, mask long")


def _by_window(parts: DataFrame, window: int) -> DataFrame:
    """The same for anchors in too many surroundings: windows meet by their words."""
    ws = F.split("words", " ")
    each = parts.select("content", "times", ws.alias("w"), F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("k", "at"))
    each = each.select("content", "times", "k", F.md5(F.array_join(F.slice("w", F.col("at"), window), " ").cast("binary")).alias("window"))
    twice = each.groupBy("window").agg(F.sum("times").alias("t")).filter("t > 1").select("window")
    return each.join(twice, "window").groupBy("content").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))


def repeated_windows(rows: DataFrame, window: int = 35, hot: int | None = None) -> DataFrame:
    """row, first and mask of every run with a repeated window; `rows` has row, text and w (hashes of its words)."""
    if not ANCHOR < window <= ANCHOR + 62:
        raise ValueError("a run of windows must fit the bits of a mask")
    runs = saved(_runs(rows, window), "runs")
    # Written first: a join right above an aggregate could not be split where an anchor is very common.
    again = saved(runs.groupBy("anchor").agg(F.count("*").alias("t")).filter("t > 1").select("anchor"), "again")
    live = saved(runs.join(again, "anchor", "left_semi"), "live")
    contents = live.groupBy("anchor", "content", "n").agg(F.count("*").alias("times"), F.min(F.struct("row", "first")).alias("x"))
    several = contents.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    mixed = saved(contents.join(several, "anchor").withColumn("hot", F.col("m") > (HOT if hot is None else hot)), "mixed")
    wanted = mixed.select("x.row", F.struct("anchor", "content", "times", "n", "hot", "x.first").alias("r")).groupBy("row").agg(F.collect_list("r").alias("runs"))
    parts = saved(_surroundings(rows, saved(wanted, "wanted"), window), "parts")
    masks = _by_automaton(parts.filter("not hot"), window).union(_by_window(parts.filter("hot"), window)).filter("mask <> 0")
    # An anchor in one surrounding only: all of its windows occur as often as it does.
    whole = live.groupBy("anchor", "content", "n").agg(F.count("*").alias("times")).join(several, "anchor", "left_anti").filter("times > 1")
    full = whole.select("content", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    return live.select("row", "first", "content").join(saved(masks.union(full), "masks"), "content").drop("content")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, hot: int | None = None) -> DataFrame:
    """Per row: row, doc_id, n_words, n_removed, spans (first-last of removed words, comma-joined) and kept (text).

    A null or short text has no window and loses nothing; a repeated row repeats all windows of its text; an empty
    table gives no rows. Nulls in the id and other columns do not matter; ids may have any type. Texts are used whole. Runs meet by 64-bit
    hashes of anchor and content, windows of one automaton by their words.
    """
    # Written once: a number made in a scan changes with the scan. Hashes are made again from the text of that table.
    numbered = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "numbered")
    rows = numbered.withColumn("w", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    found = repeated_windows(rows.select("row", "text", "w"), window, hot).groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("runs"))
    kind, word = docs.schema[id_col].dataType.simpleString(), re.compile(WORD)
    made = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.string()), ("kept", pa.string())])

    def part(batches):
        for b in slices(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in made}
            for text, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True):
                ws, edges = word.findall(text), None
                if runs:
                    edges = np.zeros(len(ws) + 1, np.int64)
                    for r in runs:
                        for k in range(r["mask"].bit_length()):
                            if r["mask"] >> k & 1:
                                edges[r["first"] + k] += 1
                                edges[r["first"] + k + window] -= 1
                gone = np.cumsum(edges[:-1]) > 0 if runs else np.zeros(len(ws), bool)
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = " ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if runs else ws)
                for c, v in zip(out, (len(ws), int(gone.sum()), ",".join(f"{a}-{z - 1}" for a, z in turn.reshape(-1, 2)), kept), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], *[pa.array(out[f.name], f.type) for f in made]], ["row", "doc_id", *made.names])

    joined = rows.select("row", "doc_id", "text").join(found, "row", "left")
    return joined.mapInArrow(part, f"row long, doc_id {kind}, n_words long, n_removed long, spans string, kept string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op7_query(docs: DataFrame) -> DataFrame:
    out = drop_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
