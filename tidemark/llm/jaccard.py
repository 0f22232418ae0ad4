"""N-gram Jaccard join of whole texts: rare-first prefix filter with length, positional and suffix filters.

Texts of equal words form one class, so copies cost nothing further. A class's shingles stand rarest first; two
classes at the threshold share a shingle within their prefixes. Rarity comes from a count of all shingles in a
fixed number of cells, small enough to broadcast at any size of the corpus; it only orders, so that its
collisions cost time and never a link. The join looks for the components of the link graph: the classes of a prefix
shingle are first compared with one hub, those of a frequent one with several more, and what these links join is not
compared again: a large group of near copies costs a multiple of its members, not of its pairs. Other pairs must pass the
length, positional and suffix filters; every pair left is verified once, on whole shingle sets. A shingle of many
classes is split into blocks, compared block by block in numpy, and a pair is made for its first such shingle only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, lower_ascii, saved, words

CELLS = 1 << 24  # of the rarity count: 16 MB when broadcast
CHUNK = 1 << 16
PARTS = 512  # of the hash range, for the suffix filter: a byte each
FILTER_BITS = 1 << 23
HOT, BLOCK = 20, 1024
HUBS = 32  # of a shingle of more than HOT classes
MIX = np.uint64(0x9E3779B97F4A7C15)
OF = 100


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(flat: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle of a batch; a document of fewer words is one shingle as a whole."""
    h = _mixed(flat.view(np.uint64))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(len(h), np.uint64)
    left = np.repeat(ends, lengths) - np.arange(len(h))
    size = np.repeat(np.minimum(lengths, width), lengths)
    for k in range(width):
        more = np.zeros(len(h), np.uint64)
        more[:max(len(h) - k, 0)] = h[k:]
        out = np.where(k < size, _mixed(out + more + np.uint64(k + 1)), out)
    start = left >= size
    return out[start], doc[start]


def _sets(h: np.ndarray, doc: np.ndarray, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per document, in the order of `level` (rarest first) and hash."""
    order = np.lexsort((h, level[h & np.uint64(CELLS - 1)], doc) if level is not None else (h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _batches(batches, most: int = 500_000):
    """Slices of about `most` words, the hashes of their words and their lengths: memory follows the longest text."""
    for b in batches:
        lengths = b["w"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.diff(np.cumsum(lengths) // most, prepend=-1))
        for a, z in zip(first, np.append(first[1:], len(lengths)), strict=True):
            t = b.slice(a, z - a)
            yield t, t["w"].flatten().to_numpy(zero_copy_only=False), lengths[a:z]


def _classes(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.array([xxhash.xxh3_64_intdigest(flat[e - n:e].tobytes()) for e, n in zip(ends, lengths, strict=True)], np.uint64).view(np.int64)


def _hashed(text: str) -> Column:
    return F.transform(words(lower_ascii(F.col(text))), lambda w: F.xxhash64(w)).alias("w")


def _members(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Per row: the text's hash, class, set size and shingles per part of the hash range; per task: counts of the rarity cells up to 255."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()),
                        ("t", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("parts", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def part(batches):
        cells = np.zeros(CELLS, np.uint8)
        for b, flat, lengths in _batches(batches):
            h, doc = _sets(*shingles(flat, lengths, width))
            cell, k = np.unique((h & np.uint64(CELLS - 1)).astype(np.uint32), return_counts=True)
            cells[cell] = np.minimum(cells[cell] + k, 255)
            n = np.bincount(doc, minlength=len(lengths))
            parts = np.bincount(doc * PARTS + (h >> np.uint64(55)).astype(np.int64), minlength=len(lengths) * PARTS)
            parts = np.minimum(parts, 255).astype(np.uint8).reshape(-1, PARTS)
            yield pa.RecordBatch.from_pydict({"row": b["row"], "doc_id": b["doc_id"], "t": b["t"], "c": _classes(flat, lengths), "n": n,
                                              "parts": [p.tobytes() for p in parts], "chunk": [None] * len(n), "counts": [None] * len(n)}, schema)
        if cells.any():
            low = cells.reshape(-1, CHUNK)
            k, none = len(low), [None] * len(low)
            yield pa.RecordBatch.from_pydict({"row": none, "doc_id": none, "t": none, "c": none, "n": none, "parts": none,
                                              "chunk": np.arange(k, dtype=np.int32), "counts": [zlib.compress(x.tobytes(), 1) for x in low]}, schema)

    return rows.mapInArrow(part, f"row long, doc_id {kind}, t long, c long, n long, parts binary, chunk int, counts binary")


def _levels(counts: DataFrame) -> np.ndarray:
    """Rarity of every cell as a byte: quarter powers of two of its count."""

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint8).astype(np.uint64) for x in b["counts"])
        return pd.DataFrame({"chunk": b["chunk"].iloc[:1], "level": [np.minimum(4 * np.log2(total + 1.0), 255).astype(np.uint8).tobytes()]})

    out = np.zeros(CELLS, np.uint8)
    got = counts.groupBy("chunk").applyInPandas(add, "chunk int, level binary").toArrow()
    for chunk, level in zip(got["chunk"].to_pylist(), got["level"], strict=True):
        out[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(level.as_buffer(), np.uint8)
    return out


def _prefixes(rows: DataFrame, levels, width: int, percent: int) -> DataFrame:
    """token, c, n, pos: the shingles of every class's prefix."""

    def part(batches):
        for _, flat, lengths in _batches(batches):
            h, doc = _sets(*shingles(flat, lengths, width), levels.value)
            n = np.bincount(doc, minlength=len(lengths))
            first = np.cumsum(n) - n
            pos = np.arange(len(h)) - first[doc]
            inside = pos < (n - -(-percent * n // OF) + 1)[doc]
            yield pa.RecordBatch.from_pydict({"token": h[inside].view(np.int64), "c": _classes(flat, lengths)[doc[inside]], "n": n[doc[inside]], "pos": pos[inside]})

    return rows.mapInArrow(part, "token long, c long, n long, pos long")


def _whole_sets(texts: DataFrame, wanted: np.ndarray, width: int) -> tuple[DataFrame, Broadcast]:
    """c and the sorted shingles of the texts (t, text) whose t a bitmap of fixed size lets through: no others are cut into
    words; and the broadcast bitmap."""
    bits = texts.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches):
        for b in batches:
            at = _mixed(b["t"].to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)
            keep = ((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            if keep.any():
                yield b.select(["text"]).filter(pa.array(keep))

    def part(batches):
        for _, flat, lengths in _batches(batches):
            h, doc = _sets(*shingles(flat, lengths, width))
            n = np.bincount(doc, minlength=len(lengths))
            ends = np.cumsum(n)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"c": _classes(flat, lengths)[some], "s": pa.array([h[ends[i] - n[i]:ends[i]].tobytes() for i in some], pa.binary())})

    return texts.mapInArrow(pick, "text string").select(_hashed("text")).mapInArrow(part, "c long, s binary"), bits


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits for a column `t`; sent to the driver as words per cell, at most FILTER_BITS / 64 of them."""

    def part(batches):
        out = np.zeros(FILTER_BITS // 64, np.uint64)
        for b in batches:
            at = _mixed(b["t"].to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(out, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        cell = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"cell": cell, "b": out[cell].view(np.int64)})

    out = np.zeros(FILTER_BITS // 64, np.uint64)
    got = keys.mapInArrow(part, "cell long, b long").groupBy("cell").agg(F.bit_or("b").alias("b")).toArrow()
    out[got["cell"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _verify(pairs: DataFrame, info: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, on whole sets; written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    # One set per class; copies of a class carry equal sets.
    sets, bits = _whole_sets(texts, _bitmap(ends.join(info.select("c", "t"), "c").select("t")), width)
    sets = saved(sets.join(ends, "c", "left_semi").dropDuplicates(["c"]), "sets")
    bits.destroy()
    both = pairs.join(sets.withColumnsRenamed({"c": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"c": "b", "s": "sb"}), "b")

    def part(batches):
        for t in batches:
            ok = []
            for x, y in zip(t["sa"], t["sb"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(OF * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_pydict({"a": t["a"], "b": t["b"]}).filter(pa.array(ok, pa.bool_()))

    links = saved(both.mapInArrow(part, "a long, b long"), "links")
    dropped(sets)
    return links


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that are not the smallest of their component, and that smallest node."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[:len(u)], at[len(u):], np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (up := root[root])).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def _contracted(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges (u, v) that join the same nodes: those of a task, in pieces of about `most`, as stars around their smallest nodes."""

    def part(batches):
        held, n = [], 0

        def stars():
            u, v = _stars(*(np.concatenate([b[k].to_numpy(zero_copy_only=False) for b in held]) for k in ("u", "v")))
            return pa.RecordBatch.from_pydict({"u": u, "v": v})

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.mapInArrow(part, "u long, v long")


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars: every node above one other at most, and then under none."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("s"))
    return ends.groupBy("s.x").agg(F.sum("s.up").alias("up"), F.max("s.down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node and root (the component's smallest node) from edges (a, b) and the components of earlier edges: large and small
    stars in turn, after each of which the edges of a task are contracted, until all edges are stars."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = saved(_contracted((e.union(known.select("node", "root")) if known is not None else e).filter("u > v").distinct()), "edges")
    while not _settled(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = saved(_contracted(small.filter("u > v").distinct()), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _alpha(n: str, m: str, percent: int) -> str:
    """Shared shingles that sets of these sizes need."""
    return f"ceil({percent} * ({n} + {m}) / {percent + OF}D)"


def _bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Suffix filter: two sets share at most the smaller count in every part of the hash range."""
    m = np.minimum(x, y)
    # A count at the type's end stands for any larger one, and then bounds nothing.
    return m.sum(axis=1, dtype=np.int64) + (m == 255).any(axis=1) * (1 << 40)


def _suffix(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the suffix filter leaves."""
    side = lambda k: info.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("parts").alias(f"p{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def part(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t[k].to_pylist()), np.uint8).reshape(-1, PARTS) for k in ("pa", "pb"))
            need = np.ceil(percent * (t["na"].to_numpy() + t["nb"].to_numpy()) / (percent + OF))
            yield pa.RecordBatch.from_pydict({"a": t["a"], "b": t["b"]}).filter(pa.array(_bound(x, y) >= need))

    return both.mapInArrow(part, "a long, b long")


def _block_pairs(b: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one hot shingle and two of its blocks (or one) that the filters leave."""
    token, i, j = b["token"].iloc[0], b["i"].iloc[0], b["j"].iloc[0]
    x, y = b[b["block"] == i], b[b["block"] == j]
    parts = lambda t: np.frombuffer(b"".join(t["parts"]), np.uint8).reshape(-1, PARTS)
    px, py, early = parts(x), parts(y), {}
    for t in (x, y):
        for r in t["hot"]:
            for h in r:
                if h < token:
                    early.setdefault(h, len(early))

    def incidence(t: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(t), len(early) + 1), np.float32)
        for k, r in enumerate(t["hot"]):
            out[k, [early[h] for h in r if h < token]] = 1
        return out

    fx, fy = incidence(x), incidence(y)
    col = lambda t, k: t[k].to_numpy()
    for k in range(len(x)):
        n, m, p, q = x["n"].iloc[k], col(y, "n"), x["pos"].iloc[k], col(y, "pos")
        need = np.ceil(percent * (n + m) / (percent + OF))
        ok = (col(y, "root") != x["root"].iloc[k]) & (OF * np.minimum(n, m) >= percent * np.maximum(n, m))
        ok &= np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1) >= need
        if i == j:
            ok[:k + 1] = False
        at = np.flatnonzero(ok)
        at = at[fy[at] @ fx[k] == 0]
        at = at[_bound(py[at], px[k:k + 1]) >= need[at]]
        for o in at:
            yield x["c"].iloc[k], y["c"].iloc[o]


def _rooted(live: DataFrame, roots: DataFrame) -> DataFrame:
    return live.drop("root").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _more_hubs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs of a frequent shingle's classes with HUBS of them that are not linked yet and that length and position allow.

    Classes stand in one hashed order for all shingles, so that shingles of one group mostly choose the same hubs.
    """
    hot = live.filter(f"g > {HOT}")
    order = F.xxhash64("c", F.lit("hub"))
    hubs = hot.groupBy("token", F.pmod(order, F.lit(HUBS)).alias("k")).agg(F.min(F.struct(order.alias("o"), "c", "n", "pos", "root")).alias("h"))
    both = hot.join(hubs.select("token", F.col("h.c").alias("hub"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos"), F.col("h.root").alias("hroot")), "token")
    both = both.filter(f"root <> hroot and {OF} * least(n, hn) >= {percent} * greatest(n, hn) "
                       f"and least(pos, hpos) + 1 + least(n - pos - 1, hn - hpos - 1) >= {_alpha('n', 'hn', percent)}")
    return both.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()


def _hot_pairs(live: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs from shingles of more than HOT classes, block by block."""
    hot = live.filter(f"g > {HOT}")
    own = hot.groupBy("c").agg(F.collect_list("token").alias("hot"))  # within one text's prefix
    blocks = F.ceil(F.col("g") / BLOCK)
    cut = hot.join(own, "c").join(info.select("c", "parts"), "c").withColumn("block", F.pmod(F.xxhash64("c"), blocks))
    dealt = cut.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumns(
        {"i": F.least("block", "k"), "j": F.greatest("block", "k")})

    def part(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_block_pairs(b, percent)), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("token", "i", "j").applyInPandas(part, "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, row_col: str | None = None) -> DataFrame:
    """Per row: row (`row_col`, else made here), doc_id, n_shingles, component_id (the smallest doc_id of its component)
    and root (equal within a component and nowhere else).

    Texts link when their sets of `width`-word shingles share `percent` of their union or more.

    A text without words has an empty set, links with nothing and is its own component; a null id never is the
    smallest unless all are null. Repeated rows and copies are one class. Empty tables give no rows; other columns
    are not read. Texts are used whole: a long text's prefix grows with it. Equal 64-bit hashes stand for equal
    words, shingles and texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("t"), _hashed(text_col))
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    first = saved(_members(rows, width, kind), "members")
    members = first.filter("chunk is null").select("row", "doc_id", "t", "c", "n", "parts")
    info = saved(members.filter("n > 0").select("c", "t", "n", "parts").dropDuplicates(["c"]), "classes")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(first.filter("chunk is not null").select("chunk", "counts")))
    prefix = saved(_prefixes(rows.select("w"), levels, width, percent), "prefixes")
    levels.destroy()
    # Copies repeat the rows of their class; a token of one class alone makes no pair.
    sizes = saved(prefix.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token"), "tokens")
    live = saved(prefix.join(sizes, "token", "left_semi").dropDuplicates(["token", "c"]), "live")
    dropped(prefix, sizes)
    hubs = live.groupBy("token").agg(F.count("*").alias("g"), F.min(F.struct("n", "c", "pos")).alias("h"))
    hubs = saved(hubs.select("token", "g", F.col("h.n").alias("hn"), F.col("h.c").alias("hub"), F.col("h.pos").alias("hpos")), "hubs")
    # Written with their hub and number of classes, so that no later step joins them again.
    alone, live = live, saved(live.join(hubs, "token"), "live")
    dropped(alone, hubs)
    star = live.filter(
        f"c <> hub and {OF} * hn >= {percent} * n and least(pos, hpos) + 1 + least(n - pos - 1, hn - hpos - 1) >= {_alpha('n', 'hn', percent)}")
    star = saved(star.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct(), "star")
    begun = saved(_suffix(star, info, percent), "pairs")
    near = _verify(begun, info, texts, width, percent)
    roots = components(near)
    hubbed, live = live, saved(_rooted(live.drop("hub", "hn", "hpos"), roots), "rooted")
    dropped(hubbed)
    more = saved(_suffix(_more_hubs(live, percent).join(star, ["a", "b"], "left_anti"), info, percent), "more")
    near = _verify(more, info, texts, width, percent)
    roots = components(near, roots)
    first_rooted, live = live, saved(_rooted(live, roots), "rooted")
    dropped(first_rooted)
    few = live.filter(f"g <= {HOT}")
    other = few.select("token", *[F.col(k).alias(f"{k}2") for k in ("c", "n", "pos", "root")])
    pairs = few.join(other, "token").filter(
        f"c < c2 and root <> root2 and {OF} * least(n, n2) >= {percent} * greatest(n, n2) "
        f"and least(pos, pos2) + 1 + least(n - pos - 1, n2 - pos2 - 1) >= {_alpha('n', 'n2', percent)}")
    pairs = _suffix(pairs.select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct(), info, percent)
    hot = _hot_pairs(live, info, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = saved(pairs.union(hot).distinct().join(star.union(more), ["a", "b"], "left_anti"), "pairs")
    far = _verify(rest, info, texts, width, percent)
    dropped(live, star, begun, more, rest, info)
    roots = components(far, roots)
    top = members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "c")).otherwise(F.col("row")))
    # Written first, so that the join can be split where a component is very large.
    least = saved(top.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return top.join(least, "root", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.struct(F.col("n") > 0, "root").alias("root"))


def op4_query(docs: DataFrame) -> DataFrame:
    return link_components(docs).drop("row", "root")
