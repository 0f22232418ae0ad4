"""LM scoring: a causal self-attention model in numpy on subword ids, and a word unigram base score.

The model has one attention layer. Its softmax is factored: the layer predicts a class of subwords, and then, by a
binary tree with weights of its own at every node, the subword within the class. As there is one layer, queries, keys
and values are tables by subword id, made once after training. A text is cut into overlapping windows; every token is
scored in one window, after the first one with `CONTEXT` tokens before it at least.

All training texts are learned from: every task takes its part of them from a common start, and the tasks' tables are
averaged by how often each of their rows was used.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, remainder, saved, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
WINDOW, CONTEXT = 32, 8
STEP = WINDOW - CONTEXT
WIDTH, HEAD, CLASSES = 16, 8, 64
#: Training goes over the texts again until it has seen so many subwords, but at most `PASSES` times.
LEAST_SEEN, PASSES = 2_000_000, 4
#: Rows that Spark hands to a task's Python at once, and distinct words that a task holds before it sends their counts.
ROWS, HELD = 500, 500_000
#: Word counts of at least N / FREQUENT are looked up in the scan: at most FREQUENT words, whatever the corpus.
FREQUENT = 1_000_000


@lru_cache(2)
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all texts in a row, an end id after each, and the lengths with it."""
    enc = tokenizer(path)
    end = np.array([enc.n_vocab], np.int64)
    parts = [x for t in texts for x in (np.asarray(enc.encode_ordinary(t), np.int64), end)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array([len(a) + 1 for a in parts[::2]], np.int64)


class Tree(NamedTuple):
    """A binary tree of the ids of every class: the nodes above an id are those from `first` on, `steps` of them."""

    of: np.ndarray  # class of each id
    first: np.ndarray
    steps: np.ndarray
    node: np.ndarray
    side: np.ndarray  # 1 where the id is on the right, else -1
    odds: np.ndarray  # per node: log odds of its right side by the counts


class Model(NamedTuple):
    """Tables by subword id; the last id but one ends a text, the last one begins it (never predicted)."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    direct: np.ndarray
    pos_q: np.ndarray
    pos_k: np.ndarray
    pos_v: np.ndarray
    pos_direct: np.ndarray
    mix: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    nodes: np.ndarray  # weights and bias of every node
    of: np.ndarray  # class of each id
    tree: Tree


PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Scores and logits are held within these bounds, so that exponentials need no shift.
LEAST, MOST = np.float32(-60), np.float32(60)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: its text, its start in the text and the first position that it scores."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STEP))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, k * STEP, np.where(k > 0, CONTEXT, 0)


def log_probs(m: Model, ids: np.ndarray, lengths: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Natural log probability of every text: every id given those before it."""
    begin = len(m.of) - 1
    base = np.cumsum(lengths) - lengths
    doc, start, skip = windows(lengths)
    given = np.concatenate([[begin], ids[:-1]]) if len(ids) else ids
    given[base] = begin
    out = np.zeros(len(lengths))
    at = np.arange(WINDOW)
    # A last value of one sums the weights in the same product.
    v, pos_v = np.pad(m.v, ((0, 0), (0, 1)), constant_values=1), np.pad(m.pos_v, ((0, 0), (0, 1)))
    ones = np.ones(CLASSES, np.float32)
    for a in range(0, len(doc), chunk):
        d = doc[a:a + chunk]
        pos = start[a:a + chunk, None] + at
        inside = pos < lengths[d][:, None]
        flat = base[d][:, None] + np.minimum(pos, lengths[d][:, None] - 1)
        x = given[flat]
        s = np.matmul(_rows(m.q, x) + m.pos_q, (_rows(m.k, x) + m.pos_k).transpose(0, 2, 1))
        np.clip(s, LEAST, MOST, out=s)
        np.exp(s, out=s)
        s *= PAST
        h = np.matmul(s, _rows(v, x) + pos_v)
        own, p = np.nonzero(inside & (at >= skip[a:a + chunk, None]))
        h = h[own, p]
        h = (h[:, :-1] / h[:, -1:]) @ m.mix
        h += _rows(m.direct, x[own, p])
        h += _rows(m.pos_direct, p)
        logit = h @ m.out + m.bias
        np.clip(logit, LEAST, MOST, out=logit)
        y = ids[flat[own, p]]
        c = m.of[y]
        lp = logit[np.arange(len(c)), c].astype(np.float64)
        own_of, node, side = steps(m.tree, y)
        lp -= np.bincount(own_of, np.log1p(np.exp(-side * node_logits(m.nodes, node, _rows(h, own_of)))), minlength=len(c))
        lp -= np.log(np.exp(logit, out=logit) @ ones)
        out += np.bincount(d[own], lp, minlength=len(out))
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Classes of about equal mass along falling counts."""
    c = counts + 1.0
    order = np.argsort(-c, kind="stable")
    mass = np.cumsum(c[order]) - c[order] / 2
    of = np.empty(len(c), np.int64)
    of[order] = np.minimum(mass / c.sum() * CLASSES, CLASSES - 1).astype(np.int64)
    return of


def grown(counts: np.ndarray) -> Tree:
    """Huffman trees of the classes; by their odds alone, ids follow their counts, smoothed by one."""
    of, c, size = classes(counts), counts + 1.0, len(counts)
    up, right, odds = np.full(2 * size, -1), np.zeros(2 * size, bool), []
    for k in range(CLASSES):
        heap = [(c[i], i) for i in np.flatnonzero(of == k).tolist()]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i), (b, j), n = heapq.heappop(heap), heapq.heappop(heap), size + len(odds)
            up[i], up[j], right[j] = n, n, True
            odds.append(np.log(b / a))
            heapq.heappush(heap, (a + b, n))
    ids, at, parts = np.arange(size), np.arange(size), []
    while len(ids := ids[more := up[at] >= 0]):
        at = at[more]
        parts.append((ids, up[at] - size, np.where(right[at], 1, -1)))
        at = up[at]
    own, node, side = (np.concatenate([p[k] for p in parts] or [np.zeros(0, int)]) for k in range(3))
    order, n = np.argsort(own, kind="stable"), np.bincount(own, minlength=size)
    return Tree(of, np.cumsum(n) - n, n, node[order].astype(np.int32), side[order].astype(np.float32), np.array(odds))


def steps(tree: Tree, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every step from an id of `y` up its tree: the position in `y`, the node and the side."""
    n = tree.steps[y]
    own = np.repeat(np.arange(len(y)), n)
    at = np.repeat(tree.first[y] - (np.cumsum(n) - n), n) + np.arange(len(own))
    return own, tree.node[at], tree.side[at]


def node_logits(nodes: np.ndarray, node: np.ndarray, h: np.ndarray) -> np.ndarray:
    w = _rows(nodes, node)
    return np.clip(np.einsum("ij,ij->i", h, w[:, :-1]) + w[:, -1], LEAST, MOST)


def start(counts: np.ndarray, tree: Tree, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training; ids that no training text holds have no embedding."""
    g, size = np.random.default_rng(seed), len(counts)
    p = {"E": g.normal(0, 0.3, (size + 1, WIDTH)), "P": g.normal(0, 0.1, (WINDOW, WIDTH)), "Q": g.normal(0, 0.3, (WIDTH, HEAD)), "K": g.normal(0, 0.3, (WIDTH, HEAD)),
         "V": g.normal(0, 0.3, (WIDTH, HEAD)), "O": g.normal(0, 0.1, (HEAD, WIDTH)), "U": g.normal(0, 0.1, (WIDTH, CLASSES))}
    p["E"][:-1][counts == 0] = 0
    p["b"] = np.log(np.maximum(np.bincount(tree.of, counts + 1.0, minlength=CLASSES) / (counts + 1.0).sum(), 1e-9))
    p["T"] = np.hstack([np.zeros((len(tree.odds), WIDTH)), tree.odds[:, None]])
    return {k: v.astype(np.float32) for k, v in p.items()}


SPARSE = ("E", "T")


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table; the places are known to lie inside."""
    return np.take(table, at, axis=0, mode="clip")


def _sums(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and the sums of their rows."""
    if not len(key):
        return key, key, rows
    # Short keys are sorted by radix.
    order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(np.append(first, len(key))), np.add.reduceat(_rows(rows, order), first)


class Learner:
    """Adam on the cross-entropy of subwords over windows; `used` counts the uses of every row of a table."""

    def __init__(self, p: dict[str, np.ndarray], tree: Tree, batch: int = 128, rate: float = 0.01, seed: int = 5):
        self.p, self.tree, self.batch, self.rate, self.t = {k: v.copy() for k, v in p.items()}, tree, batch, rate, 0
        self.mean, self.var = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.used = {k: np.zeros(len(p[k]) if k in SPARSE else 1) for k in p}
        self.g = np.random.default_rng(seed)

    def learn(self, ids: np.ndarray, lengths: np.ndarray, epochs: int = 1, most: int | None = None) -> None:
        """Every token of the texts is predicted once an epoch, unless there are more than `most` windows."""
        if not len(ids):
            return
        begin = len(self.p["E"]) - 1
        base, n = np.cumsum(lengths) - lengths, -(-lengths // WINDOW)
        doc = np.repeat(np.arange(len(lengths)), n)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        given = np.concatenate([[begin], ids[:-1]])
        given[base] = begin
        pick = np.sort(self.g.permutation(len(doc))[:most])
        for _ in range(epochs):
            self.g.shuffle(pick)
            for a in range(0, len(pick), self.batch):
                w = pick[a:a + self.batch]
                pos, long = first[w, None] + np.arange(WINDOW), lengths[doc[w]][:, None]
                flat = base[doc[w]][:, None] + np.minimum(pos, long - 1)
                self._step(given[flat], ids[flat], pos < long)

    def _step(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> None:
        p, scale, rows = self.p, np.float32(HEAD ** -0.5), lambda m: m.reshape(-1, m.shape[-1])
        e = _rows(p["E"], x) + p["P"]
        by = lambda m, w: (rows(m) @ w).reshape(*m.shape[:-1], w.shape[1])  # noqa: E731  one product, not one a window
        q, k, v = by(e, p["Q"]), by(e, p["K"]), by(e, p["V"])
        s = np.matmul(q * scale, k.transpose(0, 2, 1))
        np.clip(s, LEAST, MOST, out=s)
        np.exp(s, out=s)
        s *= PAST
        s /= by(s, np.ones((WINDOW, 1), np.float32))
        o = np.matmul(s, v)
        own = np.flatnonzero(inside.reshape(-1))
        h, y, share = _rows(rows(e + by(o, p["O"])), own), y.reshape(-1)[own], np.float32(1 / len(own))
        z = h @ p["U"] + p["b"]
        np.clip(z, LEAST, MOST, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(CLASSES, np.float32))[:, None]
        z[np.arange(len(y)), self.tree.of[y]] -= 1
        z *= share
        of, node, side = steps(self.tree, y)
        above = _rows(h, of)
        d = (-side * share / (1 + np.exp(side * node_logits(p["T"], node, above)))).astype(np.float32)
        back = z @ p["U"].T
        if len(of):
            down = _rows(p["T"], node)[:, :-1] * d[:, None]
            cell = (of * WIDTH)[:, None] + np.arange(WIDTH)
            back += np.bincount(cell.reshape(-1), down.reshape(-1), back.size).reshape(back.shape)
        dh = np.zeros((x.size, WIDTH), np.float32)
        dh[own] = back
        dh = dh.reshape(*x.shape, WIDTH)
        do = by(dh, p["O"].T)
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds -= np.einsum("bij,bij->bi", ds, s)[..., None]
        ds *= s
        ds *= scale
        dq, dk, dv = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(s.transpose(0, 2, 1), do)
        de = dh + by(dq, p["Q"].T) + by(dk, p["K"].T) + by(dv, p["V"].T)
        grad = {"U": h.T @ z, "b": z.sum(0), "O": rows(o).T @ rows(dh), "Q": rows(e).T @ rows(dq), "K": rows(e).T @ rows(dk), "V": rows(e).T @ rows(dv), "P": de.sum(0)}
        at = {}
        for name, key, g in (("E", x.reshape(-1), rows(de)), ("T", node, np.hstack([d[:, None] * above, d[:, None]]))):
            at[name], n, grad[name] = _sums(key, g)
            self.used[name][at[name]] += n
        self.t += 1
        for name, g in grad.items():
            i = at.get(name, slice(None))
            of_rows = _rows if name in SPARSE else lambda table, _: table
            if name not in SPARSE:
                self.used[name] += len(x)
            mean = self.mean[name][i] = 0.9 * of_rows(self.mean[name], i) + 0.1 * g
            var = self.var[name][i] = 0.99 * of_rows(self.var[name], i) + 0.01 * g * g
            p[name][i] = of_rows(p[name], i) - self.rate * (mean / (1 - 0.9 ** self.t)) / (np.sqrt(var / (1 - 0.99 ** self.t)) + 1e-6)


def model_of(p: dict[str, np.ndarray], tree: Tree) -> Model:
    tables = lambda w, f=1.0: (p["E"] @ w * np.float32(f), p["P"] @ w * np.float32(f))
    (q, pq), (k, pk), (v, pv) = tables(p["Q"], HEAD ** -0.5), tables(p["K"]), tables(p["V"])
    return Model(q, k, v, p["E"], pq, pk, pv, p["P"], p["O"], p["U"], p["b"], p["T"], np.append(tree.of, 0), tree)


def train(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, max_windows: int | None = None, epochs: int = 2, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Model:
    """A model of the texts given here, learned in this process; `counts` are those of the whole corpus."""
    tree = grown(counts)
    net = Learner(start(counts, tree, seed), tree, batch, rate, seed)
    net.learn(ids, lengths, epochs, max_windows)
    return model_of(net.p, tree)


def _unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(IDS).itemsize
    return np.frombuffer(b"".join(ids.to_pylist()), IDS).astype(np.int64), lengths


#: Rows of a table that are averaged together.
BUCKET = 512


def learned(texts: DataFrame, p: dict[str, np.ndarray], tree: Tree) -> dict[str, np.ndarray]:
    """One round: every task learns from its texts (ids) and all of them, from `p` on; the rows of the tables are averaged
    by their uses. Rows that no task used stay as they are."""
    given = texts.sparkSession.sparkContext.broadcast((p, tree))

    def part(batches):
        net = None
        for b in batches:
            for t in _slices(b, pc.binary_length(b["ids"]).to_numpy(zero_copy_only=False) // np.dtype(IDS).itemsize):
                net = net or Learner(*given.value)
                net.learn(*_unpacked(t["ids"]))
            pa.default_memory_pool().release_unused()
        for name, used in net.used.items() if net else ():
            rows = net.p[name] if name in SPARSE else net.p[name].reshape(1, -1)
            key = np.flatnonzero(used)
            for own in np.split(key, np.flatnonzero(np.diff(key // BUCKET)) + 1) if len(key) else ():
                sums = rows[own] * used[own, None]
                yield pa.RecordBatch.from_pydict({"name": [name], "bucket": pa.array([own[0] // BUCKET], pa.int64()), "keys": [own.astype(np.int64).tobytes()],
                                                  "used": [used[own].tobytes()], "sums": [sums.astype(np.float64).tobytes()]})

    def add(b):
        key, at = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k in b["keys"]]), return_inverse=True)
        used = np.bincount(at, np.concatenate([np.frombuffer(u, np.float64) for u in b["used"]]))
        rows = np.concatenate([np.frombuffer(x, np.float64).reshape(len(k) // 8, -1) for x, k in zip(b["sums"], b["keys"], strict=True)])
        sums = np.zeros((len(key), rows.shape[1]))
        np.add.at(sums, at, rows)
        out = b.iloc[:1].copy()
        out["keys"], out["used"], out["sums"] = [key.tobytes()], [used.tobytes()], [sums.tobytes()]
        return out

    schema, out = "name string, bucket long, keys binary, used binary, sums binary", {k: v.copy() for k, v in p.items()}
    for r in texts.select("ids").mapInArrow(part, schema).groupBy("name", "bucket").applyInPandas(add, schema).collect():
        used = np.frombuffer(r.used, np.float64)
        rows = np.frombuffer(r.sums, np.float64).reshape(len(used), -1) / used[:, None]
        if r.name in SPARSE:
            out[r.name][np.frombuffer(r["keys"], np.int64)] = rows
        else:
            out[r.name] = rows.reshape(p[r.name].shape).astype(np.float32)
    given.destroy()
    return out


def learn_all(texts: DataFrame, counts: np.ndarray) -> Model:
    """A model of all texts (row, ids): first of an eighth of them for a common start, then of the others; small tables
    are gone over again."""
    tree = grown(counts)
    p = start(counts, tree)
    early = F.pmod(F.xxhash64("row"), F.lit(8)) == 0
    for own in (early, ~early):
        p = learned(texts.filter(own), p, tree)
    for _ in range(1, min(PASSES, int(-(-LEAST_SEEN // max(counts.sum(), 1))))):
        p = learned(texts, p, tree)
    return model_of(p, tree)


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = 150_000):
    """The batch in slices of about `most` by the rows' sizes, so that memory does not follow its row count."""
    turn = np.cumsum(sizes) // most
    first = np.flatnonzero(np.diff(turn, prepend=-1))
    for a, z in zip(first, np.append(first[1:], len(sizes)), strict=True):
        yield batch.slice(a, z - a)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python `ROWS` at a time in the jobs run inside: buffers on both sides grow with rows times text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    given = int(before)
    spark.conf.set(name, str(min(given, ROWS) if given > 0 else ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _totals(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several counts and their sums."""
    key, own = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
    return key, np.bincount(own, np.concatenate([*ns, np.zeros(0, np.int64)]), minlength=len(key)).astype(np.int64)


def _encoded(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """row, doc_id, held_out and subword ids of every text; and kind, key and n: counts of the training rows' words
    ('word', by hash) and subwords ('sub', by id), per task."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", ARROW.get(kind, pa.string())), ("held_out", pa.bool_()), ("ids", pa.binary()),
                        ("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def counted(name: str, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(key))
        return pa.RecordBatch.from_arrays([*(none.cast(schema.field(k).type) for k in range(4)), pa.array([name] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    def part(batches):
        subs = np.zeros(tokenizer(path).n_vocab + 1, np.int64)
        keys, ns = [], []
        for b in batches:
            size = b["w"].value_lengths().to_numpy(zero_copy_only=False)
            for t in _slices(b, size):
                ids, lengths = encode(t["text"].to_pylist(), path)
                learn = ~t["held_out"].to_numpy(zero_copy_only=False)
                subs += np.bincount(ids[np.repeat(learn, lengths)], minlength=len(subs))
                key, n = np.unique(t["w"].flatten().to_numpy(zero_copy_only=False)[np.repeat(learn, t["w"].value_lengths().to_numpy(zero_copy_only=False))], return_counts=True)
                keys.append(key)
                ns.append(n)
                ends, ids = np.cumsum(lengths), ids.astype(IDS)
                packed = pa.array([ids[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)], pa.binary())
                none = pa.nulls(len(lengths))
                yield pa.RecordBatch.from_arrays([t["row"], t["doc_id"], t["held_out"], packed, none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int64())], schema=schema)
            if sum(map(len, keys)) > HELD:
                key, n = _totals(keys, ns)
                keys, ns = [key], [n]
                if len(key) > HELD // 2:
                    yield counted("word", key, n)
                    keys, ns = [], []
            pa.default_memory_pool().release_unused()
        yield counted("word", *_totals(keys, ns))
        key = np.flatnonzero(subs)
        yield counted("sub", key, subs[key])

    return rows.mapInArrow(part, f"row long, doc_id {kind}, held_out boolean, ids binary, kind string, key long, n long")


ARROW = {"bigint": pa.int64(), "int": pa.int32()}
IDS = np.uint32


def score_texts(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2,
    sample: int | None = None, frequent: int = FREQUENT, **how,
) -> DataFrame:
    """Per row: row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's
    probability of the text and its end).

    Word and subword counts cover all training texts (ids whose crc32 modulo `folds` is not `held_out`; a null id
    is one), and the network learns from all of them. With `sample`, it learns from so many only, those first by a hash
    of their id, in this process and with the other options of `train`. Words of at least 1 / `frequent` of all tokens are counted within the scan; the others join
    their counts by hash. A null or empty text has one token, its end. Repeated rows count and are scored each; an
    empty table gives no rows, one without training texts a model of no knowledge. Texts are scored whole. Subword
    ids are made once and written to the shared folder with the row numbers; whatever is said of a row comes from them.
    """
    with _small_batches(docs.sparkSession):
        return _scored(docs, vocabulary, id_col, text_col, folds, held_out, sample, frequent, **how)


def _scored(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, folds: int, held_out: int, sample: int | None, frequent: int, **how) -> DataFrame:
    """`score_texts`; all its Python runs before it returns, as both of its tables are written."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = lambda c: F.transform(F.concat(words(lower_ascii(c)), F.array(F.lit(""))), lambda w: F.xxhash64(w))  # noqa: E731  no word is empty: the end
    held = F.coalesce(remainder(F.col(id_col), folds) == held_out, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held.alias("held_out"), text.alias("text"), hashed(text).alias("w"))
    encoded = saved(_encoded(rows, vocabulary, kind), "encoded")
    counts = saved(encoded.filter("kind is not null").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    known = counts.filter("kind = 'word'").select("key", "n")
    total, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = known.filter(F.col("n") * frequent >= total).toPandas().sort_values("key")
    subs = np.zeros(tokenizer(vocabulary).n_vocab + 1)
    got = counts.filter("kind = 'sub'").toPandas()
    subs[got["key"].to_numpy(dtype=np.int64)] = got["n"]
    texts = encoded.filter("kind is null")
    learn = texts.filter("not held_out")
    if sample is None:
        model = learn_all(learn.select("row", "ids"), subs)
    else:
        first = learn.select("ids", F.xxhash64("doc_id").alias("h")).orderBy("h", "ids").limit(sample).collect()
        ids = [np.frombuffer(r.ids, IDS).astype(np.int64) for r in first]
        model = train(np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array([len(i) for i in ids], np.int64), subs, **how)
    network = spark.sparkContext.broadcast(model)
    table = spark.sparkContext.broadcast((often["key"].to_numpy(dtype=np.int64), often["n"].to_numpy(dtype=np.int64)))
    lowest = float(np.log10(total + distinct + 1))

    def score(batches):
        enc = tokenizer(vocabulary)
        for b in batches:
            size = pc.binary_length(b["ids"]).to_numpy(zero_copy_only=False) // np.dtype(IDS).itemsize
            for t in _slices(b, size):
                flat, lengths = _unpacked(t["ids"])
                ends = np.cumsum(lengths)
                said = [enc.decode_bytes(flat[e - n:e - 1].tolist()) for e, n in zip(ends, lengths, strict=True)]  # without the end
                yield pa.RecordBatch.from_arrays([t["row"], t["doc_id"], t["held_out"], pa.array(log_probs(network.value, flat, lengths) / np.log(10)), pa.array(said, pa.binary()).cast(pa.string())],
                                                 ["row", "doc_id", "held_out", "score", "text"])
            pa.default_memory_pool().release_unused()

    scored = texts.select("row", "doc_id", "held_out", "ids").mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, score double, text string")
    known_as = ARROW.get(kind, pa.string())
    schema = pa.schema([("row", pa.int64()), ("doc_id", known_as), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("key", pa.int64())])

    def look_up(batches):
        keys, ns = table.value
        logs = np.log10(ns + 1.0)
        for b in batches:
            for t in _slices(b, b["w"].value_lengths().to_numpy(zero_copy_only=False)):
                n = t["w"].value_lengths().to_numpy(zero_copy_only=False)
                h = t["w"].flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(doc[hit], logs[at[hit]], minlength=len(n)) if hit.any() else np.zeros(len(n))
                known = [pa.array(x) for x in (n.astype(np.int64), np.bincount(doc[hit], minlength=len(n)), base)]
                yield pa.RecordBatch.from_arrays([*(t[c] for c in ("row", "doc_id", "held_out", "score")), *known, pa.nulls(len(n), pa.int64())], schema=schema)
                if frequent < total:  # else all words are in the table
                    left = np.flatnonzero(~hit)
                    yield pa.RecordBatch.from_arrays([t["row"].take(pa.array(doc[left])), *(pa.nulls(len(left), schema.field(k).type) for k in range(1, 7)), pa.array(h[left])], schema=schema)

    looked = saved(scored.select("row", "doc_id", "held_out", "score", hashed(F.col("text")).alias("w")).mapInArrow(
        look_up, f"row long, doc_id {kind}, held_out boolean, score double, n_tokens long, n_known long, base double, key long"), "looked")
    rare = looked.filter("key is not null").join(known.filter(F.col("n") * frequent < total), "key").groupBy("row").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("extra"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return looked.filter("key is null").join(rare, "row", "left").select(
        "row", "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("extra") - F.col("n_tokens") * lowest).alias("base_score"), "score")


def op10_query(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return score_texts(docs, vocabulary).drop("row")
