"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features' inner products approximate a Gaussian kernel. Each partition sums its share of the normal
equations; their size depends on the number of features alone, so the driver solves one small system.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder, saved
from tidemark.llm.rules import quality_stats

#: Statistics of a document: rates, which do not grow with its length, and the logarithms of its sizes.
STATS = {
    "log_words": "log1p(n_words)", "log_lines": "log1p(n_lines)", "word_length": "log1p(word_chars / greatest(n_words, 1))",
    "symbols": "sqrt(least(n_symbols / greatest(n_words, 1), 4))", "stop_words": "n_stop_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)", "letters": "n_letter_words / greatest(n_words, 1)",
    "shouting": "n_shout_words / greatest(n_words, 1)", "ends": "n_ends / greatest(n_words, 1)",
    "bullets": "n_bullet_lines / greatest(n_lines, 1)", "digits": "sqrt(n_digits / greatest(word_chars, 1))",
    "capitals": "n_capitals / greatest(word_chars, 1)",
}


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.freq + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / self.freq.shape[1]), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of every document as doubles, in one pass without a shuffle, and the columns in `keep`."""
    stats = quality_stats(docs, id_col, text_col, keep=keep)
    return stats.select(F.col(id_col).alias("doc_id"), *keep, *[F.expr(c).cast("double").alias(k) for k, c in STATS.items()])


def _sums(train: DataFrame, model: Model, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: a matrix per partition, its rows summed by number, then one matrix."""
    names, width = list(STATS), model.freq.shape[1] + 1

    def part(batches):
        a = np.zeros((width, width + 1))
        for b in batches:
            z = model.features(b[names].to_numpy())
            a += z.T @ np.column_stack([z, b[label].to_numpy()])
        yield pd.DataFrame({"i": np.arange(width), "a": list(a)})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": b["i"].iloc[:1], "a": [np.sum(np.stack(b["a"].to_list()), axis=0)]})

    kind = "i long, a array<double>"
    a = np.zeros((width, width + 1))
    for r in train.mapInPandas(part, kind).groupBy("i").applyInPandas(add, kind).collect():
        a[r.i] = r.a
    return a[:, :-1], a[:, -1]


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted points: the centre and the mean of every pool."""
    pools: list[list[float]] = []
    for x, w, t in zip(at, weight, total, strict=True):
        pools.append([x * w, w, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def _with_score(df: DataFrame, model: Model, column: str, raw: bool) -> DataFrame:
    """`df` without its statistics and with the model's value."""
    names, other = list(STATS), [c for c in df.columns if c not in STATS]

    def part(batches):
        for b in batches:
            x = np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in names])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in other), pa.array(model.raw(x) if raw else model.score(x))], [*other, column])

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in other), f"{column} double"])
    return df.mapInArrow(part, kind)


def fit(train: DataFrame, label: str = "label", features: int = 256, width: float = 1.0, ridge: float = 1e-3, bins: int = 2000, seed: int = 7) -> Model:
    """Fit on all rows of `train` (the statistics and a label from 0 to 1).

    `width` scales the kernel: its deviation is width * sqrt(number of statistics). Without rows the model
    scores everything 0.5; with one class it scores that class. Calibration sees counts on a fixed grid.
    """
    names = list(STATS)
    s = train.agg(F.count("*"), *[F.coalesce(f(c), F.lit(0.0)) for c in names for f in (F.avg, F.stddev_pop)]).first()
    n, mean, dev = s[0], np.array(s[1::2]), np.array(s[2::2])
    g = np.random.default_rng(seed)
    model = Model(mean, np.where(dev > 1e-9, dev, 1.0), g.normal(size=(len(names), features)) / (width * np.sqrt(len(names))),
                  g.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not n:
        return model
    a, v = _sums(train, model, label)
    model = model._replace(weight=np.linalg.solve(a + ridge * n / features * np.eye(features + 1), v))
    cell = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (bins / 2)).cast("int")
    grid = _with_score(train.select(*names, F.col(label).alias("_y")), model, "raw", True).groupBy(cell.alias("cell")).agg(
        F.count("*").alias("n"), F.sum("_y").alias("t")).orderBy("cell").collect()
    at, value = isotonic(np.array([(r.cell + 0.5) / (bins / 2) for r in grid]), np.array([float(r.n) for r in grid]), np.array([float(r.t) for r in grid]))
    return model._replace(at=at, value=np.clip(value, 0, 1))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 4, held_out: int = 2, cut: float = 0.7, keep: tuple[str, ...] = (), **how,
) -> DataFrame:
    """Score every document; learn from labels whose id's crc32 modulo `folds` is not `held_out`.

    Returns doc_id, held_out, score, predicted and the columns in `keep` (names other than those of the result and
    of the statistics). The statistics that training reads are written to the shared folder. A null or empty text has statistics of zero
    and gets a score like any other; a null id is never held out nor labelled; repeated rows are scored each and
    count each in training. Labels without a value are ignored, several labels of one id are averaged.
    """
    given = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(label_col).alias("label"))
    given = saved(given.filter(remainder(F.col("doc_id"), folds) != held_out), "given")
    # With columns to keep, the statistics of labelled texts are computed again beside them: no text is copied.
    stats = None if keep else saved(document_stats(docs, id_col, text_col), "stats")
    some = document_stats(docs.join(given.select(F.col("doc_id").alias(id_col)), id_col, "left_semi"), id_col, text_col) if keep else stats
    model = fit(saved(some.select("doc_id", *STATS).join(given, "doc_id").drop("doc_id"), "train"), **how)
    out = _with_score(document_stats(docs, id_col, text_col, keep) if keep else stats, model, "score", False)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"), *keep)


def op5_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, labels)
