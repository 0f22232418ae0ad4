"""Group-wise joins in which one side of a group is held and the other streams past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def beside(held: DataFrame, streamed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both sides (of the same columns, `side` 0 and 1) dealt by `keys`, a group's held rows before its streamed ones."""
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.unionByName(streamed).repartition(n, *keys).sortWithinPartitions(*keys, "side", *order)


def _cuts(columns: list[pa.Array], n: int) -> list[int]:
    """Where rows differ from the row before in any of the columns (nulls are equal), and both ends."""
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            c = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
    return [*np.flatnonzero(new).tolist(), n]


def stream_past(
    batches: Iterator[pa.RecordBatch], keys: list[str], hold: Callable[[tuple, list[pa.RecordBatch]], object],
    meet: Callable[[object, pa.RecordBatch], pa.RecordBatch | None], done: Callable[[object], pa.RecordBatch | None] | None = None, step: int = 10_000,
) -> Iterator[pa.RecordBatch]:
    """Per group `hold(key, held rows)` once, `meet(that, rows)` for its streamed rows in pieces, `done(that)` at its end.

    A group without held rows, or without streamed ones, gives nothing.
    """
    group, held, state = None, [], None
    for b in batches:
        cut = _cuts([b[c] for c in [*keys, "side"]], len(b))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            *name, side = (b[c][a].as_py() for c in [*keys, "side"])
            if tuple(name) != group:
                if state is not None and done is not None and (out := done(state)) is not None:
                    yield out
                group, held, state = tuple(name), [], None
            if side == 0:
                held.append(b.slice(a, z - a))
            elif held:
                if state is None:
                    state = hold(group, held)
                for lo in range(a, z, step):
                    if (out := meet(state, b.slice(lo, min(step, z - lo)))) is not None:
                        yield out
    if state is not None and done is not None and (out := done(state)) is not None:
        yield out
