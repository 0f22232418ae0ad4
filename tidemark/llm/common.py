"""Words, tables and shared-folder helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that `saved` wrote inside it: what is still read must have been written with `kept`."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that this job wrote to the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "table", compression: str | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts lineage, survives executors."""
    path = shared_folder(df.sparkSession, kind)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return kept(df, path, compression)


def settled(spark: SparkSession, make: Callable[[], DataFrame], kind: str = "table") -> DataFrame:
    """What `make` gives, written like `saved`; the tables that it saved on its way are deleted."""
    path = shared_folder(spark, kind)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    with scratch(spark):
        return kept(make(), path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `saved` wrote and that neither a later step nor a result reads."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            delete(t.sparkSession, path)


def kept(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """`df` written to `path` as Parquet and read back; no `scratch` deletes it."""
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Cells of `without`'s filter, 64 bits each: a few MB when broadcast, at any size of the corpus.
FILTER_CELLS = 1 << 18


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose `key`, never null, is not in `gone`. A bitmap of fixed size tells most of them at once, where they lie; only
    those that it does not clear are joined, and move."""
    cell, bits, h = f"{key}cell__", f"{key}bits__", F.xxhash64(F.col(key))
    place, bit = F.pmod(h, F.lit(FILTER_CELLS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    cells = gone.select(place.alias(cell), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(bits)).groupBy(cell).agg(F.bit_or(bits).alias(bits))
    # At most FILTER_CELLS rows.
    told = rows.withColumn(cell, place).join(F.broadcast(cells), cell, "left")
    clear = F.coalesce(F.getbit(bits, bit), F.lit(0)) == 0
    return told.filter(clear).drop(cell, bits).unionByName(told.filter(~clear).drop(cell, bits).join(gone, key, "left_anti"))


def slices(batches, column: str, most: int = 2_000_000):
    """Pieces of Arrow batches with about `most` bytes of text in `column`: memory follows the longest text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = np.flatnonzero(np.diff(ends // most, prepend=-1)) if len(ends) else np.zeros(0, np.int64)
        for a, z in zip(first, np.append(first[1:], len(ends)), strict=True):
            yield b.slice(a, z - a)
