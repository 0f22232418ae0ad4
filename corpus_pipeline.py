"""From raw documents to a training mix: quality, near duplicates, benchmark leaks, secrets, mixture.

Every stage takes the documents that its predecessor kept and returns a DataFrame, which `run` writes as Parquet and
reads again. Rows are told apart by a number of their own, not by doc_id, so that documents without an id or with the
id of another pass through like any other. A null text counts as an empty one; columns that no stage reads, whatever their
names, pass through, and an empty table gives an empty one. `run` writes the number with a stage's output, so that all scans of it agree;
a stage that gets documents without it writes them with it first. Of what a stage writes on its way, only these rows and its verdicts
by their number stay for its result to read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.classifier import score_quality
from tidemark.llm.common import delete, kept, saved, scratch, settled, shared_folder, table, without
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.jaccard import link_components
from tidemark.llm.mixing import document_sizes, taken_words
from tidemark.llm.secrets import VOCABULARY, find_secrets

#: The rows' number between stages; a name reserved for it.
ROW = "__pipeline_row__"
MIXED = ("size", "source_size", "target", "taken")


def _held(docs: DataFrame) -> tuple[DataFrame, list]:
    """The documents under names that clash with none, and the columns that turn them back."""
    names = [f"in_{k}" for k in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number per row that was written with them: one made in a scan changes with the scan. As whole
    texts lie there until the stage's result is read, they are packed more tightly than other scratch."""
    return docs if ROW in docs.columns else saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered", "zstd")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; equal texts get equal verdicts, empty ones a score like any other."""
    held, back = _held(docs)
    rows = held.withColumns({"doc_id": F.col(f"in_{docs.columns.index('doc_id')}"), "text": F.col(f"in_{docs.columns.index('text')}")})
    return score_quality(rows, table(spark, sf_dir, "labels"), keep=tuple(held.columns)).filter("predicted = 1").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (shingles of five words, similarity of 0.8 or more), that with
    the smallest doc_id (null ids last, then the smallest row number); documents without words all stay."""
    rows = _numbered(docs)

    def later_rows() -> DataFrame:
        linked = saved(link_components(rows, width=5, percent=80, row_col=ROW).select("row", "doc_id", "root"), "linked")
        first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("row"))
        return linked.join(first, "row", "left_anti").select(F.col("row").alias(ROW))

    later = settled(spark, later_rows, "first")  # the rows after the first ones
    return without(rows, later, ROW).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item of five words or more: fewer stand in clean texts by chance.
    Texts without words never overlap."""
    rows = _numbered(docs)
    leaks = settled(spark, lambda: find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=ROW, least=5).select(F.col("doc_id").alias(ROW)).distinct(), "leaks")
    return without(rows, leaks, ROW).select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted again where that was done."""
    held, _ = _held(docs)
    name = {c: n for c, n in zip(docs.columns, held.columns, strict=True)}
    path = name.get("source")
    out = find_secrets(held.withColumn("doc_id", F.lit(0)), VOCABULARY, text_col=name["text"], path_col=path, keep=tuple(held.columns))
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("n_secrets") > 0, F.length("redacted")).otherwise(F.col(name.get("n_chars", name["text"])))}
    types = dict(docs.dtypes)
    return out.select(*[new.get(c, F.col(name[c])).cast(types[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, their source's size and target, and the words that the mix takes from each.

    Columns of the documents that have one of these names are kept as given_<name>. A null source is a source.
    """
    rows = _numbered(docs)
    taken = settled(spark, lambda: taken_words(document_sizes(rows, row_col=ROW)).select(F.col("row").alias(ROW), *MIXED), "taken")
    own = [F.col(f"`{c}`").alias(f"given_{c}" if c in MIXED else c) for c in docs.columns if c != ROW]
    return rows.select(ROW, *own).join(taken, ROW).drop(ROW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", secrets),
    ("source_mix", mixture),
]

#: The classifier, the forest and the whole-text joins are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Once a stage's output is written, its scratch tables and its predecessor's output go."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = shared_folder(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            docs = kept(out if k else out.withColumn(ROW, F.monotonically_increasing_id()), path)  # the last stage drops the number
        if before:
            delete(spark, before)
        before = path
    return docs
