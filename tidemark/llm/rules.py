"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, words


class Rule(NamedTuple):
    """A document fails when `top` is above `most` or below `least` times `bottom`."""

    name: str
    top: str
    bottom: str | None
    least: float | None = None
    most: float | None = None


#: Whole numbers out of 1000, so that every comparison is exact integer arithmetic.
RULES = (
    Rule("word_length_low", "word_chars", "n_words", least=1500),
    Rule("word_length_high", "word_chars", "n_words", most=25000),
    Rule("symbols", "n_symbols", "n_words", most=500),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=500),
    Rule("no_letters", "n_letter_words", "n_words", least=500),
    Rule("shouting", "n_shout_words", "n_words", most=500),
)

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "als auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "dans de des du en est et la le les par pour que qui un une "
    "con del el las los no por se su una y"
).split()


def _repeat_words(ws: Column, width: int) -> Column:
    """Words covered by a `width`-word window found twice or more in the array.

    Hashes of all windows tell texts without a repeat apart for sure; only the others are sorted,
    by the windows' own words.
    """
    starts = F.sequence(F.lit(1), F.size(ws) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, width)))
    some = F.exists(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def covered(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["k"] == F.get(s, j)["k"], F.lit(False))
        at = F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"])), lambda p: p.isNotNull())
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct(
            (a["n"] + p + width - F.greatest(a["end"], p)).alias("n"), (p + width).alias("end"))
        return F.aggregate(F.array_sort(at), start, step, lambda a: a["n"])

    pairs = F.array_sort(F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(ws, i, width), " ").alias("k"), i.alias("p"))))
    exact = F.element_at(F.transform(F.array(pairs), covered), 1)
    return F.when(F.size(ws) <= width, 0).when(~some, 0).otherwise(exact).cast("long")


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts per document behind the rules, one row in for one row out, with the columns in `keep`.

    A null text has no words and no lines; an empty table gives an empty result. A null id stays null,
    a repeated row gives a repeated result. Other columns are not read, so their names cannot clash.
    Memory per row follows its text; a long text is not cut.
    """
    space = SPACE.rstrip("+")
    base = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = base.select(id_col, *keep, "_t", words(F.col("_t")).alias("_w"),
                        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    n = lambda c: F.size(c).cast("long")
    return split.select(
        id_col, *keep,
        n(F.col("_w")).alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), width).alias("n_repeat_words"),
        n(F.col("_l")).alias("n_lines"),
        n(F.filter("_w", lambda w: w.isin(stop))).alias("n_stop_words"),
        n(F.filter("_l", lambda x: x.rlike(rf"^{space}*[-*•]"))).alias("n_bullet_lines"),
        n(F.filter("_l", lambda x: x.rlike(rf"(\.\.\.|…){space}*$"))).alias("n_ellipsis_lines"),
        n(F.filter("_w", lambda w: w.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))).alias("n_letter_words"),
        n(F.filter("_w", lambda w: w.rlike(r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"))).alias("n_shout_words"),
        n(F.array_distinct("_w")).alias("n_distinct_words"),
        n(F.filter("_w", lambda w: w.rlike(r"[.!?]$"))).alias("n_ends"),
        F.length(F.regexp_replace("_t", "[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Per rule, whether a row of `quality_stats` fails it."""
    out = {}
    for r in rules:
        top, bottom = F.col(r.top) * 1000, F.col(r.bottom) if r.bottom else F.lit(1000)
        fails = []
        if r.least is not None:
            fails.append(top < bottom * r.least)
        if r.most is not None:
            fails.append(top > bottom * r.most)
        out[r.name] = reduce(lambda a, b: a | b, fails)
    return out


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
    min_words: int = 20, repeat_percent: int = 30,
) -> DataFrame:
    """Verdict per document: base counts, base verdict, the names of failed rules, kept or not.

    A document of no words fails the base rule. See `quality_stats` for nulls, ties and long texts.
    """
    failed = compile_rules(rules)
    s = quality_stats(docs, id_col, text_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    s = s.withColumn("base_failed", base).withColumn(
        "failed_rules", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in failed.items()]))
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op1_query(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _failed_sql() -> str:
    parts = []
    for r in RULES:
        low = [f"{r.top} * 1000 < {r.bottom} * {r.least}"] if r.least is not None else []
        high = [f"{r.top} * 1000 > {r.bottom} * {r.most}"] if r.most is not None else []
        parts.append(f"CASE WHEN {' OR '.join(low + high)} THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


_STOP = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$'))) AS n_shout_words
  FROM w LEFT JOIN cov USING (doc_id)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_failed_sql()} AS failed_rules FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM v
"""
