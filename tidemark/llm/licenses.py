"""License scan: ordered signature rules over a text's words, in DataFrame operations only.

A text becomes its lower-cased words with one space before each, so a signature is a regex over words.
Each rule names a keyword; only rules whose keyword occurs are matched, and only texts that pass a gate of
all keywords are looked at in more detail. Of overlapping detections, one that lies inside another of equal
or better rank is suppressed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import lower_ascii

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Signature(NamedTuple):
    label: str
    keyword: str
    regex: str
    rank: int
    base: bool = False


#: Phrases that always count, whatever else overlaps them.
BASE = (
    Signature("cc-by", "cc by", "cc by", 9, True),
    Signature("gpl", "general public license", "general public license", 9, True),
    Signature("reserved", "all rights reserved", "all rights reserved", 9, True),
)

LIC = r"licen[cs]e"
V = r"(?:version |v ?)?"

#: Per family: label, keyword, its name as words, its short identifier as words, and its versions with the
#: words that state them. A family without versions has one entry of no words.
FAMILIES = (
    ("apache", "apache", rf"apache(?: software)?(?: {LIC})?", "apache", {"2.0": "2(?: 0)?", "1.1": "1 1", "1.0": "1 0"}),
    ("gpl", "general public", rf"(?:gnu )?general public {LIC}", "gpl", {"3.0": "3(?: 0)?", "2.0": "2(?: 0)?", "1.0": "1(?: 0)?"}),
    ("gpl", "gpl", "(?:gnu )?gpl", "gpl", {"3.0": "3(?: 0)?", "2.0": "2(?: 0)?", "1.0": "1(?: 0)?"}),
    ("lgpl", "lesser general", rf"(?:gnu )?lesser general public {LIC}", "lgpl", {"3.0": "3(?: 0)?", "2.1": "2 1"}),
    ("lgpl", "library general", rf"(?:gnu )?library general public {LIC}", "lgpl", {"2.0": "2(?: 0)?"}),
    ("agpl", "affero", rf"(?:gnu )?affero general public {LIC}", "agpl", {"3.0": "3(?: 0)?", "1.0": "1(?: 0)?"}),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {LIC}", "gfdl", {"1.3": "1 3", "1.2": "1 2", "1.1": "1 1"}),
    ("mpl", "mozilla public", rf"mozilla public {LIC}", "mpl", {"2.0": "2(?: 0)?", "1.1": "1 1", "1.0": "1 0"}),
    ("epl", "eclipse public", rf"eclipse public {LIC}", "epl", {"2.0": "2(?: 0)?", "1.0": "1 0"}),
    ("edl", "eclipse distribution", rf"eclipse distribution {LIC}", "edl", {"1.0": "1 0"}),
    ("cpl", "common public", rf"common public {LIC}", "cpl", {"1.0": "1 0"}),
    ("cpal", "common public attribution", rf"common public attribution {LIC}", "cpal", {"1.0": "1 0"}),
    ("cddl", "common development", rf"common development and distribution {LIC}", "cddl", {"1.1": "1 1", "1.0": "1 0"}),
    ("eupl", "european union public", rf"european union public {LIC}", "eupl", {"1.2": "1 2", "1.1": "1 1", "1.0": "1 0"}),
    ("osl", "open software", rf"open software {LIC}", "osl", {"3.0": "3(?: 0)?", "2.1": "2 1", "1.0": "1 0"}),
    ("afl", "academic free", rf"academic free {LIC}", "afl", {"3.0": "3(?: 0)?", "2.1": "2 1"}),
    ("artistic", "artistic", rf"artistic {LIC}", "artistic", {"2.0": "2(?: 0)?", "1.0": "1(?: 0)?"}),
    ("bsl", "boost software", rf"boost software {LIC}", "bsl", {"1.0": "1(?: 0)?"}),
    ("busl", "business source", rf"business source {LIC}", "busl", {"1.1": "1 1"}),
    ("ofl", "open font", rf"(?:sil )?open font {LIC}", "ofl", {"1.1": "1 1", "1.0": "1 0"}),
    ("odbl", "open database", rf"open database {LIC}", "odbl", {"1.0": "1 0"}),
    ("odc-by", "open data commons", rf"open data commons attribution {LIC}", "odc by", {"1.0": "1 0"}),
    ("pddl", "public domain dedication", rf"public domain dedication and {LIC}", "pddl", {"1.0": "1 0"}),
    ("cc-by-nc-nd", "by nc nd", "(?:cc|creative commons) by nc nd", "cc by nc nd", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?", "2.0": "2 0"}),
    ("cc-by-nc-sa", "by nc sa", "(?:cc|creative commons) by nc sa", "cc by nc sa", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?", "2.0": "2 0"}),
    ("cc-by-nc", "by nc", "(?:cc|creative commons) by nc", "cc by nc", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?", "2.0": "2 0"}),
    ("cc-by-nd", "by nd", "(?:cc|creative commons) by nd", "cc by nd", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?", "2.0": "2 0"}),
    ("cc-by-sa", "by sa", "(?:cc|creative commons) by sa", "cc by sa", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?", "2.0": "2 0"}),
    ("cc-by", "cc by", "cc by", "cc by", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?", "2.5": "2 5", "2.0": "2 0"}),
    ("cc-by", "creative commons", rf"creative commons attribution(?: {LIC})?", "cc by", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?"}),
    ("cc-by-sa", "creative commons attribution share", rf"creative commons attribution share ?alike(?: {LIC})?", "cc by sa", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?"}),
    ("cc-by-nc", "creative commons attribution non", rf"creative commons attribution non ?commercial(?: {LIC})?", "cc by nc", {"4.0": "4(?: 0)?", "3.0": "3(?: 0)?"}),
    ("cc0", "cc0", "(?:creative commons )?cc0", "cc0", {"1.0": "1(?: 0)?"}),
    ("zpl", "zope public", rf"zope public {LIC}", "zpl", {"2.1": "2 1", "2.0": "2 0"}),
    ("psf", "python software", rf"python software foundation {LIC}", "psf", {"2.0": "2(?: 0)?"}),
    ("php", "php", rf"php {LIC}", "php", {"3.01": "3 01", "3.0": "3 0"}),
    ("w3c", "w3c", rf"w3c (?:software|document) (?:notice and )?{LIC}", "w3c", {"": ""}),
    ("isc", "isc", rf"isc {LIC}", "isc", {"": ""}),
    ("mit", "mit", rf"mit (?:x11 )?{LIC}", "mit", {"": ""}),
    ("mit-0", "mit no attribution", "mit no attribution", "mit 0", {"": ""}),
    ("x11", "x11", rf"x11 {LIC}", "x11", {"": ""}),
    ("zlib", "zlib", rf"zlib(?: libpng)? {LIC}", "zlib", {"": ""}),
    ("bsd-2-clause", "bsd", rf"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: {LIC})?", "bsd 2 clause", {"": ""}),
    ("bsd-2-clause", "freebsd", rf"freebsd(?: {LIC})?", "bsd 2 clause", {"": ""}),
    ("bsd-3-clause", "bsd", rf"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: {LIC})?", "bsd 3 clause", {"": ""}),
    ("bsd-4-clause", "bsd", rf"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {LIC})?", "bsd 4 clause", {"": ""}),
    ("0bsd", "bsd", rf"zero clause bsd(?: {LIC})?", "0bsd", {"": ""}),
    ("0bsd", "0bsd", rf"0bsd(?: {LIC})?", "0bsd", {"": ""}),
    ("bsd", "bsd", rf"bsd(?: style)? {LIC}", "bsd", {"": ""}),
    ("unlicense", "unlicense", "the unlicense", "unlicense", {"": ""}),
    ("wtfpl", "want to public", rf"do what the fuck you want to public {LIC}", "wtfpl", {"": "", "2": "2"}),
    ("beerware", "beer ware", rf"(?:the )?beer ware {LIC}", "beerware", {"": ""}),
    ("postgresql", "postgresql", rf"postgresql {LIC}", "postgresql", {"": ""}),
    ("openssl", "openssl", rf"openssl {LIC}", "openssl", {"": ""}),
    ("ms-pl", "microsoft public", rf"microsoft public {LIC}", "ms pl", {"": ""}),
    ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal {LIC}", "ms rl", {"": ""}),
    ("upl", "universal permissive", rf"universal permissive {LIC}", "upl", {"1.0": "1 0"}),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {LIC}", "ncsa", {"": ""}),
    ("sspl", "server side public", rf"server side public {LIC}", "sspl", {"1.0": "1(?: 0)?"}),
    ("elastic", "elastic", rf"elastic {LIC}", "elastic", {"2.0": "2(?: 0)?"}),
    ("mulan", "mulan", rf"mulan (?:permissive|public) software {LIC}", "mulanpsl", {"2.0": "2(?: 0)?", "1.0": "1(?: 0)?"}),
    ("qpl", "q public", rf"q public {LIC}", "qpl", {"1.0": "1 0"}),
    ("apsl", "apple public", rf"apple public source {LIC}", "apsl", {"2.0": "2(?: 0)?"}),
    ("nasa", "nasa", rf"nasa open source agreement", "nasa", {"1.3": "1 3"}),
)

#: Sentences of license texts and notices that no identifier names.
TEXTS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", 2),
    ("mit", "the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies", 3),
    ("isc", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 2),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("bsd-3-clause", "endorse or promote", "neither the name of(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse or promote", 2),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", 2),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 2),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 3),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 2),
    ("public-domain", "public domain", "(?:is|are|been)(?: hereby)? (?:in|released (?:in)?to|placed in|dedicated to) the public domain", 4),
    ("public-domain", "no copyright", "no copyright is claimed", 4),
    ("warranty-disclaimer", "without warranty", "without warranty of any kind", 6),
    ("warranty-disclaimer", "without warranties", "without warranties or conditions of any kind", 6),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 5),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)(?: of this [^ ]+)? is (?:strictly )?prohibited", 5),
    ("proprietary", "permission", "(?:reproduced|copied|distributed) without(?: prior)?(?: written)? permission", 5),
    ("free-software", "free software", "this (?:program|library|file) is free software", 5),
    ("gpl-or-later", "any later version", "either version [23](?: 0)? of the license or at your option any later version", 4),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", 7),
    ("license-mention", "licen", rf"(?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?(?: [^ ]+){{1,4}} {LIC}", 8),
)


def signatures() -> list[Signature]:
    """All rules in order of rank: identifiers, notices, versioned names, then bare names and sentences."""
    out = list(BASE)
    for label, keyword, name, ident, versions in FAMILIES:
        for v, said in versions.items():
            full = f"{label}-{v}" if v else label
            tail = f" {said}" if said else ""
            later = "(?: (?:or later|only))?"
            out.append(Signature(full, f"identifier {ident.split()[0]}", f"spdx license identifier {ident}{tail}{later}", 1))
            out.append(Signature(full, keyword, rf"(?:licensed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)? {name}"
                                 + (f" {V}{said}{later}" if said else ""), 2))
            out.append(Signature(full, keyword, f"{name} {V}{said}{later}" if said else name, 3))
        if "" not in versions:
            out.append(Signature(label, keyword, name, 6))
    out += [Signature(*t) for t in TEXTS]
    return out


#: Some word of every keyword; a text without any is not looked at again. Case is ignored for A-Z only.
GATE = (rf"(?i)licen|public|reserved|copyright|gpl|spdx|commons|cc0|cc{GAP_ANY_CASE}by|bsd|hereby|redistribut|endorse|advertis|"
        rf"notice|warrant|propriet|unauthor|permission|free{GAP_ANY_CASE}software|any{GAP_ANY_CASE}later|unencumber|apache|mozilla|"
        rf"artistic|unlicense|(?<![0-9a-z])(?:mit|isc|nasa|php){GAP_ANY_CASE}(?:no|open|licen)|by{GAP_ANY_CASE}(?:nc|nd|sa)(?![0-9a-z])|"
        rf"as{GAP_ANY_CASE}is|sharealike|commercial|identifier|affero|w3c|zlib|x11|elastic|mulan|postgresql|openssl|ncsa")


def _n(text: Column) -> Column:
    """Words of a piece in which every word follows one space."""
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _hits(said: Column, rules: list[Signature]) -> Column:
    """Per rule and match: rule, match number, words before it since the last match, words of the match."""
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(f" {r.keyword}").alias("kw"), F.lit(f" (?:{r.regex})(?= )").alias("re"))
                      for i, r in enumerate(rules)])
    gated = F.filter(table, lambda r: F.contains(said, r["kw"]))

    def of(r: Column) -> Column:
        found = F.regexp_extract_all(said, r["re"], F.lit(0))
        return F.transform(F.arrays_zip(found.alias("m"), F.slice(F.split(said, r["re"]), F.lit(1), F.size(found)).alias("p")),
                           lambda x, j: F.struct(r["rule"].alias("rule"), j.alias("j"), _n(x["p"]).alias("lead"), _n(x["m"]).alias("len")))

    return F.flatten(F.transform(gated, of))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """Detections after suppression: one row per document and detection, one of nulls for a document without.

    Columns: `_row` (identifies the input row), id, n_words, label, rank, base, first (word index from 0), last
    (word index after the match). Null and empty texts have no words and no detection; null ids stay null and
    repeated rows are reported each. Ties (two rules over the same words) go to the better rank, then the
    smaller rule number. Other columns are not read. A long text is scanned whole; its detections are rows.
    """
    rules = rules or signatures()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col),
        F.size(F.array_remove(F.split(text, GAP_ANY_CASE), "")).cast("long").alias("n_words"),
        F.when(text.rlike(GATE), F.concat(F.lit(" "), F.array_join(F.array_remove(F.split(lower_ascii(text), GAP), ""), " "), F.lit(" "))).alias("_said"),
    )
    rows = base.select(
        "_row", id_col, "n_words",
        F.explode_outer(F.element_at(F.transform(F.array("_said"), lambda s: F.when(s.isNotNull(), _hits(s, rules))), 1)).alias("_h"),
    ).select("_row", id_col, "n_words", "_h.*").repartition("_row")
    run = Window.partitionBy("_row", "rule").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    meta = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.rank).alias("rank"), F.lit(r.base).alias("base")) for r in rules])
    placed = rows.withColumn("last", F.sum(F.col("lead") + F.col("len")).over(run)).withColumn("_m", F.get(meta, F.col("rule")))
    placed = placed.select("_row", id_col, "n_words", "rule", "_m.*", (F.col("last") - F.col("len")).alias("first"), "last")
    # Inside another: an earlier start (or the same start and a later end) with an end not before this one's.
    before = Window.partitionBy("_row").orderBy("first", F.desc("last"), "rank", "rule").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sorted({r.rank for r in rules if not r.base})
    inside = F.lit(False)
    for k in ranks:
        end = F.max(F.when(~F.col("base") & (F.col("rank") <= k), F.col("last"))).over(before)
        inside = inside | ((F.col("rank") == k) & F.coalesce(end >= F.col("last"), F.lit(False)))
    kept = placed.withColumn("_in", inside & ~F.col("base")).filter(F.col("rule").isNull() | ~F.coalesce(F.col("_in"), F.lit(False)))
    return kept.drop("_in")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: word count, base places, labels, and the confidence of the best detection."""
    d = scan_licenses(docs, id_col, text_col)
    base = F.coalesce(F.col("base"), F.lit(False))
    sure = F.when(base, 0.5).when(F.col("rank").isNotNull(), 1.0 - F.col("rank") / 10.0).otherwise(0.0)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return d.groupBy("_row").agg(
        F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"),
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"),
        F.max(sure).alias("score"),
    ).drop("_row")


def op8_query(docs: DataFrame) -> DataFrame:
    return license_labels(docs)
