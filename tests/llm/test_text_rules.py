"""Quality rules and license scan against plain loops over the same texts."""

import re
from collections import Counter
from re import _parser

from tests.conftest import SF
from tests.llm.cases import documents, rows_of
from tidemark.llm import licenses, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    t = text or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    rep = {j for i in range(len(ws) - 7) if wins[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)


def test_quality_rules_match_a_loop(spark):
    docs = documents(spark, SF)
    want = sorted(((r.doc_id, *base_counts(r.text)) for r in docs.collect()), key=repr)
    out = rules.op1_query(docs)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in out.collect():
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.failed_rules == "")


def test_quality_rules_on_an_empty_table(spark):
    assert rules.op1_query(documents(spark).limit(0)).count() == 0


def test_compiled_rules_are_plain_comparisons(spark):
    plan = rules.op1_query(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def scan(text):
    sig = licenses.signatures()
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    said = " " + " ".join(ws) + " "
    hits = []
    for k, s in enumerate(sig):
        for m in re.finditer(f" (?:{s.regex})(?= )", said):
            first = said[:m.start()].count(" ")
            hits.append((first, first + m.group().count(" "), s.rank, k, s))
    left = []
    for a in hits:
        over = [b for b in hits if not b[4].base and b[2] <= a[2] and b[0] <= a[0] and b[1] >= a[1]
                and (b[0], -b[1], b[2], b[3]) < (a[0], -a[1], a[2], a[3])]
        if a[4].base or not over:
            left.append(a)
    base = [a for a in left if a[4].base]
    score = max([0.5 if a[4].base else 1.0 - a[2] / 10.0 for a in left], default=0.0)
    return (len(ws), len(base), min((a[0] for a in base), default=None), max((a[0] for a in base), default=None),
            ",".join(sorted({a[4].label for a in base})), ",".join(sorted({a[4].label for a in left})), round(score, 9))


MORE = [
    (20, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-or-later", "en", "a"),
    (21, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "en", "a"),
    (22, "the GNU Lesser General Public License version 2.1 and the GNU General Public License v3", "en", "a"),
    (23, "mit dem und der MIT nicht; under the MIT License (BSD-3-Clause License) Copyright (c) 2019 X", "de", "a"),
    (24, "CC BY-SA 4.0, CC-BY-NC-ND 3.0, CC0 1.0, Creative Commons Attribution ShareAlike", "en", "a"),
    (25, "cc by cc by all rights reserved " * 50, "en", "a"),
]


def test_license_scan_matches_a_loop(spark):
    docs = documents(spark, SF, MORE)
    got = {}
    for r in licenses.op8_query(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(scan(r.text))
    assert got == want
    assert got[20][0][5] == "apache-2.0,gpl-3.0" and "mit" in got[23][0][5].split(",")
    assert licenses.op8_query(docs.limit(0)).count() == 0


def test_the_gate_lets_every_signature_through(spark):
    texts = [(k, "x " + re.sub(r"\(\?:|\)\?|\)|\?|\[cs\]", "", s.keyword) + " y") for k, s in enumerate(licenses.signatures()) if s.rank != 3]
    df = spark.createDataFrame(texts, "k int, text string")
    short = {r.text for r in df.filter(~df.text.rlike(licenses.GATE)).collect()}
    # Keywords that are only a part of their signature; the rest of the regex carries another gated word.
    assert all(any(w in s.regex for w in ("licen", "nasa", "mit no", "commons")) for t in short
               for s in licenses.signatures() if f"x {s.keyword} y" == t)


def said_by(parsed):
    """Texts of every alternative of a signature's regex; optional parts with and without, repeats at their least."""
    out = [""]
    for op, a in parsed:
        kind = str(op)
        if kind == "LITERAL":
            some = [chr(a)]
        elif kind == "IN":
            some = ["z"] if str(a[0][0]) == "NEGATE" else [chr(v if str(o) == "LITERAL" else v[0]) for o, v in a]
        elif kind == "MAX_REPEAT":
            some = ([""] if a[0] == 0 else []) + [x * max(a[0], 1) for x in said_by(a[2])]
        elif kind == "NOT_LITERAL":
            some = ["z"]
        else:
            some = said_by(a[3]) if kind == "SUBPATTERN" else [x for b in a[1] for x in said_by(b)]
        out = [o + x for o in out for x in some]
    return out


def test_matches_of_every_rule_hold_its_keyword_and_pass_the_gate():
    gate = re.compile(licenses.GATE)
    for s in licenses.signatures():
        for m in said_by(_parser.parse(s.regex)):
            assert re.fullmatch(s.regex, m) and f" {s.keyword}" in f" {m} " and gate.search(f" {m} "), (s.label, s.keyword, m)


def test_names_of_two_words_get_their_own_labels(spark):
    texts = ["Creative Commons Attribution Share Alike 4.0", "Creative Commons Attribution Non-Commercial", "the FreeBSD license", "0BSD", "copied without prior written permission"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.labels for r in licenses.op8_query(df).collect()}
    assert got == {0: "cc-by-sa-4.0", 1: "cc-by-nc", 2: "bsd-2-clause", 3: "0bsd", 4: "proprietary"}
