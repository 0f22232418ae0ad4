"""Secret scan: candidates by pattern, false positives removed by a random forest trained on labelled findings."""

from __future__ import annotations

import json
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Formats in order; where two meet, the first counts. The group `v` is the secret itself.
PATTERNS = (
    ("private_key", r"(?P<v>-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)"),
    ("jwt", r"(?P<v>\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"),
    ("cloud_id", r"(?P<v>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"),
    ("prefixed", r"(?P<v>\b(?:gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|npm_|AIza)[\w-]{16,})"),
    ("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:(?P<v>[^\s/@]{4,})@"),
    ("assigned", r"""["']?\s*(?:=>|:=|==?|:)\s*(?P<q>["'])(?P<v>(?:(?!(?P=q))[^\r\n]){6,})(?P=q)"""),
    ("unquoted", r"""["']?[ \t]*(?:=>|:=|==?|:)[ \t]*(?P<v>[^\s"'`,;<>(){}\[\]]{5,}[^\s"'`,;<>(){}\[\].:?])"""),
    ("opaque", r"(?<![\w+/-])(?P<v>(?=[\w+/-]*[0-9])[\w+/-]{16,}={0,2})(?![\w+/=-])"),
)
#: Formats that count only behind a name with one of the words of NAME: a quoted value to its closing quote on the line,
#: with spaces and of any length, or an unquoted one to a space or delimiter.
NAMED = ("assigned", "unquoted")
NAME = r"(?i:token|secret|passw|pass[_-]?phrase|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)"
#: Any candidate holds one of these; texts without are not sent to Python.
GATE = r"[\w+/-]{16}|eyJ|-----BEGIN|://|" + NAME

KEY_WORDS = re.compile(r"(?i)token|secret|passw|pass.?phrase|pwd|api.?key|access.?key|auth|credential|bearer|private")
HASH_WORDS = re.compile(r"(?i)sha|md5|hash|digest|checksum|commit|revision|integrity|etag|uuid|guid|build|version|\bid\b")
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|change.?me|your|placeholder|x{6}|\*{4}|<.*>|\$\{|0{8}|1234567|redacted|test")
TEST_PATH = re.compile(r"(?i)test|example|sample|mock|fixture|docs?\b|demo")
CONTEXT = 48


def load_dictionary(path: str) -> frozenset[str]:
    """Words of four letters and more among the whole words of a public tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(w[:-4] for w in vocab if w.endswith("</w>") and len(w) >= 8 and w[:-4].isalpha())


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters covered by dictionary words, longest first from the left."""
    low, i, hit = value.lower(), 0, 0
    while i < len(low):
        n = next((n for n in range(min(14, len(low) - i), 3, -1) if low[i:i + n] in words), 0)
        hit, i = hit + n, i + max(n, 1)
    return hit / max(len(low), 1)


def _named(p: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of a pattern right behind a name. A name is looked at once, however many of the words it has."""
    end = at = 0
    for m in NAME_WORD.finditer(text):
        if m.end() > end:
            end = NAME_END.match(text, m.end()).end()
            if m.start() >= at and (found := p.match(text, end)):
                at = found.end()
                yield found


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """start, end and pattern number of every candidate; overlaps go to the earlier pattern."""
    taken: list[tuple[int, int, int]] = []
    for k, (_, p) in enumerate(COMPILED):
        new = [(m.start("v"), m.end("v"), k) for m in (_named(p, text) if PATTERNS[k][0] in NAMED else p.finditer(text))]
        if new and taken:
            starts, ends = np.array([t[0] for t in taken]), np.array([t[1] for t in taken])
            at = lambda a: np.searchsorted(starts, a)
            new = [(a, b, k) for a, b, k in new if not ((at(a) > 0 and ends[at(a) - 1] > a) or (at(a) < len(starts) and starts[at(a)] < b))]
        taken = sorted(taken + new)
    return iter(taken)


# ASCII classes, as in the gate
COMPILED = tuple((name, re.compile(p, re.A)) for name, p in PATTERNS)
NAME_WORD, NAME_END = re.compile(NAME, re.A), re.compile(r"[\w.-]*", re.A)


def features(value: str, before: str, after: str, path: str, pattern: int, words: frozenset[str]) -> list[float]:
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    n = max(len(kinds), 1)
    share = [kinds.count(k) / n for k in range(4)]
    moves = [0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[4 * a + b] += 1
    counts = np.array(list(Counter(value).values()), dtype=float)
    p = counts / counts.sum() if len(counts) else np.ones(1)
    near = re.findall(r"[\w.-]+", before)[-3:]
    return [
        float(len(value)), -float((p * np.log2(p)).sum()), *share, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        moves[2] / n, moves[8] / n, float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(value.isdigit()),
        coverage(value, words), len(set(value)) / n, float(bool(KEY_WORDS.search(" ".join(near)))), float(bool(HASH_WORDS.search(" ".join(near[-2:])))),
        float(bool(re.search(r"[=:]>?\s{0,4}[\"']?$", before))), float(bool(before[-1:] in "\"'" and before[-1:])), float(bool(after[:1] in "\"'" and after[:1])),
        float(bool(PLACEHOLDER.search(value))), float(bool(TEST_PATH.search(path or ""))), float(pattern),
        float(value.count("/")), float(value.count("_") + value.count("-")),
        float(value.count(" ")), float(value.count(".")),
    ]


class Forest(NamedTuple):
    """Trees as arrays of nodes: feature (-1 for a leaf), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out += value[at]
        return out / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 3) -> Forest:
    """Bootstrapped trees split by Gini impurity over a random root-sized choice of features."""
    g, out = np.random.default_rng(seed), []
    few = max(1, round(x.shape[1] ** 0.5) + 1)
    for _ in range(trees):
        rows = g.integers(0, len(x), len(x))
        nodes: list[list[float]] = []
        stack = [(rows, 0, -1, 0)]
        while stack:
            own, level, parent, side = stack.pop()
            k = len(nodes)
            nodes.append([-1, 0.0, 0, 0, y[own].mean()])
            if parent >= 0:
                nodes[parent][2 + side] = k
            if level == depth or len(own) < 2 * least or y[own].min() == y[own].max():
                continue
            best = (1e-9, -1, 0.0)
            whole = 2 * nodes[k][4] * (1 - nodes[k][4])
            for f in g.choice(x.shape[1], few, replace=False):
                order = own[np.argsort(x[own, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(own))
                a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(own) - n)
                gain = whole - (n * 2 * a * (1 - a) + (len(own) - n) * 2 * b * (1 - b)) / len(own)
                gain[(v[1:] == v[:-1]) | (n < least) | (len(own) - n < least)] = 0
                if len(gain) and gain[i := int(gain.argmax())] > best[0]:
                    best = (gain[i], f, (v[i] + v[i + 1]) / 2)
            if best[1] >= 0:
                nodes[k][:2] = [best[1], best[2]]
                low = x[own, best[1]] <= best[2]
                stack += [(own[low], level + 1, k, 0), (own[~low], level + 1, k, 1)]
        a = np.array(nodes)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(out)


def synthetic_findings(n: int = 4000, seed: int = 11) -> pd.DataFrame:
    """Labelled findings made from rules: keys of common formats where they are set, and what is taken for them.

    Columns value, before, after, path, label. Used where no reviewed findings are given.
    """
    g = random.Random(seed)
    syllables = "an ber con de el for ge ha in ja ke la men no on per que ra sta ti un ver wo za".split()
    word = lambda: "".join(g.choices(syllables, k=g.randint(1, 4)))
    some = lambda chars, a, b: "".join(g.choices(chars, k=g.randint(a, b)))
    plain = "required optional string value number field user name account reset change login hidden story garden never answer question please enter your the old one will expire soon empty invalid missing open summer winter river stone".split()
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    names = ["token", "TOKEN", "api_key", "apiKey", "API-KEY", "secret", "client_secret", "password", "passwd", "access_key", "auth_token", "db.password", "DB_PASSWORD", "passphrase", "credential"]
    case = lambda v: v.upper() if g.random() < 0.2 else v
    text = lambda k: " ".join(word() for _ in range(k))
    rows = []
    for _ in range(n // 2):
        v = g.choice([
            lambda: case("".join(g.choices(hexa, k=g.choice([32, 40, 40, 64])))),
            lambda: some(alnum, 16, 64), lambda: some(alnum + "+/", 24, 64) + g.choice(["", "=", "=="]), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
            lambda: g.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + some(alnum, 20, 40), lambda: some(alnum + "!@#%&", 8, 20),
            lambda: word().capitalize() + some(string.digits, 1, 4) + g.choice("!@#$%&*") + some(alnum, 0, 4),
            lambda: some(alnum + "!@#%&*", 80, 900), lambda: " ".join(g.choices([*plain, word(), word().capitalize()], k=g.randint(3, 6))) + g.choice([" ", ""]) + some(string.digits, 1, 4) + g.choice(["", "!", "#"]),
        ])()
        op, quote = g.choice([" = ", "=", ": ", " := "]), g.choice(['"', '"', "'"] + ([] if " " in v else [""]))
        known = re.match(r"AKIA|ghp_|sk-|xoxb-|glpat-", v)
        before = f"{text(3)} " if known and g.random() < 0.4 else f"{text(2)} {g.choice(names)}{op}{quote}"
        rows.append((v, before, (quote if before[-1:] == quote else "") + f"{g.choice(['', '!!', ';', '###', ','])} {text(2)}", g.choice(["", "", "src/app.py", "config.yml"]), 1))
        u = g.choice([
            lambda: "".join(g.choices(hexa, k=g.choice([32, 40, 64]))), lambda: str(uuid.UUID(int=g.getrandbits(128))), lambda: some(string.digits, 16, 19),
            lambda: "_".join(word() for _ in range(4)) + str(g.randint(0, 99)), lambda: "/".join(word() for _ in range(4)) + str(g.randint(1, 9)),
            lambda: "-".join(word() for _ in range(4)) + f"-{g.randint(2000, 2030)}", lambda: text(5).replace(" ", "") + str(g.randint(1, 999)),
            lambda: g.choice("x0a*") * g.randint(8, 40), lambda: g.choice(["your_api_key_here1", "example-token-1234", "changeme12345678", "${SECRET_TOKEN_1}", "<password-123456>", "dummy_secret_value_1"]),
            lambda: g.choice([g.choice(plain), word(), "_".join(g.choices(plain, k=2)), ".".join(g.choices(plain, k=2)), " ".join(g.choices(plain, k=g.randint(2, 12))), " ".join(g.choices(plain, k=g.randint(2, 12))).capitalize() + "."]),
        ])()
        placeholder = bool(PLACEHOLDER.search(u)) or len(set(u)) == 1 or not re.search("[0-9]", u)
        quote = quote or ('"' if " " in u else "")
        lead = f"{text(2)} {g.choice(names)}{op}{quote}" if placeholder and g.random() < 0.6 else g.choice([f"{text(3)} ", f"{text(1)} sha256:", f"{text(1)} commit ", f"{text(1)} md5 = ", f"{text(1)} id: ", f'{text(1)} checksum = "', f"{text(1)} https://{word()}.com/"])
        rows.append((u, lead, (quote if lead[-1:] == quote else "") + " " + text(2), g.choice(["", "", "tests/test_a.py", "docs/example.md"]), 0))
    return pd.DataFrame(rows, columns=["value", "before", "after", "path", "label"])


def pattern_of(value: str, before: str, after: str) -> int:
    at = len(before)
    return next((k for a, b, k in candidates(before + value + after) if a < at + len(value) and b > at), len(PATTERNS))


def train(findings: pd.DataFrame, words: frozenset[str], **how) -> Forest:
    x = np.array([features(r.value, r.before, r.after, r.path or "", pattern_of(r.value, r.before, r.after), words) for r in findings.itertuples()])
    return grow(x, findings["label"].to_numpy(dtype=float), **how)


def find_secrets(
    docs: DataFrame, vocabulary: str, findings: DataFrame | None = None, max_findings: int = 20_000, cut: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: n_candidates, n_secrets, spans (start-end in characters, comma-joined), score (the surest
    candidate's), redacted (the text with every secret replaced), and the columns named in `keep`.

    `vocabulary` is the path of a public tokenizer file, the dictionary. `findings` holds reviewed findings (value,
    before, after, path, label) of which up to `max_findings`, in the order of a hash, train the forest; without it
    the rule-made ones do. A null text has no candidates and stays null. Nulls in other columns, repeated rows and
    empty tables pass through; names in `keep` must not be those of the result. Texts are scanned whole,
    and values of any length; passwords in URLs count from four characters on, values behind a name from six.
    """
    words = load_dictionary(vocabulary)
    if findings is None:
        labelled = synthetic_findings()
    else:
        wanted = findings.select("value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "path", "label")
        labelled = wanted.filter("value is not null and label is not null").orderBy(F.xxhash64("value", "before"), "value").limit(max_findings).toPandas()
    model = docs.sparkSession.sparkContext.broadcast((words, train(labelled, words)))
    text = F.col(text_col)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col), *keep, text.alias("_text"), path.alias("_path"), F.coalesce(text.rlike(GATE), F.lit(False)).alias("_look"))

    def part(batches):
        words, forest = model.value
        for b in batches:
            texts, spans, found = b["_text"].to_pylist(), [], []
            for i, (t, p, look) in enumerate(zip(texts, b["_path"].to_pylist(), b["_look"].to_pylist(), strict=True)):
                for a, z, k in candidates(t) if look else ():
                    spans.append((i, a, z))
                    found.append(features(t[a:z], t[max(0, a - CONTEXT):a], t[z:z + 16], p, k, words))
            score = forest.score(np.array(found)) if found else np.zeros(0)
            n, hit, best, at, out = np.zeros(len(texts), int), np.zeros(len(texts), int), np.zeros(len(texts)), [[] for _ in texts], list(texts)
            for (i, a, z), s in zip(spans, score, strict=True):
                n[i], best[i] = n[i] + 1, max(best[i], s)
                if s >= cut:
                    at[i].append((a, z))
            for i, own in enumerate(at):
                if own:
                    t, cuts = texts[i], [0, *(x for s in own for x in s), len(texts[i])]
                    out[i] = REDACTED.join(t[cuts[j]:cuts[j + 1]] for j in range(0, len(cuts), 2))
                    hit[i] = len(own)
            where = pa.array([",".join(f"{a}-{z}" for a, z in own) for own in at], pa.string())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in given), pa.array(n), pa.array(hit), where, pa.array(best), pa.array(out, pa.string())],
                                             [*given, "n_candidates", "n_secrets", "spans", "score", "redacted"])

    given = [f.name for f in rows.schema if f.name[0] != "_"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in given)
    return rows.mapInArrow(part, f"{kind}, n_candidates long, n_secrets long, spans string, score double, redacted string")


REDACTED = "<secret>"
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def op9_query(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts, spans, the surest score and the digest of the redacted text, per document."""
    out = find_secrets(docs.select("doc_id", "text", "source"), vocabulary)
    return out.withColumn("redacted_sha256", F.sha2(F.coalesce("redacted", F.lit("")).cast("binary"), 256)).drop("redacted")
