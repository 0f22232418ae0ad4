"""Headline and page text as columns."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

_META = set(r"\.^$|?*+()[]{}-")


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def keyword_pattern(keywords) -> str:
    """One alternation: ASCII keywords as whole words, others as plain substrings."""
    ascii_ = [_quote(k) for k in keywords if k.isascii()]
    other = [_quote(k) for k in keywords if not k.isascii()]
    parts = []
    if ascii_:
        parts.append(r"(?<![\p{L}\p{N}_])(?:" + "|".join(ascii_) + r")(?![\p{L}\p{N}_])")
    if other:
        parts.append("|".join(other))
    return "|".join(parts)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def keyword_groups(headline: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups with a keyword in the headline, in the order given; empty for null.

    ASCII keywords are whole words, others plain substrings. The headline is lower-cased and cut into words once; one
    walk keeps the words that are a keyword of any group, and a pattern runs only where a phrase's text occurs.
    """
    single = lambda kws: [k for k in kws if k.isascii() and k.isalnum()]
    phrase = lambda kws: [k for k in kws if k.isascii() and not k.isalnum()]
    known = sorted({k for kws in groups.values() for k in single(kws)})
    low = F.lower(headline)
    own = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(known)) if known else F.array().cast("array<string>")

    def match(kws, line: Column, own: Column) -> Column:
        words = [F.arrays_overlap(own, F.array(*[F.lit(k) for k in single(kws)]))] if single(kws) else []
        texts = [line.contains(k) & line.rlike(keyword_pattern([k])) for k in phrase(kws)]
        return _any([*words, *texts, *[line.contains(k) for k in kws if not k.isascii()]])

    return _let(
        F.struct(low.alias("line"), own.alias("own")),
        lambda s: F.array_compact(F.array(*[F.when(match(kws, s["line"], s["own"]), F.lit(name)) for name, kws in groups.items()])),
    )


def has_keyword(headline: Column, keywords) -> Column:
    return F.when(headline.isNotNull(), F.size(keyword_groups(headline, {"": tuple(keywords)})) > 0)


def normalize_headline(h: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(h), "[^a-z0-9가-힣 ]", " "), " +", " "))


def normalize_title(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), r"[^\p{L}\p{N}]", "")


def event_tags(headline: Column) -> Column:
    """Sorted categories a headline matches."""
    return keyword_groups(headline, dict(sorted(fixed.EVENT_KEYWORDS.items())))


def risk_bucket(headline: Column) -> Column:
    """First macro risk bucket a headline falls in, most severe first; NULL if none."""

    def first(h: Column) -> Column:
        among = lambda words: _any([h.contains(w) for w in words])
        bank = among(fixed.CENTRAL_BANK_SUBSTRINGS) | (among(fixed.CENTRAL_BANK_WORDS) & h.rlike(keyword_pattern(fixed.CENTRAL_BANK_WORDS)))
        out = F.lit(None).cast("string")
        for name, _, words in reversed(fixed.MACRO_RISK_BUCKETS):
            cond = among(words)
            if name == "emergency_central_bank":
                cond = cond | (among(fixed.EMERGENCY_PHRASES) & bank)
            out = F.when(cond, name).otherwise(out)
        return out

    return _let(F.lower(headline), first)


def risk_weight(bucket: Column) -> Column:
    out = F.lit(0)
    for name, weight, _ in fixed.MACRO_RISK_BUCKETS:
        out = F.when(bucket == name, weight).otherwise(out)
    return out


def risk_level(score: Column, elevated: int = 2, risk_off: int = 6) -> Column:
    return F.when(score >= risk_off, "RISK_OFF").when(score >= elevated, "ELEVATED").otherwise("NORMAL")


def recency_weight(date: Column, asof: Column, half_life: float = 3.0) -> Column:
    age = F.greatest(F.datediff(asof, date), F.lit(0))
    return F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(1.0))


def tokens(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z가-힣0-9]+)"), F.lit(1)), lambda t: F.lower(t))
    stop = fixed.KO_STOPWORDS + fixed.EN_STOPWORDS
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*stop))


def ngrams(toks: Column, n: int) -> Column:
    """All runs of `n` tokens, joined by spaces; empty for fewer tokens or null."""
    count = F.greatest(F.size(toks) - n + 1, F.lit(0))
    out = F.slice(toks, 1, count)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(toks, k, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.coalesce(out, F.array().cast("array<string>"))


_ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def _entity(e: Column) -> Column:
    """The text of one character reference; unknown names stay, code points that are none become U+FFFD."""
    names = F.create_map(*[F.lit(x) for k, v in sorted(html5.items()) if k.endswith(";") for x in (f"&{k}", v)])
    digits = F.regexp_extract(e, "^&#([0-9]+);$", 1)
    hexa = F.regexp_extract(e, "^&#[xX]([0-9A-Fa-f]+);$", 1)
    code = F.when(digits != "", digits.try_cast("bigint")).when(F.length(hexa) < 9, F.conv(hexa, 16, 10).try_cast("bigint"))
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(F.startswith(e, F.lit("&#")), char).otherwise(F.coalesce(F.try_element_at(names, e), e))


def clean_html(raw: Column) -> Column:
    """Strip tags, then unescape every character reference once, so that no result is unescaped again."""
    s = F.regexp_replace(raw, "<[^>]+>", "")
    found = F.regexp_extract_all(s, F.lit(_ENTITY), F.lit(0))
    parts = F.transform(F.split(s, _ENTITY, -1), lambda p, i: F.concat(p, F.coalesce(_entity(F.get(found, i)), F.lit(""))))
    return F.regexp_replace(F.array_join(parts, ""), r"^[\s ]+|[\s ]+$", "")


def domain(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def redact_key(msg: Column) -> Column:
    return F.regexp_replace(msg, r"(apikey=)[^&\s'\"]+", "$1***")


def parse_signals(raw: Column) -> Column:
    """JSON array of strings; anything else is an empty array."""
    arr = F.try_variant_get(F.try_parse_json(raw), "$", "array<string>")
    return F.coalesce(arr, F.array().cast("array<string>"))


def kv_map(raw: Column) -> Column:
    """'a=1,b=2' to a map; blank parts are skipped. See `kv_bad_parts` for the error check."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    good = F.filter(parts, lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(
        good,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value"),
        ),
    )
    # of a repeated key the last entry counts; `let` by a one-element array, so that pairs are built once
    last = F.transform(
        F.array(pairs),
        lambda ps: F.filter(ps, lambda x, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda y: y["key"] == x["key"])),
    )
    return F.map_from_entries(F.element_at(last, 1))


def kv_bad_parts(raw: Column) -> Column:
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (F.instr(p, "=") == 0))


def zero_pad_code(raw: Column, width: int = 6) -> Column:
    """Upper-cased code, zero-padded to `width`; longer codes keep their length."""
    c = F.upper(F.trim(raw))
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def watch_ticker(raw: Column) -> Column:
    """Upper-case unless the code starts with a digit."""
    t = F.trim(raw)
    return F.when(t.rlike("^[0-9]"), t).otherwise(F.upper(t))


def krw_cap(cap: Column) -> Column:
    """Market cap in Korean units: trillion (jo), hundred million (eok), won."""
    return (
        F.when(cap >= 1e12, F.format_string("%,.1f조", cap / 1e12)).when(cap >= 1e8, F.format_string("%,.0f억", cap / 1e8))
        .otherwise(F.format_string("%,.0f원", cap))
    )


def usd_cap(cap: Column) -> Column:
    return (
        F.when(cap >= 1e12, F.format_string("$%,.2fT", cap / 1e12)).when(cap >= 1e9, F.format_string("$%,.1fB", cap / 1e9))
        .when(cap >= 1e6, F.format_string("$%,.0fM", cap / 1e6)).otherwise(F.format_string("$%,.0f", cap))
    )
