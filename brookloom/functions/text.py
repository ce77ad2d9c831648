"""Column functions over texts: lengths, trims, validity, hashes, keys, budgets and clean-ups. All run in the JVM, but for
the hash of a text's units, which is a dot product of Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as a web page's script sees it: ASCII, and the fixed further code points.
SPACES = r"[\s\u000b   -     　﻿]"
#: Fixed values of the text filter.
MIN_TEXT, MAX_TEXT, SHORT_LABEL, MAX_TUPLES = 3, 3072, 25, 8
TUPLE = r"""\[\s*['"][^'"]+['"]\s*,\s*-?\d+(?:\.\d+)?\s*\]"""
PACKED = r"^[A-Za-z0-9+/=_-]{200,}$"
#: (text to look for as a regular expression, label), first match wins; fixed values.
ERROR_CLASSES = (
    ("HTTP 401", "401-auth"),
    ("HTTP 403", "403-billing"),
    ("HTTP 429", "429-rate-limit"),
    ("HTTP 5", "5xx-server"),
    ("HTTP 400", "400-bad-req"),
    (r"HTTP 4\d\d", "4xx-other"),
    ("网络请求失败|fetch", "network"),
    ("请求超时|timeout", "timeout"),
    ("Unexpected token|JSON", "json-parse"),
    (r"缺少 choices\[0\]\.message\.content", "invalid-resp"),
    ("response body is null", "null-body"),
)
#: Addresses that never leave the machine; fixed values.
PRIVATE_URL = r"(?i)^(https?://(localhost|127\.|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|[^/]*\.local\b)|file://)"
MAX_UPLOAD = 5 * 1024 * 1024


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, by which the thresholds are stated."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACES}+|{SPACES}+$", "")


def is_valid_text(c: Column, skip_patterns: tuple[str, ...] = ()) -> Column:
    """Whether a trimmed text is worth keeping: length, short labels in capitals, data tuples, packed data, site patterns."""
    n = utf16_length(c)
    ok = (n >= MIN_TEXT) & (n < MAX_TEXT)
    ok &= ~((n < SHORT_LABEL) & c.rlike(r"^[A-Z0-9\s]+$") & ~c.rlike(r"^[0-9\s]+$"))
    ok &= (F.size(F.regexp_extract_all(c, F.lit(TUPLE), F.lit(0))) < MAX_TUPLES) & ~c.rlike(PACKED)
    for p in skip_patterns:
        ok &= ~c.rlike(f"(?i){p}")
    return F.coalesce(ok, F.lit(False))


def collapse_spaced(c: Column) -> Column:
    """Runs of four or more single letters or digits with spaces between, joined: a look-behind and a look-ahead pick
    the spaces inside such runs, found first and then replaced one run at a time."""
    runs = F.regexp_extract_all(c, F.lit(r"([a-zA-Z0-9](?:\s+[a-zA-Z0-9]){3,})"), F.lit(1))
    return F.aggregate(F.coalesce(runs, F.array().cast("array<string>")), c, lambda t, run: F.replace(t, run, F.regexp_replace(run, r"\s+", "")))


def token_estimate(c: Column) -> Column:
    return F.ceil(utf16_length(c) / 4)


def output_budget(c: Column) -> Column:
    return F.greatest(F.lit(1024), F.ceil(F.ceil(utf16_length(c) * 0.5) * 16))


def caption_budget(c: Column) -> Column:
    return F.greatest(F.lit(2048), token_estimate(c) * 2)


def trace_budget(c: Column) -> Column:
    return F.greatest(F.lit(256), F.ceil(token_estimate(c) * 2.4))


HEAD_UNITS, HASH_BASE, HASH_MASK = 200, 31, 0x7FFFFFFF


def _powers(n: int) -> np.ndarray:
    """HASH_BASE to the powers n - 1 down to 0, modulo 2**32."""
    out = np.full(n, HASH_BASE, np.uint32)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)[::-1]


@F.pandas_udf(T.StructType([T.StructField("whole", T.LongType()), T.StructField("head", T.LongType())]))
def _hashes(text: pd.Series, extra: pd.Series) -> pd.DataFrame:
    """31 * h + unit over UTF-16 units, modulo 2**31, of each text and of its head, the extra text after either."""
    powers = np.empty(0, np.uint32)
    rows = []
    for t, x in zip(text, extra, strict=True):
        if t is None:
            rows.append((None, None))
            continue
        units, more = (np.frombuffer((s or "").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32) for s in (t, x))
        if len(units) + len(more) > len(powers):
            powers = _powers(2 * (len(units) + len(more)))
        one = lambda u: int((u * powers[len(powers) - len(u) :]).sum(dtype=np.uint32)) & HASH_MASK  # noqa: B023, E731
        rows.append((one(np.r_[units, more]), one(np.r_[units[:HEAD_UNITS], more])))
    return pd.DataFrame(rows, columns=["whole", "head"]).astype("Int64")


def rolling_hash(c: Column) -> Column:
    """31 * h + unit over UTF-16 units, modulo 2**31."""
    return _hashes(c, F.lit(""))["whole"]


def cache_key(content: Column, source: Column, target: Column, provider: Column | None = None, style: Column | None = None) -> Column:
    """Key of a translation, of the whole text and its first 200 units; provider and style count only where one of them is
    set. Null for a null text."""
    p = F.coalesce(provider, F.lit("")) if provider is not None else F.lit("")
    s = F.coalesce(style, F.lit("")) if style is not None else F.lit("")
    h = _hashes(content, F.when((p != "") | (s != ""), F.concat(p, F.lit(":"), s)).otherwise(""))
    return F.when(content.isNotNull(), F.concat_ws("_", F.lit("translation"), source, target, h["whole"], h["head"]))


def error_class(c: Column) -> Column:
    out = F.when(F.coalesce(c, F.lit("")) == "", "other")
    for pattern, label in ERROR_CLASSES:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise("other")


def is_private_url(c: Column) -> Column:
    return c.rlike(PRIVATE_URL)


def upload_verdict(share: Column, url: Column, html: Column, server: Column) -> Column:
    """Why an upload isn't tried, or null."""
    return (
        F.when(~F.coalesce(share, F.lit(False)), "not shared")
        .when(utf16_length(html) > MAX_UPLOAD, "too large")
        .when(is_private_url(url), "private url")
        .when(F.coalesce(server, F.lit("")) == "", "no server")
    )


def pixels(c: Column) -> Column:
    """The number that a length in pixels begins with, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_parameter(c: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(c, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def without_base(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)<base\b[^>]*>", "")


def secure_forms(c: Column) -> Column:
    return F.regexp_replace(c, r"""(?i)(<form\b[^>]*\baction=["'])http://""", "$1https://")


def server_html(c: Column, most: int = 900_000) -> Column:
    """The page for a server: forms made secure; beyond ``most`` units its body alone."""
    safe = secure_forms(c)
    body = F.regexp_extract(safe, r"(?is)(<body\b.*</body\s*>)", 1)
    return F.when((utf16_length(safe) > most) & (body != ""), body).otherwise(safe)


def without_thinking(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def without_fence(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), r"(?i)^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""))


def repaired_json(c: Column) -> Column:
    """A cut-off JSON text with its string, lists and objects closed. Escaped characters and whole strings are taken out; a
    quote that is left opens a string that doesn't end, and brackets before it are counted."""
    text = trimmed(c)
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    outside = F.substring_index(rest, '"', 1)
    n = lambda x: F.length(outside) - F.length(F.replace(outside, F.lit(x), F.lit("")))
    missing = lambda opens, closes: F.repeat(F.lit(closes), F.greatest(n(opens) - n(closes), F.lit(0)))
    return F.concat(text, F.when(rest.contains('"'), '"').otherwise(""), missing("[", "]"), missing("{", "}"))


#: Languages whose captions are measured in characters; fixed values.
CHARACTER_LANGUAGES = ("zh", "ja", "ko", "th", "lo", "km", "my")


def counts_characters(lang: Column) -> Column:
    return F.coalesce(lang.rlike(f"^({'|'.join(CHARACTER_LANGUAGES)})"), F.lit(False))


def unit_length(text: Column, lang: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(counts_characters(lang), utf16_length(text)).otherwise(words)


def unit_limit(lang: Column) -> Column:
    return F.when(counts_characters(lang), 30).otherwise(15)


def without_noise(c: Column) -> Column:
    """Captions without bracketed sounds and notes of music."""
    for p in (r"\[.*?\]", r"\(.*?\)", "♪.*?♪", "🎵.*?🎵", "🎶.*?🎶"):
        c = F.regexp_replace(c, p, "")
    return c


def clean_caption(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(c, "​", ""), rf"{SPACES}+", " "))


_EDGE = r"""[,;:.!?'"“”‘’()\[\]{}\-–—#*_/\\|<>~`\s]+"""


def clean_term(c: Column) -> Column:
    """A candidate term without edge punctuation, possessive, apostrophes, and what follows a full stop and a capital."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"^{_EDGE}", ""), f"{_EDGE}$", ""), "(?i)['’]s$", "")
    return trimmed(F.regexp_replace(F.regexp_extract(c, r"(?s)^(.*?)(?:\.[A-Z].*)?$", 1), "['’]", ""))


def blanked_code(c: Column) -> Column:
    """Code fences, inline code and addresses as blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), r"`[^`\n]+`", " "), r"https?://\S+", " ")
