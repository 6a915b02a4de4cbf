"""Credential redaction for text and JSON columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Credential names, patterns and markers. The blank class is spelled out because
# engines disagree on which characters `\s` covers.
SENSITIVE_KEYS = (
    "api_key",
    "apikey",
    "authorization",
    "password",
    "secret",
    "token",
    "access_token",
    "refresh_token",
)
SENSITIVE_SUFFIXES = (
    "_api_key",
    "_authorization",
    "_password",
    "_secret",
    "_access_token",
    "_refresh_token",
    "_token",
)
BLANK = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
KEY_NAMES = r"api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token|token"
BEARER = rf"(?i)(bearer[{BLANK}]+)([^{BLANK},;]+)"
KEY_VALUE = rf"(?i)({KEY_NAMES})([{BLANK}]*[:=][{BLANK}]*)([^{BLANK},;]+)"
# one of these is in every text that either pattern matches
MARKS = ("bearer", "api", "authorization", "password", "secret", "token")
MASK = "[REDACTED]"
CUT_MARK = "...[truncated]"
#: Fixed value: where the service cuts a stored string. Masking alone keeps the whole text.
STORED_LENGTH = 2000


def java_pattern(pattern: str) -> Column:
    """Case folding over all of Unicode, as in the producer's patterns."""
    return F.lit(pattern.replace("(?i)", "(?iu)", 1))


def _bind(c: Column, body) -> Column:
    """body(c) with c computed once per row."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def may_hold_credentials(c: Column) -> Column:
    """Cheap test that lets most texts skip the patterns. A `ſ` counts as a hit: it folds to `s`
    in the patterns, but not by lower()."""

    def any_mark(folded: Column) -> Column:
        hit = F.contains(folded, F.lit("ſ"))
        for mark in MARKS:
            hit = hit | F.contains(folded, F.lit(mark))
        return hit

    return _bind(F.lower(c), any_mark)


def mask_text(c: Column) -> Column:
    """Bearer values first: otherwise the key rule would take the word `Bearer` for the value."""
    bearer = F.regexp_replace(c, java_pattern(BEARER), F.lit("$1" + MASK))
    masked = F.regexp_replace(bearer, java_pattern(KEY_VALUE), F.lit("$1$2" + MASK))
    return F.when(may_hold_credentials(c), masked).otherwise(c)


def redact_text(c: Column, max_len: int | None = None) -> Column:
    """The whole text with its credentials masked; with `max_len`, cut behind so many characters and marked."""
    if max_len is None:
        return mask_text(c)

    def cut(masked: Column) -> Column:
        short = F.concat(F.substring(masked, 1, max_len), F.lit(CUT_MARK))
        return F.when(F.length(masked) > max_len, short).otherwise(masked)

    return _bind(mask_text(c), cut)


def redact_map(c: Column, max_len: int | None = None) -> Column:
    """Flat map<string,string>: JVM-only form of redact_json."""
    return F.transform_values(
        c, lambda k, v: F.when(is_sensitive(k), F.lit(MASK)).otherwise(redact_text(v, max_len))
    )


def is_sensitive(key: Column) -> Column:
    name = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    hit = name.isin(*SENSITIVE_KEYS)
    for suffix in SENSITIVE_SUFFIXES:
        hit = hit | F.endswith(name, F.lit(suffix))
    return hit


def _python_pattern(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].zfill(4), pattern))


def redact_json(c: Column, max_len: int | None = None) -> Column:
    """Masks values under credential keys at any depth and credentials inside any string.

    Depth is unbounded, which column expressions cannot follow: an Arrow batch function.
    Malformed text is treated as one string.
    """
    bearer, pair = _python_pattern(BEARER), _python_pattern(KEY_VALUE)

    def text(value: str) -> str:
        masked, folded = value, value.lower().replace("ſ", "s")
        if any(mark in folded for mark in MARKS):
            masked = pair.sub(rf"\1\2{MASK}", bearer.sub(rf"\1{MASK}", value))
        return masked[:max_len] + CUT_MARK if max_len is not None and len(masked) > max_len else masked

    def hidden(key: str) -> bool:
        name = key.lower().replace("-", "_")
        return name in SENSITIVE_KEYS or name.endswith(SENSITIVE_SUFFIXES)

    def walk(node):
        if isinstance(node, str):
            return text(node)
        if isinstance(node, list):
            return [walk(child) for child in node]
        if isinstance(node, dict):
            return {k: MASK if hidden(k) else walk(v) for k, v in node.items()}
        return node

    def one(raw):
        if raw is None:
            return None
        try:
            doc = json.loads(raw)
        except ValueError:
            return text(raw)
        return json.dumps(walk(doc), ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return redact(c)
