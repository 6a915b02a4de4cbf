"""Canonical JSON, content hashes and request fingerprints."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F


def _exact(separators: tuple[str, str]):
    @F.pandas_udf("string")
    def dump(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(
                    json.loads(text), sort_keys=True, ensure_ascii=False, separators=separators
                )
            except ValueError:
                return None

        return texts.map(one)

    return dump


def canonical_json(c: Column, exact: bool = False) -> Column:
    """Sorted-key compact JSON; null for malformed input.

    The default stays in the JVM: variants keep object keys sorted and normalise numbers
    (`1.0` becomes `1`). `exact=True` keeps number spelling, through an Arrow batch function.
    """
    return _exact((",", ":"))(c) if exact else F.to_json(F.try_parse_json(c))


def config_hash(c: Column, exact: bool = False) -> Column:
    return F.sha2(canonical_json(c, exact), 256)


def request_fingerprint(
    template: Column, params_json: Column, version: Column | None = None, exact: bool = False
) -> Column:
    """Key-order-insensitive digest of template, parameters and optional schema version.

    `exact=True` writes the parameters with a blank after each separator, which gives digests
    equal to those already stored by the producing service.
    """
    body = _exact((", ", ": "))(params_json) if exact else canonical_json(params_json)
    text = F.concat(template, F.lit("|"), body)
    if version is not None:
        suffix = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("|"), version))
        text = F.concat(text, F.coalesce(suffix, F.lit("")))
    return F.sha2(text, 256)


def _unwrap_text(text: str | None, required: frozenset[str]) -> str | None:
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return text
    if not isinstance(doc, dict) or not required or required <= doc.keys():
        return text
    inner = (
        element
        for value in doc.values()
        for element in (value if isinstance(value, list) else [value])
        if isinstance(element, dict) and required <= element.keys()
    )
    found = next(inner, None)
    return text if found is None else json.dumps(found, ensure_ascii=False, separators=(",", ":"))


def unwrap_payload(c: Column, required) -> Column:
    """First nested object (or array element) holding all required keys, else the text unchanged.

    Key order of the source text decides which one is first, which variants do not keep; hence
    the Arrow batch function.
    """
    names = frozenset(required)

    @F.pandas_udf("string")
    def unwrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _unwrap_text(t, names))

    return unwrap(c)
