"""Personal data by weak supervision.

Candidates are found by plain expressions (`base`: e-mail, IP, card and phone in their strict forms) and by looser ones
(written-out e-mail addresses, IPv6 also in its short form, cards of 15 digits, phone numbers without a plus or with 00,
cards and phone numbers whose strict form ran on into digits behind them and failed, and credentials: long values of
mixed signs behind a word like `token` or with a known beginning). Five labelers vote for (1),
against (-1) or abstain (0) on every candidate: the strict expression, a check of its digits or parts, a gazetteer, the
words before it, and whether it stands alone. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; these probabilities train a logistic classifier
over votes and shape, which decides on every candidate that is not a base span. Base spans always stay.

Patterns are few (kinds x 3^5 votes x 8 shapes), so what reaches the driver is bounded whatever the table's size; every
candidate of every text is counted.

Defined cases: null text is empty; places are code points, the end exclusive; a span that overlaps a base span, or one
taken before it, is dropped; rows that repeat an id are judged each; an empty table gives no row; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

#: The last kind has no strict form.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Digit runs are entered at their first digit only: what fails there fails further on too.
EMAIL_HEAD, EMAIL_TAIL = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)+"),
    "ip": re.compile(
        r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
    ),
    "card": re.compile(
        r"(?<![0-9A-Za-z+.-])(?:[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z]|[.-][0-9])"
    ),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{1,4}){2,5}|(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![0-9A-Za-z])"
    ),
    "secret": re.compile(
        r"(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|bearer|authorization)[\"']?(?: ?[:=] ?| is | )[\"']?((?=[^\s\"']{0,64}?[0-9])[A-Za-z0-9+/_.-]{12,256}+=*)"
        r"|(?<![A-Za-z0-9])((?:AKIA|gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,256}+)",
        re.I,
    ),
}
#: Gazetteers: top-level domains, country codes, first digits of cards, words before a candidate.
DOMAINS = set("com org net edu gov info de fr es uk eu io it nl ch at be pl us ca br ru jp cn in au".split())
#: One and two digits as they are; of three digits the zones they begin with.
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
             "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "53",
             "58", "59", "67", "68", "69", "85", "88", "96", "97", "99")
CARD_STARTS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
CUES = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobil|cell|numm?er|num[eé]r", re.I),
    "secret": re.compile(r"key|secret|token|passw|pwd|bearer|authorization", re.I),
}
STARTS = re.compile(r"AKIA|gh[pousr]_|sk-|xox[abp]-|eyJ")
AGAINST = re.compile(r"version|isbn|issn|order|serial|sku|part|commit|hash|section|\bv$", re.I)
LABELERS, SHAPES, BEFORE = 5, 8, 32


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict forms, leftmost and not overlapping within a kind, by kind and place."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and EMAIL_HEAD.match(text, start - 1):
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        low = tail.end() if tail else at + 1
        if tail:
            out.append((0, start, tail.end()))
        at = text.find("@", low)
    if any(d in text for d in "0123456789"):
        for m in IP.finditer(text):
            if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p.lstrip("0")[3:]) for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def votes(kind: int, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    found, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - BEFORE) : start]
    if kind == 0:
        last = re.split(r"[.\])\s]", found)[-1].lower()
        check, gazetteer = 1 if last.isalpha() and 2 <= len(last) <= 24 else -1, 1 if last in DOMAINS or len(last) == 2 else 0  # two letters: a country
    elif kind == 1:
        parts = found.split(".")
        plain = len(parts) == 4 and all(p == str(int(p)) for p in parts if len(p) < 4)
        check, gazetteer = 1 if plain or ":" in found else -1, -1 if parts[0] in ("0", "127", "255") else 1
    elif kind == 2:
        check, gazetteer = 1 if _luhn(digits) else -1, 1 if CARD_STARTS.match(digits) else -1
    elif kind == 4:
        mixed = len(found) >= 16 and len(set(found)) >= 8 and any(c.isalpha() for c in found)
        check, gazetteer = 1 if mixed and len(digits) >= 2 else -1, 1 if STARTS.match(found) else 0
    else:
        known = digits.startswith(COUNTRIES) if found[0] == "+" else digits[2:].startswith(COUNTRIES) if digits[:2] == "00" else digits[0] in "23456789"
        check, gazetteer = 1 if 8 <= len(digits) <= 15 else -1, 1 if known else -1
    cue = -1 if AGAINST.search(before) else 1 if CUES[KINDS[kind]].search(before) else 0
    alone = not (text[start - 1 : start].isalnum() if start else False) and not text[end : end + 1].isalnum()
    return 1 if base else 0, check, gazetteer, cue, 1 if alone else -1


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, pattern) of all spans that are voted on."""
    if not text:
        return []
    found = [(k, a, b, True) for k, a, b in base_spans(text)]
    if any(d in text for d in "0123456789") or "at)" in text or "at]" in text:
        for k, name in enumerate(KINDS):
            for m in LOOSE[name].finditer(text):
                found.append((k, *m.span(m.lastindex or 0), False))
    out = []
    for k, a, b, base in found:
        pattern = 0
        for v in votes(k, text, a, b, base):
            pattern = pattern * 3 + v + 1
        digits = len(_digits(text[a : min(b, a + 256)]))
        shape = min(3, (b - a) // 8) * 2 + (2 * digits > b - a)
        out.append((k, a, b, base, (k * 3**LABELERS + pattern) * SHAPES + shape))
    return out


def _unpack(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, rest = pattern % SHAPES, pattern // SHAPES
    kind, code = rest // 3**LABELERS, rest % 3**LABELERS
    return kind, np.stack([code // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], 1), shape


def reliabilities(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50):
    """EM over vote patterns of each kind: P(personal | pattern), and P(vote | personal or not) of each labeler."""
    # start: the share of supporting among given votes
    given = np.maximum((vote != 1).sum(1), 1)
    p = np.clip((vote == 2).sum(1) / given, 0.05, 0.95)
    table = np.full((len(KINDS), LABELERS, 2, 3), 1 / 3)
    for _ in range(rounds):
        for k in range(len(KINDS)):
            mine = kind == k
            if not mine.any():
                continue
            w = np.stack([(1 - p[mine]) * count[mine], p[mine] * count[mine]])
            prior = (w.sum(1) + 1) / (w.sum() + 2)
            score = np.log(prior)[:, None] * np.ones(mine.sum())
            for j in range(LABELERS):
                sums = np.stack([np.bincount(vote[mine, j], w[y], 3) for y in (0, 1)]) + np.array([[1.5, 1, 0.5], [0.5, 1, 1.5]])
                table[k, j] = sums / sums.sum(1, keepdims=True)
                score += np.log(table[k, j][:, vote[mine, j]])
            p[mine] = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return p, table


def train(pattern: np.ndarray, count: np.ndarray, rounds: int = 300) -> set[int]:
    """Patterns that the classifier takes for personal data."""
    if not len(pattern):
        return set()
    kind, vote, shape = _unpack(pattern)
    p, _ = reliabilities(kind, vote, count.astype(float))
    x = np.concatenate(
        [np.eye(len(KINDS))[kind], *(np.eye(3)[vote[:, j]] for j in range(LABELERS)), np.eye(SHAPES)[shape]], 1
    )
    weight, beta = np.sqrt(count / count.max()), np.zeros(x.shape[1])
    for _ in range(rounds):  # iteratively reweighted least squares with a ridge
        mean = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = (x * (weight * np.maximum(mean * (1 - mean), 1e-6))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        step = np.linalg.solve(slope, x.T @ (weight * (p - mean)) - 0.01 * beta)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return set(pattern[x @ beta >= 0].tolist())


def found_spans(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end, base)) of every text, base spans and those that the classifier adds."""

    def run(batches):
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))
        names = ("kind", "start", "end", "base", "pattern")
        for batch in batches:
            spans = [[dict(zip(names, s)) for s in candidates(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kinds)], ["doc_id", "spans"])

    shaped = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    element = "struct<kind: int, start: int, end: int, base: boolean, pattern: int>"
    all_ = C.cut(shaped.mapInArrow(run, f"doc_id long, spans array<{element}>"), folder, "candidates")
    # at most kinds x 3^labelers x shapes rows
    counts = all_.select(F.explode("spans").alias("s")).groupBy("s.pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    taken = train(np.array([r.pattern for r in counts], np.int64), np.array([r.n for r in counts], np.int64))

    def decide(batches):
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                keep = [s for s in spans if s["base"]]
                for s in spans:
                    clear = all(s["end"] <= t["start"] or t["end"] <= s["start"] for t in keep)
                    if not s["base"] and s["pattern"] in taken and clear:
                        keep.append(s)
                keep.sort(key=lambda s: (s["kind"], s["start"]))
                out.append([{k: s[k] for k in ("kind", "start", "end", "base")} for s in keep])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], ["doc_id", "spans"])

    return all_.mapInArrow(decide, "doc_id long, spans array<struct<kind: int, start: int, end: int, base: boolean>>")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans as text, how many were added, how many
    of these are credentials, and how many there are in all."""
    def one(s):
        name = F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string"))

    text = lambda c: F.array_join(F.transform(c, one), ",")
    base = F.filter("spans", lambda s: s["base"])
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", *(n(k) for k in range(len(KINDS) - 1)), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
        F.size(F.filter("spans", lambda s: s["kind"] == len(KINDS) - 1)).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )
