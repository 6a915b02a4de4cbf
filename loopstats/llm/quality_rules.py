"""Quality rules with risk-controlled cutoffs.

A rule rejects a text whose value exceeds a cutoff. Labelled texts decide the cutoffs: in each stratum (language) and for
each rule the cutoffs are tried from the loosest to the strictest, and a cutoff is taken as long as an exact binomial
test shows that it rejects less than `risk` / rules of the good texts: P(Bin(n, risk / rules) <= rejected) is at most
`error` / (strata x rules). Testing in a fixed order needs no further correction along the cutoffs; the error is shared
out over strata and rules (Bonferroni), and the risk over rules, so with probability 1 - `error` no stratum loses more
than `risk` of its good texts. Where the labels cannot show that, nothing is rejected.

Counts are sums over all labelled rows in one aggregation; a stratum's test sees its one row of counts.

Defined cases: null text has no words; null language is a stratum; unlabelled strata have no cutoffs; several labels of
an id count as good if all are; labels without a text, or null, do not count; an empty table gives no row; other
columns are carried where `carry` is set, and the added names replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common as C

RISK, ERROR = 0.04, 0.05
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
RULES = ("symbols", "dup_lines", "repeats", "capitals")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS, CAPITALS = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LINE = np.ones(256, bool)
LINE[10] = False
FOLLOWS = np.array([0x80 <= b < 0xC0 for b in range(256)])


def _count(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(kind[raw]), offsets))


def _repeated(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (row, value), and where in it an entry equals the one before."""
    order = np.lexsort((values, rows))
    same = np.zeros(len(rows), bool)
    same[1:] = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return order, same


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of each text, from the bytes of all."""
    n = len(offsets) - 1
    words = C.Words(raw, offsets)
    lines = C.Words(raw, offsets, LINE)
    full = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    line_rows = lines.row[full]
    _, same = _repeated(line_rows, lines.hash[full])
    dup_rows = np.sort(line_rows)[same]

    at = np.flatnonzero(words.first[words.row + 1] - np.arange(len(words.hash)) >= WINDOW) if len(words.hash) else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for i in range(WINDOW):
        value += words.hash[at + i] * C.PLACES[i]
    order, same = _repeated(words.row[at], C.mix(value))
    twice = same.copy()
    twice[:-1] |= same[1:]
    change = np.zeros(len(words.hash) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0
    return {
        "n_words": words.n,
        "word_chars": np.bincount(words.row, words.end - words.start, n).astype(np.int64) - _count(raw, offsets, FOLLOWS),
        "n_symbols": _count(raw, offsets, SYMBOLS),
        "n_dup_lines": np.bincount(dup_rows, minlength=n),
        "n_repeat_words": np.bincount(words.row[covered], minlength=n),
        "n_lines": np.bincount(line_rows, minlength=n),
        "n_capitals": _count(raw, offsets, CAPITALS),
    }


def with_metrics(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` of `docs` and the metrics of its text."""
    others = [c for c in carry if c != text]
    fields = [docs.schema[c] for c in carry] + [T.StructField(m, T.LongType()) for m in METRICS]
    at = [0 if c == text else 1 + others.index(c) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, b in C.chunks(batch.column(0)):
                found = measure(*C.text_bytes(batch.column(0).slice(a, b - a)))
                columns = [batch.column(i).slice(a, b - a) for i in at]
                columns += [pa.array(found[m].astype(np.int64)) for m in METRICS]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *METRICS])

    return docs.select(text, *others).mapInArrow(run, T.StructType(fields))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"), "capitals": over("n_capitals", "word_chars"),
    }


def binomial_tail(n: int, rejected: int, p: float) -> float:
    """P(Bin(n, p) <= rejected), exact: summed downwards from `rejected` until terms no longer count; 1 at or above the mean."""
    if n <= 0 or rejected >= n * p:
        return 1.0
    log_term = (
        math.lgamma(n + 1) - math.lgamma(rejected + 1) - math.lgamma(n - rejected + 1)
        + rejected * math.log(p) + (n - rejected) * math.log1p(-p)
    )
    total, ratio, i = 1.0, 1.0, rejected
    while i > 0 and ratio > 1e-18:
        ratio *= i * (1 - p) / ((n - i + 1) * p)
        total += ratio
        i -= 1
    return min(1.0, math.exp(log_term) * total)


def choose_cutoffs(metrics: DataFrame, labels: DataFrame, folder: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, symbols, dup_lines, repeats, capitals): cutoffs per language, null where none is safe.

    `metrics`: doc_id, lang and METRICS; `labels`: doc_id, quality (1: good).
    """
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = metrics.where(~base_failed()).join(good, "doc_id").withColumn("stratum", F.col("lang").cast("string"))
    sums = [F.sum((v > c).cast("long")).alias(f"{r}_{i}") for r, v in rule_values().items() for i, c in enumerate(GRID)]
    counts = C.cut(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums), folder, "counts")
    share, tests, grid, rules = risk / len(RULES), len(RULES), GRID, RULES
    strata = max(1, counts.count())
    level = error / (strata * tests)

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                cut = []
                for rule in rules:
                    safe = None
                    for i, c in enumerate(grid):
                        if binomial_tail(row["n"], row[f"{rule}_{i}"], share) > level:
                            break
                        safe = c
                    cut.append(safe)
                rows.append((row["stratum"], *cut))
            names = ["stratum", *rules]
            kinds = [pa.string()] + [pa.float64()] * len(rules)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return counts.mapInArrow(run, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def judged(metrics: DataFrame, cutoffs: DataFrame, lang: str = "lang") -> DataFrame:
    """`metrics` with base_failed, kept and the first rule that rejects (null: none)."""
    named = cutoffs.select(F.col("stratum").alias("__stratum"), *(F.col(r).alias(f"__{r}") for r in RULES))
    rows = metrics.join(named, F.col(lang).cast("string").eqNullSafe(F.col("__stratum")), "left")
    over = F.coalesce(*(F.when(v > F.col(f"__{r}"), F.lit(r)) for r, v in rule_values().items()))
    rows = rows.withColumns({"base_failed": base_failed(), "rejected_by": over})
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return rows.withColumn("kept", kept).drop("__stratum", *(f"__{r}" for r in RULES))


def screen(docs: DataFrame, labels: DataFrame, folder: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row for each document row: doc_id, lang, the metrics, base_failed, rejected_by, kept."""
    metrics = C.cut(with_metrics(docs, ["doc_id", "lang"]), folder, "metrics")
    return judged(metrics, C.cut(choose_cutoffs(metrics, labels, folder, risk, error), folder, "cutoffs"))


def kept_documents(docs: DataFrame, labels: DataFrame, folder: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of `docs` that stay, all columns. The metrics are taken twice, so that no text is shuffled."""
    cutoffs = choose_cutoffs(with_metrics(docs, ["doc_id", "lang"]), labels, folder, risk, error)
    cutoffs = C.cut(cutoffs, folder, "cutoffs")
    numbered = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))  # no name of the table meets one of a metric
    text, lang = (f"__{docs.columns.index(c)}" for c in ("text", "lang"))
    kept = judged(with_metrics(numbered, numbered.columns, text), cutoffs, lang).where("kept")
    return kept.select(*numbered.columns).toDF(*docs.columns)
