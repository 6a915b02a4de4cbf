"""Per-row decision rules: routing, failure classes, retry delays, thread ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Message fragments that decide whether a failure is worth retrying.
PERMANENT_MARKS = ("422", "400", "Unprocessable Entity")
TRANSIENT_MARKS = ("429", "503", "500")


def qc_route(
    score: Column,
    threshold: Column,
    revise_count: Column,
    max_revise: Column,
    gray_enabled: Column,
    margin: Column,
) -> Column:
    """store / submit_review / revise / reject; the gray zone comes before the revision budget."""
    score = F.coalesce(score, F.lit(0.0))
    return (
        F.when(score >= threshold, "store")
        .when(gray_enabled & (score >= threshold - margin), "submit_review")
        .when(F.coalesce(revise_count, F.lit(0)) < max_revise, "revise")
        .otherwise("reject")
    )


def _contains_any(message: Column, marks) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | F.contains(message, F.lit(mark))
    return hit


def failure_class(message: Column) -> Column:
    return (
        F.when(_contains_any(message, PERMANENT_MARKS), "PERMANENT_ERROR")
        .when(_contains_any(message, TRANSIENT_MARKS), "TRANSIENT_ERROR")
        .otherwise("UNKNOWN_ERROR")
    )


def item_retry_seconds(attempts: Column) -> Column:
    return F.pow(F.lit(2.0), attempts).cast("bigint")


def thread_parse(c: Column) -> Column:
    """`task:index` into its two parts; index is null for a bare task id."""
    return F.struct(
        F.split_part(c, F.lit(":"), F.lit(1)).alias("task_id"),
        F.when(F.contains(c, F.lit(":")), F.split_part(c, F.lit(":"), F.lit(2)))
        .try_cast("int")
        .alias("item_index"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
