"""Filters, scopes, listings and counts shared by all tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ELIGIBLE_STATUSES
from .ordered import ordered_groups, running


def matching(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Equality filters; None means no filter."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def list_page(
    df: DataFrame,
    filters: Mapping[str, object] | None = None,
    order: Sequence[str] = ("created_at", "id"),
    page: int = 1,
    size: int = 20,
    cursor: Sequence[object] | None = None,
) -> DataFrame:
    """One page, newest first, with the filtered total in `total`.

    Offset pages keep offset+size rows per task. For deep pages pass the last row's order values
    as `cursor`: the scan then starts behind that row and keeps only `size` rows.
    """
    rows = matching(df, filters or {})
    total = rows.agg(F.count("*")).scalar()
    if cursor is not None:
        rows = rows.filter(_before(order, cursor))
    top = rows.orderBy(*(F.desc(c) for c in order))
    if cursor is None:
        top = top.offset((page - 1) * size)
    return top.limit(size).withColumn("total", total)


def _before(order: Sequence[str], cursor: Sequence[object]) -> Column:
    """(c1, c2, …) < cursor, written out so that the first comparison reaches the scan."""
    first, rest = F.col(order[0]), order[1:]
    below = first < F.lit(cursor[0])
    if not rest:
        return below
    return (first <= F.lit(cursor[0])) & (below | _before(rest, cursor[1:]))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def scope_filter(
    df: DataFrame, role: str, tenant: str | None, requested: str | None = None
) -> DataFrame:
    """Admins may ask for any tenant, everyone else sees their own; a null tenant is unscoped."""
    return matching(df, {"tenant_id": requested if role == "admin" else tenant})


def time_range(
    df: DataFrame, start=None, end=None, column: str = "created_at", day: str | None = None
) -> DataFrame:
    """Half-open [start, end). Where the table is partitioned by day, name that column in `day`
    and the days outside the range are not even listed."""
    bounds = {"start": start, "end": end}
    at = {k: F.lit(v).cast("timestamp") for k, v in bounds.items() if v is not None}
    if "start" in at:
        df = df.filter(F.col(column) >= at["start"])
    if "end" in at:
        df = df.filter(F.col(column) < at["end"])
    if day and "start" in at:
        df = df.filter(F.col(day) >= F.to_date(at["start"]))
    if day and "end" in at:
        df = df.filter(F.col(day) <= F.to_date(at["end"]))
    return df


def published_view(content: DataFrame, tenant: str | None = None) -> DataFrame:
    rows = matching(content, {"status": "published", "tenant_id": tenant})
    return rows.orderBy(F.desc("published_at"), F.desc("id"))


def manual_rejections(records: DataFrame) -> DataFrame:
    rows = records.filter((F.col("source") == "manual_review") & F.col("reason").isNotNull())
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def eligible_content(content: DataFrame) -> DataFrame:
    return content.filter(F.col("status").isin(*ELIGIBLE_STATUSES))


def _in_call_order(calls: DataFrame, key: str, value) -> DataFrame:
    groups = ordered_groups(matching(calls, {key: value}), [key], ["created_at", "id"])
    return running(groups, {"step": ("sum", F.lit(1))}).result()


def trace_replay(calls: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Calls of one trace, or of every trace, numbered in time order; a blank stage is inferred."""
    scored = F.array_contains(F.json_object_keys("output_data"), "dimension_scores")
    inferred = F.when(F.coalesce(scored, F.lit(False)), "qc").otherwise("generate")
    blank = F.coalesce(F.col("stage"), F.lit("")) == ""
    staged = calls.withColumn("stage", F.when(blank, inferred).otherwise(F.col("stage")))
    return _in_call_order(staged, "trace_id", trace_id)


def task_calls(calls: DataFrame, task_id: str | None = None) -> DataFrame:
    return _in_call_order(calls, "task_id", task_id)


def item_calls(calls: DataFrame, item_id: str | None = None) -> DataFrame:
    return _in_call_order(calls, "item_id", item_id)


def audit_log_query(
    log: DataFrame,
    entity_type: str | None = None,
    entity_id: str | None = None,
    tenant: str | None = None,
    start=None,
    end=None,
    limit: int = 100,
) -> DataFrame:
    """Newest configuration changes; the limit is the report's."""
    wanted = {"entity_type": entity_type, "entity_id": entity_id, "tenant_id": tenant}
    rows = time_range(matching(log, wanted), start, end)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_calls(
    calls: DataFrame, limit: int = 20, template: str | None = None, task: str | None = None
) -> DataFrame:
    rows = matching(calls, {"template_id": template, "task_id": task})
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return (
        rows.orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
        .select(
            "id", "trace_id", "model", F.coalesce("stage", F.lit("")).alias("stage"), "template_id",
            "task_id", "prompt_tokens", "completion_tokens", tokens.alias("total_tokens"), "cost",
            "latency_ms", "created_at",
        )
    )
