"""Structured Streaming forms of the call-log operators.

Input streams have the call log's columns; event time is `created_at` as a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.costing import call_cost
from ..functions.redaction import redact_json
from ..operators.cost import price_lookup
from ..operators.lifecycle import final_status
from ..session import ROCKSDB
from ..sources.sinks import write_traces
from .processors import BudgetAlert, ModelHealth, TaskProgress

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: With state that ends, Spark runs batches without data as well, so such a stream needs a processing-time trigger;
#: `availableNow` ends only with NO_DATA_BATCHES off.
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def clean_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Redacted payloads and the cost at the model's price; stateless, batch or stream."""
    sides = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "prompt_rate", "completion_rate")]
    payloads = {c: redact_json(F.col(c)) for c in ("input_data", "output_data") if c in calls.columns}
    priced = price_lookup(calls, prices).withColumns({**payloads, "cost": call_cost(*sides)})
    return priced.drop("prompt_rate", "completion_rate")


def st_trace_ingest(
    stream: DataFrame,
    prices: DataFrame,
    sinks: Mapping[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
) -> StreamingQuery:
    """redact → price → every sink."""
    return write_traces(clean_calls(stream, prices), sinks, checkpoint)


def st_cost_windows(
    stream: DataFrame,
    watermark: str = "1 hour",
    window: str = "1 day",
    slide: str | None = None,
) -> DataFrame:
    """Cost per model and event-time window, tumbling or sliding. State is one row per model and
    open window; rows later than the watermark are dropped."""
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return (
        stream.withWatermark("created_at", watermark)
        .groupBy(span, "model")
        .agg(F.round(F.sum("cost"), 6).alias("total_cost"), F.count("*").alias("calls"))
        .select("window.start", "window.end", "model", "total_cost", "calls")
    )


def st_event_dedup(stream: DataFrame, watermark: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Redelivered events pass once; the ids seen are kept only as long as the watermark."""
    return stream.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark([key])


def _stateful(
    stream: DataFrame, key: str, processor, schema: str, mode: str = "Append", ttl_ms: int | None = None, time: str | None = None
) -> DataFrame:
    if stream.sparkSession.conf.get(STATE_STORE, None) != ROCKSDB:
        raise RuntimeError(f"set {STATE_STORE} to {ROCKSDB}, as build_session does")
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time or ("ProcessingTime" if ttl_ms else "None")
    )


def st_model_health(
    stream: DataFrame, threshold: int = 2, cooldown_seconds: int = 60, watermark: str = "10 minutes"
) -> DataFrame:
    """Health of each model after each call, and a row `eligible` at the end of each cooldown.

    That row (without id and success; created_at and cooldown_until are the end) comes when the watermark passes the end
    and no call of the model did, by a timer, or before the row of a later call. The state is one counter and one cooldown per model;
    within a micro-batch calls go in event-time order, across batches in arrival order; calls later than the watermark
    are dropped.
    """
    schema = (
        "id bigint, model string, success boolean, created_at timestamp, failure_count bigint, "
        "health_status string, cooldown_until timestamp"
    )
    columns = stream.select("id", "model", "success", "created_at").withWatermark("created_at", watermark)
    return _stateful(columns, "model", ModelHealth(threshold, cooldown_seconds), schema, time="EventTime")


def st_budget_alert(
    stream: DataFrame, budget: float = 0.0, budgets: DataFrame | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """One row per task, at the call that takes its spend to the budget.

    `budgets` (model, budget_per_task) goes before the global `budget`; 0 is no budget. State: spend and flag, kept
    until `ttl_ms` after the task's last call, or for good.
    """
    schema = "task_id string, id bigint, spent double, created_at timestamp"
    calls, limit = stream.filter("task_id is not null"), F.lit(float(budget))
    if budgets is not None:
        named = budgets.select(F.col("model").alias("_model"), F.col("budget_per_task").cast("double").alias("_own"))
        calls = calls.join(named, F.col("model") == F.col("_model"), "left")
        limit = F.coalesce(F.when(F.col("_own") != 0, F.col("_own")), limit)
    columns = calls.select("task_id", "id", "cost", "created_at", limit.alias("budget"))
    return _stateful(columns, "task_id", BudgetAlert(ttl_ms), schema, ttl_ms=ttl_ms)


def st_task_progress(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Progress per task from a stream of item states (task_id, item_index, status, updated_at).

    Update mode: a task's row comes again whenever one of its items moves. The state holds each
    item's latest status and the counts, so a micro-batch costs only the items it touches; it ends `ttl_ms` after the
    last change, if that is given.
    """
    schema = (
        "task_id string, total bigint, succeeded bigint, failed bigint, awaiting_review bigint, "
        "cancelled bigint"
    )
    columns = stream.select("task_id", "item_index", "status", "updated_at")
    counts = _stateful(columns, "task_id", TaskProgress(ttl_ms), schema, "Update", ttl_ms)
    counts = counts.withColumnRenamed("awaiting_review", "awaiting")
    finished = F.col("succeeded") + F.col("failed") + F.col("awaiting") + F.col("cancelled")
    counts = counts.withColumn("finished", finished)
    return counts.select(
        "task_id",
        F.round(F.col("finished") / F.col("total"), 4).alias("progress"),
        F.coalesce(final_status(), F.lit("running")).alias("status"),
    )
