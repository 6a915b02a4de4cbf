"""Task life cycle: progress, ageing, failures, outbox, notifications, status moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import failure_class, item_retry_seconds, seconds_between
from ..schemas import (
    BACKOFF_BASE_SECONDS,
    CONTENT_STATUSES,
    OUTBOX_MAX_ATTEMPTS,
    SENDING_TIMEOUT_SECONDS,
    STALE_TASK_SECONDS,
    TASK_ACTIVE,
    TASK_STATUSES,
    TASK_TERMINAL,
)
from .listing import matching
from .ordered import ordered_groups, previous


def _now(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def _status_pivot(df: DataFrame, tenant: str | None, statuses) -> DataFrame:
    counts = matching(df, {"tenant_id": tenant}).groupBy("tenant_id").pivot("status", list(statuses))
    return counts.count().na.fill(0, list(statuses))


def task_status_pivot(tasks: DataFrame, tenant: str | None = None) -> DataFrame:
    """Tasks per tenant with one column per declared status; declared, so no pass to find them."""
    return _status_pivot(tasks, tenant, TASK_STATUSES)


def content_status_pivot(content: DataFrame, tenant: str | None = None) -> DataFrame:
    return _status_pivot(content, tenant, CONTENT_STATUSES)


def task_latency(tasks: DataFrame, limit: int = 10) -> DataFrame:
    latency = seconds_between(F.col("created_at"), F.col("updated_at"))
    return (
        tasks.orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
        .select(
            F.col("id").alias("task_id"), "template_id", "status", "created_at",
            F.round(latency, 1).alias("latency_s"),
        )
    )


def progress_columns() -> dict[str, Column]:
    """Progress aggregates over a task's item rows; also used by the streaming job."""
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    done = count("succeeded", "failed", "awaiting_review", "cancelled")
    return {
        "total": F.count("*"),
        "finished": done,
        "succeeded": count("succeeded"),
        "failed": count("failed"),
        "awaiting": count("awaiting_review"),
        "cancelled": count("cancelled"),
    }


def final_status() -> Column:
    """Status of a task whose items are all finished; null while some are not."""
    clean = F.when(F.col("awaiting") == 0, "succeeded").otherwise("partially_succeeded")
    broken = F.when(F.col("succeeded") > 0, "partially_succeeded").otherwise("failed")
    return F.when(
        F.col("finished") == F.col("total"),
        F.when(F.col("cancelled") == F.col("total"), "cancelled")
        .when(F.col("failed") == 0, clean)
        .otherwise(broken),
    )


def task_progress(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Progress and status of every task that has items. Items are counted per task before the
    join, so both sides meet one row to one."""
    counts = items.groupBy("task_id").agg(*(c.alias(n) for n, c in progress_columns().items()))
    joined = tasks.select(F.col("id").alias("task_id"), F.col("status").alias("_was")).join(
        counts, "task_id"
    )
    return joined.select(
        "task_id",
        F.round(F.col("finished") / F.col("total"), 4).alias("progress"),
        F.coalesce(final_status(), F.col("_was")).alias("status"),
    )


def terminal_report(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks per status and in all ('(all)'): terminal share, stuck tasks, mean age."""
    terminal = F.col("status").isin(*TASK_TERMINAL)
    age = seconds_between(F.col("created_at"), _now(as_of))
    done = F.count(F.when(terminal, 1))
    rows = tasks.groupingSets([["status"], []], "status").agg(
        (F.grouping("status") == 1).alias("_all"),
        F.count("*").alias("tasks"),
        done.alias("terminal"),
        F.round(done / F.count("*") * 100, 1).alias("terminal_pct"),
        (F.count("*") - done).alias("stuck"),
        F.round(F.avg(age), 1).alias("avg_elapsed_s"),
    )
    return rows.withColumn("status", F.when(F.col("_all"), "(all)").otherwise(F.col("status"))).drop("_all")


def failure_codes(items: DataFrame) -> DataFrame:
    """Failed items by class, with the mean delay before the next try of transient ones."""
    failed = items.filter(F.col("status") == "failed")
    kind = failure_class(F.coalesce("failure_reason", F.lit(""))).alias("failure_code")
    delay = F.when(
        F.col("failure_code") == "TRANSIENT_ERROR", item_retry_seconds(F.col("attempts"))
    )
    return failed.select(kind, "attempts").groupBy("failure_code").agg(
        F.count("*").alias("items"), F.round(F.avg(delay), 4).alias("avg_retry_s")
    )


def backoff_schedule(
    outbox: DataFrame,
    as_of,
    base: int = BACKOFF_BASE_SECONDS,
    max_attempts: int = OUTBOX_MAX_ATTEMPTS,
) -> DataFrame:
    """What a failed delivery at `as_of` does to each undelivered event: next time, or dead."""
    dead = F.col("attempts") >= max_attempts
    delay = F.pow(F.lit(2.0), F.col("attempts") - 1) * base
    return outbox.filter(F.col("status").isin("pending", "sending")).select(
        "event_id", "attempts",
        F.when(dead, "dead").otherwise("pending").alias("next_status"),
        F.when(~dead, F.timestamp_micros((F.unix_micros(_now(as_of)) + delay * 1_000_000).cast("bigint")))
        .alias("available_at"),
    )


def _due(as_of) -> Column:
    return (F.col("status") == "pending") & (F.col("available_at") <= _now(as_of))


def outbox_health(outbox: DataFrame, as_of, stale_seconds: int = SENDING_TIMEOUT_SECONDS) -> DataFrame:
    """Events per status, with how many of them are due or stuck in sending."""
    waited = seconds_between(F.col("updated_at"), _now(as_of))
    stale = (F.col("status") == "sending") & (waited >= stale_seconds)
    return outbox.groupBy("status").agg(
        F.count("*").alias("events"),
        F.count(F.when(_due(as_of), 1)).alias("due"),
        F.count(F.when(stale, 1)).alias("stale"),
        F.min(F.when(_due(as_of), F.col("available_at"))).alias("oldest_due"),
    )


def outbox_due(outbox: DataFrame, as_of, limit: int = 50) -> DataFrame:
    """The relay's next batch: oldest due events."""
    return outbox.filter(_due(as_of)).orderBy("created_at", "event_id").limit(limit)


def stale_tasks(tasks: DataFrame, as_of, seconds: int = STALE_TASK_SECONDS) -> DataFrame:
    cutoff = _now(as_of) - F.make_dt_interval(secs=F.lit(seconds))
    return tasks.filter((F.col("status") == "running") & (F.col("updated_at") < cutoff))


def pending_age(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks not yet at their end, with their age; oldest last."""
    age = seconds_between(F.col("created_at"), _now(as_of))
    return (
        tasks.filter(F.col("status").isin(*TASK_ACTIVE))
        .select("id", "status", "template_id", "created_at", F.round(age, 0).cast("bigint").alias("age_s"))
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


# Texts of the notifications, by status or event.
TASK_NOTICES = {
    "succeeded": ("task_succeeded", "生成任务完成", "任务 %s 已成功生成 %d 条内容"),
    "partially_succeeded": ("task_partial", "生成任务部分成功", "任务 %s 部分成功，部分条目生成失败"),
    "failed": ("task_failed", "生成任务失败", "任务 %s 生成失败"),
}
REJECTED_NOTICE = ("content_rejected", "内容被驳回", "内容 %s 被人工质检驳回", "：")
REVIEW_NOTICE = (
    "content_awaiting_review",
    "内容待人工审核",
    "内容 %s 自动质检 %s 分，处于灰区，等待人工裁决",
)


def _notice(kind: Column, title: Column, content: Column, event: Column) -> list[Column]:
    return [
        kind.alias("type"), title.alias("title"), content.alias("content"),
        F.col("id").alias("related_id"), event.alias("event_id"), F.col("tenant_id"),
    ]


def _event(prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("id"), F.lit(suffix))


def notifications(
    tasks: DataFrame, records: DataFrame, content: DataFrame, existing: DataFrame
) -> DataFrame:
    """Notifications due for finished tasks, reviewers' rejections and items awaiting review;
    one per event, and none that exists already."""
    pick = lambda part: F.coalesce(
        *(F.when(F.col("status") == s, part(n)) for s, n in TASK_NOTICES.items())
    )
    text = lambda n: F.format_string(n[2], F.col("id"), *([F.col("quantity")] if "%d" in n[2] else []))
    from_tasks = tasks.filter(F.col("status").isin(*TASK_NOTICES)).select(
        *_notice(pick(lambda n: F.lit(n[0])), pick(lambda n: F.lit(n[1])), pick(text), _event("task:", ":result"))
    )

    first_reason = F.min_by(F.coalesce("reason", F.lit("")), F.struct("created_at", "id"))
    rejected = (
        records.filter((F.col("source") == "manual_review") & (F.col("score") == 0))
        .groupBy(F.col("item_id").alias("id"))
        .agg(first_reason.alias("reason"))
        .join(content.select("id", "tenant_id"), "id")
    )
    kind, title, body, mark = REJECTED_NOTICE
    tail = F.when(F.col("reason") != "", F.concat(F.lit(mark), F.col("reason"))).otherwise("")
    from_reviews = rejected.select(
        *_notice(F.lit(kind), F.lit(title), F.concat(F.format_string(body, F.col("id")), tail),
                 _event("content:", ":rejected"))
    )

    kind, title, body = REVIEW_NOTICE
    score = F.regexp_replace(F.coalesce("qc_score", F.lit(0.0)).cast("string"), r"\.0$", "")
    from_gray = content.filter(F.col("status") == "awaiting_review").select(
        *_notice(F.lit(kind), F.lit(title), F.format_string(body, F.col("id"), score),
                 _event("content:", ":awaiting-review"))
    )
    due = from_tasks.unionByName(from_reviews).unionByName(from_gray)
    return due.join(existing.select("event_id"), "event_id", "left_anti")


def lifecycle_events(calls: DataFrame, stages=("workflow", "queue_item")) -> DataFrame:
    """Workflow and queue rows of the call log with event, status and reason as columns."""
    field = lambda name: F.get_json_object("output_data", f"$.{name}").alias(name)
    return calls.filter(F.col("stage").isin(*stages)).select(
        "id", "trace_id", "stage", field("event"), field("status"), field("reason"), "success", "created_at"
    )


def lifecycle_durations(calls: DataFrame) -> DataFrame:
    """Per thread: first start, last finish, seconds between them, last status and reason."""
    at = F.struct("created_at", "id")
    event = F.col("event")
    rows = lifecycle_events(calls).groupBy("trace_id").agg(
        F.count("*").alias("events"),
        F.min(F.when(event.isin("started", "resume"), F.col("created_at"))).alias("started_at"),
        F.max(F.when(event == "finished", F.col("created_at"))).alias("finished_at"),
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), at)).alias("reason"),
    )
    duration = seconds_between(F.col("started_at"), F.col("finished_at"))
    return rows.withColumn("duration_s", F.round(duration, 3))


def transition_audit(events: DataFrame, allowed: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Status moves that are not allowed: each status against the one before it of its entity.

    `allowed` holds (from_status, to_status). A status machine is a short list: given as pairs it is a predicate and
    the moves are not shuffled for it; a table is joined.
    """
    rows = events.select("entity_id", "status", "created_at", "id")
    groups = ordered_groups(rows, ["entity_id"], ["created_at", "id"])
    moves = previous(groups, "_p", ["status"]).result().filter("_p is not null")
    moves = moves.select(
        "id", "entity_id", F.col("_p.status").alias("from_status"),
        F.col("status").alias("to_status"), "created_at",
    )
    if isinstance(allowed, DataFrame):
        return moves.join(allowed, ["from_status", "to_status"], "left_anti")
    known = F.map_from_arrays(
        F.array(*(F.lit(a) for a in dict.fromkeys(a for a, _ in allowed))),
        F.array(*(F.array(*(F.lit(b) for x, b in allowed if x == a)) for a in dict.fromkeys(a for a, _ in allowed))),
    )
    legal = F.array_contains(F.try_element_at(known, F.col("from_status")), F.col("to_status"))
    return moves.filter(~F.coalesce(legal, F.lit(False)))
