"""Cost and call-log reports. Every report is one pass with map-side partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.costing import call_cost, token_breakdown
from ..functions.rules import blank_to_null
from ..schemas import FLAT_PRICE_PER_1K
from .listing import matching, time_range
from .ordered import ordered_groups, previous, running, since_reset


def _zero_sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _measures() -> list[Column]:
    prompt, completion = _zero_sum("prompt_tokens"), _zero_sum("completion_tokens")
    return [
        F.count("*").alias("count"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
    ]


def _filtered(calls: DataFrame, template: str | None, task: str | None) -> DataFrame:
    return matching(calls, {"template_id": template, "task_id": task})


def cost_by_key(
    calls: DataFrame, key: str, template: str | None = None, task: str | None = None
) -> DataFrame:
    """Calls, cost and tokens per key, dearest first.

    The key is named 'unknown' after grouping, so a null key and a literal 'unknown' stay apart.
    """
    grouped = _filtered(calls, template, task).groupBy(key).agg(*_measures())
    named = grouped.select(F.coalesce(key, F.lit("unknown")).alias("name"), *grouped.columns[1:])
    return named.orderBy(F.desc("total_cost"), "name")


def cost_rollup(
    calls: DataFrame,
    keys: Sequence[str] = ("template_id", "model", "task_id", "stage"),
    template: str | None = None,
    task: str | None = None,
) -> DataFrame:
    """All one-key reports and the grand total from one scan.

    Rows are expanded once per grouping set and combined before the shuffle. The grouping id,
    not the null, tells a null key from a subtotal.
    """
    sets = [[key] for key in keys] + [[]]
    rolled = _filtered(calls, template, task).groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_gid"), *_measures()
    )
    full = (1 << len(keys)) - 1
    dimension, name = F.lit("total"), F.lit("all")
    for position, key in enumerate(keys):
        here = F.col("_gid") == full ^ (1 << (len(keys) - 1 - position))
        dimension = F.when(here, key).otherwise(dimension)
        name = F.when(here, F.coalesce(key, F.lit("unknown"))).otherwise(name)
    return rolled.select(
        dimension.alias("dimension"), name.alias("name"), "count", "total_cost", "prompt_tokens",
        "completion_tokens", "total_tokens",
    )


def cost_by_stage(
    calls: DataFrame,
    flat: float = FLAT_PRICE_PER_1K,
    template: str | None = None,
    task: str | None = None,
    prices: DataFrame | None = None,
) -> DataFrame:
    """Stage split. `prompt_cost` and `completion_cost` use the flat price; with a price table,
    `*_cost_by_model` add the same at each call's own rate."""
    rows = _filtered(calls, template, task)
    extra = []
    if prices is not None:
        rows = price_lookup(rows, prices, flat)
        extra = [
            F.round(
                F.sum(F.coalesce(f"{side}_tokens", F.lit(0)).cast("double") / 1000 * F.col(f"{side}_rate")), 6
            ).alias(f"{side}_cost_by_model")
            for side in ("prompt", "completion")
        ]
    grouped = rows.groupBy("stage").agg(*_measures(), *extra)
    flat_cost = lambda c: F.round(F.col(c).cast("double") / 1000 * F.lit(flat), 6)
    return grouped.withColumns(
        {
            "stage": F.coalesce(blank_to_null(F.col("stage")), F.lit("unknown")),
            "prompt_cost": flat_cost("prompt_tokens"),
            "completion_cost": flat_cost("completion_tokens"),
        }
    )


def cost_totals(calls: DataFrame, template: str | None = None, task: str | None = None) -> DataFrame:
    return _filtered(calls, template, task).agg(*_measures())


def cost_join_content(
    calls: DataFrame, content: DataFrame, by: str = "template", template: str | None = None
) -> DataFrame:
    """Cost per template, model or task; a template filter matches the call's or its item's
    template, and only then is the content table read."""
    key = {"template": "template_id", "model": "model", "task": "task_id"}[by]
    if template is not None:
        # calls of the template need no join and are filtered in the scan; of the others only those with an item are
        # shuffled, against the ids of the template's content
        wanted = content.filter(F.col("template_id") == template).select(F.col("id").alias("item_id"))
        own = calls.filter(F.col("template_id") == template)
        others = calls.filter(~F.col("template_id").eqNullSafe(F.lit(template)) & F.col("item_id").isNotNull())
        calls = own.unionByName(others.join(wanted, "item_id", "left_semi").select(*calls.columns))
    grouped = calls.groupBy(key).agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        F.count("*").alias("count"),
    )
    return grouped.select(F.coalesce(key, F.lit("unknown")).alias("name"), "total_cost", "count")


def cost_by_model_since(calls: DataFrame, tenant: str | None = None, since=None) -> DataFrame:
    """Per tenant and model. A call with either token count missing adds no tokens."""
    rows = time_range(matching(calls, {"tenant_id": tenant}), since)
    return rows.groupBy("tenant_id", "model").agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias(
            "total_tokens"
        ),
        F.count("*").alias("call_count"),
    )


def cost_by_date(calls: DataFrame, tenant: str | None = None, since=None) -> DataFrame:
    rows = time_range(matching(calls, {"tenant_id": tenant}), since)
    return rows.groupBy("tenant_id", F.to_date("created_at").alias("date")).agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        F.count("*").alias("call_count"),
    )


def cost_task_template_stage(
    calls: DataFrame, keys: Sequence[str], start=None, end=None, **filters: str
) -> DataFrame:
    """Totals per task, per template and period, or per task and stage: pick the keys."""
    rows = time_range(matching(calls, filters), start, end)
    return rows.groupBy(*keys).agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        _zero_sum("prompt_tokens").alias("total_prompt_tokens"),
        _zero_sum("completion_tokens").alias("total_completion_tokens"),
        F.count("*").alias("call_count"),
    )


def cost_recent(calls: DataFrame, as_of) -> DataFrame:
    """Cost of the last 24 hours and 7 days per tenant: one scan of seven days."""
    now = F.lit(as_of).cast("timestamp")
    hours = lambda n: F.col("created_at") >= now - F.expr(f"interval {n} hours")
    return calls.filter(hours(168)).groupBy("tenant_id").agg(
        F.round(F.coalesce(F.sum(F.when(hours(24), F.col("cost"))), F.lit(0.0)), 6).alias("cost_24h"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost_7d"),
    )


def success_rate(calls: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(False)).cast("int")
    return calls.groupBy("template_id").agg(
        F.count("*").alias("total"),
        F.sum(ok).alias("success"),
        F.round(F.avg(ok), 4).alias("rate"),
    )


def call_conformance(calls: DataFrame, tenant: str | None = None) -> DataFrame:
    """Generate calls per tenant and model; `model` is null on the row of the whole tenant."""
    rows = matching(calls, {"tenant_id": tenant}).filter(F.col("stage") == "generate")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    return rows.groupingSets(
        [["tenant_id"], ["tenant_id", "model"]], "tenant_id", "model"
    ).agg(
        (F.grouping("model") == 1).alias("whole_tenant"),
        F.count("*").alias("total"),
        share(F.col("success")).alias("success_rate"),
        share(~F.col("success")).alias("retry_rate"),
    )


def structured_stats(
    calls: DataFrame,
    by: Sequence[str] = (),
    template: str | None = None,
    task: str | None = None,
) -> DataFrame:
    """Generate threads: first-pass rate, mean attempts, failure rate; null without a denominator.

    Two levels: the least successful attempt per thread, then the thread counts.
    """
    attempt = F.when(F.coalesce("attempt", F.lit(0)) == 0, 1).otherwise(F.col("attempt"))
    threads = (
        _filtered(calls, template, task)
        .filter(F.col("stage") == "generate")
        .groupBy(*by, "trace_id")
        .agg(F.min(F.when(F.col("success"), attempt)).alias("won"))
    )
    total, won = F.count("*"), F.count("won")
    return threads.groupBy(*by).agg(
        total.alias("total_generations"),
        won.alias("success_generations"),
        (total - won).alias("failed_generations"),
        F.round(F.try_divide(F.count(F.when(F.col("won") == 1, 1)), won), 4).alias("first_pass_rate"),
        F.round(F.avg("won"), 4).alias("avg_attempts"),
        F.round(F.try_divide(total - won, total), 4).alias("failure_rate"),
    )


def trace_summary(
    calls: DataFrame, limit: int | None = 50, offset: int = 0, approximate_total: bool = False
) -> DataFrame:
    """A page of traces by last call, newest first, with the number of traces in `total`; `limit=None`: all, unsorted."""
    count = F.approx_count_distinct if approximate_total else F.count_distinct
    total = calls.agg(count("trace_id")).scalar()
    rows = calls.groupBy("trace_id").agg(
        F.max("task_id").alias("task_id"),
        F.max("template_id").alias("template_id"),
        F.count("*").alias("call_count"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        F.round(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), 4).alias("total_latency_ms"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )
    if limit is not None:  # a page is a top-k; all traces are not sorted
        rows = rows.orderBy(F.desc("last_at"), "trace_id").offset(offset).limit(limit)
    return rows.withColumn("total", total)


def price_lookup(calls: DataFrame, prices: DataFrame, flat: float = FLAT_PRICE_PER_1K) -> DataFrame:
    """Adds prompt_rate and completion_rate; a missing model or side costs the flat price.

    No broadcast hint: the price table is broadcast when its measured size is below the
    session's threshold, and beyond it AQE splits the hot models of the sort-merge join.
    """
    rates = prices.select(
        F.col("model").alias("_model"),
        F.col("prompt").alias("_prompt"),
        F.col("completion").alias("_completion"),
    )
    joined = calls.join(rates, calls["model"] == rates["_model"], "left")
    return joined.withColumns(
        {
            "prompt_rate": F.coalesce("_prompt", F.lit(flat)),
            "completion_rate": F.coalesce("_completion", F.lit(flat)),
        }
    ).drop("_model", "_prompt", "_completion")


def priced_calls(calls: DataFrame, prices: DataFrame, flat: float = FLAT_PRICE_PER_1K) -> DataFrame:
    """Calls with the cost and the token breakdown at their model's rates."""
    sides = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "prompt_rate", "completion_rate")]
    return price_lookup(calls, prices, flat).withColumns(
        {"priced_cost": call_cost(*sides), "breakdown": token_breakdown(*sides)}
    )


def attempt_number(calls: DataFrame) -> DataFrame:
    """Position of a call among the calls of its trace and stage."""
    groups = ordered_groups(calls, ["trace_id", "stage"], ["created_at", "id"])
    return running(groups, {"attempt": ("sum", F.lit(1))}).result()


def budget_guard(calls: DataFrame, budgets: DataFrame, global_budget: float = 0.0) -> DataFrame:
    """Calls made after their task's spend had reached the budget of the model (0 = no budget)."""
    limits = budgets.select(F.col("model").alias("_model"), "budget_per_task")
    tasked = calls.filter(F.coalesce(F.col("task_id"), F.lit("")) != "").select(
        "id", "task_id", "model", "cost", "created_at"
    )
    groups = ordered_groups(tasked, ["task_id"], ["created_at", "id"])
    spend = running(
        groups, {"spent_before": ("sum", F.coalesce("cost", F.lit(0.0)))}, inclusive=False
    ).result()
    own = F.when(F.col("budget_per_task") != 0, F.col("budget_per_task"))
    return (
        spend.join(limits, spend["model"] == limits["_model"], "left")
        .select(
            "id", "task_id", "model", "created_at",
            F.round("spent_before", 6).alias("spent_before"),
            F.coalesce(own, F.lit(global_budget)).alias("budget"),
        )
        .filter((F.col("budget") > 0) & (F.col("spent_before") >= F.col("budget")))
    )


def model_health(
    calls: DataFrame,
    threshold: int = 2,
    cooldown_seconds: int = 60) -> DataFrame:
    """State of each model after each call: failures since its last success, health, cooldown."""
    rows = calls.select("id", "model", "success", "created_at")
    groups = ordered_groups(rows, ["model"], ["created_at", "id"])
    good = F.coalesce(F.col("success"), F.lit(False))
    groups = since_reset(groups, "_failures", F.when(good, 0).otherwise(1).cast("long"), good)
    failures = F.col("_failures")
    health = (
        F.when(failures == 0, "healthy").when(failures >= threshold, "unhealthy").otherwise("degraded")
    )
    until = F.col("created_at") + F.make_dt_interval(secs=F.lit(cooldown_seconds))
    return groups.result().select(
        "id", "model", "success", "created_at",
        failures.alias("failure_count"),
        health.alias("health_status"),
        F.when(failures >= threshold, until).alias("cooldown_until"),
    )


def model_recoveries(calls: DataFrame, as_of, threshold: int = 2, cooldown_seconds: int = 60) -> DataFrame:
    """The end of each cooldown: an unhealthy model is eligible again at `cooldown_until` if no call came before.

    One row for each cooldown that ran out by the model's next call, or by `as_of` where none followed (null: only
    those before a next call): model, failure_count, eligible_at.
    """
    states = model_health(calls, threshold, cooldown_seconds)
    groups = ordered_groups(states, ["model"], ["created_at", "id"])
    seen = previous(groups, "_p", ["failure_count", "cooldown_until"]).result()
    ended = seen.filter(F.col("_p.cooldown_until") <= F.col("created_at")).select("model", "_p.failure_count", F.col("_p.cooldown_until").alias("eligible_at"))
    last = states.groupBy("model").agg(F.max_by(F.struct("failure_count", "cooldown_until"), F.struct("created_at", "id")).alias("_p"))
    quiet = last.filter(F.col("_p.cooldown_until") <= F.lit(as_of).cast("timestamp"))
    return ended.unionByName(quiet.select("model", "_p.failure_count", F.col("_p.cooldown_until").alias("eligible_at")))
