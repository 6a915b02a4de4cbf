"""Reports composed of several operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.agreement import confusion
from ..operators.calibration import calibrate, label_pairs
from ..operators.cost import cost_rollup, structured_stats
from ..operators.listing import matching, recent_calls, time_range
from ..functions.rules import seconds_between
from ..schemas import FLAT_PRICE_PER_1K, QUALITY_THRESHOLD

# Unit, target and direction of every KPI.
KPIS = {
    "generated": ("条", None, "higher_better"),
    "published": ("条", None, "higher_better"),
    "qc_pass_rate": ("%", 90.0, "higher_better"),
    "manual_reject_rate": ("%", 5.0, "lower_better"),
    "avg_latency": ("s", 3600.0, "lower_better"),
    "avg_cost": ("¥", None, "lower_better"),
    "structured_first_pass_rate": ("%", None, "higher_better"),
    "structured_avg_attempts": ("次", 1.0, "lower_better"),
    "structured_failure_rate": ("%", 0.0, "lower_better"),
    "revise_trigger_rate": ("%", None, "lower_better"),
}


def _rows(aggregated: DataFrame, names: list[str]) -> DataFrame:
    """A one-row aggregate as (key, value) rows."""
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names))
    return aggregated.select(F.explode(pairs).alias("kv")).select("kv.*")


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 2)


def dashboard_kpis(
    content: DataFrame,
    records: DataFrame,
    tasks: DataFrame,
    calls: DataFrame,
    threshold: float = QUALITY_THRESHOLD,
) -> DataFrame:
    """The ten KPIs as rows: one aggregation pass per table, stacked, never joined."""
    count = lambda c: F.count(F.when(c, 1))
    of_content = content.agg(
        F.count("*").alias("generated"),
        count(F.col("status") == "published").alias("published"),
        F.round(F.coalesce(F.avg("cost"), F.lit(0.0)), 6).alias("avg_cost"),
        _percent(count(F.col("revise_count") >= 1), F.count("*")).alias("revise_trigger_rate"),
    )
    auto, manual = F.col("source") == "auto", F.col("source") == "manual_review"
    of_records = records.agg(
        _percent(count(auto & (F.col("score") >= threshold)), count(auto)).alias("qc_pass_rate"),
        _percent(count(manual & (F.col("score") == 0)), count(manual)).alias("manual_reject_rate"),
    )
    cycle = seconds_between(F.col("created_at"), F.col("updated_at"))
    of_tasks = tasks.agg(F.round(F.coalesce(F.avg(cycle), F.lit(0.0)), 1).alias("avg_latency"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    of_calls = structured_stats(calls).select(
        F.round(zero("first_pass_rate") * 100, 2).alias("structured_first_pass_rate"),
        F.round(zero("avg_attempts"), 2).alias("structured_avg_attempts"),
        F.round(zero("failure_rate") * 100, 2).alias("structured_failure_rate"),
    )
    parts = [_rows(part, part.columns) for part in (of_content, of_records, of_tasks, of_calls)]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)

    fixed = lambda i, kind: F.coalesce(
        *(F.when(F.col("key") == k, F.lit(v[i]).cast(kind)) for k, v in KPIS.items())
    )
    rows = stacked.withColumns(
        {"unit": fixed(0, "string"), "target": fixed(1, "double"), "goal": fixed(2, "string")}
    )
    met = F.when(F.col("goal") == "higher_better", F.col("value") >= F.col("target")).otherwise(
        F.col("value") <= F.col("target")
    )
    return rows.withColumn("met", met)


def deep_cost_report(
    calls: DataFrame,
    template: str | None = None,
    task: str | None = None,
    limit: int = 20,
    compat: bool = False,
    flat: float = FLAT_PRICE_PER_1K,
) -> tuple[DataFrame, DataFrame]:
    """(breakdowns, recent calls). All breakdowns and the total come from one scan.

    With compat=True only the total and the stage split follow the filters, as in the service.
    """
    filtered = cost_rollup(calls, template=template, task=task)
    if compat and (template or task):
        narrow = filtered.filter(F.col("dimension").isin("total", "stage"))
        wide = cost_rollup(calls, keys=("template_id", "model", "task_id"))
        filtered = narrow.unionByName(wide.filter(F.col("dimension") != "total"))
    cost = lambda c: F.when(
        F.col("dimension") == "stage", F.round(F.col(c).cast("double") / 1000 * F.lit(flat), 6)
    )
    breakdowns = filtered.withColumns(
        {"prompt_cost": cost("prompt_tokens"), "completion_cost": cost("completion_tokens")}
    )
    return breakdowns, recent_calls(calls, limit, template, task)


def cost_period_report(calls: DataFrame, tenant: str | None, as_of, days: int = 7) -> DataFrame:
    """Period totals and both breakdowns as rows (tenant_id, part, name, …), from one scan.

    The totals add up the models' rows, which come from the same exchange.
    """
    rows = time_range(matching(calls, {"tenant_id": tenant}), as_of - timedelta(days=days))
    rows = rows.withColumn("date", F.to_date("created_at").cast("string"))
    tokens = F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0))
    by = rows.groupingSets([["tenant_id", "model"], ["tenant_id", "date"]], "tenant_id", "model", "date").agg(
        F.grouping("model").alias("_dated"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        tokens.alias("total_tokens"), F.count("*").alias("call_count"),
    )
    dated = F.col("_dated") == 1
    parts = by.select(
        "tenant_id", F.when(dated, "date").otherwise("model").alias("part"), F.when(dated, F.col("date")).otherwise(F.col("model")).alias("name"),
        "total_cost", F.when(~dated, F.col("total_tokens")).alias("total_tokens"), "call_count",
    )
    of_models = lambda c: F.sum(F.when(~dated, F.col(c)))
    totals = by.groupBy("tenant_id").agg(
        F.round(of_models("total_cost"), 6).alias("total_cost"), of_models("total_tokens").alias("total_tokens"), of_models("call_count").alias("call_count"),
    )
    return parts.unionByName(totals.select("tenant_id", F.lit("total").alias("part"), F.lit("all").alias("name"), "total_cost", "total_tokens", "call_count"))


def calibration_report(
    records: DataFrame, content: DataFrame, templates: DataFrame, **options
) -> DataFrame:
    """Calibrations with the agreement of judge and reviewer at the calibrated threshold."""
    fitted = calibrate(records, content, templates, **options)
    limits = fitted.select("template_id", F.col("threshold").alias("_limit"))
    margin = F.col("auto") - F.col("_limit")
    pairs = label_pairs(records, content).join(limits, "template_id").withColumn("auto", margin)
    return fitted.join(confusion(pairs, 0.0, ["template_id"]), "template_id", "left")
