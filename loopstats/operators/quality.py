"""Judge scores, routing inputs and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import config_hash
from ..schemas import QUALITY_THRESHOLD
from .listing import matching, time_range
from .ordered import ordered_groups, running


def quality_content_join(records: DataFrame, content: DataFrame) -> DataFrame:
    """Records with their item's template; only the key and the template of content are read."""
    items = content.select(F.col("id").alias("item_id"), "template_id")
    return records.join(items, "item_id")


def content_quality_outer(
    content: DataFrame,
    records: DataFrame,
    threshold: float = QUALITY_THRESHOLD,
    distinct_items: bool = False,
) -> DataFrame:
    """Items and auto passes per template.

    The default counts joined rows, so an item with an auto and a manual record counts twice;
    distinct_items=True counts items, with the records combined per item before the join.
    """
    items = content.select(F.col("id").alias("item_id"), "template_id")
    passed = (F.col("source") == "auto") & (F.col("score") >= threshold)
    per_item = records.groupBy("item_id").agg(
        F.count("*").alias("_rows"), F.count(F.when(passed, 1)).alias("_passed")
    )
    joined = items.join(per_item, "item_id", "left")
    if distinct_items:
        total = F.count("*")
        good = F.count(F.when(F.col("_passed") > 0, 1))
    else:
        total = F.sum(F.coalesce("_rows", F.lit(1)))
        good = F.coalesce(F.sum("_passed"), F.lit(0))
    return joined.groupBy("template_id").agg(total.alias("generated"), good.alias("passed"))


def dashboard_by_template(
    content: DataFrame,
    records: DataFrame,
    threshold: float = QUALITY_THRESHOLD,
    distinct_items: bool = False,
) -> DataFrame:
    counts = content_quality_outer(content, records, threshold, distinct_items)
    rate = F.round(F.col("passed") / F.col("generated") * 100, 2)
    return counts.select("template_id", "generated", rate.alias("pass_rate"))


def quality_buckets(
    records: DataFrame,
    content: DataFrame,
    template: str | None = None,
    version: int | None = None,
    tenant: str | None = None,
    source: str | None = None,
    start=None,
    end=None,
    exact_hash: bool = False,
) -> DataFrame:
    """Pass counts per template, version, tenant, source, reviewer and configuration."""
    rows = time_range(
        matching(records, {"template_version": version, "tenant_id": tenant, "source": source}),
        start,
        end,
    )
    items = matching(content, {"template_id": template})
    snapshot = F.coalesce("config_snapshot", F.lit("{}"))
    declared = F.get_json_object(snapshot, "$.threshold").try_cast("double")
    threshold = F.coalesce(F.when(declared != 0, declared), F.lit(QUALITY_THRESHOLD))
    hashed = quality_content_join(rows, items).withColumns(
        {"config_hash": config_hash(snapshot, exact_hash), "effective_threshold": threshold}
    )
    passed = F.count(F.when(F.col("score") >= F.col("effective_threshold"), 1))
    return hashed.groupBy(
        "template_id", "template_version", "tenant_id", "source", "reviewer", "config_hash",
        "effective_threshold",
    ).agg(
        F.count("*").alias("total"),
        passed.alias("passed"),
        (F.count("*") - passed).alias("rejected"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


def judge_rounds_mean(rounds: DataFrame, templates: DataFrame) -> DataFrame:
    """Mean per declared dimension over the rounds that scored it, as one map per item.

    An item none of whose rounds has a declared dimension keeps an empty map and an `error`.
    """
    # an item's rounds are few, so one shuffle brings them together as a list
    gathered = rounds.groupBy("item_id", "template_id").agg(F.sort_array(F.collect_list(F.array_sort(F.map_entries("scores")))).alias("_rounds"))
    declared = templates.select("template_id", F.map_keys("weights").alias("_declared"))
    scored = gathered.join(declared, "template_id", "left").select(
        "item_id", "template_id", "_declared", F.filter(F.flatten("_rounds"), lambda e: e["value"].isNotNull()).alias("_scores")
    )

    def mean(dim: Column) -> Column:
        own = F.transform(F.filter("_scores", lambda e: e["key"] == dim), lambda e: e["value"].cast("double"))
        return F.struct(dim.alias("dim"), F.try_divide(F.reduce(own, F.lit(0.0), lambda a, x: a + x), F.size(own)).alias("score"))

    found = F.filter(F.transform(F.array_sort("_declared"), mean), lambda m: m["score"].isNotNull())
    none = F.create_map().cast("map<string,double>")
    means = scored.select("item_id", "template_id", F.coalesce(F.map_from_entries(found), none).alias("dimension_scores"))
    empty = F.size("dimension_scores") == 0
    return means.withColumn("error", F.when(empty, "no valid dimension scores"))


def own_weights() -> dict[str, Column]:
    """`weights` and `threshold` over the columns of a template, as its own rules and run
    configuration state them; of rules with the same id the last one counts."""
    rules = F.filter("quality_rules", lambda r: F.coalesce(r["id"], F.lit("")) != "")
    ids = F.array_distinct(F.transform(rules, lambda r: r["id"]))

    def weight(name: Column) -> Column:
        last = F.element_at(F.filter(rules, lambda r: r["id"] == name), -1)
        return F.coalesce(last["weight"], F.lit(0.0))

    own = F.get_json_object("run_config", "$.quality_threshold").try_cast("double")
    return {
        "weights": F.map_from_arrays(ids, F.transform(ids, weight)),
        "threshold": F.coalesce(own, F.lit(QUALITY_THRESHOLD)),
    }


def template_defaults(templates: DataFrame) -> DataFrame:
    """(template_id, weights, threshold) of each template: own_weights."""
    own = own_weights()
    return templates.select(F.col("type_id").alias("template_id"), *(c.alias(n) for n, c in own.items()))


def _sum_over(names: Column, value) -> Column:
    return F.aggregate(names, F.lit(0.0), lambda acc, d: acc + F.coalesce(value(d), F.lit(0.0)))


def weighted_score(dims: DataFrame, rules: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Adds `score`: Σ(score·weight)/Σ(weight) over the rule dimensions present, per-dimension
    override weights first; the plain mean when no weight is left.

    Rules are one map per template, so this is a lookup join and row arithmetic: no shuffle of
    the scores beyond it.
    """
    joined = dims.join(rules.select("template_id", F.col("weights").alias("_rules")), "template_id", "left")
    if override is not None:
        other = override.select("template_id", F.col("weights").alias("_override"))
        joined = joined.join(other, "template_id", "left")
    else:
        joined = joined.withColumn("_override", F.lit(None).cast("map<string,double>"))
    scores, rules_c, own = F.col("dimension_scores"), F.col("_rules"), F.col("_override")
    weight = lambda d: F.coalesce(own[d], rules_c[d])
    present = F.filter(F.map_keys(rules_c), lambda d: F.map_contains_key(scores, d))
    total = _sum_over(present, weight)
    weighted = _sum_over(present, lambda d: scores[d] * weight(d))
    values = F.map_values(scores)
    plain = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
    score = F.when(total > 0, F.try_divide(weighted, total)).otherwise(plain)
    # the inner rounding takes away what the order of summation leaves in the last bits
    return joined.withColumn("score", F.round(F.round(score, 8), 2)).drop("_rules", "_override")


def latest_quality(records: DataFrame) -> DataFrame:
    """Newest record per item."""
    rest = [c for c in records.columns if c != "item_id"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")
    return records.groupBy("item_id").agg(newest).select("item_id", "r.*")


def effective_weights(templates: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Newest calibration of each template, else the template's own weights and threshold."""
    newest = calibrations.groupBy("template_id").agg(
        F.max_by(F.struct("weights", "threshold"), F.struct("created_at", "id")).alias("_c")
    )
    return templates.join(newest, "template_id", "left").select(
        "template_id",
        F.coalesce("_c.weights", "weights").alias("weights"),
        F.coalesce("_c.threshold", "threshold").alias("threshold"),
        F.col("_c").isNotNull().alias("calibrated"),
    )


def effective_weights_asof(records: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Adds the calibration in force at each record's own time: as-of join by template.

    Both sides are stacked and read in time order; a calibration of the same instant counts.
    """
    marks = calibrations.select(
        "template_id",
        F.col("created_at").alias("_at"),
        F.lit(0).alias("_side"),
        F.col("id").cast("string").alias("_id"),
        F.lit(None).cast(records.select(F.struct("*")).schema[0].dataType).alias("_record"),
        F.struct("weights", "threshold").alias("_calibration"),
    )
    rows = records.select(
        "template_id",
        F.col("created_at").alias("_at"),
        F.lit(1).alias("_side"),
        F.col("id").cast("string").alias("_id"),
        F.struct(*records.columns).alias("_record"),
        F.lit(None).cast(marks.schema["_calibration"].dataType).alias("_calibration"),
    )
    groups = ordered_groups(
        marks.unionByName(rows), ["template_id"], ["_at", "_side", "_id"]
    )
    seen = running(groups, {"_in_force": ("last", F.col("_calibration"))}).result()
    return seen.filter("_side = 1").select(
        "_record.*",
        F.col("_in_force.weights").alias("effective_weights"),
        F.col("_in_force.threshold").alias("effective_threshold"),
    )


def judge_stability(scores: DataFrame) -> DataFrame:
    """Population variance of single-round against many-round scores per item.

    Input: item_id, mode ('single' or 'multi'), score.
    """
    pick = lambda mode: F.round(F.var_pop(F.when(F.col("mode") == mode, F.col("score"))), 4)
    rows = scores.groupBy("item_id").agg(
        pick("single").alias("var_single"), pick("multi").alias("var_multi")
    )
    single, multi = F.col("var_single"), F.col("var_multi")
    verdict = (
        F.when(single == 0, "no_jitter").when(multi < single, "reduced").otherwise("not_reduced")
    )
    drop = F.round((1 - F.try_divide(multi, single)) * 100, 1)
    return rows.withColumns({"reduction": drop, "verdict": verdict})
