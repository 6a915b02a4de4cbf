"""Calibration: learn dimension weights and thresholds from reviewers' verdicts.

All templates at once. Shapes:
  pairs       item_id, template_id, auto, manual, auto_dims (map)
  thresholds  template_id, threshold
  weights     template_id, weights (map)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FLOOR_SHARE = 0.05
TARGET_REJECTION = 0.05


def label_pairs(records: DataFrame, content: DataFrame) -> DataFrame:
    """Earliest auto and earliest manual record of each item that has both: one groupBy."""
    def first(source: str, *fields: str) -> Column:
        values = ", ".join(fields)
        return F.expr(
            f"min_by(struct({values}), struct(created_at, id)) filter (where source = '{source}')"
        )

    per_item = (
        records.filter(F.col("source").isin("auto", "manual_review"))
        .groupBy("item_id")
        .agg(first("auto", "score", "dimension_scores").alias("a"), first("manual_review", "score").alias("m"))
        .filter("a is not null and m is not null")
    )
    items = content.select(F.col("id").alias("item_id"), "template_id")
    return per_item.join(items, "item_id").select(
        "item_id",
        "template_id",
        F.col("a.score").alias("auto"),
        F.col("m.score").alias("manual"),
        F.coalesce("a.dimension_scores", F.create_map().cast("map<string,double>")).alias("auto_dims"),
    )


def labelled_intersect(records: DataFrame) -> DataFrame:
    """Items that have records of both sources."""
    ids = lambda source: records.filter(F.col("source") == source).select("item_id")
    return ids("auto").intersect(ids("manual_review"))


def _marked(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    rejected = F.col("manual") == 0
    return pairs.join(thresholds.select("template_id", "threshold"), "template_id").withColumns(
        {"rejected": rejected, "false_pass": rejected & (F.col("auto") >= F.col("threshold"))}
    )


def false_pass_set(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(F.col(c), 1))
    return _marked(pairs, thresholds).groupBy("template_id").agg(
        F.count("*").alias("sample_size"),
        count("rejected").alias("rejected"),
        count("false_pass").alias("false_pass_cnt"),
        F.round(count("rejected") / F.count("*"), 4).alias("rejection_rate"),
    )


def weights_long(weights: DataFrame) -> DataFrame:
    return weights.select("template_id", F.explode("weights").alias("dim", "weight"))


def dim_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (template_id, dim) of two long frames."""
    pick = lambda df: df.select("template_id", "dim")
    return pick(a).union(pick(b)).distinct()


def evidence(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What calibration needs from the labels, one row per template: counts, and per dimension
    the means over false passes (`fp`) and over passes (`ok`).

    One aggregation over the pairs; a row without dimension carries the counts. The second
    groupBy sees a row per template and dimension.
    """
    entry = "struct<dim:string,score:double>"
    entries = F.transform(
        F.map_entries("auto_dims"), lambda e: F.struct(e["key"].alias("dim"), e["value"].alias("score"))
    ).cast(f"array<{entry}>")
    long = _marked(pairs, thresholds).select(
        "template_id", "rejected", "false_pass",
        F.explode(F.array_append(entries, F.lit(None).cast(entry))).alias("e"),
    )
    count = lambda c: F.count(F.when(F.col(c), 1))
    per_dim = long.groupBy("template_id", F.col("e.dim").alias("dim")).agg(
        F.count("*").alias("n"),
        count("rejected").alias("rejected"),
        count("false_pass").alias("false_pass"),
        F.avg(F.when(F.col("false_pass"), F.col("e.score"))).alias("fp"),
        F.avg(F.when(~F.col("rejected"), F.col("e.score"))).alias("ok"),
    )
    whole = lambda c: F.max(F.when(F.col("dim").isNull(), F.col(c)))
    seen = F.col("dim").isNotNull() & (F.col("fp").isNotNull() | F.col("ok").isNotNull())
    means = F.when(seen, F.struct("dim", F.struct("fp", "ok")))
    return per_dim.groupBy("template_id").agg(
        whole("n").alias("sample_size"),
        whole("rejected").alias("rejected"),
        whole("false_pass").alias("false_pass_cnt"),
        F.map_from_entries(F.collect_list(means)).alias("means"),
    )


def _lenient_map(weights: Column, means: Column) -> Column:
    """Mean over false passes − mean over passes, 0 where a side is empty; the dimensions are
    those of the weights and those seen."""
    seen = F.coalesce(F.map_keys(means), F.array().cast("array<string>"))
    dims = F.array_union(F.map_keys(weights), seen)
    gap = lambda d: F.round(means[d]["fp"] - means[d]["ok"], 2)
    return F.map_from_arrays(dims, F.transform(dims, lambda d: F.coalesce(gap(d), F.lit(0.0))))


def _with_fitted(df: DataFrame, alpha: float) -> DataFrame:
    """Adds `fitted`: lenient dimensions lose weight, then floor and renormalisation.

    The largest leniency is taken over all dimensions, weighted or not.
    """
    share = lambda k: F.try_divide(
        F.greatest(F.coalesce(F.col("lenient")[k], F.lit(0.0)), F.lit(0.0)), F.col("_worst")
    )
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, x: acc + x)
    floor = F.try_divide(total("_raw"), F.size("_raw")) * FLOOR_SHARE
    usable = (F.col("_worst") > 0) & (F.col("_total") > 0)
    return (
        df.withColumn("_worst", F.array_max(F.map_values("lenient")))
        .withColumn("_raw", F.transform_values("weights", lambda k, w: w * (1.0 - F.lit(alpha) * share(k))))
        .withColumn("_floor", floor)
        .withColumn("_kept", F.transform_values("_raw", lambda k, w: F.greatest(w, F.col("_floor"))))
        .withColumn("_total", total("_kept"))
        .withColumn(
            "fitted",
            F.when(usable, F.transform_values("_kept", lambda k, w: F.round(w / F.col("_total"), 4)))
            .otherwise(F.col("weights")),
        )
        .drop("_worst", "_raw", "_floor", "_kept", "_total")
    )


def leniency(pairs: DataFrame, thresholds: DataFrame, weights: DataFrame) -> DataFrame:
    """(template_id, dim, lenient) for every dimension of the weights or the labels."""
    found = weights.select("template_id", "weights").join(
        evidence(pairs, thresholds).select("template_id", "means"), "template_id", "left"
    )
    gaps = _lenient_map(F.col("weights"), F.col("means"))
    return found.select("template_id", F.explode(gaps).alias("dim", "lenient"))


def fit_weights(lenient: DataFrame, weights: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(template_id, dim, default_weight, weight) from the leniency of each dimension."""
    gaps = lenient.groupBy("template_id").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "lenient"))).alias("lenient")
    )
    fitted = _with_fitted(weights.select("template_id", "weights").join(gaps, "template_id", "left"), alpha)
    return fitted.select(
        "template_id", "fitted", F.explode("weights").alias("dim", "default_weight")
    ).select("template_id", "dim", "default_weight", F.col("fitted")[F.col("dim")].alias("weight"))


#: The sketch of p10_rank tells ranks to one part in ACCURACY; its bracket is MARGIN such parts to either side.
ACCURACY, MARGIN = 10_000, 10


def p10_rank(df: DataFrame, value: str, by: str) -> DataFrame:
    """Element number n div 10 (from 0) of the sorted values of each group, exactly, in two passes.

    The first pass counts each group and brackets the element by a mergeable quantile sketch. The second counts the
    values inside the bracket one by one and those below it as one; running counts over them pick the element. The
    bracket holds a 500th of a group (a group of fewer than ACCURACY values is its own), so no group is sorted whole.
    Should a sketch ever miss, the job fails.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("_v"))
    far = MARGIN / ACCURACY
    sketch = F.percentile_approx("_v", F.array(F.lit(0.1 - far), F.lit(0.1 + far)), F.lit(ACCURACY))
    facts = rows.groupBy(F.col("_by").alias("_of")).agg(F.count("*").alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_s"))
    large = F.col("n") >= ACCURACY
    facts = facts.select(
        "_of", "n", F.when(large, F.col("_s")[0]).otherwise(F.col("_least")).alias("_lo"), F.when(large, F.col("_s")[1]).otherwise(F.col("_most")).alias("_hi")
    )
    known = rows.join(facts, F.col("_by").eqNullSafe(F.col("_of")))
    side = F.when(F.col("_v") < F.col("_lo"), 0).when(F.col("_v") <= F.col("_hi"), 1).otherwise(2)
    known = known.select("_by", "n", side.alias("_side"), F.when(side == 1, F.col("_v")).alias("_v"))
    counts = known.groupBy("_by", "n", "_side", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_by").orderBy("_side", "_v"))
    rank = F.floor(F.col("n") / 10) + 1
    held = counts.withColumn("_upto", upto).filter((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank))
    missed = F.raise_error(F.lit("p10_rank: the sketch's bracket does not hold the rank")).cast(df.schema[value].dataType)
    return held.select(F.col("_by").alias(by), "n", F.when(F.col("_side") == 1, F.col("_v")).otherwise(missed).alias("p10"))


def _dim_mean(dims: Column) -> Column:
    values = F.map_values(dims)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values))


def pass_p10(pairs: DataFrame) -> DataFrame:
    """(template_id, p10_dim_mean): the passes' tenth percentile of mean dimension scores."""
    passes = pairs.filter("manual != 0").select("template_id", _dim_mean(F.col("auto_dims")).alias("_mean"))
    return p10_rank(passes, "_mean", "template_id").select(
        "template_id", F.col("p10").alias("p10_dim_mean")
    )


def _raised(rate: Column, target: float) -> Column:
    """The tightened threshold where reviewers reject too often, never below the current one."""
    limit = F.greatest("threshold", F.round("p10_dim_mean", 1))
    return F.when(rate > target, limit).otherwise(F.col("threshold"))


def fit_threshold(
    pairs: DataFrame, thresholds: DataFrame, target: float = TARGET_REJECTION
) -> DataFrame:
    rates = false_pass_set(pairs, thresholds).select("template_id", "rejection_rate")
    return (
        thresholds.select("template_id", "threshold")
        .join(rates, "template_id", "left")
        .join(pass_p10(pairs), "template_id", "left")
        .select(
            "template_id",
            F.col("threshold").alias("default_threshold"),
            "rejection_rate",
            "p10_dim_mean",
            _raised(F.col("rejection_rate"), target).alias("threshold"),
        )
    )


# The notes stored with a calibration.
NOTE_SHORT = "样本不足（标注 %d 条，假阳性 %d 条），需 ≥%d 标注且 ≥%d 假阳性，保持默认权重"
NOTE_DONE = "校准成功：%d 个假阳性样本反向降权，驳回率 %s（目标 ≤5%%）"


def calibrate(
    records: DataFrame,
    content: DataFrame,
    templates: DataFrame,
    alpha: float = 1.0,
    min_samples: int = 20,
    min_fp: int = 5,
) -> DataFrame:
    """One calibration row per template; too few labels keep the default weights and threshold."""
    pairs = label_pairs(records, content)
    found = templates.select("template_id", "weights", "threshold").join(
        evidence(pairs, templates), "template_id", "left"
    )
    p10 = pass_p10(pairs)
    fitted = _with_fitted(
        found.join(p10, "template_id", "left").withColumn(
            "lenient", _lenient_map(F.col("weights"), F.col("means"))
        ),
        alpha,
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    n, fp = count("sample_size"), count("false_pass_cnt")
    rate = F.round(F.coalesce(F.try_divide("rejected", "sample_size"), F.lit(0.0)), 4)
    enough = (n >= min_samples) & (fp >= min_fp)
    # without passes there is nothing to compare the false passes with
    comparable = enough & (n > F.coalesce("rejected", F.lit(0)))
    none = F.create_map().cast("map<string,double>")
    limit = _raised(rate, TARGET_REJECTION)
    percent = F.format_string("%.1f%%", F.round(rate * 100, 1))
    return fitted.select(
        "template_id",
        F.when(comparable, F.col("fitted")).otherwise(F.col("weights")).alias("weights"),
        F.when(enough, limit).otherwise(F.col("threshold")).alias("threshold"),
        F.col("weights").alias("default_weights"),
        F.col("threshold").alias("default_threshold"),
        n.alias("sample_size"),
        fp.alias("false_pass_cnt"),
        F.when(comparable, F.col("lenient")).otherwise(none).alias("lenient"),
        rate.alias("rejection_rate"),
        F.when(enough, F.format_string(NOTE_DONE, fp, percent))
        .otherwise(F.format_string(NOTE_SHORT, n, fp, F.lit(min_samples), F.lit(min_fp)))
        .alias("note"),
    )
