"""Agreement between the judge's and the reviewer's verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import QUALITY_THRESHOLD


def _verdicts(threshold: float) -> tuple[Column, Column]:
    """(truth, prediction): reviewer score above 0, judge score at the threshold."""
    return F.col("manual") > 0, F.col("auto") >= threshold


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _confusion_columns(threshold: float) -> list[Column]:
    truth, pred = _verdicts(threshold)
    n, tp, tn = F.count("*"), F.count(F.when(truth & pred, 1)), F.count(F.when(~truth & ~pred, 1))
    fp, fn = F.count(F.when(~truth & pred, 1)), F.count(F.when(truth & ~pred, 1))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    agreed = _ratio(tp + tn, n)
    chance = _ratio((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    kappa = F.when(n == 0, None).when(chance >= 1, 1.0).otherwise(
        F.try_divide(agreed - chance, 1 - chance)
    )
    return [
        n.alias("n"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"),
        F.round(agreed, 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round(kappa, 4).alias("kappa"),
    ]


def confusion(
    pairs: DataFrame, threshold: float = QUALITY_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates; rates are null on an empty denominator."""
    return pairs.groupBy(*by).agg(*_confusion_columns(threshold))


def cohen_kappa(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Kappa for any label set.

    Rows shrink to (truth, pred) counts before the shuffle; each cell then adds to the margins of
    its two labels, so no self-join is needed.
    """
    cells = df.groupBy(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(
        F.count("*").alias("_n")
    )
    side = lambda label, row, col: F.struct(
        label.alias("label"), row.alias("row"), col.alias("col")
    )
    n, zero = F.col("_n"), F.lit(0).cast("bigint")
    margins = (
        cells.select(
            *by,
            F.when(F.col("_t").eqNullSafe(F.col("_p")), n).otherwise(zero).alias("_same"),
            F.explode(F.array(side(F.col("_t"), n, zero), side(F.col("_p"), zero, n))).alias("m"),
        )
        .groupBy(*by, "m.label")
        .agg(F.sum("m.row").alias("_row"), F.sum("m.col").alias("_col"), F.sum("_same").alias("_same2"))
    )
    # every cell was counted once per side, hence the half
    total = F.sum("_row").cast("double")
    agreed = F.sum("_same2") / 2 / total
    chance = F.sum(F.col("_row").cast("double") * F.col("_col")) / (total * total)
    kappa = F.when(chance >= 1, 1.0).otherwise(F.try_divide(agreed - chance, 1 - chance))
    return margins.groupBy(*by).agg(
        F.sum("_row").alias("n"), F.round(kappa, 4).alias("kappa")
    )


def agreement_report(
    pairs: DataFrame, threshold: float = QUALITY_THRESHOLD, min_samples: int = 30
) -> DataFrame:
    """Per template and over all; `sufficient` tells whether there are enough pairs."""
    report = pairs.groupingSets([["template_id"], []], "template_id").agg(
        (F.grouping("template_id") == 1).alias("_all"), *_confusion_columns(threshold)
    )
    return report.withColumns(
        {
            "template_id": F.when(F.col("_all"), "(all)").otherwise(F.col("template_id")),
            "threshold": F.lit(threshold),
            "sufficient": F.col("n") >= min_samples,
        }
    ).drop("_all")
