"""Data hygiene: secrets in documents, duplicate requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.redaction import BEARER, KEY_VALUE, java_pattern, mask_text
from ..schemas import TASK_ACTIVE


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Credentials in documents that redaction would change: one row per document and kind.

    Most texts fail the cheap test inside `mask_text` and never meet the patterns; only hits are
    shuffled.
    """
    suspects = docs.filter(mask_text(F.col(text)) != F.col(text)).select(key, text)
    bearer = F.transform(
        F.regexp_extract_all(text, java_pattern(BEARER), F.lit(1)), lambda m: F.lit("bearer")
    )
    # a bearer value is masked first, as in redaction, so both rules see the same text
    rest = F.regexp_replace(text, java_pattern(BEARER), F.lit("$1[REDACTED]"))
    pairs = F.transform(
        F.regexp_extract_all(rest, java_pattern(KEY_VALUE), F.lit(1)),
        lambda m: F.replace(F.lower(m), F.lit("-"), F.lit("_")),
    )
    kinds = suspects.select(key, F.explode(F.concat(bearer, pairs)).alias("kind"))
    return kinds.groupBy(key, "kind").agg(F.count("*").alias("hits"))


def active_duplicates(
    requests: DataFrame, tasks: DataFrame, active_statuses: Sequence[str] = TASK_ACTIVE
) -> DataFrame:
    """Requests whose hash already has an active task.

    Active hashes are made distinct first (combined before the shuffle the join needs anyway), so
    a hash with very many tasks is one row on that side.
    """
    active = tasks.filter(F.col("status").isin(*active_statuses)).select("request_hash").distinct()
    return requests.join(active, "request_hash", "left_semi")


def first_of_batch(requests: DataFrame) -> DataFrame:
    """First request of each hash inside one batch (hot hashes are cut to one row per task
    before the shuffle)."""
    order = Window.partitionBy("request_hash").orderBy("created_at", "id")
    return requests.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
