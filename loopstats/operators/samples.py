"""Sample pool: sync, search and few-shot selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rules import blank_to_null
from ..sources.sinks import AppendLog
from .listing import eligible_content, list_page


def sample_kp_join(content: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds the knowledge point of the item's task; blank, zero and false count as none.

    A task with many items is a hot key of the left side, which AQE's skew join may split.
    """
    value = blank_to_null(F.get_json_object("params", "$.knowledge_point"))
    points = tasks.select(
        F.col("id").alias("task_id"),
        F.when(~value.isin("0", "0.0", "false", "[]", "{}"), value).alias("knowledge_point"),
    )
    return content.join(points, "task_id", "left")


def sample_sync(
    content: DataFrame,
    tasks: DataFrame,
    pool: DataFrame,
    source: str = "auto",
    purpose: str = "sft",
) -> DataFrame:
    """Samples to append for eligible items not pooled yet; a second run yields none.

    Which items, and their knowledge points, is settled on ids alone, so the payloads are
    shuffled once at most, and never by the skewed task key.
    """
    fresh = eligible_content(content).select("id", "task_id").join(
        pool.select(F.col("item_id").alias("id")), "id", "left_anti"
    )
    points = sample_kp_join(fresh, tasks).select("id", "knowledge_point")
    return content.join(points, "id").select(
        F.sha2(F.concat(F.lit("sample:"), F.col("id")), 256).alias("id"),
        F.col("id").alias("item_id"),
        "template_id",
        F.lit(source).alias("source"),
        F.lit(purpose).alias("purpose"),
        "knowledge_point",
        "payload",
        F.to_json(F.struct("qc_score", "status"), {"ignoreNullFields": "false"}).alias("meta"),
    )


def sync_into(content: DataFrame, tasks: DataFrame, pool: AppendLog, run: str, source: str = "auto", purpose: str = "sft") -> bool:
    """A sync that appends its samples to the pool, once for each run id."""
    have = pool.read("item_id string")
    return pool.append(sample_sync(content, tasks, have, source, purpose), run)


def sync_counts(content: DataFrame, fresh: DataFrame, pool: DataFrame) -> DataFrame:
    """Samples added by a sync, and the pool's size after it."""
    added = fresh.agg(F.count("*").alias("n")).withColumn("part", F.lit("added"))
    before = pool.agg(F.count("*").alias("n")).withColumn("part", F.lit("before"))
    return added.union(before).agg(
        F.sum(F.when(F.col("part") == "added", F.col("n"))).alias("added"),
        F.sum("n").alias("total"),
    )


def sample_search(
    pool: DataFrame,
    template: str | None = None,
    kp: str | None = None,
    purpose: str | None = None,
    source: str | None = None,
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    wanted = {
        "template_id": template, "knowledge_point": kp, "purpose": purpose, "source": source,
    }
    return list_page(pool, wanted, page=page, size=size)


def fewshot_topk(pool: DataFrame, k: int = 3, by_knowledge_point: bool = True) -> DataFrame:
    """Newest k few-shot samples per template [and knowledge point].

    Spark keeps only k rows per group and task before the shuffle (WindowGroupLimit), so a hot
    template costs no more than the others.
    """
    keys = ["template_id", "knowledge_point"] if by_knowledge_point else ["template_id"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    ranked = pool.filter(F.col("purpose") == "fewshot").withColumn("rank", F.row_number().over(newest))
    return ranked.filter(F.col("rank") <= k)
