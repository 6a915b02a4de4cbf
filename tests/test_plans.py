"""What reaches the scan, what is cut before the shuffle, and what partitioning must not change."""

import pytest
from pyspark.sql import functions as F

from loopstats.operators import calibration, cost, hygiene, knowledge, listing, nearest, samples
from loopstats.sources import derive as d, sinks, tables


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    log = d.trace_log(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    log.write.parquet(str(path / "trace_log"))
    d.sample_pool(spark, sf_dir).write.parquet(str(path / "sample_pool"))
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full_plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_time_filter_and_columns_reach_the_scan(spark, stored):
    calls = listing.time_range(tables.load(spark, stored, "trace_log"), "2024-01-05", "2024-01-06")
    text = full_plan(cost.cost_by_key(calls, "model"))
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text
    schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert schema.count(":") == 6  # ReadSchema: and five columns


def test_days_are_pruned(spark, sf_dir, tmp_path):
    log = d.trace_log(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    sinks.parquet_sink(str(tmp_path / "t"), day="day")(log, 0)
    stored = spark.read.parquet(str(tmp_path / "t"))
    part = listing.time_range(stored, "2024-01-05", "2024-01-07", day="day")
    text = full_plan(part)
    assert "PartitionFilters: [isnotnull(day" in text
    assert part.count() == listing.time_range(log, "2024-01-05", "2024-01-07").count() > 0


def test_rollup_scans_once(spark, stored):
    text = plan(cost.cost_rollup(tables.load(spark, stored, "trace_log")))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_top_k_is_cut_before_the_shuffle(spark, stored):
    text = plan(samples.fewshot_topk(tables.load(spark, stored, "sample_pool")))
    assert text.count("WindowGroupLimit") == 2
    batch = tables.load(spark, stored, "trace_log").withColumnRenamed("trace_id", "request_hash")
    assert plan(hygiene.first_of_batch(batch)).count("WindowGroupLimit") == 2


def test_chunking_does_not_shuffle(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    text = plan(knowledge.chunk_text(docs))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_cost_join_skips_content_without_template(spark, sf_dir):
    calls, content = d.trace_log(spark, sf_dir), d.content_item(spark, sf_dir)
    assert "Join" not in plan(cost.cost_join_content(calls, content, "task"))


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_partitioning_does_not_show(spark, sf_dir, parts):
    def rows(df):
        return sorted(map(str, df.collect()))

    cut = lambda df: df.repartition(parts)
    calls = d.trace_log(spark, sf_dir)
    assert rows(cost.cost_rollup(cut(calls))) == rows(cost.cost_rollup(calls))
    recs, content, t = d.quality_record(spark, sf_dir), d.content_item(spark, sf_dir), d.quality_templates(spark, sf_dir)
    assert rows(calibration.calibrate(cut(recs), cut(content), t)) == rows(calibration.calibrate(recs, content, t))
    vec = d.knowledge_vectors(spark, sf_dir)
    assert rows(nearest.knn_topk(vec, cut(vec), 3, ())) == rows(nearest.knn_topk(vec, vec, 3, ()))
