"""Running aggregates over sub-blocks give what one pass over the sorted group gives, and spread a group over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from loopstats.operators import cost, governance, lifecycle, listing, quality
from loopstats.operators.ordered import BLOCK, ordered_groups, running, since_reset
from loopstats.sources import derive as d


def jobs(spark):
    return set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


OPERATORS = {
    "attempt": lambda s, p: cost.attempt_number(d.trace_log(s, p)),
    "health": lambda s, p: cost.model_health(d.trace_log(s, p)),
    "budget": lambda s, p: cost.budget_guard(d.trace_log(s, p), d.model_budgets(s, p), 0.05),
    "replay": lambda s, p: listing.trace_replay(d.trace_log(s, p)),
    "changes": lambda s, p: governance.config_change_log(d.config_snapshots(s, p)),
    "transitions": lambda s, p: lifecycle.transition_audit(d.status_log(s, p), [("pending_qc", "passed")]),
    "asof": lambda s, p: quality.effective_weights_asof(
        d.quality_record(s, p).join(d.content_item(s, p).select(F.col("id").alias("item_id"), "template_id"), "item_id")
        .select("id", "template_id", "created_at"),
        d.calibrations(s, p),
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_building_runs_nothing_but_footers(spark, sf_dir, name):
    OPERATORS[name](spark, sf_dir)  # footers may be read by small jobs of the readers
    for source in ("trace_log", "model_budgets", "config_snapshots", "status_log", "quality_record", "content_item", "calibrations"):
        getattr(d, source)(spark, sf_dir)
    before = jobs(spark)
    frame = OPERATORS[name](spark, sf_dir)
    tables = len(set(frame.inputFiles()))
    assert len(jobs(spark) - before) <= 2 * tables + 2
    assert "_block" not in frame.columns


def test_one_key_spreads(spark, sf_dir):
    one = d.trace_log(spark, sf_dir).select(F.lit("k").alias("key"), "created_at", "id", "cost")
    groups = ordered_groups(one, ["key"], ["created_at", "id"])
    totals = running(groups, {"n": ("sum", F.lit(1)), "top": ("max", F.col("cost")), "seen": ("last", F.col("cost"))})
    sizes = [r["count"] for r in totals.rows.groupBy(BLOCK).count().collect()]
    assert len(sizes) > 100 and max(sizes) < sum(sizes) / 50
    rows = totals.result().orderBy("created_at", "id").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1))
    top, seen = None, None
    for r in rows:
        top = r.cost if top is None or (r.cost is not None and r.cost > top) else top
        seen = r.cost if r.cost is not None else seen
        assert (r.top, r.seen) == (top, seen)


@pytest.mark.parametrize("inclusive", [True, False])
def test_against_brute_force(spark, inclusive):
    random.seed(4)
    data = [(random.choice(["a", "b", None]), random.randrange(400_000), i, random.choice([None, 1, 5])) for i in range(300)]
    frame = spark.createDataFrame(data, "key string, place bigint, id bigint, v bigint")
    groups = ordered_groups(frame, ["key"], ["place", "id"])
    got = running(groups, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, inclusive).result()
    got = {r.id: (r.s, r.m, r.l) for r in got.collect()}
    for key in ("a", "b", None):
        done = []
        for _, place, i, v in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])):
            past = [x for x in done + ([v] if inclusive else []) if x is not None]
            assert got[i] == (sum(past), max(past, default=None), past[-1] if past else None)
            done.append(v)


def test_null_keys_and_times_survive(spark):
    data = [(None, 1), (None, 2), ("a", 3), (None, 4)] * 5
    log = spark.createDataFrame([(k, i) for i, (k, _) in enumerate(data)], "stage string, id bigint")
    at = F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") * 4000))
    log = log.withColumns({"trace_id": F.lit("t"), "created_at": at})
    got = cost.attempt_number(log).groupBy("stage").agg(F.max("attempt").alias("n"), F.count_distinct("attempt").alias("d"))
    assert {(r.stage, r.n, r.d) for r in got.collect()} == {(None, 15, 15), ("a", 5, 5)}


HOT = {
    "one hour": lambda i: i % 3600 + 0.25 * (i % 4),
    "one second": lambda i: i % 997 / 1000,
    "one instant": lambda i: 5.0,
    "no time": lambda i: None,
}


@pytest.mark.parametrize("case", HOT)
def test_a_hot_key_spreads_evenly(spark, case):
    """One key whose 24,000 rows share an hour, a second, an instant, or have no time."""
    n = 24_000
    data = [(i * 512, HOT[case](i), i % 5 == 0) for i in random.Random(3).sample(range(n), n)]
    frame = spark.createDataFrame(data, "id bigint, s double, good boolean").withColumn("key", F.lit("k")).withColumn("at", F.timestamp_seconds("s"))
    groups = ordered_groups(frame, ["key"], ["at", "id"], least=200)
    blocks = [r["count"] for r in groups.rows.groupBy(BLOCK).count().collect()]
    assert max(blocks) <= 200 and len(blocks) > 100
    totals = running(groups, {"n": ("sum", F.lit(1)), "last": ("last", F.when(F.col("good"), F.col("id")))})
    assert "Window" in totals.rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would fit one task
    tasks = totals.rows.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in tasks)
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    rows = totals.result().orderBy(F.asc_nulls_first("at"), "id").collect()
    assert [r.n for r in rows] == list(range(1, n + 1))
    seen = None
    for r in rows:
        seen = r.id if r.good else seen
        assert r["last"] == seen


@pytest.mark.parametrize("least", [3, 1 << 16])
def test_sums_since_a_reset(spark, least):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(9), rng.randrange(90_000)]), i, rng.random() < 0.1) for i in range(400)]
    frame = spark.createDataFrame(data, "key string, s bigint, id bigint, good boolean").withColumn("at", F.timestamp_seconds("s"))
    groups = ordered_groups(frame, ["key"], ["at", "id"], least=least)
    got = {r.id: r.open for r in since_reset(groups, "open", F.when(F.col("good"), 0).otherwise(1), F.col("good")).result().collect()}
    for key in ("a", "b", None):
        count = 0
        for _, _, i, good in sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            count = 0 if good else count + 1
            assert got[i] == count


def test_cells_of_strings_and_dates(spark):
    data = [(f"id{i % 40:03}x{i}", i % 4) for i in range(300)]
    frame = spark.createDataFrame(data, "id string, d int").select("id", F.date_add(F.lit("2024-01-30").cast("date"), "d").alias("day"), F.lit(1).alias("k"))
    groups = ordered_groups(frame, ["k"], ["day", "id"], least=20)
    rows = running(groups, {"n": ("sum", F.lit(1))}).result().orderBy("day", "id").collect()
    assert [r.n for r in rows] == list(range(1, 301))
    assert groups.rows.select(BLOCK).distinct().count() > 4
