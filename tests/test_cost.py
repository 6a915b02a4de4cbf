"""Cost, conformance, budgets and health on hand-made call logs."""

import pytest
from pyspark.sql import functions as F

from loopstats.operators import cost, listing

COLUMNS = "trace_id string, attempt int, success boolean, stage string, template_id string, task_id string"


def calls(spark, rows):
    return spark.createDataFrame([(t, a, s, "generate", "x", "k") for t, a, s in rows], COLUMNS)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([], (0, 0, 0, None, None, None)),
        ([("a", 1, True), ("b", 1, True)], (2, 2, 0, 1.0, 1.0, 0.0)),
        (
            [("a", 1, True), ("b", 1, False), ("b", 2, False), ("b", 3, True), ("c", 1, False), ("c", 2, False)],
            (3, 2, 1, 0.5, 2.0, 0.3333),
        ),
        ([("a", 2, True), ("a", 1, True)], (1, 1, 0, 1.0, 1.0, 0.0)),
        ([("a", 1, False), ("a", 2, False)], (1, 0, 1, None, None, 1.0)),
        ([("a", None, True), ("b", 0, True)], (2, 2, 0, 1.0, 1.0, 0.0)),
    ],
)
def test_structured_stats(spark, rows, expected):
    assert tuple(cost.structured_stats(calls(spark, rows)).first()) == expected


def test_prices_fall_back_per_side(spark):
    log = spark.createDataFrame(
        [("m1", 1000, 1000), ("m2", 1000, 1000), ("other", 1000, 1000), ("m1", None, 1000)],
        "model string, prompt_tokens int, completion_tokens int",
    )
    prices = spark.createDataFrame(
        [("m1", 0.001, 0.003), ("m2", 0.001, None)], "model string, prompt double, completion double"
    )
    rows = cost.priced_calls(log, prices).collect()
    got = sorted((r.model, r.priced_cost, r.breakdown.prompt_cost, r.breakdown.completion_cost) for r in rows)
    assert got == [
        ("m1", 0.003, 0.0, 0.003),
        ("m1", 0.004, 0.001, 0.003),
        ("m2", 0.003, 0.001, 0.002),
        ("other", 0.004, 0.002, 0.002),
    ]


def test_breakdown_rounds_each_side(spark):
    log = spark.createDataFrame([("m", 1, 1)], "model string, prompt_tokens int, completion_tokens int")
    prices = spark.createDataFrame([("m", 0.0004, 0.0004)], "model string, prompt double, completion double")
    row = cost.priced_calls(log, prices).first()
    assert (row.priced_cost, row.breakdown.cost) == (0.000001, 0.0)


def test_null_and_literal_unknown_stay_apart(spark):
    log = spark.createDataFrame(
        [(None, 1.0, 1, 1), ("unknown", 2.0, 1, 1)],
        "model string, cost double, prompt_tokens int, completion_tokens int",
    )
    rows = cost.cost_by_key(log, "model").collect()
    assert [(r.name, r.total_cost) for r in rows] == [("unknown", 2.0), ("unknown", 1.0)]


def test_call_tokens_need_both_sides(spark):
    log = spark.createDataFrame(
        [("t", "m", 1.0, 5, None), ("t", "m", 1.0, 2, 3)],
        "tenant_id string, model string, cost double, prompt_tokens int, completion_tokens int",
    )
    row = cost.cost_by_model_since(log.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))).first()
    assert (row.total_tokens, row.call_count) == (5, 2)


def health_log(spark, outcomes):
    rows = [(i, "m", ok, i) for i, ok in enumerate(outcomes)]
    return spark.createDataFrame(rows, "id bigint, model string, success boolean, s bigint").withColumn(
        "created_at", F.timestamp_seconds("s")
    )


def test_model_health(spark):
    log = health_log(spark, [False, False, False, True, False, True])
    rows = cost.model_health(log).orderBy("id").collect()
    assert [r.failure_count for r in rows] == [1, 2, 3, 0, 1, 0]
    assert [r.health_status for r in rows] == [
        "degraded", "unhealthy", "unhealthy", "healthy", "degraded", "healthy",
    ]
    gaps = [(r.cooldown_until - r.created_at).seconds if r.cooldown_until else None for r in rows]
    assert gaps == [None, 60, 60, None, None, None]


def test_budget_guard(spark):
    rows = [(1, "t", "m", 0.3, 1), (2, "t", "m", 0.3, 2), (3, "t", "free", 0.3, 3), (4, None, "m", 9.0, 4), (5, "t", "m", 0.1, 5)]
    log = spark.createDataFrame(rows, "id bigint, task_id string, model string, cost double, s bigint")
    log = log.withColumn("created_at", F.timestamp_seconds("s"))
    budgets = spark.createDataFrame([("m", 0.6), ("free", None)], "model string, budget_per_task double")
    over = cost.budget_guard(log, budgets).orderBy("id").collect()
    assert [(r.id, r.spent_before, r.budget) for r in over] == [(5, 0.9, 0.6)]
    over = cost.budget_guard(log, budgets, global_budget=0.5).orderBy("id").collect()
    assert [r.id for r in over] == [3, 5]


def test_pages_and_cursor_agree(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(20)], "id bigint, s bigint")
    rows = rows.withColumn("created_at", F.timestamp_seconds("s"))
    first = listing.list_page(rows, page=1, size=5).collect()
    second = listing.list_page(rows, page=2, size=5).collect()
    last = first[-1]
    keyed = listing.list_page(rows, size=5, cursor=(last.created_at, last.id)).collect()
    assert [r.id for r in first] == [19, 18, 17, 16, 15]
    assert keyed == second and second[0].total == 20


def test_scope(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "tenant_id string")
    ids = lambda *args: sorted(str(r.tenant_id) for r in listing.scope_filter(rows, *args).collect())
    assert ids("admin", "a") == ["None", "a", "b"]
    assert ids("admin", "a", "b") == ["b"]
    assert ids("viewer", "a", "b") == ["a"]
    assert ids("viewer", None) == ["None", "a", "b"]
