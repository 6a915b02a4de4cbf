"""Routing tiers, references, status moves, progress, notifications."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loopstats.functions import rules
from loopstats.operators import governance, lifecycle, quality
from loopstats.schemas import CONTENT_MOVES
from loopstats.sources import derive as d

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "config, difficulty, explicit, expected",
    [
        ({"model_profile": {"easy": "lite", "medium": "standard", "hard": "big"}}, "easy", None, "lite"),
        ({"model_profile": {"easy": "lite", "medium": "standard", "hard": "big"}}, "hard", None, "big"),
        ({"model_profile": {"default": "standard", "hard": "high"}}, None, None, "standard"),
        ({"model_profile": {"default": "lite", "hard": "high"}}, "极难", None, "lite"),
        ({"model_profile": {"default": "lite"}}, None, "high", "high"),
        ({"model_profile": {"b": "second", "a": "first"}}, None, None, "first"),
        ({"model_profile": "plain"}, "easy", None, "plain"),
        ({"model_profile": {}}, "easy", None, None),
        ({"model_profile": 3}, "easy", None, None),
        ({}, "easy", None, None),
    ],
)
def test_profile_name(spark, config, difficulty, explicit, expected):
    row = spark.createDataFrame([(json.dumps(config), difficulty, explicit)], "run_config string, d string, e string")
    name = governance.profile_name(F.col("d"), F.col("e"))
    assert governance.with_routes(row).select(name).first()[0] == expected


def profiles(spark, rows):
    return spark.createDataFrame(rows, "name string, is_default boolean, status string, cooldown_until timestamp, created_at timestamp")


def test_resolution(spark):
    early, late = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 3, tzinfo=timezone.utc)
    table = profiles(spark, [("ok", False, "enabled", early, early), ("cold", False, "enabled", late, early),
                             ("off", False, "disabled", None, early), ("base", True, "enabled", None, early)])
    templates = spark.createDataFrame(
        [(n, json.dumps({"model_profile": n})) for n in ("ok", "cold", "off", "typo")], "type_id string, run_config string"
    )
    requests = spark.createDataFrame([(n, n, "x") for n in ("ok", "cold", "off", "typo", "none")], "request_id string, template_id string, difficulty string")
    run = lambda t: {r.request_id: (r.profile, r.route) for r in governance.profile_resolution(requests, templates, t, NOW).collect()}
    assert run(table) == {"ok": ("ok", "primary"), **{n: ("base", "default") for n in ("cold", "off", "typo", "none")}}
    assert run(table.filter("not is_default"))["off"] == (None, "none")


def test_missing_references(spark):
    templates = spark.createDataFrame(
        [
            ("a", "enabled", '{"model_profile":"here"}'),
            ("b", "enabled", '{"model_profile":{"hard":"z","easy":"m","default":"here","n":4}}'),
            ("c", "disabled", '{"model_profile":"gone"}'),
            ("d", "enabled", "{}"),
        ],
        "type_id string, status string, run_config string",
    )
    names = spark.createDataFrame([("here",)], "name string")
    assert [tuple(r) for r in governance.model_ref_integrity(templates, names).collect()] == [("b", "m, z")]
    assert {r.name for r in governance.missing_refs(governance.referenced_profiles(templates), names).collect()} == {"m", "z", "gone"}


def test_only_newest_default_stays(spark):
    t = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3)]
    table = profiles(spark, [("a", True, "enabled", None, t[0]), ("b", True, "enabled", None, t[1]), ("c", False, "enabled", None, t[2])])
    assert [r.name for r in governance.default_uniqueness(table).filter("is_default").collect()] == ["b"]


VALID = dict(type_id="t", name="n", version=1, input_schema='{"type":"object"}', output_schema='{"type":"array"}',
             quality_rules=[("a", 0.5), ("b", 0.5)], gen_prompt='{"system":"s","user":"u"}',
             run_config='{"model_profile":"m"}', status="enabled")
TEMPLATE = ("type_id string, name string, version int, input_schema string, output_schema string, "
            "quality_rules array<struct<id:string,weight:double>>, gen_prompt string, run_config string, status string")


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"status": None}, []),
        ({"name": None, "version": 0}, [("name", "missing")]),
        ({"version": 0}, [("version", "below 1")]),
        ({"input_schema": '{"type":"string"}'}, [("input_schema", "not a schema")]),
        ({"quality_rules": []}, [("quality_rules", "empty")]),
        ({"quality_rules": [("a", 0.5), ("b", 0.4)]}, [("quality_rules", "weights do not sum to 1")]),
        ({"quality_rules": [("a", 0.5), (None, 0.4)]}, [("quality_rules", "rule without id or weight")]),
        ({"gen_prompt": '{"user":"u"}'}, [("gen_prompt", "no system or user")]),
        ({"run_config": "{}"}, [("run_config", "no model_profile")]),
        ({"status": "other"}, [("status", "unknown")]),
    ],
)
def test_template_checks(spark, change, expected):
    row = {**VALID, **change}
    df = spark.createDataFrame([tuple(row[k] for k in VALID)], TEMPLATE)
    assert [(r.field, r.problem) for r in governance.validate_templates(df).collect()] == expected


def test_template_hash_ignores_key_order(spark):
    rows = [tuple({**VALID, "run_config": c}[k] for k in VALID) for c in ('{"a":1,"model_profile":"m"}', '{"model_profile":"m","a":1}', '{"model_profile":"m","a":2}')]
    a, b, c = [r.template_hash for r in governance.template_hash(spark.createDataFrame(rows, TEMPLATE)).collect()]
    assert a == b != c


def test_change_log_suppresses_reordered_keys(spark):
    rows = [(1, '{"a":1,"b":2}'), (2, '{"b":2,"a":1}'), (3, '{"a":2,"b":2}')]
    df = spark.createDataFrame(rows, "id bigint, snapshot string").withColumns(
        {"entity_type": F.lit("model_profile"), "entity_id": F.lit("e"), "tenant_id": F.lit("t"), "created_at": F.timestamp_seconds("id")}
    )
    got = governance.config_change_log(df).orderBy("id").collect()
    assert [(r.id, r.action, r.before_snapshot) for r in got] == [(1, "create", None), (3, "update", '{"b":2,"a":1}')]


def test_status_moves(spark):
    path = ["pending_qc", "awaiting_review", "passed", "published", "passed", "passed"]
    log = spark.createDataFrame([("e", i, s) for i, s in enumerate(path)], "entity_id string, id bigint, status string")
    log = log.withColumn("created_at", F.timestamp_seconds("id"))
    moves = spark.createDataFrame(CONTENT_MOVES, "from_status string, to_status string")
    got = lifecycle.transition_audit(log, moves).orderBy("id").collect()
    assert [(r.from_status, r.to_status) for r in got] == [("published", "passed"), ("passed", "passed")]


@pytest.mark.parametrize(
    "statuses, progress, expected",
    [
        (["cancelled"] * 2, 1.0, "cancelled"),
        (["succeeded", "cancelled"], 1.0, "succeeded"),
        (["succeeded", "awaiting_review"], 1.0, "partially_succeeded"),
        (["succeeded", "failed"], 1.0, "partially_succeeded"),
        (["failed", "cancelled"], 1.0, "failed"),
        (["succeeded", "queued", "running"], 0.3333, "running"),
    ],
)
def test_progress(spark, statuses, progress, expected):
    items = spark.createDataFrame([("t", s) for s in statuses], "task_id string, status string")
    tasks = spark.createDataFrame([("t", "running"), ("empty", "pending")], "id string, status string")
    assert [tuple(r) for r in lifecycle.task_progress(tasks, items).collect()] == [("t", progress, expected)]


@pytest.mark.parametrize(
    "message, expected",
    [
        ("HTTP 422", "PERMANENT_ERROR"), ("code 400 after 429", "PERMANENT_ERROR"), ("Unprocessable Entity", "PERMANENT_ERROR"),
        ("429 slow down", "TRANSIENT_ERROR"), ("503", "TRANSIENT_ERROR"), ("500 oops", "TRANSIENT_ERROR"), ("boom", "UNKNOWN_ERROR"),
    ],
)
def test_failure_class(spark, message, expected):
    assert spark.range(1).select(rules.failure_class(F.lit(message))).first()[0] == expected


def test_thread_parts(spark):
    df = spark.createDataFrame([("task:3",), ("bare",)], "x string").select(rules.thread_parse(F.col("x")).alias("t"))
    assert [tuple(r.t) for r in df.collect()] == [("task", 3), ("bare", None)]


def test_backoff_and_outbox(spark):
    rows = [("a", "pending", 1, 0), ("b", "sending", 4, 400), ("c", "pending", 5, 0), ("d", "sent", 1, 0), ("e", "sending", 1, 299), ("f", "pending", 0, -10)]
    box = spark.createDataFrame(rows, "event_id string, status string, attempts int, ago int").withColumns(
        {c: F.timestamp_seconds(F.lit(int(NOW.timestamp())) - F.col("ago")) for c in ("available_at", "updated_at", "created_at")}
    )
    plan = {r.event_id: (r.next_status, r.available_at and int(r.available_at.timestamp() - NOW.timestamp())) for r in
            lifecycle.backoff_schedule(box.filter("event_id <> 'f'"), NOW)
            .withColumn("available_at", F.col("available_at")).collect()}
    assert {k: v[0] for k, v in plan.items()} == {"a": "pending", "b": "pending", "c": "dead", "e": "pending"}
    health = {r.status: (r.events, r.due, r.stale) for r in lifecycle.outbox_health(box, NOW).collect()}
    assert health == {"pending": (3, 2, 0), "sending": (2, 0, 1), "sent": (1, 0, 0)}
    assert [r.event_id for r in lifecycle.outbox_due(box, NOW).collect()] == ["a", "c"]


def test_notifications(spark):
    tasks = spark.createDataFrame([("1", "succeeded", 3, "x"), ("2", "partially_succeeded", 1, "x"), ("3", "failed", 1, "x"), ("4", "running", 1, "x"), ("5", "succeeded", 1, "x")],
                                  "id string, status string, quantity int, tenant_id string")
    content = spark.createDataFrame([("c", "rejected", 1.0, "y"), ("g", "awaiting_review", 65.5, "y"), ("h", "awaiting_review", 65.0, "y")],
                                    "id string, status string, qc_score double, tenant_id string")
    records = spark.createDataFrame([("r2", "c", "manual_review", 0.0, "later", 2), ("r1", "c", "manual_review", 0.0, "off topic", 1), ("r3", "g", "auto", 0.0, None, 1)],
                                    "id string, item_id string, source string, score double, reason string, s bigint").withColumn("created_at", F.timestamp_seconds("s"))
    existing = spark.createDataFrame([("task:5:result",)], "event_id string")
    due = lifecycle.notifications(tasks, records, content, existing)
    got = {r.event_id: (r.type, r.content) for r in due.collect()}
    assert got == {
        "task:1:result": ("task_succeeded", "任务 1 已成功生成 3 条内容"),
        "task:2:result": ("task_partial", "任务 2 部分成功，部分条目生成失败"),
        "task:3:result": ("task_failed", "任务 3 生成失败"),
        "content:c:rejected": ("content_rejected", "内容 c 被人工质检驳回：off topic"),
        "content:g:awaiting-review": ("content_awaiting_review", "内容 g 自动质检 65.5 分，处于灰区，等待人工裁决"),
        "content:h:awaiting-review": ("content_awaiting_review", "内容 h 自动质检 65 分，处于灰区，等待人工裁决"),
    }
    assert lifecycle.notifications(tasks, records, content, due.select("event_id").union(existing)).count() == 0


def test_quality_snapshot_joins_once_or_not_at_all(spark, sf_dir):
    templates = d.question_template(spark, sf_dir)
    own = governance.quality_snapshot(templates)
    joined = governance.quality_snapshot(templates, quality.template_defaults(templates))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(own) and plan(joined).count("Join ") == 1  # two joins of the table with itself before
    rows = sorted(map(tuple, own.collect()))
    assert rows == sorted(map(tuple, joined.collect())) and len(rows) == templates.count()
    none = governance.quality_snapshot(templates, quality.template_defaults(templates).limit(0)).first()
    assert '"model_name":null,"threshold":null,"weights":null' in none.snapshot
