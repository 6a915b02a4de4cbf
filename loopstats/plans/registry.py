"""The registered queries: every operator over the whole of its tables.

Results hold plain values only (instants as epoch microseconds, maps and arrays as rows), so
that they can be compared with another engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import jsons, redaction, rules, vectors
from ..operators import (
    agreement, calibration, cost, governance, hygiene, knowledge, lifecycle, listing, nearest, quality, samples,
    validate,
)
from ..schemas import CONTENT_MOVES
from ..session import BATCH_BYTES
from ..sources import derive as d, documents, sinks
from ..sources.tables import as_table
from ..streaming import jobs
from . import dashboards

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENTS_AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
LOOP_AS_OF = datetime(2030, 1, 1, tzinfo=timezone.utc)
TASKS_AS_OF = datetime(1998, 1, 1, tzinfo=timezone.utc)


def flat(df: DataFrame) -> DataFrame:
    def plain(field: T.StructField):
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(field.name).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.col(field.name).cast("string")
        return F.col(field.name)

    return df.select(*(plain(f) for f in df.schema.fields))


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the tables hold instants without a zone; all of them are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set(*BATCH_BYTES)
        return flat(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


# --- listings ---------------------------------------------------------------------------------
@query
def list_page(s, p):
    return listing.list_page(
        d.trace_log(s, p).select("id", "stage", "model", "cost", "created_at"),
        {"stage": "generate"}, page=3, size=50,
    )


@query
def count_by(s, p):
    return listing.count_by(d.content_item(s, p), "tenant_id", "template_id", "status")


@query
def scope_filter(s, p):
    calls = d.trace_log(s, p)
    views = {
        "admin_all": listing.scope_filter(calls, "admin", "t0"),
        "admin_one": listing.scope_filter(calls, "admin", "t0", "t2"),
        "viewer": listing.scope_filter(calls, "viewer", "t1", "t2"),
    }
    parts = [
        v.groupBy("tenant_id").agg(F.count("*").alias("calls")).select(F.lit(n).alias("view"), "tenant_id", "calls")
        for n, v in views.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def time_range(s, p):
    rows = listing.time_range(d.trace_log(s, p), "2024-01-10", "2024-01-20")
    return rows.select("id", "model", "created_at")


@query
def published_view(s, p):
    return listing.published_view(d.content_item(s, p)).select("id", "template_id", "qc_score", "published_at")


@query
def manual_rejections(s, p):
    return listing.manual_rejections(d.quality_record(s, p)).select("id", "item_id", "reason", "reviewer", "created_at")


@query
def eligible_content(s, p):
    return listing.eligible_content(d.content_item(s, p)).select("id", "status", "qc_score")


@query
def trace_replay(s, p):
    return listing.trace_replay(d.trace_log(s, p)).select("id", "trace_id", "stage", "step", "created_at")


@query
def task_calls(s, p):
    return listing.task_calls(d.trace_log(s, p)).select("id", "task_id", "step")


@query
def item_calls(s, p):
    return listing.item_calls(d.trace_log(s, p)).select("id", "item_id", "step")


@query
def recent_calls(s, p):
    return listing.recent_calls(d.trace_log(s, p), 200)


@query
def audit_log_query(s, p):
    log = governance.config_change_log(d.config_snapshots(s, p))
    return listing.audit_log_query(log, entity_type="model_profile", start="2024-01-05", end="2024-01-25")


@query
def sample_search(s, p):
    found = samples.sample_search(d.sample_pool(s, p), purpose="sft", source="auto", size=100)
    return found.select("id", "template_id", "knowledge_point", "created_at", "total")


# --- cost and call log --------------------------------------------------------------------------
@query
def cost_by_key(s, p):
    return cost.cost_by_key(d.trace_log(s, p), "model")


@query
def cost_rollup(s, p):
    return cost.cost_rollup(d.trace_log(s, p))


@query
def cost_by_stage(s, p):
    return cost.cost_by_stage(d.trace_log(s, p), prices=d.model_prices(s, p))


@query
def cost_totals(s, p):
    return cost.cost_totals(d.trace_log(s, p))


@query
def cost_join_content(s, p):
    return cost.cost_join_content(d.trace_log(s, p), d.content_item(s, p), "model", "en")


@query
def cost_by_model_since(s, p):
    return cost.cost_by_model_since(d.trace_log(s, p), since="2024-01-15")


@query
def cost_by_date(s, p):
    return cost.cost_by_date(d.trace_log(s, p))


@query
def cost_period_report(s, p):
    return dashboards.cost_period_report(d.trace_log(s, p), None, EVENTS_AS_OF)


@query
def cost_task_template_stage(s, p):
    calls = d.trace_log(s, p)
    none = F.lit(None).cast("string")
    shapes = {
        "task": (["task_id"], None, None),
        "template": (["template_id"], "2024-01-10", "2024-01-20"),
        "task_stage": (["task_id", "stage"], None, None),
    }
    parts = []
    for name, (keys, start, end) in shapes.items():
        rows = cost.cost_task_template_stage(calls, keys, start, end)
        for key in ("task_id", "template_id", "stage"):
            rows = rows if key in keys else rows.withColumn(key, none)
        parts.append(rows.withColumn("report", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def cost_recent(s, p):
    return cost.cost_recent(d.trace_log(s, p), EVENTS_AS_OF)


@query
def success_rate(s, p):
    return cost.success_rate(d.trace_log(s, p))


@query
def call_conformance(s, p):
    return cost.call_conformance(d.trace_log(s, p))


@query
def structured_stats(s, p):
    return cost.structured_stats(cost.attempt_number(d.trace_log(s, p)), by=["template_id"])


@query
def trace_summary(s, p):
    return cost.trace_summary(d.trace_log(s, p), limit=None)


@query
def deep_cost_report(s, p):
    return dashboards.deep_cost_report(d.trace_log(s, p), template="tpl_1")[0]


@query
def price_lookup(s, p):
    rows = cost.price_lookup(d.trace_log(s, p), d.model_prices(s, p))
    return rows.select("id", "model", "prompt_rate", "completion_rate")


def _priced(s, p):
    return cost.priced_calls(d.trace_log(s, p), d.model_prices(s, p))


@query
def call_cost(s, p):
    return _priced(s, p).select("id", "priced_cost")


@query
def token_breakdown(s, p):
    return _priced(s, p).select("id", "breakdown.*")


@query
def attempt_number(s, p):
    return cost.attempt_number(d.trace_log(s, p)).select("id", "trace_id", "stage", "attempt")


@query
def budget_guard(s, p):
    return cost.budget_guard(d.trace_log(s, p), d.model_budgets(s, p), 0.2)


@query
def model_health(s, p):
    return cost.model_health(d.trace_log(s, p))


@query
def model_recoveries(s, p):
    return cost.model_recoveries(d.trace_log(s, p), datetime(2030, 1, 1, tzinfo=timezone.utc))


# --- quality ------------------------------------------------------------------------------------
@query
def quality_content_join(s, p):
    rows = quality.quality_content_join(d.quality_record(s, p), d.content_item(s, p))
    return rows.select("id", "item_id", "template_id", "source", "score")


@query
def content_quality_outer(s, p):
    return quality.content_quality_outer(d.content_item(s, p), d.quality_record(s, p))


@query
def content_quality_distinct(s, p):
    return quality.content_quality_outer(d.content_item(s, p), d.quality_record(s, p), distinct_items=True)


@query
def dashboard_by_template(s, p):
    return quality.dashboard_by_template(d.content_item(s, p), d.quality_record(s, p))


@query
def dashboard_kpis(s, p):
    calls = cost.attempt_number(d.trace_log(s, p))
    return dashboards.dashboard_kpis(
        d.content_item(s, p), d.quality_record(s, p), d.generation_task(s, p), calls
    )


@query
def quality_buckets(s, p):
    return quality.quality_buckets(d.quality_record(s, p), d.content_item(s, p))


def _means(s, p):
    return quality.judge_rounds_mean(d.judge_rounds(s, p), d.quality_templates(s, p))


@query
def judge_rounds_mean(s, p):
    rows = _means(s, p).select("item_id", "template_id", "error", F.explode("dimension_scores").alias("dim", "score"))
    return rows.withColumn("score", F.round("score", 4))


@query
def weighted_score(s, p):
    weights = quality.effective_weights(d.quality_templates(s, p), d.calibrations(s, p))
    scored = quality.weighted_score(_means(s, p), d.quality_templates(s, p), weights)
    return scored.select("item_id", "score")


@query
def qc_route(s, p):
    scored = quality.weighted_score(_means(s, p), d.quality_templates(s, p))
    items = d.content_item(s, p).select(F.col("id").alias("item_id"), "revise_count", "tenant_id")
    route = rules.qc_route(
        F.col("score"), F.lit(50.0), F.col("revise_count"), F.lit(3), F.col("tenant_id") != "t0", F.lit(10.0)
    )
    return scored.join(items, "item_id").select("item_id", "score", route.alias("route"))


@query
def latest_quality(s, p):
    return quality.latest_quality(d.quality_record(s, p)).select("item_id", "id", "source", "score")


@query
def effective_weights(s, p):
    rows = quality.effective_weights(d.quality_templates(s, p), d.calibrations(s, p))
    return rows.select("template_id", "threshold", "calibrated", F.explode("weights").alias("dim", "weight"))


@query
def recalibrated_weights(s, p):
    """Calibrate, append to the log, read the weights in force."""
    templates = d.quality_templates(s, p)
    rows = calibration.calibrate(d.quality_record(s, p), d.content_item(s, p), templates)
    log = d.calibrations(s, p).unionByName(as_table(rows, "quality_calibration", LOOP_AS_OF, ["template_id"]), allowMissingColumns=True)
    rows = quality.effective_weights(templates, log)
    return rows.select("template_id", "threshold", "calibrated", F.explode("weights").alias("dim", "weight"))


@query
def effective_weights_asof(s, p):
    records = quality.quality_content_join(d.quality_record(s, p), d.content_item(s, p))
    rows = quality.effective_weights_asof(
        records.select("id", "template_id", "score", "created_at"), d.calibrations(s, p)
    )
    return rows.select(
        "id", "template_id", "effective_threshold", F.col("effective_weights")["kp_match"].alias("kp_weight")
    )


@query
def judge_stability(s, p):
    return quality.judge_stability(d.single_and_multi_scores(s, p))


# --- calibration and agreement --------------------------------------------------------------------
def _pairs(s, p):
    return calibration.label_pairs(d.quality_record(s, p), d.content_item(s, p))


@query
def label_pairs(s, p):
    rows = _pairs(s, p)
    return rows.select("item_id", "template_id", "auto", "manual", rows.auto_dims["distractor"].alias("distractor"))


@query
def labelled_intersect(s, p):
    return calibration.labelled_intersect(d.quality_record(s, p))


@query
def false_pass_set(s, p):
    return calibration.false_pass_set(_pairs(s, p), d.quality_templates(s, p))


@query
def dim_union(s, p):
    observed = _pairs(s, p).select("template_id", F.explode("auto_dims").alias("dim", "score"))
    return calibration.dim_union(calibration.weights_long(d.quality_templates(s, p)), observed)


@query
def leniency(s, p):
    templates = d.quality_templates(s, p)
    return calibration.leniency(_pairs(s, p), templates, templates)


@query
def fit_weights(s, p):
    templates = d.quality_templates(s, p)
    return calibration.fit_weights(calibration.leniency(_pairs(s, p), templates, templates), templates)


@query
def fit_threshold(s, p):
    return calibration.fit_threshold(_pairs(s, p), d.quality_templates(s, p))


@query
def p10_rank(s, p):
    return calibration.p10_rank(d.trace_log(s, p), "latency_ms", "model")


@query
def calibrate(s, p):
    rows = calibration.calibrate(d.quality_record(s, p), d.content_item(s, p), d.quality_templates(s, p))
    return rows.select(
        "template_id", F.explode("weights").alias("dim", "weight"), "lenient", "default_weights", "threshold",
        "default_threshold", "sample_size", "false_pass_cnt", "rejection_rate", "note",
    ).withColumns({"lenient": F.col("lenient")[F.col("dim")], "default_weights": F.col("default_weights")[F.col("dim")]})


@query
def calibration_report(s, p):
    rows = dashboards.calibration_report(d.quality_record(s, p), d.content_item(s, p), d.quality_templates(s, p))
    return rows.select("template_id", "threshold", "n", "tp", "tn", "fp", "fn", "accuracy", "kappa")


@query
def confusion(s, p):
    return agreement.confusion(_pairs(s, p), by=["template_id"])


@query
def cohen_kappa(s, p):
    pairs = _pairs(s, p).select("template_id", F.floor(F.col("auto") / 25).alias("a"), F.floor(F.col("manual") / 25).alias("m"))
    return agreement.cohen_kappa(pairs, "m", "a", ["template_id"])


@query
def agreement_report(s, p):
    return agreement.agreement_report(_pairs(s, p))


# --- samples and corpus -----------------------------------------------------------------------------
@query
def sample_kp_join(s, p):
    rows = samples.sample_kp_join(d.content_item(s, p), d.generation_task(s, p))
    return rows.select("id", "task_id", "knowledge_point")


@query
def sample_sync(s, p):
    rows = samples.sample_sync(d.content_item(s, p), d.generation_task(s, p), d.sample_pool(s, p))
    return rows.withColumn("payload", F.sha2("payload", 256))


@query
def sync_counts(s, p):
    content, pool = d.content_item(s, p), d.sample_pool(s, p)
    fresh = samples.sample_sync(content, d.generation_task(s, p), pool)
    return samples.sync_counts(content, fresh, pool)


@query
def pool_after_sync(s, p):
    """Sync, append to the pool, pick few-shot samples from it."""
    pool = d.sample_pool(s, p)
    fresh = samples.sample_sync(d.content_item(s, p), d.generation_task(s, p), pool, purpose="fewshot")
    pool = pool.unionByName(as_table(fresh, "sample_pool", LOOP_AS_OF), allowMissingColumns=True)
    return samples.fewshot_topk(pool).select("id", "template_id", "knowledge_point", "rank")


@query
def fewshot_topk(s, p):
    rows = samples.fewshot_topk(d.sample_pool(s, p))
    return rows.select("id", "template_id", "knowledge_point", "rank")


def _documents(s, p):
    return d.table(s, p, "documents").select("doc_id", "text")


def _chunk_rows(rows):
    return rows.select("doc_id", "chunk_index", F.length("content").alias("chars"), F.sha2("content", 256).alias("digest"))


@query
def chunk_text(s, p):
    return _chunk_rows(knowledge.chunk_text(_documents(s, p)))


@query
def chunk_text_reference(s, p):
    return _chunk_rows(knowledge.chunk_text(_documents(s, p), mode="reference"))


def _letter_counts(texts):
    """A stand-in for a model: how many characters a text has, and how many of two of them."""
    return [(len(t), t.count("e"), t.count(" ")) for t in texts]


@query
def index_embedded(s, p):
    docs = d.table(s, p, "documents").select("doc_id", "text")
    rows = knowledge.index_documents(docs, embed=_letter_counts)
    number = lambda i: F.col("embedding")[i].cast("long")
    return rows.select("id", "doc_id", "chunk_index", number(0).alias("chars"), number(1).alias("letters"), number(2).alias("spaces"))


@query
def index_documents(s, p):
    vec = F.col("vec_id")
    vectors = d.table(s, p, "embeddings").select(
        F.floor(vec / 2).alias("doc_id"), (vec % 2).cast("int").alias("chunk_index"), "embedding"
    )
    docs = d.table(s, p, "documents").select(
        "doc_id", "text", F.col("source").alias("knowledge_point"),
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"),
    )
    rows = knowledge.index_documents(docs, vectors)
    return rows.select(
        "id", "doc_id", "chunk_index", "source_type", "source_name", "knowledge_point", "tenant_id",
        F.length("content").alias("chars"),
        F.col("embedding").isNotNull().alias("has_vector"),
    )


@query
def chunk_counts(s, p):
    return knowledge.chunk_counts(knowledge.chunk_text(_documents(s, p)))


@query
def knn_topk(s, p):
    vectors = d.knowledge_vectors(s, p)
    return nearest.knn_topk(vectors, vectors, 3, filter_cols=())


@query
def knn_topk_filtered(s, p):
    vectors = d.knowledge_vectors(s, p)
    return nearest.knn_topk(vectors, vectors, 3, filter_cols=["knowledge_point"], min_similarity=0.2)


@query
def cosine_distance(s, p):
    vectors = d.knowledge_vectors(s, p)
    means = vectors.groupBy("knowledge_point").agg(
        F.array(*(F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64))).alias("center")
    )
    rows = vectors.join(means, "knowledge_point")
    gap = F.round(vectors_distance(), 6)
    return rows.select("id", "knowledge_point", gap.alias("distance"))


def vectors_distance():
    return vectors.cosine_distance(F.col("embedding"), F.col("center"))


def _contexts(s, p):
    chunks = d.knowledge_vectors(s, p)
    hits = knowledge.with_content(nearest.knn_topk(chunks, chunks, 3, filter_cols=()), chunks)
    return knowledge.rag_context(hits)


@query
def rag_context(s, p):
    return _contexts(s, p)


@query
def render_prompts(s, p):
    turns = d.table(s, p, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    rows = knowledge.render_prompts(
        turns, "[{{role}} #{{turn}}] {{text}} {{missing}}", ["role", "turn", "text"], _contexts(s, p)
    )
    return rows.select("id", "turn", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("digest"))


# --- hygiene ----------------------------------------------------------------------------------------
def _redacted(docs: DataFrame, max_len: int | None) -> DataFrame:
    rows = docs.select("doc_id", "text", redaction.redact_text(F.col("text"), max_len).alias("r"))
    return rows.select(
        "doc_id", (F.col("r") != F.col("text")).alias("changed"), F.length("r").alias("chars"), F.sha2("r", 256).alias("digest")
    )


@query
def redact_text(s, p):
    return _redacted(_documents(s, p), None)


@query
def redact_text_cut(s, p):
    return _redacted(_documents(s, p), redaction.STORED_LENGTH)


@query
def redact_json(s, p):
    doc = F.to_json(
        F.struct(
            F.struct(F.col("source").alias("llm-api-key"), F.array(F.struct(F.col("lang").alias("password"))).alias("nested"))
            .alias("config"),
            F.struct(F.col("text").alias("body"), F.col("n_chars").alias("token_count")).alias("payload"),
        )
    )
    out = redaction.redact_json(doc)
    field = lambda path: F.get_json_object(out, path)
    rows = d.table(s, p, "documents").select("doc_id", out.alias("r"))
    out = F.col("r")
    return rows.select(
        "doc_id",
        field("$.config.llm-api-key").alias("api_key"),
        field("$.config.nested[0].password").alias("password"),
        field("$.payload.token_count").cast("bigint").alias("token_count"),
        F.sha2(field("$.payload.body"), 256).alias("digest"),
    )


@query
def redact_map(s, p):
    pairs = F.create_map(F.lit("refresh-token"), F.col("lang"), F.lit("note"), F.col("text"))
    out = redaction.redact_map(pairs)
    return d.table(s, p, "documents").select(
        "doc_id", out["refresh-token"].alias("token"), F.sha2(out["note"], 256).alias("digest")
    )


@query
def secret_scan(s, p):
    return hygiene.secret_scan(_documents(s, p))


def _event_json():
    k = F.get_json_object("props", "$.k")
    parts = [F.lit('{ "z": '), k, F.lit(', "kind": "'), F.col("event_type"), F.lit('", "a": {"y": [2, 1], "b": '),
             (F.col("user_id") % 5).cast("string"), F.lit("}}")]
    return F.concat(*parts)


@query
def canonical_json(s, p):
    events = d.table(s, p, "events")
    return events.select("event_id", jsons.canonical_json(_event_json()).alias("canonical"))


@query
def canonical_json_exact(s, p):
    events = d.table(s, p, "events")
    return events.select("event_id", jsons.canonical_json(_event_json(), exact=True).alias("canonical"))


@query
def config_hash(s, p):
    events = d.table(s, p, "events").select(jsons.config_hash(_event_json()).alias("config_hash"))
    return events.groupBy("config_hash").agg(F.count("*").alias("rows"))


def _fingerprint(exact=False):
    return jsons.request_fingerprint(F.col("event_type"), F.col("props"), F.lit("v1"), exact)


@query
def request_fingerprint(s, p):
    events = d.table(s, p, "events")
    return events.groupBy(_fingerprint().alias("request_hash")).agg(F.count("*").alias("requests"))


@query
def request_fingerprint_exact(s, p):
    events = d.table(s, p, "events")
    return events.groupBy(_fingerprint(True).alias("request_hash")).agg(F.count("*").alias("requests"))


@query
def active_duplicates(s, p):
    params = F.to_json(F.struct(F.col("o_custkey").alias("c")))
    digest = jsons.request_fingerprint(F.col("o_orderpriority"), params)
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "pending")
    orders = d.table(s, p, "orders").select(
        F.col("o_orderkey").alias("id"), digest.alias("request_hash"), F.coalesce(status, F.lit("succeeded")).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    done = orders.filter("status = 'succeeded'").select("id", "request_hash", "created_at")
    return hygiene.active_duplicates(done, orders).select("id", "request_hash")


@query
def first_of_batch(s, p):
    events = d.table(s, p, "events").select(
        F.col("event_id").alias("id"), _fingerprint().alias("request_hash"), F.col("ts").cast("timestamp").alias("created_at")
    )
    return hygiene.first_of_batch(events)


@query
def validate_payload(s, p):
    rows = validate.validate_payload(d.payloads(s, p), "payload", d.PAYLOAD_SCHEMA)
    return rows.select("id", F.explode("violations").alias("v")).select("id", "v.path", "v.keyword", "v.input")


@query
def validate_by_template(s, p):
    rows = d.payloads(s, p).withColumn("template_id", F.concat(F.lit("tpl_"), (F.col("id").cast("long") % 3).cast("string")))
    schemas = (d.PAYLOAD_SCHEMA, {"type": "object", "required": ["result"]}, d.LEVEL_SCHEMA)
    texts = F.array(*(F.struct(F.lit(f"tpl_{i}").alias("template_id"), F.lit(json.dumps(x)).alias("output_schema")) for i, x in enumerate(schemas)))
    found = validate.validate_by_template(rows, "payload", s.range(1).select(F.inline(texts)))
    return found.select("id", "template_id", F.explode("violations").alias("v")).select("id", "template_id", "v.path", "v.keyword", "v.input")


@query
def validate_params(s, p):
    rows = validate.validate_params(d.generation_task(s, p), "params", d.PARAMS_SCHEMA)
    return rows.select("id", "valid", "field_path", "validation_keyword")


@query
def has_required(s, p):
    rows = validate.has_required(d.payloads(s, p), "payload", ["stem", "answer"])
    return rows.select("id", "valid")


@query
def error_summary(s, p):
    rows = validate.validate_payload(d.payloads(s, p), "payload", d.PAYLOAD_SCHEMA)
    return rows.filter("not valid").select("id", validate.error_summary(F.col("violations"), 1, 12).alias("summary"))


@query
def unwrap_payload(s, p):
    return d.payloads(s, p).select("id", jsons.unwrap_payload(F.col("payload"), ["options", "answer"]).alias("payload"))


# --- governance --------------------------------------------------------------------------------------
@query
def validate_templates(s, p):
    return governance.validate_templates(d.question_template(s, p))


@query
def model_ref_integrity(s, p):
    return governance.model_ref_integrity(d.question_template(s, p), d.model_profile(s, p))


@query
def missing_refs(s, p):
    return governance.missing_refs(governance.referenced_profiles(d.question_template(s, p)), d.model_profile(s, p))


@query
def profile_resolution(s, p):
    tier = F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("l_orderkey") % 3).cast("int"))
    requests = d.table(s, p, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("request_id"),
        F.concat(F.lit("tpl_"), F.col("l_partkey").cast("string")).alias("template_id"),
        tier.alias("difficulty"),
    )
    return governance.profile_resolution(
        requests, d.question_template(s, p), d.model_profile(s, p), datetime(2024, 1, 1, tzinfo=timezone.utc)
    )


@query
def default_uniqueness(s, p):
    return governance.default_uniqueness(d.model_profile(s, p)).select("name", "is_default")


@query
def template_hash(s, p):
    return governance.template_hash(d.question_template(s, p)).select("type_id", "template_hash", "prompt_hash")


@query
def profile_hash(s, p):
    return governance.profile_hash(d.model_profile(s, p)).select("name", "model_hash")


@query
def version_snapshot(s, p):
    rows = governance.version_snapshot(d.question_template(s, p), d.model_profile(s, p))
    field = lambda path: F.get_json_object("snapshot", path)
    return rows.select(
        "type_id", field("$.template_hash").alias("template_hash"), field("$.model.name").alias("model"),
        field("$.version").cast("int").alias("version"), field("$.run_config.max_retry").cast("int").alias("max_retry"),
    )


@query
def quality_snapshot(s, p):
    rows = governance.quality_snapshot(d.question_template(s, p))
    field = lambda path: F.get_json_object("snapshot", path)
    return rows.select(
        "type_id", field("$.template_hash").alias("template_hash"), field("$.model_name").alias("model_name"),
        field("$.threshold").cast("double").alias("threshold"),
        field("$.weights.kp_match").cast("double").alias("kp_weight"),
    )


@query
def template_defaults(s, p):
    rows = quality.template_defaults(d.question_template(s, p))
    return rows.select("template_id", "threshold", F.explode("weights").alias("dim", "weight"))


@query
def config_change_log(s, p):
    return governance.config_change_log(d.config_snapshots(s, p))


# --- life cycle ---------------------------------------------------------------------------------------
@query
def task_status_pivot(s, p):
    return lifecycle.task_status_pivot(d.generation_task(s, p))


@query
def content_status_pivot(s, p):
    return lifecycle.content_status_pivot(d.content_item(s, p))


@query
def task_latency(s, p):
    return lifecycle.task_latency(d.generation_task(s, p), 100)


@query
def task_progress(s, p):
    return lifecycle.task_progress(d.generation_task(s, p), d.generation_task_item(s, p))


@query
def terminal_report(s, p):
    return lifecycle.terminal_report(d.generation_task(s, p), TASKS_AS_OF)


@query
def failure_codes(s, p):
    return lifecycle.failure_codes(d.generation_task_item(s, p))


@query
def failure_class(s, p):
    items = d.generation_task_item(s, p).filter("status = 'failed'")
    return items.groupBy("failure_reason", rules.failure_class(F.col("failure_reason")).alias("failure_code")).agg(
        F.count("*").alias("items")
    )


@query
def thread_parse(s, p):
    items = d.generation_task_item(s, p).select(rules.thread_parse(F.col("thread_id")).alias("t"))
    return items.groupBy("t.task_id").agg(F.count("*").alias("items"), F.sum("t.item_index").alias("index_sum"))


@query
def backoff_schedule(s, p):
    return lifecycle.backoff_schedule(d.task_outbox(s, p), TASKS_AS_OF)


@query
def outbox_health(s, p):
    return lifecycle.outbox_health(d.task_outbox(s, p), TASKS_AS_OF)


@query
def outbox_due(s, p):
    return lifecycle.outbox_due(d.task_outbox(s, p), TASKS_AS_OF)


@query
def stale_tasks(s, p):
    return lifecycle.stale_tasks(d.generation_task(s, p), TASKS_AS_OF).select("id", "updated_at")


@query
def pending_age(s, p):
    return lifecycle.pending_age(d.generation_task(s, p), TASKS_AS_OF)


@query
def notifications(s, p):
    existing = d.task_outbox(s, p).filter("status = 'sent'").select(
        F.concat(F.lit("task:"), F.col("task_id"), F.lit(":result")).alias("event_id")
    )
    return lifecycle.notifications(
        d.generation_task(s, p), d.quality_record(s, p), d.content_item(s, p), existing
    )


@query
def lifecycle_events(s, p):
    return lifecycle.lifecycle_events(d.lifecycle_log(s, p))


@query
def lifecycle_durations(s, p):
    return lifecycle.lifecycle_durations(d.lifecycle_log(s, p))


@query
def transition_audit(s, p):
    return lifecycle.transition_audit(d.status_log(s, p), CONTENT_MOVES)


# --- batch forms of sources, sinks and streams ---------------------------------------------------------
@query
def clean_calls(s, p):
    rows = jobs.clean_calls(d.trace_log(s, p), d.model_prices(s, p))
    return rows.select("id", "cost", "output_data")


@query
def cost_windows(s, p):
    return jobs.st_cost_windows(d.trace_log(s, p))


@query
def export_lines(s, p):
    return sinks.export_lines(sinks.export_rows(d.sample_pool(s, p))).select(F.sha2("value", 256).alias("digest"))


@query
def screen_documents(s, p):
    """The documents as text files (`.MD` for French ones) beside the web pages, whose kind is not taken."""
    kind = F.when(F.col("lang") == "fr", ".MD").otherwise(".txt")
    texts = d.table(s, p, "documents").select(F.concat(F.lit("/in/doc%20"), F.col("doc_id").cast("string"), kind).alias("path"), F.col("text"))
    pages = d.table(s, p, "pages").select(F.concat(F.lit("/in/page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    files = texts.unionByName(pages).select("path", F.octet_length("text").cast("bigint").alias("length"), F.encode("text", "utf-8").alias("content"))
    ok, rejected = documents.screen_documents(files)
    ok = ok.select("path", "source_name", "length", F.lit("ok").alias("reason"), F.sha2("text", 256).alias("digest"))
    return ok.unionByName(rejected.withColumn("digest", F.lit(None).cast("string")))
