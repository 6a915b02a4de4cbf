"""Typed schemas of the thirteen analytic tables and the status vocabularies."""

from __future__ import annotations

SCORES = "map<string,double>"
RULES = "array<struct<id:string,weight:double,description:string,rubric:map<string,string>>>"

TABLES: dict[str, str] = {
    "question_template": f"""id string, type_id string, name string, version int, template_hash string,
        prompt_hash string, skill_hash string, input_schema string, output_schema string,
        quality_rules {RULES}, gen_prompt string, run_config string, status string,
        tenant_id string, created_by string, created_at timestamp, updated_at timestamp""",
    "generation_task": """id string, template_id string, params string, request_hash string, quantity int,
        status string, progress double, trace_ref string, user_id string, tenant_id string,
        result_summary string, version_snapshot string, cancel_requested_at timestamp,
        created_at timestamp, updated_at timestamp""",
    "generation_task_item": """id string, task_id string, item_index int, thread_id string, status string,
        content_id string, failure_code string, failure_reason string, attempts int,
        started_at timestamp, finished_at timestamp, tenant_id string, created_at timestamp,
        updated_at timestamp""",
    "task_outbox": """id string, event_id string, task_id string, item_id string, event_type string,
        payload string, status string, attempts int, available_at timestamp, last_error string,
        sent_at timestamp, tenant_id string, created_at timestamp, updated_at timestamp""",
    "content_item": """id string, task_id string, template_id string, payload string, qc_score double,
        status string, revise_count int, cost double, thread_id string, tenant_id string,
        failure_code string, failure_reason string, published_by string, published_at timestamp,
        created_at timestamp, updated_at timestamp""",
    "quality_record": f"""id string, item_id string, score double, dimension_scores {SCORES},
        source string, reviewer string, reason string, template_version int, config_snapshot string,
        tenant_id string, created_at timestamp""",
    "model_profile": """id string, name string, provider string, model_name string, model_hash string,
        cost_tier string, is_default boolean, status string, health_status string, failure_count int,
        cooldown_until timestamp, last_health_check_at timestamp, max_fallbacks int,
        budget_per_task double, tenant_id string, created_at timestamp""",
    "trace_log": """id string, item_id string, template_id string, task_id string, trace_id string,
        prompt_version string, model string, input_data string, output_data string, latency_ms double,
        cost double, stage string, prompt_tokens int, completion_tokens int, attempt int,
        success boolean, tenant_id string, created_at timestamp""",
    "app_notification": """id string, type string, title string, content string, related_id string,
        event_id string, is_read boolean, tenant_id string, created_at timestamp""",
    "config_audit_event": """id string, entity_type string, entity_id string, action string,
        actor_id string, tenant_id string, before_snapshot string, after_snapshot string,
        created_at timestamp""",
    "sample_pool": """id string, item_id string, template_id string, source string, purpose string,
        knowledge_point string, payload string, meta string, tenant_id string, created_at timestamp""",
    "quality_calibration": f"""id string, template_id string, weights {SCORES}, threshold double,
        default_weights {SCORES}, default_threshold double, sample_size int, false_pass_cnt int,
        lenient {SCORES}, rejection_rate double, note string, tenant_id string, created_at timestamp""",
    "knowledge_chunk": """id string, source_type string, source_name string, knowledge_point string,
        content string, embedding array<float>, meta string, tenant_id string, created_at timestamp""",
}

# Status vocabularies shared by every producer of these tables.
TASK_ACTIVE = ("pending", "dispatched", "running", "awaiting_review")
TASK_TERMINAL = ("succeeded", "partially_succeeded", "failed", "cancelled")
TASK_STATUSES = TASK_ACTIVE + TASK_TERMINAL
CONTENT_STATUSES = ("pending_qc", "passed", "rejected", "published", "awaiting_review")
ELIGIBLE_STATUSES = ("passed", "published")
CONTENT_MOVES = (
    ("pending_qc", "passed"),
    ("pending_qc", "rejected"),
    ("pending_qc", "awaiting_review"),
    ("awaiting_review", "passed"),
    ("awaiting_review", "rejected"),
    ("passed", "published"),
)

# Defaults of the producing service.
FLAT_PRICE_PER_1K = 0.002
QUALITY_THRESHOLD = 70.0
GRAY_MARGIN = 10.0
MAX_REVISE = 3
STALE_TASK_SECONDS = 1800
SENDING_TIMEOUT_SECONDS = 300
BACKOFF_BASE_SECONDS = 5
OUTBOX_MAX_ATTEMPTS = 5
FAILURE_THRESHOLD = 2
COOLDOWN_SECONDS = 60
