"""The registered queries once more, as plain SQL over the driver's tables."""

from __future__ import annotations

from ..functions.redaction import BEARER, KEY_VALUE
from ..operators.calibration import NOTE_DONE, NOTE_SHORT
from ..operators.knowledge import CONTEXT_HEADING
from ..operators.lifecycle import REJECTED_NOTICE, REVIEW_NOTICE, TASK_NOTICES
from ..operators.validate import SUMMARY_LINE, SUMMARY_MORE

_EPOCH = "TIMESTAMP '2024-01-01'"

CTES = {
    "calls": """
        SELECT event_id AS id, user_id::varchar || ':' || ts::date::varchar AS trace_id,
            user_id::varchar AS item_id,
            CASE WHEN user_id % 5 <> 0 THEN 'tpl_' || (user_id % 3) END AS template_id,
            'task_' || (user_id % 20) AS task_id, 't' || (user_id % 3) AS tenant_id,
            'model_' || (user_id % 4) AS model,
            CASE WHEN event_type IN ('view', 'click', 'error') THEN 'generate'
                 WHEN event_type = 'purchase' THEN 'qc'
                 WHEN event_type = 'signup' AND user_id % 7 <> 0 THEN 'embedding' END AS stage,
            event_type <> 'error' AS success,
            json_extract_string(props, '$.k')::int * 10 AS prompt_tokens,
            floor(value)::int AS completion_tokens, value AS latency_ms,
            round((json_extract_string(props, '$.k')::int * 10)::double / 1000 * 0.002::double
                + floor(value)::int::double / 1000 * 0.002::double, 6) AS cost,
            user_id % 2 = 0 AS scored, ts AS created_at
        FROM events""",
    "content": f"""
        SELECT doc_id, doc_id::varchar AS id, 'task_' || (doc_id % 20) AS task_id, lang AS template_id,
            text AS payload, (n_chars % 101)::double AS qc_score,
            list_extract(['pending_qc', 'passed', 'rejected', 'published', 'awaiting_review'],
                (doc_id % 5 + 1)::int) AS status,
            (doc_id % 4)::int AS revise_count,
            round(n_chars::double / 1000 * 0.002::double, 6) AS cost, 't' || (doc_id % 3) AS tenant_id,
            CASE WHEN doc_id % 5 = 3 THEN {_EPOCH} + to_minutes(doc_id + 30) END AS published_at
        FROM documents""",
    "records": f"""
        SELECT d.doc_id, d.lang, d.doc_id::varchar || ':' || s.source AS id, d.doc_id::varchar AS item_id, s.source,
            CASE WHEN s.source = 'manual_review' THEN l.quality * 100 ELSE d.n_chars % 101 END::double AS score,
            ((d.n_chars * 3 + 7) % 101)::double AS kp_match, ((d.n_chars * 5 + 11) % 101)::double AS diff_match,
            ((d.doc_id * 7) % 101)::double AS distractor, ((d.n_chars + d.doc_id) % 101)::double AS unambiguous,
            CASE WHEN s.source = 'manual_review' THEN 'r' || (d.doc_id % 3) END AS reviewer,
            CASE WHEN s.source = 'manual_review' AND l.quality = 0 THEN 'reason_' || (d.doc_id % 4) END AS reason,
            (d.doc_id % 2 + 1)::int AS template_version,
            CASE WHEN d.doc_id % 4 = 0 THEN '{{}}' ELSE '{{"threshold":70}}' END AS config_snapshot,
            't' || (d.doc_id % 3) AS tenant_id,
            {_EPOCH} + to_minutes(d.doc_id + (s.source = 'manual_review')::int) AS created_at
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id,
            (VALUES ('auto'), ('manual_review')) s(source)""",
    "pairs": """
        SELECT d.doc_id::varchar AS item_id, d.lang AS template_id, (d.n_chars % 101)::double AS auto,
            (l.quality * 100)::double AS manual, ((d.n_chars * 3 + 7) % 101)::double AS kp_match,
            ((d.n_chars * 5 + 11) % 101)::double AS diff_match, ((d.doc_id * 7) % 101)::double AS distractor,
            ((d.n_chars + d.doc_id) % 101)::double AS unambiguous
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "dims": """
        SELECT item_id, template_id, auto, manual, u.dim,
            CASE u.dim WHEN 'kp_match' THEN kp_match WHEN 'diff_match' THEN diff_match
                WHEN 'distractor' THEN distractor ELSE unambiguous END AS score
        FROM pairs, (VALUES ('kp_match'), ('diff_match'), ('distractor'), ('unambiguous')) u(dim)""",
    "weights": """
        SELECT l.lang AS template_id, w.dim, w.weight::double AS weight
        FROM (SELECT DISTINCT lang FROM documents) l,
            (VALUES ('kp_match', 0.3), ('diff_match', 0.2), ('distractor', 0.3), ('unambiguous', 0.2)) w(dim, weight)""",
    "lenient": """
        SELECT w.template_id, w.dim, w.weight,
            coalesce(round(avg(CASE WHEN d.manual = 0 AND d.auto >= 70 THEN d.score END)
                - avg(CASE WHEN d.manual <> 0 THEN d.score END), 2), 0.0) AS lenient
        FROM weights w LEFT JOIN dims d ON d.template_id = w.template_id AND d.dim = w.dim
        GROUP BY ALL""",
    "fitted": """
        SELECT template_id, dim, default_weight, lenient,
            CASE WHEN worst > 0 THEN round(kept / sum(kept) OVER (PARTITION BY template_id), 4)
                ELSE default_weight END AS weight
        FROM (SELECT *, greatest(raw, avg(raw) OVER (PARTITION BY template_id) * 0.05::double) AS kept
            FROM (SELECT template_id, dim, weight AS default_weight, lenient,
                    max(lenient) OVER (PARTITION BY template_id) AS worst,
                    weight * (1 - CASE WHEN max(lenient) OVER (PARTITION BY template_id) > 0
                        THEN greatest(lenient, 0) / max(lenient) OVER (PARTITION BY template_id) ELSE 0 END) AS raw
                FROM lenient))""",
    "falsepass": """
        SELECT template_id, count(*) AS sample_size, count(*) FILTER (manual = 0) AS rejected,
            count(*) FILTER (manual = 0 AND auto >= 70) AS false_pass_cnt,
            round(count(*) FILTER (manual = 0) / count(*), 4) AS rejection_rate
        FROM pairs GROUP BY template_id""",
    "passmeans": """
        SELECT template_id, m, row_number() OVER (PARTITION BY template_id ORDER BY m) AS rn,
            count(*) OVER (PARTITION BY template_id) AS n
        FROM (SELECT template_id, (kp_match + diff_match + distractor + unambiguous) / 4 AS m
            FROM pairs WHERE manual <> 0)""",
    "limits": """
        SELECT l.template_id, 70.0::double AS default_threshold, f.rejection_rate, p.m AS p10_dim_mean,
            CASE WHEN f.rejection_rate > 0.05 THEN greatest(70.0::double, round(p.m, 1)) ELSE 70.0::double END AS threshold
        FROM (SELECT DISTINCT lang AS template_id FROM documents) l
        LEFT JOIN falsepass f ON f.template_id = l.template_id
        LEFT JOIN passmeans p ON p.template_id = l.template_id AND p.rn = p.n // 10 + 1""",
    "fits": """
        SELECT l.template_id, coalesce(f.sample_size, 0) >= 20 AND coalesce(f.false_pass_cnt, 0) >= 5 AS enough,
            CASE WHEN coalesce(f.sample_size, 0) >= 20 AND coalesce(f.false_pass_cnt, 0) >= 5
                THEN l.threshold ELSE 70.0::double END AS threshold,
            coalesce(f.sample_size, 0)::int AS sample_size, coalesce(f.false_pass_cnt, 0)::int AS false_pass_cnt,
            coalesce(f.rejection_rate, 0.0) AS rejection_rate
        FROM limits l LEFT JOIN falsepass f ON f.template_id = l.template_id""",
    "calibrations": f"""
        SELECT d.doc_id::varchar AS id, d.lang AS template_id, (d.doc_id % 10)::double / 10 AS kp,
            1 - (d.doc_id % 10)::double / 10 AS distractor, 60.0::double + d.doc_id % 20 AS threshold,
            {_EPOCH} + to_minutes(d.doc_id) AS created_at
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0""",
    "means": """
        SELECT d.doc_id::varchar AS item_id, d.lang AS template_id, u.dim, avg(CASE u.dim
                WHEN 'kp_match' THEN (d.n_chars * (r.r + 1)) % 101
                WHEN 'diff_match' THEN (d.doc_id * (r.r + 2)) % 101
                ELSE CASE WHEN (d.doc_id + r.r) % 5 <> 0 THEN (d.n_chars + d.doc_id * r.r) % 101 END END) AS score
        FROM documents d, range(3) r(r), (VALUES ('kp_match'), ('diff_match'), ('distractor')) u(dim)
        GROUP BY ALL HAVING score IS NOT NULL""",
    "tasks": """
        SELECT 'task_' || o_orderkey AS id, o_orderkey, o_orderpriority AS template_id,
            CASE WHEN o_custkey % 10 <> 0 THEN 'kp_' || (o_custkey % 10) END AS kp,
            list_extract(['easy', 'medium', 'hard'], (o_orderkey % 3 + 1)::int) AS difficulty,
            o_custkey % 8 AS options_count, (o_custkey % 5 + 1)::int AS quantity,
            CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'succeeded' END AS status,
            't' || (o_custkey % 3) AS tenant_id, o_orderdate AS created_at,
            o_orderdate + to_seconds(floor(o_totalprice)::bigint) AS updated_at
        FROM orders""",
    "items": """
        SELECT 'task_' || l_orderkey AS task_id, l_linenumber AS item_index,
            CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded'
                WHEN l_linestatus = 'O' THEN 'awaiting_review' ELSE 'cancelled' END AS status,
            CASE WHEN l_returnflag = 'R' THEN list_extract(['422 Unprocessable Entity', '429 rate limit',
                '503 unavailable', 'socket closed'], l_linenumber % 4 + 1) END AS failure_reason,
            l_linenumber % 5 AS attempts
        FROM lineitem""",
    "outbox": """
        SELECT 'task:' || o_orderkey || ':dispatch' AS event_id, 'task_' || o_orderkey AS task_id,
            list_extract(['pending', 'sending', 'sent', 'pending', 'dead'], (o_custkey % 5 + 1)::int) AS status,
            (o_custkey % 6 + 1)::int AS attempts, o_orderdate + to_seconds(o_custkey % 100000) AS available_at,
            o_orderdate AS created_at, o_orderdate + to_seconds(o_custkey % 600) AS updated_at
        FROM orders""",
    "profiles": f"""
        SELECT s_suppkey, 'profile_' || s_suppkey AS name, 'provider_' || s_nationkey AS provider,
            lower(s_name) AS model_name, CASE WHEN s_acctbal > 5000 THEN 'premium' ELSE 'standard' END AS cost_tier,
            s_suppkey % 7 = 0 AS is_default,
            CASE WHEN s_acctbal < 0 THEN 'disabled' ELSE 'enabled' END AS status,
            CASE WHEN s_suppkey % 4 = 1 THEN {_EPOCH} + to_hours((s_suppkey % 3 - 1)::int) END AS cooldown_until,
            (s_suppkey % 3)::int AS max_fallbacks,
            CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 5)::double / 10 END AS budget_per_task
        FROM supplier""",
    "templates": """
        SELECT 'tpl_' || p_partkey AS type_id, p_partkey AS k, p_size AS size, p_name AS name,
            CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 4)::int END AS version,
            CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN ['profile_' || (p_partkey % 150)]
                ELSE ['profile_' || p_size, 'profile_' || (p_partkey % 130), 'profile_' || (p_size + 60)] END AS refs,
            CASE WHEN p_partkey % 29 = 0 THEN 'archived' WHEN p_partkey % 5 = 0 THEN 'disabled'
                ELSE 'enabled' END AS status
        FROM part""",
    "hashes": """
        SELECT type_id, k, version, refs, sha256('{"gen_prompt":' || gen || ',"input_schema":' || input
            || ',"output_schema":{"required":["stem"],"type":"object"},"quality_rules":[' || rules
            || '],"run_config":' || run || ',"type_id":"' || type_id || '","version":'
            || coalesce(version::varchar, 'null') || '}') AS template_hash, sha256(gen) AS prompt_hash
        FROM (SELECT *, CASE WHEN k % 23 = 0 THEN '{"user":"u.st"}' ELSE '{"system":"s.st","user":"u.st"}' END AS gen,
                CASE WHEN k % 19 = 0 THEN '{"type":"string"}' ELSE '{"type":"object"}' END AS input,
                CASE WHEN refs IS NULL THEN '{"max_retry":3}'
                    WHEN len(refs) = 1 THEN '{"model_profile":"' || refs[1] || '"}'
                    ELSE '{"model_profile":{"default":"' || refs[1] || '","easy":"' || refs[2]
                        || '","hard":"' || refs[3] || '"}}' END AS run,
                '{"id":' || CASE WHEN k % 13 = 0 THEN 'null' ELSE '"kp_match"' END || ',"weight":'
                    || CASE WHEN size % 10 = 0 THEN '0.4' ELSE '0.3' END || '},{"id":'
                    || CASE WHEN k % 13 = 1 THEN 'null' ELSE '"diff_match"' END || ',"weight":0.2},{"id":'
                    || CASE WHEN k % 13 = 2 THEN 'null' ELSE '"distractor"' END || ',"weight":0.3},{"id":'
                    || CASE WHEN k % 13 = 3 THEN 'null' ELSE '"unambiguous"' END || ',"weight":0.2}' AS rules
            FROM templates)""",
    "saves": """
        SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'model_profile' ELSE 'question_template' END AS entity_type,
            user_id::varchar AS entity_id, 't' || (user_id % 3) AS tenant_id, ts AS created_at,
            '{"version":' || (json_extract_string(props, '$.k')::int % 4) || ',"alpha":"' || event_type || '"}' AS snapshot
        FROM events""",
    "changes": """
        SELECT id, entity_type, entity_id, tenant_id, CASE WHEN n = 1 THEN 'create'
                WHEN entity_type = 'question_template' THEN 'sync' ELSE 'update' END AS action,
            prev AS before_snapshot, snapshot AS after_snapshot, epoch_us(created_at) AS created_at
        FROM (SELECT *, lag(snapshot) OVER w AS prev, row_number() OVER w AS n FROM saves
            WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY created_at, id))
        WHERE n = 1 OR prev <> snapshot""",
    "pool": f"""
        SELECT d.doc_id, d.doc_id::varchar AS id, d.lang AS template_id,
            CASE WHEN d.doc_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS source,
            CASE WHEN d.doc_id % 3 = 0 THEN 'fewshot' ELSE 'sft' END AS purpose,
            CASE WHEN d.doc_id % 4 <> 0 THEN 'kp_' || (d.doc_id % 4) END AS knowledge_point,
            {_EPOCH} + to_minutes(d.doc_id) AS created_at
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1""",
    "prices": """
        SELECT 'model_' || s_suppkey AS model, (s_nationkey + 1)::double / 10000 AS prompt,
            CASE WHEN s_suppkey % 2 = 0 THEN (s_nationkey + 2)::double / 5000 END AS completion
        FROM supplier""",
    "priced": """
        SELECT c.*, coalesce(p.prompt, 0.002::double) AS prompt_rate,
            coalesce(p.completion, 0.002::double) AS completion_rate
        FROM calls c LEFT JOIN prices p ON p.model = c.model""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY trace_id, stage ORDER BY created_at, id) AS attempt FROM calls""",
    "threads": """
        SELECT template_id, trace_id, min(CASE WHEN success THEN attempt END) AS won
        FROM numbered WHERE stage = 'generate' GROUP BY ALL""",
    "knn": """
        SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)
                AS rank, same
        FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label = c.label AS same,
                round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) AS similarity
            FROM embeddings q, embeddings c)""",
    "contexts": """
        SELECT query_id, string_agg('chunk ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS context
        FROM knn WHERE rank <= 3 GROUP BY query_id""",
    "payloads": """
        SELECT k AS id, k, size, p_name, stem, ans, n_opts, CASE WHEN k % 13 = 0 THEN 'not json'
                WHEN k % 6 = 0 THEN '{"result":' || body || '}'
                WHEN k % 6 = 1 THEN '{"items":[{"x":1},' || body || ']}' ELSE body END AS payload, body
        FROM (SELECT p_partkey AS k, p_size AS size, p_name, p_size % 7 AS n_opts,
                CASE WHEN p_partkey % 10 = 0 THEN '7' ELSE '"' || substr('ABCDEFGH', (p_partkey % 8 + 1)::int, 1) || '"'
                    END AS ans,
                CASE WHEN p_partkey % 9 <> 0 THEN '"stem":"' || p_name || '",' ELSE '' END AS stem,
                '{' || CASE WHEN p_partkey % 9 <> 0 THEN '"stem":"' || p_name || '",' ELSE '' END
                    || '"options":[' || rtrim(repeat('"o' || (p_partkey % 7) || '",', p_size % 7), ',') || '],"answer":'
                    || CASE WHEN p_partkey % 10 = 0 THEN '7'
                        ELSE '"' || substr('ABCDEFGH', (p_partkey % 8 + 1)::int, 1) || '"' END
                    || ',"meta":{"level":' || (p_size % 12) || '}}' AS body
            FROM part)""",
    "found": """
        SELECT id, 1 AS n, '' AS path, 'json' AS keyword, payload AS input FROM payloads WHERE k % 13 = 0
        UNION ALL SELECT id, 2, f, 'required', '{"' || CASE WHEN k % 6 = 0 THEN 'result":' || sorted || '}'
                ELSE 'items":[{"x":1},' || sorted || ']}' END
            FROM shapes, (VALUES ('stem'), ('options'), ('answer')) r(f) WHERE k % 13 <> 0 AND k % 6 < 2
        UNION ALL SELECT id, 2, 'stem', 'required', sorted FROM shapes WHERE plain AND k % 9 = 0
        UNION ALL SELECT id, 2, 'stem', CASE WHEN length(p_name) < 10 THEN 'minLength' ELSE 'maxLength' END,
            '"' || p_name || '"' FROM shapes WHERE plain AND k % 9 <> 0 AND length(p_name) NOT BETWEEN 10 AND 14
        UNION ALL SELECT id, 3, 'options', CASE WHEN n_opts < 2 THEN 'minItems' ELSE 'maxItems' END, opts
            FROM shapes WHERE plain AND n_opts NOT BETWEEN 2 AND 4
        UNION ALL SELECT id, 4, 'answer', 'type', ans FROM shapes WHERE plain AND k % 10 = 0
        UNION ALL SELECT id, 5, 'answer', 'enum', ans FROM shapes
            WHERE plain AND ans NOT IN ('"A"', '"B"', '"C"', '"D"')
        UNION ALL SELECT id, 6, 'meta.level', CASE WHEN size % 12 < 1 THEN 'minimum' ELSE 'maximum' END,
            (size % 12)::varchar FROM shapes WHERE plain AND size % 12 NOT BETWEEN 1 AND 10""",
    "shapes": """
        SELECT *, k % 13 <> 0 AND k % 6 >= 2 AS plain,
            '[' || rtrim(repeat('"o' || (k % 7) || '",', n_opts), ',') || ']' AS opts,
            '{"answer":' || ans || ',"meta":{"level":' || (size % 12) || '},"options":['
                || rtrim(repeat('"o' || (k % 7) || '",', n_opts), ',') || ']'
                || CASE WHEN k % 9 <> 0 THEN ',"stem":"' || p_name || '"' ELSE '' END || '}' AS sorted
        FROM payloads""",
    "lifecycle": """
        SELECT event_id AS id, user_id::varchar || ':' || ts::date::varchar AS trace_id, 'workflow' AS stage,
            CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'finished'
                WHEN 'error' THEN 'failed' ELSE 'resume' END AS event,
            CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' END AS status,
            CASE event_type WHEN 'error' THEN '503 unavailable' END AS reason, event_type <> 'error' AS success, ts
        FROM events""",
    "eventjson": """
        SELECT event_id, '{"a":{"b":' || (user_id % 5) || ',"y":[2,1]},"kind":"' || event_type || '","z":'
            || json_extract_string(props, '$.k') || '}' AS canonical
        FROM events""",
}

# which derivations a derivation reads
_USES = {
    "dims": ["pairs"], "lenient": ["weights", "dims"], "fitted": ["lenient"], "falsepass": ["pairs"],
    "passmeans": ["pairs"], "limits": ["falsepass", "passmeans"], "fits": ["limits", "falsepass"],
    "hashes": ["templates"], "changes": ["saves"], "priced": ["calls", "prices"], "numbered": ["calls"],
    "threads": ["numbered"], "contexts": ["knn"], "shapes": ["payloads"], "found": ["shapes"],
}

SQL: dict[str, str] = {}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for need in _closure(_USES.get(name, [])) + [name]:
            if need not in ordered:
                ordered.append(need)
    return ordered


def add(key: str, uses: str, body: str, recursive: str = "") -> None:
    parts = [f"{name} AS ({CTES[name]})" for name in _closure(uses.split())]
    if recursive:
        parts.append(recursive)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    SQL[key] = head + body


MEASURES = """count(*) AS count, round(coalesce(sum(cost), 0.0), 6) AS total_cost,
    coalesce(sum(prompt_tokens), 0)::bigint AS prompt_tokens,
    coalesce(sum(completion_tokens), 0)::bigint AS completion_tokens,
    (coalesce(sum(prompt_tokens), 0) + coalesce(sum(completion_tokens), 0))::bigint AS total_tokens"""
COST = "round(coalesce(sum(cost), 0.0), 6) AS total_cost"
US = "epoch_us(created_at) AS created_at"

# --- listings ---------------------------------------------------------------------------------
add("list_page", "calls", f"""SELECT id, stage, model, cost, {US},
    (SELECT count(*) FROM calls WHERE stage = 'generate') AS total
    FROM calls WHERE stage = 'generate' ORDER BY calls.created_at DESC, id DESC LIMIT 50 OFFSET 100""")
add("count_by", "content", "SELECT tenant_id, template_id, status, count(*) AS count FROM content GROUP BY ALL")
add("scope_filter", "calls", """SELECT 'admin_all' AS view, tenant_id, count(*) AS calls FROM calls GROUP BY ALL
    UNION ALL SELECT 'admin_one', tenant_id, count(*) FROM calls WHERE tenant_id = 't2' GROUP BY ALL
    UNION ALL SELECT 'viewer', tenant_id, count(*) FROM calls WHERE tenant_id = 't1' GROUP BY ALL""")
add("time_range", "calls", f"""SELECT id, model, {US} FROM calls
    WHERE calls.created_at >= TIMESTAMP '2024-01-10' AND calls.created_at < TIMESTAMP '2024-01-20'""")
add("published_view", "content", """SELECT id, template_id, qc_score, epoch_us(published_at) AS published_at
    FROM content WHERE status = 'published'""")
add("manual_rejections", "records", f"""SELECT id, item_id, reason, reviewer, {US} FROM records
    WHERE source = 'manual_review' AND reason IS NOT NULL""")
add("eligible_content", "content", "SELECT id, status, qc_score FROM content WHERE status IN ('passed', 'published')")
add("trace_replay", "calls", f"""SELECT id, trace_id,
    CASE WHEN coalesce(stage, '') <> '' THEN stage WHEN scored THEN 'qc' ELSE 'generate' END AS stage,
    row_number() OVER (PARTITION BY trace_id ORDER BY calls.created_at, id) AS step, {US} FROM calls""")
for _name, _key in (("task_calls", "task_id"), ("item_calls", "item_id")):
    add(_name, "calls", f"""SELECT id, {_key},
        row_number() OVER (PARTITION BY {_key} ORDER BY created_at, id) AS step FROM calls""")
add("recent_calls", "calls", f"""SELECT id, trace_id, model, coalesce(stage, '') AS stage, template_id, task_id,
    prompt_tokens, completion_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS total_tokens,
    cost, latency_ms, {US} FROM calls ORDER BY calls.created_at DESC, id DESC LIMIT 200""")
add("audit_log_query", "changes", """SELECT * FROM changes WHERE entity_type = 'model_profile'
    AND created_at >= epoch_us(TIMESTAMP '2024-01-05') AND created_at < epoch_us(TIMESTAMP '2024-01-25')
    ORDER BY created_at DESC, id DESC LIMIT 100""")
add("sample_search", "pool", f"""SELECT id, template_id, knowledge_point, {US},
    (SELECT count(*) FROM pool WHERE purpose = 'sft' AND source = 'auto') AS total FROM pool
    WHERE purpose = 'sft' AND source = 'auto' ORDER BY pool.created_at DESC, id DESC LIMIT 100""")

# --- cost and call log --------------------------------------------------------------------------
add("cost_by_key", "calls", f"SELECT coalesce(model, 'unknown') AS name, {MEASURES} FROM calls GROUP BY model")
_DIMENSION = """CASE grouping(template_id, model, task_id, stage) WHEN 7 THEN 'template_id' WHEN 11 THEN 'model'
    WHEN 13 THEN 'task_id' WHEN 14 THEN 'stage' ELSE 'total' END AS dimension,
    CASE grouping(template_id, model, task_id, stage) WHEN 7 THEN coalesce(template_id, 'unknown')
    WHEN 11 THEN coalesce(model, 'unknown') WHEN 13 THEN coalesce(task_id, 'unknown')
    WHEN 14 THEN coalesce(stage, 'unknown') ELSE 'all' END AS name"""
_SETS = "GROUP BY GROUPING SETS ((template_id), (model), (task_id), (stage), ())"
add("cost_rollup", "calls", f"SELECT {_DIMENSION}, {MEASURES} FROM calls {_SETS}")
add("deep_cost_report", "calls", f"""SELECT *,
    CASE WHEN dimension = 'stage' THEN round(prompt_tokens::double / 1000 * 0.002::double, 6) END AS prompt_cost,
    CASE WHEN dimension = 'stage' THEN round(completion_tokens::double / 1000 * 0.002::double, 6) END AS completion_cost
    FROM (SELECT {_DIMENSION}, {MEASURES} FROM calls WHERE template_id = 'tpl_1' {_SETS})""")
add("cost_by_stage", "priced", f"""SELECT coalesce(nullif(stage, ''), 'unknown') AS stage,
    count, total_cost, prompt_tokens, completion_tokens, total_tokens, prompt_cost_by_model, completion_cost_by_model,
    round(prompt_tokens::double / 1000 * 0.002::double, 6) AS prompt_cost,
    round(completion_tokens::double / 1000 * 0.002::double, 6) AS completion_cost
    FROM (SELECT stage, {MEASURES},
        round(sum(priced.prompt_tokens::double / 1000 * prompt_rate), 6) AS prompt_cost_by_model,
        round(sum(priced.completion_tokens::double / 1000 * completion_rate), 6) AS completion_cost_by_model
        FROM priced GROUP BY stage)""")
add("cost_totals", "calls", f"SELECT {MEASURES} FROM calls")
add("cost_join_content", "calls content", f"""SELECT coalesce(c.model, 'unknown') AS name,
    round(coalesce(sum(c.cost), 0.0), 6) AS total_cost, count(*) AS count
    FROM calls c LEFT JOIN content i ON i.id = c.item_id
    WHERE i.template_id = 'en' OR c.template_id = 'en' GROUP BY c.model""")
_BY_MODEL = f"""SELECT tenant_id, model, {COST},
    coalesce(sum(prompt_tokens + completion_tokens), 0)::bigint AS total_tokens, count(*) AS call_count FROM calls"""
add("cost_by_model_since", "calls", f"{_BY_MODEL} WHERE created_at >= TIMESTAMP '2024-01-15' GROUP BY ALL")
add("cost_by_date", "calls", f"""SELECT tenant_id, created_at::date::varchar AS date, {COST}, count(*) AS call_count
    FROM calls GROUP BY ALL""")
_SINCE = "WHERE created_at >= TIMESTAMP '2024-01-24'"
add("cost_period_report", "calls", f"""SELECT tenant_id, 'total' AS part, 'all' AS name,
        round(sum(total_cost), 6) AS total_cost, sum(total_tokens)::bigint AS total_tokens,
        sum(call_count)::bigint AS call_count FROM ({_BY_MODEL} {_SINCE} GROUP BY ALL) GROUP BY tenant_id
    UNION ALL SELECT tenant_id, 'model', model, total_cost, total_tokens, call_count
        FROM ({_BY_MODEL} {_SINCE} GROUP BY ALL)
    UNION ALL SELECT tenant_id, 'date', created_at::date::varchar, round(sum(cost), 6), NULL, count(*)
        FROM calls {_SINCE} GROUP BY ALL""")
_TOTALS = f"""{COST}, coalesce(sum(prompt_tokens), 0)::bigint AS total_prompt_tokens,
    coalesce(sum(completion_tokens), 0)::bigint AS total_completion_tokens, count(*) AS call_count"""
add("cost_task_template_stage", "calls", f"""
    SELECT 'task' AS report, task_id, NULL AS template_id, NULL AS stage, {_TOTALS} FROM calls GROUP BY task_id
    UNION ALL SELECT 'template', NULL, template_id, NULL, {_TOTALS} FROM calls
        WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20' GROUP BY template_id
    UNION ALL SELECT 'task_stage', task_id, NULL, stage, {_TOTALS} FROM calls GROUP BY task_id, stage""")
add("cost_recent", "calls", f"""SELECT tenant_id,
    round(coalesce(sum(cost) FILTER (created_at >= TIMESTAMP '2024-01-30'), 0.0), 6) AS cost_24h,
    round(coalesce(sum(cost), 0.0), 6) AS cost_7d FROM calls {_SINCE} GROUP BY tenant_id""")
add("success_rate", "calls", """SELECT template_id, count(*) AS total, sum(success::int)::bigint AS success,
    round(avg(success::int), 4) AS rate FROM calls GROUP BY template_id""")
add("call_conformance", "calls", """SELECT tenant_id, model, grouping(model) = 1 AS whole_tenant, count(*) AS total,
    round(avg(success::int), 4) AS success_rate, round(avg((NOT success)::int), 4) AS retry_rate
    FROM calls WHERE stage = 'generate' GROUP BY GROUPING SETS ((tenant_id), (tenant_id, model))""")
_THREAD_STATS = """count(*) AS total_generations, count(won) AS success_generations,
    count(*) - count(won) AS failed_generations,
    round(count(*) FILTER (won = 1) / nullif(count(won), 0), 4) AS first_pass_rate,
    round(avg(won), 4) AS avg_attempts, round((count(*) - count(won)) / count(*), 4) AS failure_rate"""
add("structured_stats", "threads", f"SELECT template_id, {_THREAD_STATS} FROM threads GROUP BY template_id")
add("trace_summary", "calls", f"""SELECT trace_id, max(task_id) AS task_id, max(template_id) AS template_id,
    count(*) AS call_count, {COST}, round(sum(latency_ms), 4) AS total_latency_ms,
    epoch_us(min(created_at)) AS first_at, epoch_us(max(created_at)) AS last_at,
    (SELECT count(DISTINCT trace_id) FROM calls) AS total FROM calls GROUP BY trace_id""")
add("price_lookup", "priced", "SELECT id, model, prompt_rate, completion_rate FROM priced")
add("call_cost", "priced", """SELECT id, round(prompt_tokens::double / 1000 * prompt_rate
    + completion_tokens::double / 1000 * completion_rate, 6) AS priced_cost FROM priced""")
add("token_breakdown", "priced", """SELECT *, round(prompt_cost + completion_cost, 6) AS cost
    FROM (SELECT id, prompt_tokens, completion_tokens,
        round(prompt_tokens::double / 1000 * prompt_rate, 6) AS prompt_cost,
        round(completion_tokens::double / 1000 * completion_rate, 6) AS completion_cost FROM priced)""")
add("attempt_number", "numbered", "SELECT id, trace_id, stage, attempt FROM numbered")
add("budget_guard", "calls", f"""SELECT * FROM (SELECT c.id, c.task_id, c.model, epoch_us(c.created_at) AS created_at,
        round(coalesce(sum(c.cost) OVER (PARTITION BY c.task_id ORDER BY c.created_at, c.id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spent_before,
        coalesce(nullif(CASE WHEN s.s_suppkey % 2 = 0 THEN (s.s_suppkey % 5)::double / 10 END, 0), 0.2::double) AS budget
    FROM calls c LEFT JOIN supplier s ON 'model_' || s.s_suppkey = c.model)
    WHERE budget > 0 AND spent_before >= budget""")
add("model_health", "calls", """SELECT id, model, success, epoch_us(created_at) AS created_at, failures AS failure_count,
    CASE WHEN failures = 0 THEN 'healthy' WHEN failures >= 2 THEN 'unhealthy' ELSE 'degraded' END AS health_status,
    CASE WHEN failures >= 2 THEN epoch_us(created_at) + 60000000 END AS cooldown_until
    FROM (SELECT *, count(*) FILTER (NOT success) OVER (PARTITION BY model, island ORDER BY created_at, id) AS failures
        FROM (SELECT *, sum(success::int) OVER (PARTITION BY model ORDER BY created_at, id) AS island FROM calls))""")
add("model_recoveries", "calls", """SELECT model, failures AS failure_count, epoch_us(created_at) + 60000000 AS eligible_at
    FROM (SELECT *, lead(created_at) OVER (PARTITION BY model ORDER BY created_at, id) AS later
        FROM (SELECT *, count(*) FILTER (NOT success) OVER (PARTITION BY model, island ORDER BY created_at, id) AS failures
            FROM (SELECT *, sum(success::int) OVER (PARTITION BY model ORDER BY created_at, id) AS island FROM calls)))
    WHERE failures >= 2 AND epoch_us(created_at) + 60000000 <= epoch_us(coalesce(later, TIMESTAMP '2030-01-01'))""")

# --- quality ------------------------------------------------------------------------------------
add("quality_content_join", "records content", """SELECT r.id, r.item_id, c.template_id, r.source, r.score
    FROM records r JOIN content c ON c.id = r.item_id""")
_PASSED = "sum(CASE WHEN r.source = 'auto' AND r.score >= 70 THEN 1 ELSE 0 END)::bigint"
add("content_quality_outer", "records content", f"""SELECT c.template_id, count(*) AS generated, {_PASSED} AS passed
    FROM content c LEFT JOIN records r ON r.item_id = c.id GROUP BY c.template_id""")
add("content_quality_distinct", "records content", """SELECT c.template_id, count(DISTINCT c.id) AS generated,
    count(DISTINCT CASE WHEN r.source = 'auto' AND r.score >= 70 THEN c.id END) AS passed
    FROM content c LEFT JOIN records r ON r.item_id = c.id GROUP BY c.template_id""")
add("dashboard_by_template", "records content", f"""SELECT c.template_id, count(*) AS generated,
    round({_PASSED} / count(*) * 100, 2) AS pass_rate
    FROM content c LEFT JOIN records r ON r.item_id = c.id GROUP BY c.template_id""")
add("dashboard_kpis", "content records tasks threads", f"""
    SELECT key, value, unit, target::double AS target, goal,
        CASE WHEN goal = 'higher_better' THEN value >= target ELSE value <= target END AS met
    FROM (SELECT 'generated' AS key, count(*)::double AS value, '条' AS unit, NULL AS target, 'higher_better' AS goal FROM content
    UNION ALL SELECT 'published', count(*) FILTER (status = 'published')::double, '条', NULL, 'higher_better' FROM content
    UNION ALL SELECT 'avg_cost', round(avg(cost), 6), '¥', NULL, 'lower_better' FROM content
    UNION ALL SELECT 'revise_trigger_rate', round(count(*) FILTER (revise_count >= 1) / count(*) * 100, 2), '%', NULL, 'lower_better' FROM content
    UNION ALL SELECT 'qc_pass_rate', round(count(*) FILTER (source = 'auto' AND score >= 70) / count(*) FILTER (source = 'auto') * 100, 2), '%', 90.0, 'higher_better' FROM records
    UNION ALL SELECT 'manual_reject_rate', round(count(*) FILTER (source = 'manual_review' AND score = 0) / count(*) FILTER (source = 'manual_review') * 100, 2), '%', 5.0, 'lower_better' FROM records
    UNION ALL SELECT 'avg_latency', round(avg((epoch_us(updated_at) - epoch_us(created_at)) / 1e6::double), 1), 's', 3600.0, 'lower_better' FROM tasks
    UNION ALL SELECT 'structured_first_pass_rate', round(first_pass_rate * 100, 2), '%', NULL, 'higher_better' FROM s
    UNION ALL SELECT 'structured_avg_attempts', round(avg_attempts, 2), '次', 1.0, 'lower_better' FROM s
    UNION ALL SELECT 'structured_failure_rate', round(failure_rate * 100, 2), '%', 0.0, 'lower_better' FROM s)""")
SQL["dashboard_kpis"] = SQL["dashboard_kpis"].replace(
    " \n    SELECT key, value", f", s AS (SELECT {_THREAD_STATS} FROM (SELECT trace_id, min(won) AS won FROM threads GROUP BY trace_id))\n    SELECT key, value", 1
)
add("quality_buckets", "records content", """SELECT c.template_id, r.template_version, r.tenant_id, r.source, r.reviewer,
    sha256(r.config_snapshot) AS config_hash, 70.0::double AS effective_threshold, count(*) AS total,
    count(*) FILTER (r.score >= 70) AS passed, count(*) FILTER (r.score < 70) AS rejected,
    round(avg(r.score), 6) AS avg_score FROM records r JOIN content c ON c.id = r.item_id GROUP BY ALL""")
add("judge_rounds_mean", "means", """SELECT item_id, template_id, NULL::varchar AS error, dim,
    round(score, 4) AS score FROM means""")
_SCORE = "round(round(sum(m.score * {w}) / sum({w}), 8), 2) AS score"
_NEWEST = """newest AS (SELECT template_id, arg_max(kp, (created_at, id)) AS kp,
    arg_max(distractor, (created_at, id)) AS distractor, arg_max(threshold, (created_at, id)) AS threshold
    FROM calibrations GROUP BY template_id)"""
_OWN = """CASE WHEN n.template_id IS NULL THEN w.weight WHEN m.dim = 'kp_match' THEN n.kp
    WHEN m.dim = 'distractor' THEN n.distractor ELSE w.weight END"""
add("weighted_score", "means weights calibrations", f"""SELECT m.item_id, {_SCORE.format(w=_OWN)}
    FROM means m JOIN weights w ON w.template_id = m.template_id AND w.dim = m.dim
    LEFT JOIN newest n ON n.template_id = m.template_id GROUP BY m.item_id""", _NEWEST)
add("qc_route", "means weights content", f"""SELECT s.item_id, s.score, CASE WHEN s.score >= 50 THEN 'store'
        WHEN c.tenant_id <> 't0' AND s.score >= 40 THEN 'submit_review' WHEN c.revise_count < 3 THEN 'revise'
        ELSE 'reject' END AS route
    FROM (SELECT m.item_id, {_SCORE.format(w='w.weight')} FROM means m
        JOIN weights w ON w.template_id = m.template_id AND w.dim = m.dim GROUP BY m.item_id) s
    JOIN content c ON c.id = s.item_id""")
add("latest_quality", "records", """SELECT item_id, id, source, score FROM records
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, id DESC) = 1""")
add("effective_weights", "weights calibrations", """SELECT w.template_id, coalesce(n.threshold, 70.0::double) AS threshold,
    n.template_id IS NOT NULL AS calibrated, w.dim,
    CASE WHEN n.template_id IS NULL THEN w.weight WHEN w.dim = 'kp_match' THEN n.kp ELSE n.distractor END AS weight
    FROM weights w LEFT JOIN newest n ON n.template_id = w.template_id
    WHERE n.template_id IS NULL OR w.dim IN ('kp_match', 'distractor')""", _NEWEST)
add("effective_weights_asof", "records calibrations", """SELECT r.id, r.lang AS template_id,
    c.threshold AS effective_threshold, c.kp AS kp_weight
    FROM records r ASOF LEFT JOIN calibrations c ON c.template_id = r.lang AND r.created_at >= c.created_at""")
add("judge_stability", "", """WITH v AS (SELECT item_id, round(var_pop(score), 4) AS var_single,
        (SELECT NULL) AS x FROM (SELECT doc_id::varchar AS item_id, ((n_chars * (r + 1)) % 101)::double AS score
        FROM documents, range(6) t(r)) GROUP BY item_id),
    m AS (SELECT item_id, round(var_pop(score), 4) AS var_multi FROM (SELECT doc_id::varchar AS item_id, r // 3 AS part,
        avg(((n_chars * (r + 1)) % 101)::double) AS score FROM documents, range(6) t(r) GROUP BY ALL) GROUP BY item_id)
    SELECT item_id, var_single, var_multi, round((1 - var_multi / nullif(var_single, 0)) * 100, 1) AS reduction,
    CASE WHEN var_single = 0 THEN 'no_jitter' WHEN var_multi < var_single THEN 'reduced' ELSE 'not_reduced' END AS verdict
    FROM v JOIN m USING (item_id)""")

# --- calibration and agreement --------------------------------------------------------------------
add("label_pairs", "pairs", "SELECT item_id, template_id, auto, manual, distractor FROM pairs")
add("labelled_intersect", "records", """SELECT item_id FROM records WHERE source = 'auto'
    INTERSECT SELECT item_id FROM records WHERE source = 'manual_review'""")
add("false_pass_set", "falsepass", "SELECT * FROM falsepass")
add("dim_union", "weights dims", "SELECT template_id, dim FROM weights UNION SELECT template_id, dim FROM dims")
add("leniency", "lenient", "SELECT template_id, dim, lenient FROM lenient")
add("fit_weights", "fitted", "SELECT template_id, dim, default_weight, weight FROM fitted")
add("fit_threshold", "limits", "SELECT * FROM limits")
add("p10_rank", "calls", """SELECT model, n, latency_ms AS p10 FROM (SELECT model, latency_ms,
    row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY model) AS n FROM calls)
    WHERE rn = n // 10 + 1""")


def _printf(pattern: str) -> str:
    return pattern.replace("'", "''")


_SHORT = f"printf('{_printf(NOTE_SHORT)}', f.sample_size, f.false_pass_cnt, 20, 5)"
_DONE = f"printf('{_printf(NOTE_DONE)}', f.false_pass_cnt, printf('%.1f%%', round(f.rejection_rate * 100, 1)))"
add("calibrate", "fitted fits", f"""SELECT t.template_id, t.dim,
    CASE WHEN f.enough THEN t.weight ELSE t.default_weight END AS weight,
    CASE WHEN f.enough THEN t.lenient END AS lenient, t.default_weight AS default_weights, f.threshold,
    70.0::double AS default_threshold, f.sample_size, f.false_pass_cnt, f.rejection_rate,
    CASE WHEN f.enough THEN {_DONE} ELSE {_SHORT} END AS note
    FROM fitted t JOIN fits f ON f.template_id = t.template_id""")
add("recalibrated_weights", "fitted fits", """SELECT t.template_id, f.threshold, true AS calibrated, t.dim,
    CASE WHEN f.enough THEN t.weight ELSE t.default_weight END AS weight
    FROM fitted t JOIN fits f ON f.template_id = t.template_id""")
_CELLS = """count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn,
    count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn"""
_RATES = """n, tp, tn, fp, fn, round((tp + tn) / n, 4) AS accuracy, round(tp / nullif(tp + fp, 0), 4) AS precision,
    round(tp / nullif(tp + fn, 0), 4) AS recall,
    round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
        / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 4) AS f1"""
_CHANCE = "(((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn))::double / (n * n))"
_KAPPA = f"round(CASE WHEN {_CHANCE} >= 1 THEN 1.0 ELSE ((tp + tn) / n - {_CHANCE}) / (1 - {_CHANCE}) END, 4) AS kappa"
_VERDICTS = "SELECT *, manual > 0 AS t, auto >= 70 AS p FROM pairs"
add("confusion", "pairs", f"""SELECT template_id, {_RATES}, {_KAPPA}
    FROM (SELECT template_id, {_CELLS} FROM ({_VERDICTS}) GROUP BY template_id)""")
add("agreement_report", "pairs", f"""SELECT CASE WHEN g = 1 THEN '(all)' ELSE template_id END AS template_id,
    {_RATES}, {_KAPPA}, 70.0::double AS threshold, n >= 30 AS sufficient
    FROM (SELECT template_id, grouping(template_id) AS g, {_CELLS} FROM ({_VERDICTS})
        GROUP BY GROUPING SETS ((template_id), ()))""")
add("calibration_report", "pairs fits", f"""SELECT f.template_id, f.threshold, c.n, c.tp, c.tn, c.fp, c.fn,
    c.accuracy, c.kappa FROM fits f LEFT JOIN (SELECT template_id, {_RATES}, {_KAPPA} FROM (
        SELECT template_id, {_CELLS} FROM (SELECT p.template_id, p.manual > 0 AS t, p.auto >= x.threshold AS p
            FROM pairs p JOIN fits x ON x.template_id = p.template_id) GROUP BY template_id)) c
    ON c.template_id = f.template_id""")
add("cohen_kappa", "pairs", """SELECT o.template_id, o.n, round(CASE WHEN c.pe >= 1 THEN 1.0
        ELSE (o.po - coalesce(c.pe, 0)) / (1 - coalesce(c.pe, 0)) END, 4) AS kappa
    FROM (SELECT template_id, count(*) AS n, avg((a = m)::int) AS po FROM v GROUP BY template_id) o
    LEFT JOIN (SELECT x.template_id, sum(x.c::double * y.c / (x.n::double * x.n)) AS pe
        FROM (SELECT template_id, m AS k, count(*) AS c, sum(count(*)) OVER (PARTITION BY template_id) AS n
            FROM v GROUP BY template_id, m) x
        JOIN (SELECT template_id, a AS k, count(*) AS c FROM v GROUP BY template_id, a) y
        ON y.template_id = x.template_id AND y.k = x.k GROUP BY x.template_id) c ON c.template_id = o.template_id""",
    "v AS (SELECT template_id, floor(auto / 25) AS a, floor(manual / 25) AS m FROM pairs)")

# --- samples and corpus -----------------------------------------------------------------------------
add("sample_kp_join", "content tasks", """SELECT c.id, c.task_id, t.kp AS knowledge_point
    FROM content c LEFT JOIN tasks t ON t.id = c.task_id""")
_FRESH = "c.status IN ('passed', 'published') AND c.id NOT IN (SELECT id FROM pool)"
add("sample_sync", "content tasks pool", f"""SELECT sha256('sample:' || c.id) AS id, c.id AS item_id, c.template_id,
    'auto' AS source, 'sft' AS purpose, t.kp AS knowledge_point, sha256(c.payload) AS payload,
    '{{"qc_score":' || c.qc_score::varchar || ',"status":"' || c.status || '"}}' AS meta
    FROM content c LEFT JOIN tasks t ON t.id = c.task_id WHERE {_FRESH}""")
add("pool_after_sync", "content tasks pool", f"""SELECT id, template_id, knowledge_point, row_number() OVER w AS rank FROM (
        SELECT id, template_id, knowledge_point, created_at FROM pool WHERE purpose = 'fewshot'
        UNION ALL SELECT sha256('sample:' || c.id), c.template_id, t.kp, TIMESTAMP '2030-01-01'
        FROM content c LEFT JOIN tasks t ON t.id = c.task_id WHERE {_FRESH})
    WINDOW w AS (PARTITION BY template_id, knowledge_point ORDER BY created_at DESC, id DESC) QUALIFY rank <= 3""")
add("sync_counts", "content pool", f"""SELECT count(*) AS added, count(*) + (SELECT count(*) FROM pool) AS total
    FROM content c WHERE {_FRESH}""")
add("fewshot_topk", "pool", """SELECT id, template_id, knowledge_point, row_number() OVER w AS rank FROM pool
    WHERE purpose = 'fewshot'
    WINDOW w AS (PARTITION BY template_id, knowledge_point ORDER BY created_at DESC, id DESC) QUALIFY rank <= 3""")

# the characters stripped at both ends of a text, and the window rule, one step per row
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def _chunk_steps(floor: str) -> str:
    """Recursive derivation of the windows; `floor` is the position a newline must lie beyond."""
    cut = "strpos(reverse(substr(t.text, n.start + 1, 500)), chr(10))"
    return f"""texts AS (SELECT doc_id, trim(text, {_STRIP}) AS text FROM documents),
    steps AS (SELECT doc_id, 0 AS step, 0 AS start, -1 AS done, 0 AS stop, false AS last FROM texts WHERE text <> ''
      UNION ALL
      SELECT n.doc_id, n.step + 1, n.start, n.done,
        CASE WHEN n.start + 500 >= length(t.text) THEN length(t.text)
             WHEN {cut} > 0 AND n.start + 500 - {cut} > {floor} THEN n.start + 500 - {cut}
             ELSE n.start + 500 END, n.start + 500 >= length(t.text)
      FROM (SELECT doc_id, step, last,
                CASE WHEN step = 0 THEN 0 ELSE greatest(stop - 50, start + 1) END AS start,
                CASE WHEN step = 0 THEN 0 ELSE stop END AS done FROM steps) n
      JOIN texts t ON t.doc_id = n.doc_id WHERE NOT n.last),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk_index, content
      FROM (SELECT s.doc_id, s.step, trim(substr(t.text, s.start + 1, s.stop - s.start), {_STRIP}) AS content
        FROM steps s JOIN texts t ON t.doc_id = s.doc_id WHERE s.step > 0) WHERE content <> '')"""


_CHUNK_ROWS = "SELECT doc_id, chunk_index::int AS chunk_index, length(content)::int AS chars, sha256(content) AS digest FROM chunks"
add("chunk_text", "", _CHUNK_ROWS, _chunk_steps("greatest(n.start, n.done)"))
add("chunk_text_reference", "", _CHUNK_ROWS, _chunk_steps("n.start"))
add("chunk_counts", "", "SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id",
    _chunk_steps("greatest(n.start, n.done)"))
add("index_documents", "", """SELECT sha256(c.doc_id || ':' || c.chunk_index) AS id, c.doc_id,
    c.chunk_index::int AS chunk_index, 'document' AS source_type, c.doc_id::varchar AS source_name,
    d.source AS knowledge_point, 't' || (c.doc_id % 3) AS tenant_id, length(c.content)::int AS chars,
    e.vec_id IS NOT NULL AS has_vector
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id
    LEFT JOIN embeddings e ON e.vec_id // 2 = c.doc_id AND e.vec_id % 2 = c.chunk_index""",
    _chunk_steps("greatest(n.start, n.done)"))
add("index_embedded", "", """SELECT sha256(doc_id || ':' || chunk_index) AS id, doc_id, chunk_index::int AS chunk_index,
    length(content) AS chars, length(content) - length(replace(content, 'e', '')) AS letters,
    length(content) - length(replace(content, ' ', '')) AS spaces FROM chunks""", _chunk_steps("greatest(n.start, n.done)"))
add("knn_topk", "knn", "SELECT query_id, chunk_id, similarity, rank FROM knn WHERE rank <= 3")
add("knn_topk_filtered", "knn", """SELECT query_id, chunk_id, similarity, rank FROM (SELECT query_id, chunk_id, similarity,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM knn WHERE same)
    WHERE rank <= 3 AND similarity >= 0.2""")
add("cosine_distance", "", """WITH parts AS (SELECT label, i, avg(embedding[i]::double) AS x
        FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
    centers AS (SELECT label, list(x ORDER BY i) AS center FROM parts GROUP BY label)
    SELECT e.vec_id AS id, e.label::varchar AS knowledge_point,
        round(1 - list_cosine_similarity(e.embedding::double[], c.center), 6) AS distance
    FROM embeddings e JOIN centers c ON c.label = e.label""")
add("rag_context", "contexts", "SELECT query_id, context FROM contexts")
_PROMPT = f"""'[' || v.role || ' #' || v.turn || '] ' || v.text || ' {{{{missing}}}}'
    || coalesce('{CONTEXT_HEADING}' || c.context, '')"""
add("render_prompts", "contexts", f"""SELECT v.conv_id AS id, v.turn, length({_PROMPT})::int AS chars,
    sha256({_PROMPT}) AS digest FROM conversations v LEFT JOIN contexts c ON c.query_id = v.conv_id""")

# --- hygiene ----------------------------------------------------------------------------------------


def _masked(column: str) -> str:
    return (
        f"regexp_replace(regexp_replace({column}, '{BEARER}', '\\1[REDACTED]', 'g'), "
        f"'{KEY_VALUE}', '\\1\\2[REDACTED]', 'g')"
    )


def _cut(masked: str, most: int) -> str:
    return f"CASE WHEN length({masked}) > {most} THEN substr({masked}, 1, {most}) || '...[truncated]' ELSE {masked} END"


def _redact_sql(r: str) -> str:
    return f"""SELECT doc_id, r <> text AS changed, length(r)::int AS chars, sha256(r) AS digest
    FROM (SELECT doc_id, text, {r} AS r FROM documents)"""


add("redact_text", "", _redact_sql(_masked("text")))
add("redact_text_cut", "", _redact_sql(_cut(_masked("text"), 2000)))
add("redact_json", "", f"""SELECT doc_id, '[REDACTED]' AS api_key, '[REDACTED]' AS password, n_chars AS token_count,
    sha256({_masked('text')}) AS digest FROM documents""")
add("redact_map", "", f"""SELECT doc_id, '[REDACTED]' AS token, sha256({_masked('text')}) AS digest FROM documents""")
add("secret_scan", "", f"""SELECT doc_id, kind, count(*) AS hits FROM (
        SELECT doc_id, 'bearer' AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{BEARER}', 1)) FROM h)
        UNION ALL SELECT doc_id, replace(lower(k), '-', '_') FROM (SELECT doc_id, unnest(regexp_extract_all(
            regexp_replace(text, '{BEARER}', '\\1[REDACTED]', 'g'), '{KEY_VALUE}', 1)) AS k FROM h))
    GROUP BY ALL""", f"h AS (SELECT doc_id, text FROM documents WHERE {_masked('text')} <> text)")
add("canonical_json", "eventjson", "SELECT event_id, canonical FROM eventjson")
add("canonical_json_exact", "eventjson", "SELECT event_id, canonical FROM eventjson")
add("config_hash", "eventjson", "SELECT sha256(canonical) AS config_hash, count(*) AS rows FROM eventjson GROUP BY ALL")
add("request_fingerprint", "", """SELECT sha256(event_type || '|' || '{"k":' || json_extract_string(props, '$.k') || '}|v1')
    AS request_hash, count(*) AS requests FROM events GROUP BY ALL""")
add("request_fingerprint_exact", "", """SELECT sha256(event_type || '|' || '{"k": ' || json_extract_string(props, '$.k')
    || '}|v1') AS request_hash, count(*) AS requests FROM events GROUP BY ALL""")
add("active_duplicates", "", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus,
        sha256(o_orderpriority || '|{"c":' || o_custkey || '}') AS request_hash FROM orders)
    SELECT id, request_hash FROM o WHERE o_orderstatus = 'F'
        AND request_hash IN (SELECT request_hash FROM o WHERE o_orderstatus <> 'F')""")
add("first_of_batch", "", """SELECT event_id AS id, sha256(event_type || '|{"k":' || json_extract_string(props, '$.k')
    || '}|v1') AS request_hash, epoch_us(ts) AS created_at FROM events
    QUALIFY row_number() OVER (PARTITION BY request_hash ORDER BY ts, event_id) = 1""")
add("validate_payload", "found", "SELECT id, path, keyword, input FROM found")
add("validate_by_template", "found shapes", """SELECT id, 'tpl_' || k % 3 AS template_id, path, keyword, input FROM (
        SELECT f.id, s.k, f.path, f.keyword, f.input FROM found f JOIN shapes s ON s.id = f.id WHERE s.k % 3 = 0
        UNION ALL SELECT id, k, '', 'json', payload FROM shapes WHERE k % 3 <> 0 AND k % 13 = 0
        UNION ALL SELECT id, k, 'result', 'required', CASE WHEN k % 6 = 1 THEN '{"items":[{"x":1},' || sorted || ']}' ELSE sorted END
            FROM shapes WHERE k % 3 = 1 AND k % 13 <> 0 AND k % 6 <> 0
        UNION ALL SELECT id, k, 'meta.level', 'maximum', (size % 12)::varchar FROM shapes
            WHERE k % 3 = 2 AND plain AND size % 12 > 5)""")
_WHAT = """CASE keyword WHEN 'json' THEN 'not a JSON text' WHEN 'required' THEN 'missing ' || path
    WHEN 'minLength' THEN 'at least 10 characters' WHEN 'maxLength' THEN 'at most 14 characters'
    WHEN 'minItems' THEN 'at least 2 items' WHEN 'maxItems' THEN 'at most 4 items'
    WHEN 'type' THEN 'expected string' WHEN 'enum' THEN 'one of ["A", "B", "C", "D"]'
    WHEN 'minimum' THEN 'at least 1' ELSE 'at most 10' END"""
add("error_summary", "found", f"""SELECT id, printf('{SUMMARY_LINE}', CASE WHEN path = '' THEN '<顶层>' ELSE path END,
        keyword, {_WHAT}, CASE WHEN length(input) > 12 THEN substr(input, 1, 9) || '...' ELSE input END)
        || CASE WHEN total > 1 THEN chr(10) || printf('{SUMMARY_MORE}', total - 1) ELSE '' END AS summary
    FROM (SELECT *, count(*) OVER (PARTITION BY id) AS total,
        row_number() OVER (PARTITION BY id ORDER BY n, CASE path WHEN 'stem' THEN 1 WHEN 'options' THEN 2 ELSE 3 END) AS rn
        FROM found) WHERE rn = 1""")
add("validate_params", "tasks", """SELECT id, kw IS NULL AS valid,
    CASE kw WHEN 'required' THEN '' WHEN 'enum' THEN 'difficulty'
        WHEN 'minimum' THEN 'options_count' WHEN 'maximum' THEN 'options_count' END AS field_path,
    kw AS validation_keyword
    FROM (SELECT id, CASE WHEN kp IS NULL THEN 'required' WHEN difficulty = 'hard' THEN 'enum'
        WHEN options_count < 2 THEN 'minimum' WHEN options_count > 6 THEN 'maximum' END AS kw FROM tasks)""")
add("has_required", "payloads", "SELECT id, k % 13 <> 0 AND k % 6 >= 2 AND k % 9 <> 0 AS valid FROM payloads")
add("unwrap_payload", "payloads", """SELECT id, CASE WHEN k % 13 = 0 THEN payload ELSE body END AS payload FROM payloads""")

# --- governance --------------------------------------------------------------------------------------
add("validate_templates", "templates", """
    SELECT type_id, 'version' AS field, 'missing' AS problem FROM templates WHERE version IS NULL
    UNION ALL SELECT type_id, 'version', 'below 1' FROM templates WHERE version < 1
    UNION ALL SELECT type_id, 'input_schema', 'not a schema' FROM templates WHERE version IS NOT NULL AND k % 19 = 0
    UNION ALL SELECT type_id, 'quality_rules', 'rule without id or weight' FROM templates
        WHERE version IS NOT NULL AND k % 13 < 4
    UNION ALL SELECT type_id, 'quality_rules', 'weights do not sum to 1' FROM templates
        WHERE version IS NOT NULL AND k % 13 >= 4 AND size % 10 = 0
    UNION ALL SELECT type_id, 'gen_prompt', 'no system or user' FROM templates WHERE version IS NOT NULL AND k % 23 = 0
    UNION ALL SELECT type_id, 'run_config', 'no model_profile' FROM templates WHERE version IS NOT NULL AND k % 11 = 0
    UNION ALL SELECT type_id, 'status', 'unknown' FROM templates WHERE version IS NOT NULL AND status = 'archived'""")
add("model_ref_integrity", "templates profiles", """SELECT type_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS missing
    FROM (SELECT type_id, unnest(refs) AS name FROM templates WHERE status = 'enabled')
    WHERE name NOT IN (SELECT name FROM profiles) GROUP BY type_id""")
add("missing_refs", "templates profiles", """SELECT name FROM (SELECT unnest(refs) AS name FROM templates)
    EXCEPT SELECT name FROM profiles""")
_ELIGIBLE = f"status = 'enabled' AND (cooldown_until IS NULL OR cooldown_until <= {_EPOCH})"
add("profile_resolution", "templates profiles", f"""SELECT request_id, template_id, requested,
        CASE WHEN hit THEN requested ELSE (SELECT name FROM e WHERE is_default ORDER BY s_suppkey DESC LIMIT 1) END AS profile,
        CASE WHEN hit THEN 'primary' WHEN (SELECT count(*) FROM e WHERE is_default) > 0 THEN 'default' ELSE 'none' END AS route
    FROM (SELECT r.*, r.requested IN (SELECT name FROM e) AND r.requested IS NOT NULL AS hit FROM (
        SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS request_id, 'tpl_' || l_partkey AS template_id,
            CASE WHEN len(t.refs) = 1 THEN t.refs[1] WHEN l_orderkey % 3 = 0 THEN t.refs[2]
                WHEN l_orderkey % 3 = 2 THEN t.refs[3] ELSE t.refs[1] END AS requested
        FROM lineitem LEFT JOIN templates t ON t.k = l_partkey) r)""",
    f"e AS (SELECT * FROM profiles WHERE {_ELIGIBLE})")
add("default_uniqueness", "profiles", """SELECT name, is_default AND s_suppkey = (SELECT max(s_suppkey) FROM profiles
    WHERE is_default) AS is_default FROM profiles""")
add("template_hash", "hashes", "SELECT type_id, template_hash, prompt_hash FROM hashes")
add("profile_hash", "profiles", """SELECT name, sha256('{"budget_per_task":' || CASE WHEN budget_per_task IS NULL THEN 'null'
        WHEN budget_per_task = 0 THEN '0' ELSE budget_per_task::varchar END || ',"cost_tier":"' || cost_tier
    || '","is_default":' || is_default::varchar || ',"max_fallbacks":' || max_fallbacks || ',"model_name":"' || model_name
    || '","name":"' || name || '","provider":"' || provider || '","status":"' || status || '"}') AS model_hash
    FROM profiles""")
add("version_snapshot", "hashes profiles", """SELECT h.type_id, h.template_hash, p.name AS model, h.version,
    CASE WHEN h.refs IS NULL THEN 3 END AS max_retry FROM hashes h LEFT JOIN profiles p ON p.name = h.refs[1]""")
_KP = "CASE WHEN k % 13 <> 0 THEN CASE WHEN size % 10 = 0 THEN 0.4::double ELSE 0.3::double END END"
add("quality_snapshot", "hashes", f"""SELECT type_id, template_hash, NULL::varchar AS model_name,
    70.0::double AS threshold, {_KP} AS kp_weight FROM (SELECT h.*, t.size FROM hashes h JOIN templates t USING (type_id))""")
add("template_defaults", "templates", f"""SELECT * FROM (
    SELECT type_id AS template_id, 70.0::double AS threshold, 'kp_match' AS dim, {_KP} AS weight FROM templates
    UNION ALL SELECT type_id, 70.0::double, d.dim, CASE WHEN k % 13 <> d.i THEN d.w::double END FROM templates,
        (VALUES (1, 'diff_match', 0.2), (2, 'distractor', 0.3), (3, 'unambiguous', 0.2)) d(i, dim, w))
    WHERE weight IS NOT NULL""")
add("config_change_log", "changes", "SELECT * FROM changes")

# --- life cycle ---------------------------------------------------------------------------------------
_COUNTED = lambda names: ", ".join(f"count(*) FILTER (status = '{n}') AS {n}" for n in names.split())
add("task_status_pivot", "tasks", f"""SELECT tenant_id, {_COUNTED('pending dispatched running awaiting_review succeeded '
    'partially_succeeded failed cancelled')} FROM tasks GROUP BY tenant_id""")
add("content_status_pivot", "content", f"""SELECT tenant_id, {_COUNTED('pending_qc passed rejected published '
    'awaiting_review')} FROM content GROUP BY tenant_id""")
add("task_latency", "tasks", f"""SELECT id AS task_id, template_id, status, {US},
    round((epoch_us(updated_at) - epoch_us(tasks.created_at)) / 1e6::double, 1) AS latency_s
    FROM tasks ORDER BY tasks.created_at DESC, id DESC LIMIT 100""")
add("task_progress", "tasks items", """SELECT t.id AS task_id, 1.0::double AS progress,
    CASE WHEN c = n THEN 'cancelled' WHEN f = 0 THEN CASE WHEN a = 0 THEN 'succeeded' ELSE 'partially_succeeded' END
        WHEN s > 0 THEN 'partially_succeeded' ELSE 'failed' END AS status
    FROM tasks t JOIN (SELECT task_id, count(*) AS n, count(*) FILTER (status = 'cancelled') AS c,
        count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'succeeded') AS s,
        count(*) FILTER (status = 'awaiting_review') AS a FROM items GROUP BY task_id) i ON i.task_id = t.id""")
_NOW = "TIMESTAMP '1998-01-01'"
_DONE_STATES = "status IN ('succeeded', 'partially_succeeded', 'failed', 'cancelled')"
add("terminal_report", "tasks", f"""SELECT CASE WHEN grouping(status) = 1 THEN '(all)' ELSE status END AS status,
    count(*) AS tasks, count(*) FILTER ({_DONE_STATES}) AS terminal,
    round(count(*) FILTER ({_DONE_STATES}) / count(*) * 100, 1) AS terminal_pct,
    count(*) - count(*) FILTER ({_DONE_STATES}) AS stuck,
    round(avg((epoch_us({_NOW}) - epoch_us(created_at)) / 1e6::double), 1) AS avg_elapsed_s
    FROM tasks GROUP BY GROUPING SETS ((status), ())""")
_CLASS = """CASE failure_reason WHEN '422 Unprocessable Entity' THEN 'PERMANENT_ERROR'
    WHEN 'socket closed' THEN 'UNKNOWN_ERROR' ELSE 'TRANSIENT_ERROR' END AS failure_code"""
add("failure_codes", "items", f"""SELECT failure_code, count(*) AS items,
    round(avg(CASE WHEN failure_code = 'TRANSIENT_ERROR' THEN pow(2, attempts) END), 4) AS avg_retry_s
    FROM (SELECT {_CLASS}, attempts FROM items WHERE status = 'failed') GROUP BY failure_code""")
add("failure_class", "items", f"""SELECT failure_reason, {_CLASS}, count(*) AS items FROM items WHERE status = 'failed'
    GROUP BY ALL""")
add("thread_parse", "items", """SELECT task_id, count(*) AS items, sum(item_index)::bigint AS index_sum FROM items
    GROUP BY task_id""")
add("backoff_schedule", "outbox", f"""SELECT event_id, attempts, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END
        AS next_status,
    CASE WHEN attempts < 5 THEN epoch_us({_NOW}) + 5000000 * pow(2, attempts - 1)::bigint END AS available_at
    FROM outbox WHERE status IN ('pending', 'sending')""")
_IS_DUE = f"status = 'pending' AND available_at <= {_NOW}"
add("outbox_health", "outbox", f"""SELECT status, count(*) AS events, count(*) FILTER ({_IS_DUE}) AS due,
    count(*) FILTER (status = 'sending' AND updated_at <= {_NOW} - INTERVAL 300 SECOND) AS stale,
    epoch_us(min(available_at) FILTER ({_IS_DUE})) AS oldest_due FROM outbox GROUP BY status""")
add("outbox_due", "outbox", f"""SELECT event_id, task_id, status, attempts, epoch_us(available_at) AS available_at, {US},
    epoch_us(updated_at) AS updated_at FROM outbox WHERE {_IS_DUE} ORDER BY outbox.created_at, event_id LIMIT 50""")
add("stale_tasks", "tasks", f"""SELECT id, epoch_us(updated_at) AS updated_at FROM tasks
    WHERE status = 'running' AND tasks.updated_at < {_NOW} - INTERVAL 1800 SECOND""")
add("pending_age", "tasks", f"""SELECT id, status, template_id, {US},
    round((epoch_us({_NOW}) - epoch_us(tasks.created_at)) / 1e6::double, 0)::bigint AS age_s
    FROM tasks WHERE status IN ('pending', 'running')""")
_T, _R, _G = TASK_NOTICES["succeeded"], REJECTED_NOTICE, REVIEW_NOTICE
add("notifications", "tasks records content outbox", f"""SELECT * FROM (
    SELECT 'task:' || id || ':result' AS event_id, '{_T[0]}' AS type, '{_T[1]}' AS title,
        printf('{_T[2]}', id, quantity) AS content, id AS related_id, tenant_id FROM tasks WHERE status = 'succeeded'
    UNION ALL SELECT 'content:' || item_id || ':rejected', '{_R[0]}', '{_R[1]}',
        printf('{_R[2]}', item_id) || coalesce('{_R[3]}' || reason, ''), item_id, tenant_id
        FROM records WHERE source = 'manual_review' AND score = 0
    UNION ALL SELECT 'content:' || id || ':awaiting-review', '{_G[0]}', '{_G[1]}',
        printf('{_G[2]}', id, regexp_replace(qc_score::varchar, '\\.0$', '')), id, tenant_id
        FROM content WHERE status = 'awaiting_review')
    WHERE event_id NOT IN (SELECT 'task:' || task_id || ':result' FROM outbox WHERE status = 'sent')""")
add("lifecycle_events", "lifecycle", """SELECT id, trace_id, stage, event, status, reason, success,
    epoch_us(ts) AS created_at FROM lifecycle""")
add("lifecycle_durations", "lifecycle", """SELECT trace_id, count(*) AS events,
    epoch_us(min(ts) FILTER (event IN ('started', 'resume'))) AS started_at,
    epoch_us(max(ts) FILTER (event = 'finished')) AS finished_at,
    arg_max(status, (ts, id)) FILTER (status IS NOT NULL) AS status,
    arg_max(reason, (ts, id)) FILTER (reason IS NOT NULL) AS reason,
    round((epoch_us(max(ts) FILTER (event = 'finished'))
        - epoch_us(min(ts) FILTER (event IN ('started', 'resume')))) / 1e6::double, 3) AS duration_s
    FROM lifecycle GROUP BY trace_id""")
add("transition_audit", "", """WITH log AS (SELECT user_id::varchar AS entity_id, event_id AS id, ts,
        CASE event_type WHEN 'click' THEN 'pending_qc' WHEN 'view' THEN 'passed' WHEN 'purchase' THEN 'published'
            WHEN 'error' THEN 'rejected' ELSE 'awaiting_review' END AS status FROM events)
    SELECT id, entity_id, was AS from_status, status AS to_status, epoch_us(ts) AS created_at
    FROM (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY ts, id) AS was FROM log)
    WHERE was IS NOT NULL AND was || '>' || status NOT IN ('pending_qc>passed', 'pending_qc>rejected',
        'pending_qc>awaiting_review', 'awaiting_review>passed', 'awaiting_review>rejected', 'passed>published')""")

# --- batch forms of sources, sinks and streams ---------------------------------------------------------
add("clean_calls", "priced", """SELECT id, round(prompt_tokens::double / 1000 * prompt_rate
    + completion_tokens::double / 1000 * completion_rate, 6) AS cost,
    CASE WHEN scored THEN '{"dimension_scores":{"kp_match":1}}' ELSE '{"k":' || (prompt_tokens // 10) || '}' END AS output_data
    FROM priced""")
add("cost_windows", "calls", """SELECT epoch_us(date_trunc('day', created_at)::timestamp) AS start,
    epoch_us(date_trunc('day', created_at)::timestamp + INTERVAL 1 DAY) AS "end", model, round(sum(cost), 6) AS total_cost,
    count(*) AS calls FROM calls GROUP BY ALL""")
add("export_lines", "pool", """SELECT sha256('{"template_id":' || to_json(p.template_id) || ',"source":' || to_json(p.source)
    || ',"purpose":' || to_json(purpose) || ',"knowledge_point":' || coalesce(to_json(knowledge_point), 'null')
    || ',"payload":' || to_json(d.text) || ',"meta":{"qc_score":' || (p.doc_id % 101) || '}}') AS digest
    FROM pool p JOIN documents d ON d.doc_id = p.doc_id""")
add("screen_documents", "", """SELECT '/in/' || replace(name, ' ', '%20') || ext AS path, name AS source_name, length, reason,
    CASE WHEN reason = 'ok' THEN sha256(text) END AS digest
    FROM (SELECT *, CASE WHEN length = 0 THEN 'empty' WHEN length > 10485760 THEN 'too_large'
            WHEN ext = '.html' THEN 'unsupported_extension' ELSE 'ok' END AS reason
        FROM (SELECT 'doc ' || doc_id AS name, text, strlen(text) AS length, CASE lang WHEN 'fr' THEN '.MD' ELSE '.txt' END AS ext FROM documents
            UNION ALL SELECT 'page' || page_id, html, strlen(html), '.html' FROM pages))""")
