"""Analytic tables derived from the driver tables with plain expressions.

The driver ships star-schema, event and corpus tables; these functions shape them like the call
log, content, judgement, task and configuration tables, row for row, so that every operator runs
on data that grows with its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.costing import call_cost
from ..schemas import FLAT_PRICE_PER_1K

DIMENSIONS = ("kp_match", "diff_match", "distractor", "unambiguous")
DEFAULT_WEIGHTS = (0.3, 0.2, 0.3, 0.2)
CONTENT_EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call log; `attempt` is added where needed by the attempt_number operator."""
    kind, user = F.col("event_type"), F.col("user_id")
    prompt = F.get_json_object("props", "$.k").cast("int") * 10
    completion = F.floor("value").cast("int")
    flat = F.lit(FLAT_PRICE_PER_1K)
    stage = (
        F.when(kind.isin("view", "click", "error"), "generate")
        .when(kind == "purchase", "qc")
        .when((kind == "signup") & (user % 7 != 0), "embedding")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(user.cast("string"), F.lit(":"), F.to_date("ts").cast("string")).alias("trace_id"),
        user.cast("string").alias("item_id"),
        F.when(user % 5 != 0, _text("tpl_", user % 3)).alias("template_id"),
        _text("task_", user % 20).alias("task_id"),
        _text("t", user % 3).alias("tenant_id"),
        _text("model_", user % 4).alias("model"),
        stage.alias("stage"),
        (kind != "error").alias("success"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        F.col("value").alias("latency_ms"),
        call_cost(prompt, completion, flat, flat).alias("cost"),
        F.when(user % 2 == 0, F.lit('{"dimension_scores":{"kp_match":1}}'))
        .otherwise(F.col("props"))
        .alias("output_data"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow rows of the call log, with their context as JSON text."""
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", "started")
        .when(kind == "purchase", "finished")
        .when(kind == "error", "failed")
        .otherwise("resume")
    )
    context = F.struct(
        event.alias("event"),
        F.when(event.isin("finished", "failed"), event).alias("status"),
        F.when(event == "failed", F.lit("503 unavailable")).alias("reason"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
        .alias("trace_id"),
        F.lit("workflow").alias("stage"),
        (kind != "error").alias("success"),
        F.to_json(context).alias("output_data"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def _minutes_after_epoch(minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(F.lit(CONTENT_EPOCH).cast("timestamp")) + minutes * 60)


def content_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, chars = F.col("doc_id"), F.col("n_chars")
    statuses = F.array(
        *(F.lit(s) for s in ("pending_qc", "passed", "rejected", "published", "awaiting_review"))
    )
    created = _minutes_after_epoch(doc)
    return table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("id"),
        _text("task_", doc % 20).alias("task_id"),
        F.col("lang").alias("template_id"),
        F.col("text").alias("payload"),
        (chars % 101).cast("double").alias("qc_score"),
        F.get(statuses, (doc % 5).cast("int")).alias("status"),
        (doc % 4).cast("int").alias("revise_count"),
        F.round(chars.cast("double") / 1000 * F.lit(0.002), 6).alias("cost"),
        _text("t", doc % 3).alias("tenant_id"),
        F.when(doc % 5 == 3, _minutes_after_epoch(doc + 30)).alias("published_at"),
        created.alias("created_at"),
    )


def _dimension_map() -> Column:
    doc, chars = F.col("doc_id"), F.col("n_chars")
    values = (
        (chars * 3 + 7) % 101,
        (chars * 5 + 11) % 101,
        (doc * 7) % 101,
        (chars + doc) % 101,
    )
    pairs = [x for d, v in zip(DIMENSIONS, values) for x in (F.lit(d), v.cast("double"))]
    return F.create_map(*pairs)


def quality_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judgements per labelled document: the judge's, and a reviewer's a minute later."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    labelled = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    sources = F.explode(F.array(F.lit("auto"), F.lit("manual_review"))).alias("source")
    manual = F.col("source") == "manual_review"
    return labelled.select("*", sources).select(
        F.concat(doc.cast("string"), F.lit(":"), F.col("source")).alias("id"),
        doc.cast("string").alias("item_id"),
        "source",
        F.when(manual, F.col("quality") * 100).otherwise(chars % 101).cast("double").alias("score"),
        _dimension_map().alias("dimension_scores"),
        F.when(manual, _text("r", doc % 3)).alias("reviewer"),
        F.when(manual & (F.col("quality") == 0), _text("reason_", doc % 4)).alias("reason"),
        (doc % 2 + 1).cast("int").alias("template_version"),
        F.when(doc % 4 == 0, "{}").otherwise('{"threshold":70}').alias("config_snapshot"),
        _text("t", doc % 3).alias("tenant_id"),
        _minutes_after_epoch(doc + manual.cast("int")).alias("created_at"),
    )


def judge_rounds(spark: SparkSession, sf_dir: str, rounds: int = 3) -> DataFrame:
    """One row per document and judge round; one dimension is missing now and then, and one is
    never declared by any template."""
    doc, chars, r = F.col("doc_id"), F.col("n_chars"), F.col("round")
    present = F.create_map(
        F.lit("kp_match"), ((chars * (r + 1)) % 101).cast("double"),
        F.lit("diff_match"), ((doc * (r + 2)) % 101).cast("double"),
        F.lit("distractor"), ((chars + doc * r) % 101).cast("double"),
        F.lit("undeclared"), F.lit(1.0),
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", "lang")
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        .select(
            doc.cast("string").alias("item_id"),
            F.col("lang").alias("template_id"),
            "round",
            F.map_filter(
                present, lambda k, v: (k != "distractor") | ((doc + r) % 5 != 0)
            ).alias("scores"),
        )
    )


def quality_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template per content language, with the default dimension weights."""
    weights = F.create_map(
        *(F.lit(x) for pair in zip(DIMENSIONS, DEFAULT_WEIGHTS) for x in pair)
    )
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("lang").alias("template_id"))
        .distinct()
        .select("template_id", weights.alias("weights"), F.lit(70.0).alias("threshold"))
    )


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only calibration log: one row per reviewed document of bad quality."""
    doc = F.col("doc_id")
    w = (doc % 10).cast("double") / 10
    weights = F.create_map(F.lit("kp_match"), w, F.lit("distractor"), 1 - w)
    return (
        table(spark, sf_dir, "labels").filter("quality = 0")
        .join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
        .select(
            doc.cast("string").alias("id"),
            F.col("lang").alias("template_id"),
            weights.alias("weights"),
            (F.lit(60.0) + doc % 20).alias("threshold"),
            _minutes_after_epoch(doc).alias("created_at"),
        )
    )


def generation_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    created = F.col("o_orderdate").cast("timestamp")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        _text("task_", key).alias("id"),
        F.col("o_orderpriority").alias("template_id"),
        F.to_json(
            F.struct(
                F.when(cust % 10 != 0, _text("kp_", cust % 10)).alias("knowledge_point"),
                F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (key % 3).cast("int"))
                .alias("difficulty"),
                (cust % 8).alias("options_count"),
            )
        ).alias("params"),
        (cust % 5 + 1).cast("int").alias("quantity"),
        F.when(status == "P", "running").when(status == "O", "pending").otherwise("succeeded")
        .alias("status"),
        _text("t", cust % 3).alias("tenant_id"),
        created.alias("created_at"),
        F.timestamp_seconds(F.unix_seconds(created) + F.floor("o_totalprice")).alias("updated_at"),
    )


def generation_task_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    reasons = F.array(
        *(F.lit(x) for x in ("422 Unprocessable Entity", "429 rate limit", "503 unavailable", "socket closed"))
    )
    status = (
        F.when(flag == "R", "failed")
        .when(flag == "A", "succeeded")
        .when(F.col("l_linestatus") == "O", "awaiting_review")
        .otherwise("cancelled")
    )
    return table(spark, sf_dir, "lineitem").select(
        _text("task_", F.col("l_orderkey")).alias("task_id"),
        F.concat_ws(":", _text("task_", F.col("l_orderkey")), line.cast("string")).alias("thread_id"),
        line.alias("item_index"),
        status.alias("status"),
        F.when(flag == "R", F.get(reasons, line % 4)).alias("failure_reason"),
        (line % 5).alias("attempts"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"),
    )


def task_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dispatch event per task."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    statuses = F.array(*(F.lit(s) for s in ("pending", "sending", "sent", "pending", "dead")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("task:"), key.cast("string"), F.lit(":dispatch")).alias("event_id"),
        _text("task_", key).alias("task_id"),
        F.get(statuses, (cust % 5).cast("int")).alias("status"),
        (cust % 6 + 1).cast("int").alias("attempts"),
        F.timestamp_seconds(created + cust % 100000).alias("available_at"),
        F.timestamp_seconds(created).alias("created_at"),
        F.timestamp_seconds(created + cust % 600).alias("updated_at"),
    )


def model_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per supplier; several claim to be the default."""
    key = F.col("s_suppkey")
    day = F.unix_seconds(F.lit(CONTENT_EPOCH).cast("timestamp"))
    return table(spark, sf_dir, "supplier").select(
        _text("profile_", key).alias("name"),
        _text("provider_", F.col("s_nationkey")).alias("provider"),
        F.lower("s_name").alias("model_name"),
        F.when(F.col("s_acctbal") > 5000, "premium").otherwise("standard").alias("cost_tier"),
        (key % 7 == 0).alias("is_default"),
        F.when(F.col("s_acctbal") < 0, "disabled").otherwise("enabled").alias("status"),
        F.when(key % 4 == 1, F.timestamp_seconds(day + (key % 3 - 1) * 3600)).alias("cooldown_until"),
        (key % 3).cast("int").alias("max_fallbacks"),
        F.when(key % 2 == 0, (key % 5).cast("double") / 10).alias("budget_per_task"),
        F.timestamp_seconds(day + key * 60).alias("created_at"),
    )


def question_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template per part: routing by name or by tier, with broken entries among them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    named = F.to_json(F.struct(_text("profile_", key % 150).alias("model_profile")))
    tiered = F.to_json(
        F.struct(
            F.struct(
                _text("profile_", size).alias("default"),
                _text("profile_", key % 130).alias("easy"),
                _text("profile_", size + 60).alias("hard"),
            ).alias("model_profile")
        )
    )
    run_config = (
        F.when(key % 11 == 0, F.lit('{"max_retry":3}')).when(key % 2 == 0, named).otherwise(tiered)
    )
    rule = lambda i, w: F.struct(
        F.when(key % 13 != i, F.lit(DIMENSIONS[i])).alias("id"), w.cast("double").alias("weight")
    )
    rules = F.array(
        rule(0, F.when(size % 10 == 0, 0.4).otherwise(0.3)), rule(1, F.lit(0.2)),
        rule(2, F.lit(0.3)), rule(3, F.lit(0.2)),
    )
    return table(spark, sf_dir, "part").select(
        _text("tpl_", key).alias("type_id"),
        F.col("p_name").alias("name"),
        F.when(key % 17 != 0, (key % 4).cast("int")).alias("version"),
        F.when(key % 19 == 0, '{"type":"string"}').otherwise('{"type":"object"}').alias("input_schema"),
        F.lit('{"type":"object","required":["stem"]}').alias("output_schema"),
        rules.alias("quality_rules"),
        F.when(key % 23 == 0, '{"user":"u.st"}').otherwise('{"system":"s.st","user":"u.st"}')
        .alias("gen_prompt"),
        run_config.alias("run_config"),
        F.when(key % 29 == 0, "archived").when(key % 5 == 0, "disabled").otherwise("enabled")
        .alias("status"),
    )


def config_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved configurations in time order: one entity per user, one save per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct((k % 4).alias("version"), F.col("event_type").alias("alpha")))
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "model_profile").otherwise("question_template")
        .alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        _text("t", F.col("user_id") % 3).alias("tenant_id"),
        F.col("event_id").alias("id"),
        body.alias("snapshot"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content status changes in time order: one entity per user."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("event_id").alias("id"),
        F.when(kind == "click", "pending_qc").when(kind == "view", "passed")
        .when(kind == "purchase", "published").when(kind == "error", "rejected")
        .otherwise("awaiting_review").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def sample_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples pooled earlier: one per labelled document of good quality."""
    doc = F.col("doc_id")
    return (
        table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
        .join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
        .select(
            doc.cast("string").alias("id"),
            doc.cast("string").alias("item_id"),
            F.col("lang").alias("template_id"),
            F.when(doc % 2 == 0, "auto").otherwise("manual").alias("source"),
            F.when(doc % 3 == 0, "fewshot").otherwise("sft").alias("purpose"),
            F.when(doc % 4 != 0, _text("kp_", doc % 4)).alias("knowledge_point"),
            F.col("text").alias("payload"),
            F.to_json(F.struct((doc % 101).alias("qc_score"))).alias("meta"),
            _minutes_after_epoch(doc).alias("created_at"),
        )
    )


def knowledge_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding"),
        F.col("label").cast("string").alias("knowledge_point"),
        _text("chunk ", F.col("vec_id")).alias("content"),
    )


def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price list per model, one side missing for every other model."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _text("model_", key).alias("model"),
        ((F.col("s_nationkey") + 1).cast("double") / 10000).alias("prompt"),
        F.when(key % 2 == 0, (F.col("s_nationkey") + 2).cast("double") / 5000).alias("completion"),
    )


def model_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _text("model_", key).alias("model"),
        F.when(key % 2 == 0, (key % 5).cast("double") / 10).alias("budget_per_task"),
    )


def single_and_multi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six single-round scores per document, and two means of three rounds each."""
    score = ((F.col("n_chars") * (F.col("round") + 1)) % 101).cast("double")
    singles = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("round"))
        .select(F.col("doc_id").cast("string").alias("item_id"), "round", score.alias("score"))
    )
    third = F.floor(F.col("round") / 3)
    multi = singles.groupBy("item_id", third.alias("part")).agg(F.avg("score").alias("score"))
    mode = lambda df, name: df.select("item_id", F.lit(name).alias("mode"), "score")
    return mode(singles, "single").unionByName(mode(multi, "multi"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated payloads as JSON text: some wrapped, some broken, some out of bounds."""
    key, size = F.col("p_partkey"), F.col("p_size")
    option = F.concat(F.lit('"o'), (key % 7).cast("string"), F.lit('"'))
    options = F.concat(F.lit("["), F.array_join(F.array_repeat(option, (size % 7)), ","), F.lit("]"))
    answer = F.when(key % 10 == 0, F.lit("7")).otherwise(
        F.concat(F.lit('"'), F.substring(F.lit("ABCDEFGH"), (key % 8 + 1).cast("int"), F.lit(1)), F.lit('"'))
    )
    stem = F.when(
        key % 9 != 0, F.concat(F.lit('"stem":"'), F.col("p_name"), F.lit('",'))
    ).otherwise("")
    level = F.concat(F.lit('"meta":{"level":'), (size % 12).cast("string"), F.lit("}"))
    body = F.concat(
        F.lit("{"), stem, F.lit('"options":'), options, F.lit(',"answer":'), answer, F.lit(","), level,
        F.lit("}"),
    )
    text = (
        F.when(key % 13 == 0, F.lit("not json"))
        .when(key % 6 == 0, F.concat(F.lit('{"result":'), body, F.lit("}")))
        .when(key % 6 == 1, F.concat(F.lit('{"items":[{"x":1},'), body, F.lit("]}")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "part").select(
        key.alias("id"), "p_name", size.alias("size"), text.alias("payload")
    )


# Output schema of the derived payloads and input schema of the derived task parameters.
LEVEL_SCHEMA = {"properties": {"meta": {"type": "object", "properties": {"level": {"type": "integer", "maximum": 5}}}}}
PAYLOAD_SCHEMA = {
    "type": "object",
    "properties": {
        "stem": {"type": "string", "minLength": 10, "maxLength": 14},
        "options": {"type": "array", "items": {"type": "string"}, "minItems": 2, "maxItems": 4},
        "answer": {"type": "string", "enum": ["A", "B", "C", "D"]},
        "meta": {
            "type": "object",
            "properties": {"level": {"type": "integer", "minimum": 1, "maximum": 10}},
            "required": ["level"],
        },
    },
    "required": ["stem", "options", "answer"],
}
PARAMS_SCHEMA = {
    "type": "object",
    "properties": {
        "knowledge_point": {"type": "string"},
        "difficulty": {"type": "string", "enum": ["easy", "medium"]},
        "options_count": {"type": "integer", "minimum": 2, "maximum": 6},
    },
    "required": ["knowledge_point", "difficulty", "options_count"],
}
