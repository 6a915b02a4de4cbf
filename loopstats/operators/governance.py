"""Templates, model profiles and configuration history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import canonical_json, config_hash
from .ordered import ordered_groups, previous
from .quality import own_weights

# The fields a hash or snapshot covers.
TEMPLATE_FIELDS = (
    "type_id", "version", "input_schema", "output_schema", "quality_rules", "gen_prompt", "run_config",
)
JSON_FIELDS = ("input_schema", "output_schema", "gen_prompt", "run_config")
PROFILE_FIELDS = (
    "name", "provider", "model_name", "cost_tier", "is_default", "status", "max_fallbacks",
    "budget_per_task",
)
KEEP_NULLS = {"ignoreNullFields": "false"}


def _json_struct(columns, json_columns=()) -> Column:
    """A struct as JSON text in which JSON columns are nested, not quoted."""
    return F.to_json(
        F.struct(
            *(F.try_parse_json(c).alias(c) if c in json_columns else F.col(c) for c in columns)
        ),
        KEEP_NULLS,
    )


def template_hash(templates: DataFrame) -> DataFrame:
    """Adds template_hash and prompt_hash, over the executable fields only."""
    return templates.withColumns(
        {
            "template_hash": config_hash(_json_struct(TEMPLATE_FIELDS, JSON_FIELDS)),
            "prompt_hash": config_hash(F.col("gen_prompt")),
        }
    )


def profile_hash(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("model_hash", config_hash(_json_struct(PROFILE_FIELDS)))


def _version_fields(hashed: DataFrame, profiles: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """Templates with their hashes, and the fields of their snapshots."""
    fields = [
        F.col("type_id").alias("template_id"),
        F.col("version"),
        F.col("template_hash"),
        F.col("prompt_hash"),
        F.col("quality_rules"),
        F.try_parse_json("run_config").alias("run_config"),
    ]
    if profiles is not None:
        model = profile_hash(profiles).select(
            F.col("name").alias("_name"),
            F.struct("name", "provider", "model_name", "model_hash").alias("model"),
        )
        named = profile_name(F.lit(None).cast("string"))
        hashed = with_routes(hashed).withColumn("_named", named)
        hashed = hashed.join(model, F.col("_named") == F.col("_name"), "left")
        fields.append(F.col("model"))
    return hashed, fields


def version_snapshot(templates: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """type_id and the immutable configuration `snapshot` stored with tasks and records; with
    profiles, the one the template names is part of it."""
    hashed, fields = _version_fields(template_hash(templates), profiles)
    return hashed.select("type_id", F.to_json(F.struct(*fields), KEEP_NULLS).alias("snapshot"))


def quality_snapshot(templates: DataFrame, effective: DataFrame | None = None, model: Column | None = None) -> DataFrame:
    """version_snapshot with the judge model, threshold and weights a judgement was made with.

    `effective` holds (template_id, weights, threshold), as effective_weights gives them, and is
    joined once; without it a template's own (template_defaults) count, and nothing is joined or
    shuffled. Without a judge model the template's `judge_model` is taken. Templates without a
    type_id have no snapshot.
    """
    judge = F.get_json_object("run_config", "$.judge_model") if model is None else model
    named = templates.filter("type_id is not null").withColumn("_judge", judge)
    if effective is None:
        own = own_weights()
        named = named.withColumns({"_weights": own["weights"], "_threshold": own["threshold"]})
    else:
        used = effective.select(
            F.col("template_id").alias("type_id"), F.col("weights").alias("_weights"), F.col("threshold").alias("_threshold")
        )
        named = named.join(used, "type_id", "left")
    hashed, fields = _version_fields(template_hash(named))
    extra = (F.col("_" + c).alias(name) for c, name in (("judge", "model_name"), ("threshold", "threshold"), ("weights", "weights")))
    return hashed.select("type_id", F.to_json(F.struct(*fields, *extra), KEEP_NULLS).alias("snapshot"))


def _configured(run_config: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(run_config), "$.model_profile", "variant")


def _as_name(value: Column) -> Column:
    """Profile names are strings; any other JSON value is no reference."""
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.try_variant_get(value, "$", "string"))


def with_routes(templates: DataFrame) -> DataFrame:
    """Templates with the profile they name (`_plain`) or their tiers (`_tiers`, map). Run
    configurations are parsed here, once per template, and not once per request."""
    read = templates.withColumn("_configured", _configured(F.col("run_config")))
    is_map = F.startswith(F.schema_of_variant("_configured"), F.lit("OBJECT"))
    tiers = F.when(is_map, F.try_variant_get("_configured", "$", "map<string,variant>"))
    return read.withColumns(
        {
            "_plain": _as_name(F.col("_configured")),
            "_tiers": F.transform_values(tiers, lambda k, v: _as_name(v)),
        }
    ).drop("_configured")


def profile_name(difficulty: Column, explicit: Column | None = None) -> Column:
    """Profile a request asks for, over the columns of `with_routes`: explicit, plain name, tier
    of its difficulty, `default`, or the first tier in key order."""
    tiers = F.col("_tiers")
    # keys of a JSON object come sorted, so the first value is that of the smallest key
    tier = (
        F.when(F.map_contains_key(tiers, difficulty), tiers[difficulty])
        .when(F.map_contains_key(tiers, F.lit("default")), tiers["default"])
        .otherwise(F.get(F.map_values(tiers), F.lit(0)))
    )
    name = F.coalesce("_plain", tier)
    return name if explicit is None else F.coalesce(explicit, name)


def referenced_profiles(templates: DataFrame) -> DataFrame:
    """(type_id, name) for every profile a template's run configuration names."""
    names = F.coalesce(F.map_values("_tiers"), F.array("_plain"))
    return with_routes(templates).select("type_id", F.explode(names).alias("name")).filter("name is not null")


def missing_refs(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Referenced names that do not exist."""
    return refs.select("name").distinct().subtract(names.select("name"))


def model_ref_integrity(templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Enabled templates that reference missing profiles, with the sorted names."""
    refs = referenced_profiles(templates.filter(F.col("status") == "enabled"))
    missing = refs.join(profiles.select("name"), "name", "left_anti")
    # a template names a handful of tiers, so the set is small
    names = F.array_join(F.array_sort(F.collect_set("name")), ", ")
    return missing.groupBy("type_id").agg(names.alias("missing"))


def _eligible(as_of) -> Column:
    now = F.lit(as_of).cast("timestamp")
    rested = F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now)
    return (F.coalesce("status", F.lit("enabled")) == "enabled") & rested


def profile_resolution(
    requests: DataFrame, templates: DataFrame, profiles: DataFrame, as_of
) -> DataFrame:
    """Profile of each request (request_id, template_id, difficulty [, profile]): the one asked
    for when eligible, else the default when eligible, else none.

    Templates and profiles are dimensions: Spark broadcasts them when they measure below the
    session's threshold. The default profile's name is one scalar.
    """
    eligible = profiles.filter(_eligible(as_of)).select("name", "is_default", "created_at")
    fallback = eligible.filter("is_default").agg(
        F.max_by("name", F.struct("created_at", "name"))
    ).scalar()
    configs = with_routes(templates).select(F.col("type_id").alias("template_id"), "_plain", "_tiers")
    explicit = F.col("profile") if "profile" in requests.columns else None
    asked = requests.join(configs, "template_id", "left").withColumn(
        "requested", profile_name(F.col("difficulty"), explicit)
    )
    found = asked.join(
        eligible.select(F.col("name").alias("requested"), F.lit(True).alias("_found")),
        "requested",
        "left",
    )
    hit = F.coalesce(F.col("_found"), F.lit(False))
    resolved = found.withColumn("_fallback", fallback)
    route = F.when(hit, "primary").when(F.col("_fallback").isNotNull(), "default").otherwise("none")
    return resolved.select(
        "request_id",
        "template_id",
        "requested",
        F.when(hit, F.col("requested")).otherwise(F.col("_fallback")).alias("profile"),
        route.alias("route"),
    )


def default_uniqueness(profiles: DataFrame) -> DataFrame:
    """Profiles with `is_default` left only on the newest of those that claim it."""
    newest = profiles.filter("is_default").agg(
        F.max_by("name", F.struct("created_at", "name"))
    ).scalar()
    keep = F.col("is_default") & F.col("name").eqNullSafe(F.col("_newest"))
    return profiles.withColumn("_newest", newest).withColumn("is_default", keep).drop("_newest")


def config_change_log(snapshots: DataFrame) -> DataFrame:
    """Real configuration changes: each save against the one before it by canonical JSON.

    The first save is a `create`; later ones are `sync` for templates and `update` for the rest.
    """
    saves = snapshots.withColumn("_canonical", canonical_json(F.col("snapshot")))
    groups = ordered_groups(saves, ["entity_type", "entity_id"], ["created_at", "id"])
    rows = previous(groups, "_p", ["_canonical", "snapshot"]).result()
    first = F.col("_p").isNull()
    changed = first | ~F.col("_p._canonical").eqNullSafe(F.col("_canonical"))
    later = F.when(F.col("entity_type") == "question_template", "sync").otherwise("update")
    return rows.filter(changed).select(
        "id", "entity_type", "entity_id", "tenant_id",
        F.when(first, "create").otherwise(later).alias("action"),
        F.col("_p.snapshot").alias("before_snapshot"),
        F.col("snapshot").alias("after_snapshot"),
        "created_at",
    )


def validate_templates(templates: DataFrame) -> DataFrame:
    """One row per violation: type_id, field, problem. Missing fields hide the other checks."""
    required = ("type_id", "name", "version", *TEMPLATE_FIELDS[2:])
    schema_kind = lambda c: F.get_json_object(c, "$.type")
    rules = F.col("quality_rules")
    broken_rule = F.exists(rules, lambda r: r["id"].isNull() | r["weight"].isNull())
    weight = F.aggregate(rules, F.lit(0.0), lambda acc, r: acc + r["weight"])
    has = lambda c, key: F.array_contains(F.json_object_keys(c), key)
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def problem(field: str, text: str, when: Column) -> Column:
        row = F.struct(F.lit(field).alias("field"), F.lit(text).alias("problem"))
        return F.when(when, row)

    missing = [problem(f, "missing", F.col(f).isNull()) for f in required]
    invalid = [
        problem("version", "below 1", F.col("version") < 1),
        *(
            problem(f, "not a schema", no(schema_kind(f).isin("object", "array")))
            for f in ("input_schema", "output_schema")
        ),
        problem("quality_rules", "empty", F.size(rules) == 0),
        problem("quality_rules", "rule without id or weight", broken_rule),
        problem(
            "quality_rules",
            "weights do not sum to 1",
            (F.size(rules) > 0) & ~broken_rule & (F.abs(weight - 1.0) > 1e-6),
        ),
        problem("gen_prompt", "no system or user", no(has("gen_prompt", "system") & has("gen_prompt", "user"))),
        problem("run_config", "no model_profile", no(has("run_config", "model_profile"))),
        problem("status", "unknown", ~F.coalesce("status", F.lit("enabled")).isin("enabled", "disabled")),
    ]
    drop_nulls = lambda items: F.filter(F.array(*items), lambda p: p.isNotNull())
    rows = templates.select("type_id", drop_nulls(missing).alias("_m"), drop_nulls(invalid).alias("_i"))
    shown = F.when(F.size("_m") > 0, F.col("_m")).otherwise(F.col("_i"))
    return rows.select("type_id", F.explode(shown).alias("v")).select("type_id", "v.*")
