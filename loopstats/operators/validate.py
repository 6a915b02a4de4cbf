"""JSON conformance: a schema becomes column predicates over variants.

The schema is walked once, on the driver, and yields one expression per row; rows never leave
the JVM. Keywords: required, type, enum, minLength, maxLength, minItems, maxItems, minimum,
maximum, nested objects and arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

VIOLATION = "array<struct<path:string,keyword:string,message:string,input:string>>"
# variant type names per JSON type; decimals without a fraction are integers too
_KINDS = {
    "string": "STRING",
    "boolean": "BOOLEAN",
    "integer": "(BIGINT|DECIMAL|DOUBLE)",
    "number": "(BIGINT|DECIMAL|DOUBLE)",
    "array": "ARRAY",
    "object": "OBJECT",
    "null": "VOID",
}


def _variant_text(value) -> str:
    """A constant as variants spell it: sorted keys, no blanks, no `.0`."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _bind(value: Column, body) -> Column:
    """body(value, kind) with both computed once per row: a transform over a one-element array,
    which is as near to a `let` as column expressions come."""
    pair = F.array(F.struct(value.alias("v"), F.schema_of_variant(value).alias("kind")))
    return F.flatten(F.transform(pair, lambda p: body(p["v"], p["kind"])))


def _is(value: Column, kind: Column, name: str) -> Column:
    fits = F.rlike(kind, F.lit("^" + _KINDS[name]))
    if name == "integer":
        number = F.try_variant_get(value, "$", "double")
        fits = fits & (number == F.floor(number))
    return fits


def _report(condition: Column, path: Column, keyword: str, message: str, value: Column) -> Column:
    row = F.struct(
        path.alias("path"),
        F.lit(keyword).alias("keyword"),
        F.lit(message).alias("message"),
        F.to_json(value).alias("input"),
    )
    return F.when(condition, F.array(row).cast(VIOLATION)).otherwise(_none())


def _child(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _in_enum(members: Sequence, value: Column, kind: Column) -> Column:
    """Numbers are compared as numbers, whatever their spelling (1e3 is 1000); anything else by its text."""
    is_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    numbers = [float(v) for v in members if is_number(v)]
    texts = [_variant_text(v) for v in members if not is_number(v)]
    fits = F.to_json(value).isin(*texts) if texts else F.lit(False)
    if numbers:
        fits = fits | F.coalesce(_is(value, kind, "number") & F.try_variant_get(value, "$", "double").isin(*numbers), F.lit(False))
    return fits


def _bounds(schema: Mapping, value: Column, kind: Column, path: Column) -> list[Column]:
    text = F.when(_is(value, kind, "string"), F.try_variant_get(value, "$", "string"))
    items = F.when(_is(value, kind, "array"), F.size(F.try_variant_get(value, "$", "array<variant>")))
    number = F.when(_is(value, kind, "number"), F.try_variant_get(value, "$", "double"))
    measures = (
        ("minLength", F.length(text), "at least %s characters", lambda m, n: m < n),
        ("maxLength", F.length(text), "at most %s characters", lambda m, n: m > n),
        ("minItems", items, "at least %s items", lambda m, n: m < n),
        ("maxItems", items, "at most %s items", lambda m, n: m > n),
        ("minimum", number, "at least %s", lambda m, n: m < n),
        ("maximum", number, "at most %s", lambda m, n: m > n),
    )
    return [
        _report(F.coalesce(outside(measure, F.lit(schema[k])), F.lit(False)), path, k, text_ % schema[k], value)
        for k, measure, text_, outside in measures
        if k in schema
    ]


def _field(value: Column, name: str) -> Column:
    """A member of an object; paths know no escapes, so a name with both quotes goes by map."""
    for quote in "'\"":
        if quote not in name:
            return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
    return F.try_variant_get(value, "$", "map<string,variant>")[name]


def _members(schema: Mapping) -> list[str]:
    return list(dict.fromkeys([*schema.get("properties", {}), *(schema.get("required") or [])]))


def _check(schema: Mapping, value: Column, path: Column, at_parent: bool) -> Column:
    """Violations of a value that is present."""
    return _bind(value, lambda v, kind: _check_bound(schema, v, kind, path, at_parent))


def _check_bound(
    schema: Mapping, value: Column, kind: Column, path: Column, at_parent: bool, staged: _Staged | None = None
) -> Column:
    """`staged` holds the members' columns where they have been projected before; else each
    member is bound inside the expression."""
    found = []
    names = schema.get("type", [])
    names = [names] if isinstance(names, str) else list(names)
    known = [n for n in names if n in _KINDS]
    if known:
        fits = F.lit(False)
        for name in known:
            fits = fits | _is(value, kind, name)
        found.append(_report(~fits, path, "type", "expected " + " or ".join(names), value))
    if "enum" in schema:
        text = "one of " + json.dumps(schema["enum"], ensure_ascii=False)
        found.append(_report(~_in_enum(schema["enum"], value, kind), path, "enum", text, value))
    found += _bounds(schema, value, kind, path)

    properties, required = schema.get("properties", {}), schema.get("required") or []

    def member(name: str) -> Column:
        where = _child(path, F.lit(name))
        gap = _none()
        if name in required:
            place = path if at_parent else where
            gap = _report(F.lit(True), place, "required", f"missing {name}", value)

        def checks(field: Column, field_kind: Column) -> Column:
            below = staged and staged.members[name]
            inner = _check_bound(properties.get(name, {}), field, field_kind, where, at_parent, below)
            return F.when(field.isNull(), gap).otherwise(inner)

        if staged:
            return checks(*staged.members[name].columns())
        return _bind(_field(value, name), checks)

    members = [member(name) for name in _members(schema)]
    if members:
        found.append(F.when(_is(value, kind, "object"), F.concat(*members)).otherwise(_none()))

    if isinstance(schema.get("items"), Mapping) and schema["items"]:
        each = F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda element, i: _check(schema["items"], element, _child(path, i.cast("string")), at_parent),
        )
        found.append(F.when(_is(value, kind, "array"), F.flatten(each)).otherwise(_none()))
    return F.concat(*found) if found else _none()


class _Staged:
    """The columns of one value of a document: itself, its kind, and its members'."""

    def __init__(self, name: str):
        self.name, self.members = name, {}

    def columns(self) -> tuple[Column, Column]:
        return F.col(self.name), F.col(self.name + "_kind")


def _stage(df: DataFrame, payload: str, schema: Mapping) -> tuple[DataFrame, _Staged]:
    """Projects every member that is reachable without an array, level by level. The checks over
    these columns are generated code; only array elements need lambdas."""
    root = _Staged("_doc")
    level, values, count = [(schema, root)], {"_doc": F.try_parse_json(payload)}, 0
    while values:
        df = df.withColumns(values)
        df = df.withColumns({name + "_kind": F.schema_of_variant(name) for name in values})
        values, below = {}, []
        for node, place in level:
            for name in _members(node):
                count += 1
                child = place.members[name] = _Staged(f"_doc{count}")
                values[child.name] = _field(F.col(place.name), name)
                below.append((node.get("properties", {}).get(name, {}), child))
        level = below
    return df, root


def _with_violations(df: DataFrame, payload: str, schema: Mapping, at_parent: bool) -> DataFrame:
    staged, root = _stage(df, payload, schema)
    value, kind = root.columns()
    found = _check_bound(schema, value, kind, F.lit(""), at_parent, root)
    found = F.when(value.isNull(), _broken(F.col(payload))).otherwise(found)
    # always true, but tied to the task: Spark does not copy such a column into the filters that
    # explode() or `valid` put on it, which would evaluate all checks again for each copy
    once = F.when(F.spark_partition_id() >= 0, found)
    return staged.select(*df.columns, once.alias("violations"))


def _broken(payload: Column) -> Column:
    return F.array(
        F.struct(
            F.lit("").alias("path"),
            F.lit("json").alias("keyword"),
            F.lit("not a JSON text").alias("message"),
            payload.alias("input"),
        )
    ).cast(VIOLATION)


def violations(payload: Column, schema: Mapping, at_parent: bool = False) -> Column:
    """array<struct<path, keyword, message, input>>; empty when the payload conforms.

    A missing field is reported at its own path, or with at_parent=True at its object's.
    """
    def checks(parsed: Column, kind: Column) -> Column:
        found = _check_bound(schema, parsed, kind, F.lit(""), at_parent)
        return F.when(parsed.isNull(), _broken(payload)).otherwise(found)

    return _bind(F.try_parse_json(payload), checks)


def validate_payload(df: DataFrame, payload: str, schema: Mapping) -> DataFrame:
    """Adds `violations` and `valid` for generated payloads against their output schema."""
    return _with_violations(df, payload, schema, at_parent=False).withColumn("valid", F.size("violations") == 0)


#: A node of a schema: where its value stands, and what it must be. Nodes below an array are relative to its elements.
NODE = (
    "struct<id:int,base:int,items:int,path:string,member:string,parent:string,label:string,gap:string,missing:string,"
    "kinds:array<string>,type_message:string,enum_texts:array<string>,enum_numbers:array<double>,enum_message:string,"
    "bounds:array<struct<keyword:string,most:double,message:string>>>"
)
_BOUNDS = (
    ("minLength", "at least %s characters"), ("maxLength", "at most %s characters"), ("minItems", "at least %s items"),
    ("maxItems", "at most %s items"), ("minimum", "at least %s"), ("maximum", "at most %s"),
)


def schema_nodes(schema: Mapping, at_parent: bool = False) -> list[tuple]:
    """The nodes of a schema in the order in which they are checked; `base` is the number of the array they are below.

    A name with both kinds of quotes has no path; it is found as a `member` of its parent, and may have none itself.
    """
    nodes: list[list] = []

    def add(node: Mapping, base: int, path: str | None, member: str | None, parent: str | None, label: str, gap: str, missing: str | None) -> None:
        names = node.get("type", [])
        kinds = [n for n in ([names] if isinstance(names, str) else names) if n in _KINDS]
        enum = node.get("enum")
        is_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        own = [len(nodes), base, None, path, member, parent, label, gap, missing, kinds, "expected " + " or ".join(kinds)]
        own += [None, None, None] if enum is None else [
            [_variant_text(v) for v in enum if not is_number(v)], [float(v) for v in enum if is_number(v)], "one of " + json.dumps(enum, ensure_ascii=False)
        ]
        nodes.append([*own, [(k, float(node[k]), text % node[k]) for k, text in _BOUNDS if k in node]])
        required = node.get("required") or []
        for name in _members(node):
            where = f"{label}.{name}" if label else name
            quote = next((q for q in "'\"" if q not in name), None)
            if path is None:
                raise ValueError(f"{label}: a name with both kinds of quotes has members")
            below = None if quote is None else f"{path}[{quote}{name}{quote}]"
            add(node.get("properties", {}).get(name, {}), base, below, name if quote is None else None, path, where, label if at_parent else where, f"missing {name}" if name in required else None)
        if isinstance(node.get("items"), Mapping) and node["items"]:
            nodes[own[0]][2] = number = len(nodes)
            nodes.append([number, -2, *[None] * (len(own) + 2)])  # takes the place of the elements in the order
            add(node["items"], number, "$", None, None, "", "", None)

    add(schema, -1, "$", None, None, "", "", None)
    return [tuple(n) for n in nodes if n[1] != -2]


def _depth(nodes: Sequence[tuple]) -> int:
    """Arrays within arrays."""
    level, inside = {-1: 0}, {}
    for n in nodes:
        if n[2] is not None:
            inside[n[2]] = n[1]
    for number in sorted(inside):
        level[number] = level[inside[number]] + 1
    return max(level.values())


def compiled_schemas(templates: DataFrame, schema: str = "output_schema", key: str = "template_id", at_parent: bool = False) -> DataFrame:
    """(key, nodes, depth): the schema of each template as data. Of several schemas of a key the first by text counts."""
    kind = T.StructType([templates.select(key).schema[0], *T.StructType.fromDDL(f"nodes array<{NODE}>, depth int").fields])

    def compile_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [schema_nodes(json.loads(text), at_parent) for text in batch.column(1).to_pylist()]
            names = [f.name for f in kind["nodes"].dataType.elementType.fields]
            rows = [[dict(zip(names, n[:-1]), bounds=[dict(zip(("keyword", "most", "message"), b)) for b in n[-1]]) for n in nodes] for nodes in made]
            arrow = to_arrow_schema(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow.field("nodes").type), pa.array([_depth(n) for n in made], pa.int32())], kind.names)

    return templates.where(F.col(schema).isNotNull()).groupBy(key).agg(F.min(schema).alias("text")).mapInArrow(compile_all, kind)


def _found(value: Column, node: Column) -> Column:
    """Value of a node of `value`, by path or as a member of its parent."""
    by_name = F.try_variant_get(F.try_variant_get(value, node["parent"], "variant"), "$", "map<string,variant>")[node["member"]]
    return F.when(node["path"].isNull(), by_name).otherwise(F.try_variant_get(value, node["path"], "variant"))


def _instances(nodes: Column, value: Column, base: Column, label: Column, order: Column) -> Column:
    """The nodes of one base over one value: node, value, parent's value, label, place in the order."""

    def instance(node: Column) -> Column:
        under = lambda c: F.when(label == "", c).when(c == "", label).otherwise(F.concat(label, F.lit("."), c))
        return F.struct(
            node.alias("node"), _found(value, node).alias("value"),
            F.when(node["missing"].isNotNull(), F.try_variant_get(value, node["parent"], "variant")).alias("parent"),
            under(node["label"]).alias("label"), under(node["gap"]).alias("gap"), F.array_append(order, node["id"]).alias("order"), order.alias("base"),
        )

    return F.transform(F.filter(nodes, lambda n: n["base"] == base), instance)


def _elements(nodes: Column, found: Column) -> Column:
    """The instances within the elements of the arrays among `found`."""

    def of_array(x: Column) -> Column:
        items = F.when(x["node"]["items"].isNotNull() & _is(x["value"], F.schema_of_variant(x["value"]), "array"), F.try_variant_get(x["value"], "$", "array<variant>"))
        number = x["node"]["items"]

        def of_element(element: Column, i: Column) -> Column:
            return _instances(nodes, element, number, _child(x["label"], i.cast("string")), F.concat(x["base"], F.array(number, i)))

        return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), of_element))

    return F.flatten(F.transform(found, of_array))


def _checked(x: Column) -> Column:
    """The violations of one instance."""
    node, value = x["node"], x["value"]

    def checks(v: Column, kind: Column) -> Column:
        row = lambda keyword, message: F.array(F.struct(x["label"].alias("path"), keyword.alias("keyword"), message.alias("message"), F.to_json(v).alias("input"))).cast(VIOLATION)
        number = F.when(_is(v, kind, "number"), F.try_variant_get(v, "$", "double"))
        measure = {
            "Length": F.length(F.when(_is(v, kind, "string"), F.try_variant_get(v, "$", "string"))).cast("double"),
            "Items": F.size(F.when(_is(v, kind, "array"), F.try_variant_get(v, "$", "array<variant>"))).cast("double"),
        }
        fits = F.exists(node["kinds"], lambda k: F.coalesce(*(F.when(k == name, _is(v, kind, name)) for name in _KINDS), F.lit(False)))
        wrong_kind = (F.size(node["kinds"]) > 0) & ~fits
        listed = F.array_contains(node["enum_texts"], F.to_json(v)) | F.coalesce(F.array_contains(node["enum_numbers"], number), F.lit(False))

        def bound(b: Column) -> Column:
            k = b["keyword"]
            m = F.when(k.endswith("Length"), measure["Length"]).when(k.endswith("Items"), F.when(measure["Items"] >= 0, measure["Items"])).otherwise(number)
            outside = F.when(k.startswith("min"), m < b["most"]).otherwise(m > b["most"])
            return F.when(F.coalesce(outside, F.lit(False)), row(k, b["message"])).otherwise(_none())

        return F.concat(
            F.when(wrong_kind, row(F.lit("type"), node["type_message"])).otherwise(_none()),
            F.when(node["enum_message"].isNotNull() & ~listed, row(F.lit("enum"), node["enum_message"])).otherwise(_none()),
            F.flatten(F.transform(node["bounds"], bound)),
        )

    parent = x["parent"]
    lacks = node["missing"].isNotNull() & F.coalesce(_is(parent, F.schema_of_variant(parent), "object"), F.lit(False))
    gap = F.struct(x["gap"].alias("path"), F.lit("required").alias("keyword"), node["missing"].alias("message"), F.to_json(parent).alias("input"))
    absent = F.when(lacks, F.array(gap).cast(VIOLATION)).otherwise(_none())
    return F.when(value.isNull(), absent).otherwise(_bind(value, checks))


def validate_by_template(
    df: DataFrame, payload: str, templates: DataFrame, schema: str = "output_schema", key: str = "template_id",
    at_parent: bool = False,
) -> DataFrame:
    """Adds `violations` and `valid` for payloads against the schema of their own template.

    Schemas are data: each becomes an array of nodes, which is joined to the rows by template, so there may be any number
    of them and the plan does not grow with it (only with the depth of arrays within arrays, the one figure that is read
    when the plan is built). Rows whose template is unknown or has no schema have no violations.
    """
    nodes = compiled_schemas(templates, schema, key, at_parent)
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    rules = nodes.select(F.col(key).alias("_key"), F.col("nodes").alias("_nodes"))
    rows = df.join(rules, F.col(key) == F.col("_key"), "left").withColumn("_doc", F.try_parse_json(payload))
    no_order = F.array().cast("array<int>")
    rows = rows.withColumn("_level0", _instances(F.col("_nodes"), F.col("_doc"), F.lit(-1), F.lit(""), no_order))
    for i in range(depth):
        rows = rows.withColumn(f"_level{i + 1}", _elements(F.col("_nodes"), F.col(f"_level{i}")))
    each = [F.transform(f"_level{i}", lambda x: F.struct(x["order"].alias("order"), _checked(x).alias("v"))) for i in range(depth + 1)]
    some = F.filter(F.concat(*each), lambda x: F.size(x["v"]) > 0)
    found = F.flatten(F.transform(F.array_sort(some), lambda x: x["v"]))
    found = F.when(F.col("_nodes").isNull(), _none()).when(F.col("_doc").isNull(), _broken(F.col(payload))).otherwise(found)
    # tied to the task, so that Spark does not evaluate it again for filters on it
    once = F.when(F.spark_partition_id() >= 0, found)
    return rows.select(*(df[c] for c in df.columns), once.alias("violations")).withColumn("valid", F.size("violations") == 0)


def validate_params(df: DataFrame, params: str, schema: Mapping) -> DataFrame:
    """Adds the first violation of request parameters as `field_path` and `validation_keyword`.

    Parameter values are left out; a missing parameter is reported at the object that lacks it.
    """
    found = _with_violations(df, params, schema, at_parent=True)
    first = F.get("violations", F.lit(0))
    return found.select(
        *df.columns,
        first.isNull().alias("valid"),
        first["path"].alias("field_path"),
        first["keyword"].alias("validation_keyword"),
    )


def has_required(df: DataFrame, payload: str, required: Sequence[str]) -> DataFrame:
    """Fallback check: are all required keys there?"""
    keys = F.json_object_keys(F.col(payload))
    found = F.forall(F.array(*(F.lit(k) for k in required)), lambda k: F.array_contains(keys, k))
    return df.withColumn("valid", F.coalesce(found, F.lit(False)))


# The layout of the error summary fed back to a generator.
SUMMARY_LINE = "- 字段 %s [%s]: %s；输入: %s"
SUMMARY_TOP = "<顶层>"
SUMMARY_MORE = "- ……另有 %d 条错误未列出"


def error_summary(found: Column, limit: int = 10, width: int = 80) -> Column:
    """The first violations as lines, long inputs cut, and the number of those not shown."""

    def line(v: Column) -> Column:
        shown = F.coalesce(v["input"], F.lit("null"))
        cut = F.concat(F.substring(shown, 1, width - 3), F.lit("..."))
        shown = F.when(F.length(shown) > width, cut).otherwise(shown)
        place = F.when(v["path"] == "", SUMMARY_TOP).otherwise(v["path"])
        return F.format_string(SUMMARY_LINE, place, v["keyword"], v["message"], shown)

    lines = F.transform(F.slice(found, 1, limit), line)
    more = F.format_string(SUMMARY_MORE, F.size(found) - limit)
    tail = F.when(F.size(found) > limit, F.array(more)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, tail), "\n")
