"""Hashes, redaction and conformance."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from loopstats.functions import jsons, redaction
from loopstats.operators import hygiene, validate


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_canonical_json(spark):
    text = '{"b": [1, {"z": "é", "a": null}], "a": 1.50}'
    assert one(spark, text, lambda c: jsons.canonical_json(c, exact=True)) == '{"a":1.5,"b":[1,{"a":null,"z":"é"}]}'
    assert one(spark, text, jsons.canonical_json) == '{"a":1.5,"b":[1,{"a":null,"z":"é"}]}'
    for bad in ("{", "{'a':1}"):
        assert one(spark, bad, jsons.canonical_json) is None
        assert one(spark, bad, lambda c: jsons.canonical_json(c, exact=True)) is None


@pytest.mark.parametrize("exact", [False, True])
def test_fingerprint(spark, exact):
    def digest(template, params, version=None):
        return one(spark, json.dumps(params), lambda c: jsons.request_fingerprint(
            F.lit(template), c, version and F.lit(version), exact))

    base = digest("single_choice", {"topic": "greeting", "level": 2})
    assert base == digest("single_choice", {"level": 2, "topic": "greeting"})
    assert base != digest("single_choice", {"topic": "greeting", "level": 3})
    assert base != digest("cloze", {"topic": "greeting", "level": 2})
    assert base != digest("single_choice", {"topic": "greeting", "level": 2}, "v2")
    if exact:
        assert base == hashlib.sha256(b'single_choice|{"level": 2, "topic": "greeting"}').hexdigest()


def test_unwrap(spark):
    unwrap = lambda doc: json.loads(one(spark, json.dumps(doc), lambda c: jsons.unwrap_payload(c, ["stem", "answer"])))
    item = {"stem": "x", "answer": "A"}
    for doc in (item, {"result": item}, {"questions": [item]}, {"n": 1, "list": [3, {"stem": 1}, item], "z": {**item, "q": 1}}):
        assert unwrap(doc) == item
    for doc in ({"stem": "x"}, [item], {"questions": [{"stem": "x"}]}, {"questions": []}):
        assert unwrap(doc) == doc
    assert one(spark, "not json", lambda c: jsons.unwrap_payload(c, ["stem"])) == "not json"


def test_redact_nested_json(spark):
    data = [
        {"store": {"items": [[{"jwt-secret": 17, "count": 2}], "secret : q;z"]}},
        {"ACCESS-TOKEN": ["x", {"y": 1}], "tokenized": "bearer k9, then password=a b"},
        None, 3.5, True, "plain",
    ]
    out = json.loads(one(spark, json.dumps(data), redaction.redact_json))
    assert out[0] == {"store": {"items": [[{"jwt-secret": "[REDACTED]", "count": 2}], "secret : [REDACTED];z"]}}
    assert out[1] == {"ACCESS-TOKEN": "[REDACTED]", "tokenized": "bearer [REDACTED], then password=[REDACTED] b"}
    assert out[2:] == [None, 3.5, True, "plain"]


TEXTS = [
    "api-key: abc,def token=1;2",
    "BEARER  x.y.z password =  p　rest",
    "no credentials here",
    "secret= v access_token:q refreshtoken=r",
    "token=" + "a" * 3000,
    "é" * 2001,
]


def test_column_and_batch_forms_agree(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    both = lambda most: rows.select(
        "x", redaction.redact_text(F.col("x"), most).alias("a"),
        F.get_json_object(redaction.redact_json(F.to_json(F.struct("x")), most), "$.x").alias("b"),
    ).collect()
    got = both(None)
    assert all(r.a == r.b for r in got)
    by_text = {r.x: r.a for r in got}
    assert by_text[TEXTS[0]] == "api-key: [REDACTED],def token=[REDACTED];2"
    assert by_text[TEXTS[1]] == "BEARER  [REDACTED] password =  [REDACTED]　rest"
    assert by_text[TEXTS[2]] == TEXTS[2]
    assert by_text[TEXTS[4]] == "token=[REDACTED]"
    assert by_text[TEXTS[5]] == TEXTS[5]  # masking drops nothing; cutting is asked for
    cut = both(redaction.STORED_LENGTH)
    assert all(r.a == r.b for r in cut) and {r.x: r.a for r in cut}[TEXTS[5]] == "é" * 2000 + "...[truncated]"


def test_redaction_is_a_fixpoint(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS[:4]], "x string")
    once = redaction.redact_text(F.col("x"))
    assert rows.filter(redaction.redact_text(once) != once).count() == 0


def test_sensitive_keys(spark):
    names = ["token", "JWT-Secret", "apikey", "my_apikey", "tokenizer", "x_authorization", "access-token"]
    rows = spark.createDataFrame([(n,) for n in names], "k string")
    got = [r.k for r in rows.filter(redaction.is_sensitive(F.col("k"))).collect()]
    assert got == ["token", "JWT-Secret", "apikey", "x_authorization", "access-token"]


def test_secret_scan_counts(spark):
    docs = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[2]), (3, "Bearer a bearer b token=c")], "doc_id bigint, text string")
    got = {(r.doc_id, r.kind): r.hits for r in hygiene.secret_scan(docs).collect()}
    assert got == {(1, "api_key"): 1, (1, "token"): 1, (3, "bearer"): 2, (3, "token"): 1}


def check(spark, doc, schema, keyword=None):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    found = one(spark, text, lambda c: validate.violations(c, schema))
    rows = spark.createDataFrame([(text,)], "p string")
    staged = validate.validate_payload(rows, "p", schema).first()
    assert staged.violations == found and staged.valid == (not found)
    return [(v.path, v.keyword) for v in found]


def obj(**properties):
    return {"type": "object", "properties": properties, "required": list(properties)}


CASES = [
    (obj(o={"type": "array", "minItems": 3, "maxItems": 6}), {"o": [1, 2, 3]}, []),
    (obj(o={"type": "array", "minItems": 3}), {"o": [1, 2]}, [("o", "minItems")]),
    (obj(o={"type": "array", "maxItems": 1}), {"o": [1, 2]}, [("o", "maxItems")]),
    (obj(o={"type": "array", "items": {"type": "string"}}), {"o": []}, []),
    (obj(o={"type": "array", "items": {"type": "string"}}), {"o": ["a", 1, None]}, [("o.1", "type"), ("o.2", "type")]),
    (obj(d={"type": "string", "enum": ["easy", "hard"]}), {"d": "超难"}, [("d", "enum")]),
    (obj(d={"type": "string", "enum": ["easy", "hard"]}), {"d": "easy"}, []),
    (obj(s={"type": "string", "minLength": 10}), {"s": "12345"}, [("s", "minLength")]),
    (obj(s={"type": "string", "maxLength": 5}), {"s": "ABCDEF"}, [("s", "maxLength")]),
    (obj(s={"type": "string", "minLength": 2, "maxLength": 2}), {"s": "题目"}, []),
    (obj(n={"type": "integer", "minimum": 2, "maximum": 6}), {"n": 7}, [("n", "maximum")]),
    (obj(n={"type": "integer"}), {"n": 2.5}, [("n", "type")]),
    (obj(n={"type": "integer"}), {"n": 2.0}, []),
    (obj(n={"type": "number"}), {"n": True}, [("n", "type")]),
    (obj(n={"type": "boolean"}), {"n": True}, []),
    (obj(n={"type": "string"}), {"n": None}, [("n", "type")]),
    (obj(n={"type": ["string", "null"]}), {"n": None}, []),
    (obj(n={"type": "file"}), {"n": 1}, []),
    (obj(a={}, b={}), {}, [("a", "required"), ("b", "required")]),
    ({"type": "object", "properties": {"a": {"type": "string"}}}, {}, []),
    (obj(q={"type": "array", "minItems": 2, "items": obj(s={"type": "string"})}), {"q": [{"s": 1}]}, [("q", "minItems"), ("q.0.s", "type")]),
    (obj(q={"type": "array", "items": obj(s={})}), {"q": [{}, {"s": 1}, 5]}, [("q.0.s", "required"), ("q.2", "type")]),
    (obj(m=obj(level={"type": "integer"})), {"m": {}}, [("m.level", "required")]),
    ({"type": "array", "items": {"type": "integer"}}, [1, "x"], [("1", "type")]),
    (obj(**{"it's a.key": {"type": "string"}}), {"it's a.key": 3}, [("it's a.key", "type")]),
    (obj(a={}), "not json", [("", "json")]),
    (obj(a={}), [1], [("", "type")]),
]


@pytest.mark.parametrize("schema, doc, expected", CASES)
def test_violations(spark, schema, doc, expected):
    assert check(spark, doc, schema) == expected


def test_params_report_the_object(spark):
    schema = obj(topic={"type": "string"}, options_count={"type": "integer", "minimum": 2})
    rows = spark.createDataFrame([('{"topic":"x"}',), ('{"topic":"x","options_count":1}',), ('{"topic":"x","options_count":2}',)], "p string")
    got = [(r.valid, r.field_path, r.validation_keyword) for r in validate.validate_params(rows, "p", schema).collect()]
    assert got == [(False, "", "required"), (False, "options_count", "minimum"), (True, None, None)]


def test_error_summary(spark):
    schema = obj(**{f"f{i:02d}": {"type": "string"} for i in range(12)})
    doc = json.dumps({**{f"f{i:02d}": i for i in range(11)}, "f11": ["y" * 200]})
    text = one(spark, doc, lambda c: validate.error_summary(validate.violations(c, schema)))
    lines = text.split("\n")
    assert len(lines) == 11 and lines[0] == "- 字段 f00 [type]: expected string；输入: 0"
    assert lines[10] == "- ……另有 2 条错误未列出"
    long = one(spark, json.dumps({"f": ["y" * 200]}), lambda c: validate.error_summary(validate.violations(c, obj(f={"type": "string"}))))
    shown = re.search("输入: (.*)$", long)[1]
    assert len(shown) == 80 and shown.endswith("...")
    assert one(spark, "{}", lambda c: validate.error_summary(validate.violations(c, {"type": "object"}))) == ""


def test_has_required(spark):
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1}',), ("x",)], "p string")
    assert [r.valid for r in validate.has_required(rows, "p", ["a", "b"]).collect()] == [True, False, False]


def test_enum_compares_numbers_as_numbers(spark):
    schema = {"properties": {"n": {"enum": [1000, 2.5, "1000", True, None]}}}
    docs = ['{"n":1e3}', '{"n":1000.0}', '{"n":1000}', '{"n":2.50}', '{"n":"1000"}', '{"n":true}', '{"n":null}', '{"n":1001}', '{"n":"2.5"}', '{"n":1}', '{"n":false}']
    rows = spark.createDataFrame([(x,) for x in docs], "x string")
    got = {r.x: r.valid for r in validate.validate_payload(rows, "x", schema).collect()}
    assert [got[x] for x in docs] == [True] * 7 + [False] * 4


def test_each_template_has_its_schema(spark):
    templates = spark.createDataFrame(
        [("a", '{"required":["x"]}'), ("b", '{"required":["x"]}'), ("c", '{"properties":{"x":{"type":"integer"}}}'), ("d", None)],
        "template_id string, output_schema string",
    )
    rows = spark.createDataFrame([(t, doc) for t in ("a", "b", "c", "d", None) for doc in ('{"x":1}', '{"x":"s"}', "{}", "no")], "template_id string, doc string")
    got = validate.validate_by_template(rows, "doc", templates).collect()
    bad = sorted((r.template_id, r.doc, [v.keyword for v in r.violations]) for r in got if not r.valid)
    assert bad == [(t, doc, [k]) for t in "ab" for doc, k in (("no", "json"), ("{}", "required"))] + [("c", "no", ["json"]), ("c", '{"x":"s"}', ["type"])]


SCHEMAS = [
    {"type": "object", "required": ["stem", "options"], "properties": {
        "stem": {"type": "string", "minLength": 3, "maxLength": 6}, "level": {"enum": ["a", 2, True, None, {"k": [1]}]},
        "options": {"type": "array", "minItems": 2, "maxItems": 3, "items": {"type": "object", "required": ["t"], "properties": {"t": {"type": "string"}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}}}},
        "meta": {"type": "object", "required": ["who"], "properties": {"who": {"type": "string"}, "deep": {"type": "object", "required": ["x"]}}}}},
    {"type": "array", "minItems": 1, "items": {"type": "array", "items": {"type": "number", "maximum": 5}}},
    {"type": "array", "items": {"type": "object", "required": ["rows"], "properties": {"rows": {"items": {"items": {"type": "string", "maxLength": 2}}}, "a.b": {"type": "null"}, "it's": {"type": "integer"}}}},
    {"required": ["a"], "properties": {"b": {"type": "boolean"}, "it's \"x\"": {"type": "string"}}},
    {},
]
DOCS = [
    '{"stem":"abcd","options":[{"t":"x"},{"t":"y","n":3}],"level":2}', '{"stem":"ab","options":[{"t":1,"n":0},{},5,{"t":"z","n":null},{"n":10.5}],"level":"z"}',
    '{"options":"none","meta":{"deep":{}}}', '{"stem":null,"options":[],"level":{"k":[1]},"meta":7}', '{"stem":"toolong!","options":[[],{"t":"q","n":"s"}],"level":null,"meta":{"who":"me","deep":{"x":1}}}',
    "[]", "[[1,2],[7,\"s\"],3]", '[{"rows":[["a","bcd"],["efg",4]],"a.b":1,"it\'s":2.5},{},{"rows":"x","it\'s":3},4]', '{"a":1,"b":"x","it\'s \\"x\\"":4}', '{"b":true}', "3", "null", '"s"', "{broken", "", None,
]


@pytest.mark.parametrize("at_parent", [False, True])
def test_schemas_as_data_find_what_compiled_ones_find(spark, at_parent):
    templates = spark.createDataFrame([(str(i), json.dumps(x)) for i, x in enumerate(SCHEMAS)] + [("none", None)], "template_id string, output_schema string")
    rows = spark.createDataFrame([(i, t, x) for t in [*map(str, range(len(SCHEMAS))), "none", None, "other"] for i, x in enumerate(DOCS)], "n int, template_id string, doc string")
    got = validate.validate_by_template(rows, "doc", templates, at_parent=at_parent)
    assert got.columns == ["n", "template_id", "doc", "violations", "valid"]
    found = {(r.template_id, r.n): [tuple(v) for v in r.violations] for r in got.collect()}
    some = 0
    for t, schema in enumerate(SCHEMAS):
        wanted = rows.filter(F.col("template_id") == str(t)).select("n", validate.violations(F.col("doc"), schema, at_parent).alias("v")).collect()
        for r in wanted:
            assert found[str(t), r.n] == [tuple(v) for v in r.v], (schema, DOCS[r.n])
            some += len(r.v)
    assert some > 60 and not any(found[t, i] for t in ("none", None, "other") for i in range(len(DOCS)))


def test_five_thousand_schemas(spark):
    text = """concat('{"type":"object","required":["f', id, '"],"properties":{"f', id, '":{"type":"integer","maximum":', id, '}}}')"""
    templates = spark.range(5000).selectExpr("concat('t', id) template_id", f"{text} output_schema")
    rows = spark.range(20_000).selectExpr("concat('t', id % 5000) template_id", """concat('{"f', id % 5000, '":', id % 5000 + if(id >= 10000, 1, 0), '}') doc""")
    got = validate.validate_by_template(rows, "doc", templates)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 60_000  # does not grow with the schemas
    counts = {(r.valid, r.k): r["count"] for r in got.groupBy("valid", F.get("violations", F.lit(0))["keyword"].alias("k")).count().collect()}
    assert counts == {(True, None): 10_000, (False, "maximum"): 10_000}


def test_names_that_have_no_path(spark):
    schema = {"properties": {"a'\"b": {"properties": {"c": {"type": "string"}}}}}
    with pytest.raises(ValueError):
        validate.schema_nodes(schema)
