"""Scores, calibration and agreement against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from loopstats.functions.rules import qc_route
from loopstats.operators import agreement, calibration, quality

WEIGHTS = {"kp_match": 0.3, "diff_match": 0.2, "distractor": 0.3, "unambiguous": 0.2}
SCORES = {"kp_match": 80.0, "diff_match": 90.0, "distractor": 70.0, "unambiguous": 60.0}
MAP = "map<string,double>"


def templates(spark, weights=None, threshold=70.0):
    return spark.createDataFrame(
        [("t", weights or WEIGHTS, threshold)], f"template_id string, weights {MAP}, threshold double"
    )


def score(spark, scores, override=None, weights=None):
    dims = spark.createDataFrame([("i", "t", scores)], f"item_id string, template_id string, dimension_scores {MAP}")
    own = override and spark.createDataFrame([("t", override)], f"template_id string, weights {MAP}")
    return quality.weighted_score(dims, templates(spark, weights), own).first().score


def test_weighted_score(spark):
    assert score(spark, SCORES) == 75.0
    assert score(spark, {k: v for k, v in SCORES.items() if k != "diff_match"}) == 71.25
    full = {"kp_match": 0.5, "diff_match": 0.2, "distractor": 0.1, "unambiguous": 0.2}
    assert score(spark, SCORES, full) == 77.0
    assert score(spark, SCORES, {"kp_match": 0.6}) == round(99 / 1.3, 2)
    assert score(spark, {"x": 10.0, "y": 20.0}) == 15.0
    assert score(spark, SCORES, weights={"kp_match": 0.0}) == 75.0


def test_rounds_mean(spark):
    rounds = spark.createDataFrame(
        [
            ("i", "t", 0, {"kp_match": 80.0, "diff_match": 60.0}),
            ("i", "t", 1, {"kp_match": 90.0, "other": 5.0}),
            ("i", "t", 2, {"kp_match": 100.0, "diff_match": None}),
            ("bad", "t", 0, {"other": 1.0}),
            ("none", "t", 0, {}),
        ],
        f"item_id string, template_id string, round int, scores {MAP}",
    )
    got = {r.item_id: r for r in quality.judge_rounds_mean(rounds, templates(spark)).collect()}
    assert got["i"].dimension_scores == {"kp_match": 90.0, "diff_match": 60.0} and got["i"].error is None
    assert got["bad"].error and got["none"].error and not got["bad"].dimension_scores


ROUTES = [
    (50.0, True, 0, "store"),
    (49.9, True, 0, "submit_review"),
    (40.0, True, 0, "submit_review"),
    (39.9, True, 0, "revise"),
    (45.0, False, 0, "revise"),
    (39.9, True, 3, "reject"),
]


def test_routes(spark):
    rows = spark.createDataFrame(ROUTES, "score double, gray boolean, n int, wanted string")
    route = qc_route(F.col("score"), F.lit(50.0), F.col("n"), F.lit(3), F.col("gray"), F.lit(10.0))
    assert rows.filter(route != F.col("wanted")).count() == 0


def pairs(spark, rows):
    """rows: (auto, manual, dims)"""
    data = [(str(i), "t", a, m, dims) for i, (a, m, dims) in enumerate(rows)]
    return spark.createDataFrame(
        data, f"item_id string, template_id string, auto double, manual double, auto_dims {MAP}"
    )


def dims(*values):
    return dict(zip(WEIGHTS, map(float, values)))


def fit(spark, false_passes, passes, alpha=1.0):
    labelled = pairs(spark, [(90.0, 0.0, x) for x in false_passes] + [(90.0, 100.0, x) for x in passes])
    t = templates(spark)
    gaps = calibration.leniency(labelled, t, t)
    fitted = calibration.fit_weights(gaps, t, alpha)
    return (
        {r.dim: r.weight for r in fitted.collect()},
        {r.dim: r.lenient for r in gaps.collect()},
    )


def test_lenient_dimension_loses_weight(spark):
    weights, gaps = fit(
        spark,
        [dims(71, 64, 93, 40), dims(77, 58, 99, 46), dims(74, 61, 96, 43)],
        [dims(70, 66, 76, 53), dims(72, 68, 70, 51), dims(66, 70, 72, 49), dims(64, 60, 66, 55)],
    )
    # means 74 61 96 43 against 68 66 71 52
    assert gaps == {"kp_match": 6.0, "diff_match": -5.0, "distractor": 25.0, "unambiguous": -9.0}
    # raw .3·(1−6/25), .2, 0 → floor, .2; then normalised
    raw = [0.3 * (1 - 6 / 25), 0.2, 0.0, 0.2]
    floor = sum(raw) / 4 * 0.05
    kept = [max(x, floor) for x in raw]
    assert weights == {k: round(x / sum(kept), 4) for k, x in zip(WEIGHTS, kept)}


def test_no_leniency_keeps_weights(spark):
    weights, gaps = fit(spark, [dims(41, 37, 62, 20)], [dims(55, 61, 70, 33)])
    assert weights == WEIGHTS and all(v <= 0 for v in gaps.values())


def test_no_false_passes_keeps_weights(spark):
    weights, gaps = fit(spark, [], [dims(1, 2, 3, 4)])
    assert weights == WEIGHTS and set(gaps.values()) == {0.0}


@pytest.mark.parametrize("alpha", [0.0, 1.0, 2.0])
def test_weights_sum_to_one(spark, alpha):
    weights, _ = fit(
        spark,
        [dims(61, 83, 47, 90), dims(58, 79, 52, 94)],
        [dims(72, 54, 66, 81), dims(69, 50, 61, 77), dims(75, 58, 70, 85)],
        alpha,
    )
    assert sum(weights.values()) == pytest.approx(1.0, abs=0.001) and min(weights.values()) >= 0
    if alpha == 0.0:
        assert weights == WEIGHTS


def test_unweighted_dimension_sets_the_largest_leniency(spark):
    weights, gaps = fit(spark, [{**dims(60, 50, 50, 50), "extra": 90.0}], [{**dims(50, 50, 50, 50), "extra": 50.0}])
    assert gaps["extra"] == 40.0
    raw = [0.3 * (1 - 10 / 40), 0.2, 0.3, 0.2]
    assert weights == {k: round(x / sum(raw), 4) for k, x in zip(WEIGHTS, raw)}


def records(spark, rows):
    """rows: (id, item, source, score, second)"""
    df = spark.createDataFrame(rows, "id string, item_id string, source string, score double, s bigint")
    return df.withColumns(
        {"created_at": F.timestamp_seconds("s"), "dimension_scores": F.create_map(F.lit("kp_match"), "score")}
    )


def test_earliest_record_of_each_source(spark):
    rows = records(spark, [
        ("1", "a", "auto", 10.0, 5), ("2", "a", "auto", 20.0, 1), ("3", "a", "manual_review", 0.0, 9),
        ("4", "a", "manual_review", 100.0, 10), ("5", "b", "auto", 1.0, 1), ("6", "a", "auto", 30.0, 1),
    ])
    content = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, template_id string")
    got = calibration.label_pairs(rows, content).collect()
    assert [(r.item_id, r.auto, r.manual) for r in got] == [("a", 20.0, 0.0)]


def labelled(spark, n_fp, n_ok, n_low):
    rows, items = [], []
    kinds = [("f", 90.0, 0.0)] * n_fp + [("o", 80.0, 100.0)] * n_ok + [("l", 10.0, 0.0)] * n_low
    for i, (_, auto, manual) in enumerate(kinds):
        rows += [(f"a{i}", str(i), "auto", auto, 1), (f"m{i}", str(i), "manual_review", manual, 2)]
        items.append((str(i), "t"))
    return records(spark, rows), spark.createDataFrame(items, "id string, template_id string")


def test_calibrate_guards(spark):
    for n_fp, n_ok, n_low, enough in [(5, 10, 5, True), (4, 11, 5, False), (5, 9, 5, False)]:
        recs, content = labelled(spark, n_fp, n_ok, n_low)
        row = calibration.calibrate(recs, content, templates(spark)).first()
        assert (row.sample_size, row.false_pass_cnt) == (n_fp + n_ok + n_low, n_fp)
        if enough:
            assert row.lenient["kp_match"] == 10.0 and row.weights != row.default_weights
            assert row.threshold == 80.0 and row.rejection_rate == 0.5
            assert row.note == "校准成功：5 个假阳性样本反向降权，驳回率 50.0%（目标 ≤5%）"
        else:
            assert row.weights == WEIGHTS and row.lenient == {} and row.threshold == 70.0
            assert row.note.startswith("样本不足（标注 ")


def test_calibrate_without_passes_keeps_weights(spark):
    recs, content = labelled(spark, 20, 0, 0)
    row = calibration.calibrate(recs, content, templates(spark)).first()
    assert row.weights == WEIGHTS and row.lenient == {} and row.threshold == 70.0 and "校准成功" in row.note


@pytest.mark.parametrize("n", [1, 9, 10, 11, 99, 1000])
def test_p10_is_the_exact_element(spark, n):
    values = [((i * 7919) % 1009) / 10 for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    assert calibration.p10_rank(df, "v", "g").first().p10 == sorted(values)[n // 10]


@pytest.mark.parametrize("spread", ["even", "skewed", "few"])
def test_p10_of_large_groups_uses_the_bracket(spark, spread):
    """Groups above and below the sketch's accuracy, from many partitions; rows of the bracket alone are counted by value."""
    value = {"even": "xxhash64(id) % 1000003", "skewed": "cast(pow(2, pmod(xxhash64(id), 600) / 10.0) as long)", "few": "pmod(xxhash64(id), 3)"}[spread]
    df = spark.range(0, 70_000, numPartitions=7).selectExpr("if(id < 52347, 'large', if(id < 69000, 'middle', null)) g", f"cast({value} as double) v")
    got = {r.g: (r.n, r.p10) for r in calibration.p10_rank(df, "v", "g").collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.v)
    assert got == {g: (len(v), sorted(v)[len(v) // 10]) for g, v in values.items()}


def test_p10_reads_twice_and_joins_once(spark):
    df = spark.range(100).selectExpr("id % 3 g", "id v")
    plan = calibration.p10_rank(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2 and plan.count("Join ") == 1 and plan.count("Window ") == 1



def test_kappa(spark):
    def kappa(truth, pred):
        df = spark.createDataFrame(list(zip(truth, pred)), "t int, p int")
        return agreement.cohen_kappa(df, "t", "p").first().kappa

    assert kappa([1, 0, 1, 0], [1, 0, 1, 0]) == 1.0
    assert kappa([1, 1, 1, 0, 0, 0, 1, 0], [1, 1, 0, 0, 0, 1, 1, 0]) == 0.5
    assert kappa([0, 0], [0, 0]) == 1.0
    assert kappa([0, 1, 2], [1, 2, 0]) == -0.5


def test_confusion(spark):
    pick = lambda rows: agreement.confusion(pairs(spark, [(a, m, {}) for a, m in rows])).first().asDict()
    r = pick([(80.0, 1.0), (60.0, 0.0), (80.0, 0.0), (60.0, 1.0)])
    assert [r[k] for k in ("n", "tp", "tn", "fp", "fn")] == [4, 1, 1, 1, 1]
    assert [r[k] for k in ("accuracy", "precision", "recall", "f1", "kappa")] == [0.5, 0.5, 0.5, 0.5, 0.0]
    r = pick([(50.0, 0.0), (60.0, 0.0)])
    assert (r["precision"], r["accuracy"], r["kappa"]) == (None, 1.0, 1.0)
    r = pick([])
    assert r["n"] == 0 and r["accuracy"] is None and r["kappa"] is None
    r = pick([(85.0, 0.0)])
    assert (r["fp"], r["tn"], r["tp"], r["fn"]) == (1, 0, 0, 0)


def test_stability(spark):
    rows = [("a", "single", 0.0), ("a", "single", 10.0), ("a", "multi", 4.0), ("a", "multi", 6.0),
            ("b", "single", 5.0), ("b", "multi", 5.0), ("c", "single", 1.0), ("c", "single", 2.0), ("c", "multi", 0.0), ("c", "multi", 9.0)]
    got = quality.judge_stability(spark.createDataFrame(rows, "item_id string, mode string, score double")).collect()
    got = {r.item_id: (r.var_single, r.var_multi, r.reduction, r.verdict) for r in got}
    assert got["a"] == (25.0, 1.0, 96.0, "reduced")
    assert got["b"] == (0.0, 0.0, None, "no_jitter")
    assert got["c"][3] == "not_reduced"


def test_snapshot_threshold(spark):
    rows = [("1", "i", 60.0, '{"threshold":50}'), ("2", "i", 60.0, '{"threshold":0}'), ("3", "i", 60.0, None), ("4", "i", 60.0, "{}")]
    df = spark.createDataFrame(rows, "id string, item_id string, score double, config_snapshot string").withColumns(
        {c: F.lit("x") for c in ("tenant_id", "source", "reviewer")}
    ).withColumn("template_version", F.lit(1))
    content = spark.createDataFrame([("i", "t")], "id string, template_id string")
    got = quality.quality_buckets(df, content).orderBy("effective_threshold", "total").collect()
    assert [(r.effective_threshold, r.total, r.passed) for r in got] == [(50.0, 1, 1), (70.0, 1, 0), (70.0, 2, 0)]


def test_template_defaults(spark):
    rows = [("t", [("a", 0.5), ("", 9.0), (None, 1.0), ("b", None), ("a", 0.7)], '{"quality_threshold": 55}'), ("u", [], "{}")]
    df = spark.createDataFrame(rows, "type_id string, quality_rules array<struct<id:string,weight:double>>, run_config string")
    got = {r.template_id: (r.weights, r.threshold) for r in quality.template_defaults(df).collect()}
    assert got == {"t": ({"a": 0.7, "b": 0.0}, 55.0), "u": ({}, 70.0)}
