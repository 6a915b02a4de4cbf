"""Registered text queries against their SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as contract
import cases
import corpus_pipeline as pipeline
from compare import connect, difference
from loopstats.llm import common as C, mixing
from loopstats.llm.oracle import SQL
from loopstats.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), QUERIES[name], SQL[name], sf_dir) is None


def test_all_are_registered():
    names = [n for n in contract.queries() if n in QUERIES or n == "pipeline"]
    assert len(names) == 14 and {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", ["op1_dart_minhash", "op3_quality_rules", "op4_weak_pii", "op7_sentence_pieces", "op11_token_counts", "op12_token_alignment"])
def test_one_row_for_each_document(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in C.table(spark, sf_dir, "documents").select("doc_id").collect())


@pytest.mark.parametrize("name", ["op5_water_filling", "op6_spot_signatures", "op9_line_runs", "op10_url_rules"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_pipeline_stages(spark, tmp_path):
    from test_dart_minhash import brute as classes
    from test_line_dedup import brute as lines
    from test_quality_rules import brute as metrics

    rows = [(i, t + " " + " ".join(f"own{i}x{j}" for j in range(25)) if i % 3 else t, *r) for i, t, *r in cases.corpus(41, 240)]
    rows += [(None if r[0] is None else 300 + r[0], *r[1:]) for r in cases.edge_rows()]
    docs = cases.frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(240)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stage, folder, sf = dict(pipeline.STAGES), C.scratch(spark), str(tmp_path)
    assert list(stage) == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "sentence_pieces"]

    kept = C.cut(stage["quality_rules"](spark, docs, sf), folder, "a")
    wanted = [r for r in rows if metrics(r[1])[0] >= 20 and 100 * metrics(r[1])[4] <= 30 * metrics(r[1])[0]]
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(wanted, key=repr)

    clean = C.cut(stage["line_dedup"](spark, kept, sf), folder, "b")
    texts = [(i, t) for i, _, _, t in lines(wanted, 10, True)]
    got = clean.collect()
    assert clean.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(texts, key=repr)
    assert all(r.n_chars == len(r.text) for r in got)

    one = C.cut(stage["near_duplicates"](spark, clean, sf), folder, "c")
    first = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):  # a text without id is a copy of one that has one, here
        first.setdefault(t, i)
    left = {i for i, c in classes(sorted((i, t) for t, i in first.items())).items() if i == c}
    ids = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and left <= set(ids) and len(ids) - len(left) <= 2 and len(set(ids)) == len(ids)

    mix = C.cut(stage["mixing"](spark, one, sf), folder, "d")
    plan = {r.doc_id: r for r in mixing.mixture(one, C.scratch(spark)).collect()}
    times = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert mix.columns == docs.columns
    assert all(abs(times.get(i, 0) * p.size - p.taken) <= p.size / 2 for i, p in plan.items())

    last = stage["sentence_pieces"](spark, mix, sf).collect()
    assert len(last) == mix.count() and all(r.round_trip for r in last)
    assert len(pipeline.run(spark, sf).collect()) == len(last)


def test_pipeline_on_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_family_of_copies_keeps_its_text(spark):
    text = " ".join(f"same{j}" for j in range(30))
    rows = [(i, text, "en", "s", len(text)) for i in range(20, 40)] + [(50, "alone " + text, "en", "s", 1), (9, None, "en", "s", 0), (60, "", "en", "s", 0)]
    rows += [(None, text, "en", "s", 1), (20, text, "en", "s", len(text))]
    stage = dict(pipeline.STAGES)
    clean = C.cut(stage["line_dedup"](spark, cases.frame(spark, rows), ""), C.scratch(spark), "a")
    assert clean.where("text = ''").count() == 2 and clean.count() == len(rows)
    got = [(r.doc_id, r.text) for r in stage["near_duplicates"](spark, clean, "").collect()]
    assert sorted(got) == [(9, ""), (20, text)]  # 50 is a near copy
