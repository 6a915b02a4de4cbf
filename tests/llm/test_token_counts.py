import random

import pytest

import cases
from loopstats.llm import blocks as B, common as C, token_counts as T

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

AWKWARD = ["a ", "  a   b  ", " ", "▁ ▁▁a", "a▁ b", "<s> </s><unk> <0x41>", "\n\t x\r\n", "x" * 3000, "日本語 漢字 \U0001f600\u0001", "    "]


@pytest.fixture(scope="module")
def model():
    return T.load_model()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_counts_are_those_of_the_library(spark, sf_dir, folder, model, library):
    docs = C.table(spark, sf_dir, "documents")
    got = T.token_counts(docs, model, folder, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    assert [r.n_tokens for r in got] == [len(x) for x in library.encode([r.text or "" for r in got])]
    assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 4096) for r in got)
    assert any(r.over_limit for r in got)


def test_awkward_rows(spark, folder, model, library):
    rng = random.Random(8)
    rows = cases.edge_rows() + [(100 + i, t, "en", "a", 1) for i, t in enumerate(AWKWARD)]
    rows += [(200 + i, "".join(rng.choice(["the ", "er", " ", "  ", "é", "\n", "12", "日", ".", "▁"]) for _ in range(40)), "en", "a", 1) for i in range(200)]
    got = T.token_counts(cases.frame(spark, rows, clashes=True), model, folder, ["doc_id", "text", "key", "at"], limit=20).collect()
    assert sorted([repr((r.doc_id, r.text)) for r in got]) == sorted(repr((r[0], r[1])) for r in rows)
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(r.text or "")), len((r.text or "").encode())), r.text
        assert r.over_limit == (r.n_tokens > 20) and (r.key, r["at"]) == ("x", "x")


def test_small_blocks_give_the_same(spark, folder, model, library, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 500)
    monkeypatch.setattr(B.cut_batch, "__defaults__", (300,))
    rows = cases.corpus(3, 120)
    got = T.token_counts(cases.frame(spark, rows).repartition(5), model, folder).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {r[0]: len(library.encode(r[1])) for r in rows}
    assert spark.read.parquet(f"{folder}/blocks").count() > 20


def test_empty_table_and_refused_names(spark, folder, model):
    assert T.token_counts(cases.empty(spark), model, folder).count() == 0
    with pytest.raises(ValueError):
        T.token_counts(cases.frame(spark, cases.edge_rows()), model, f"{folder}/x", ["n_tokens"])


def test_frequencies_stay_with_their_block(spark, sf_dir, folder, model):
    df = T.token_counts(C.table(spark, sf_dir, "documents"), model, folder)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FlatMapGroupsInArrow") == 1 and "text" not in plan
