"""Typed tables, document files, and every writer."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loopstats.operators import calibration, knowledge, samples
from loopstats.schemas import TABLES
from loopstats.sources import derive, documents, sinks, tables


def test_tables_round_trip(spark, tmp_path, sf_dir):
    derive.content_item(spark, sf_dir).write.parquet(str(tmp_path / "content_item"))
    df = tables.load(spark, str(tmp_path), "content_item")
    assert df.filter("status = 'passed'").count() == 40
    assert df.filter("failure_code is not null").count() == 0
    assert len(TABLES) == 13


def test_every_schema_parses(spark):
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {
        "plain.txt": "héllo".encode(),
        "two.dots.MD": "中文".encode("gb18030"),
        "broken.txt": b"ok \xff",
        "pic.png": b"x",
        "noext": b"x",
        "paper.pdf": b"%PDF",
        "a b+c.txt": b"name",
        "big.txt": b"y" * (documents.MAX_BYTES + 1),
    }
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    ok, rejected = documents.read_documents(spark, str(tmp_path / "in"))
    texts = {r.source_name: r.text for r in ok.collect()}
    assert texts == {
        "plain": "héllo", "two.dots": "中文", "broken": b"ok \xff".decode("gb18030", "replace"), "a b+c": "name",
    }
    reasons = {Path(r.path).name: r.reason for r in rejected.collect()}
    assert reasons == {
        "pic.png": "unsupported_extension", "noext": "unsupported_extension",
        "paper.pdf": "no_parser", "big.txt": "too_large",
    }


def test_empty_and_nameless_files(spark):
    rows = [("/x/empty.md", 0, b""), ("/x/.txt", 1, b"x"), ("/x/a.md", 1, b"x")]
    ok, rejected = documents.screen_documents(spark.createDataFrame(rows, "path string, length bigint, content binary"))
    assert [r.source_name for r in ok.collect()] == ["a"]
    assert {(r.source_name, r.reason) for r in rejected.collect()} == {("empty", "empty"), (".txt", "unsupported_extension")}


def test_small_limit(spark):
    rows = [(f"/x/{n}.txt", n, b"y" * n) for n in (19, 20, 21)] + [("/x/22.bin", 22, b"y" * 22)]
    ok, rejected = documents.screen_documents(spark.createDataFrame(rows, "path string, length bigint, content binary"), 20)
    assert sorted(r.source_name for r in ok.collect()) == ["19", "20"]
    assert {(r.source_name, r.reason) for r in rejected.collect()} == {("21", "too_large"), ("22", "too_large")}


def test_size_guard_is_pushed_down(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_bytes(b"x")
    ok, rejected = documents.read_documents(spark, str(tmp_path))
    ok.explain()
    assert "LessThanOrEqual(length" in capsys.readouterr().out
    rejected.explain()
    assert "ReadSchema: struct<path:string,length:bigint>" in capsys.readouterr().out


def pool(spark):
    rows = [
        ("1", "t", "auto", "sft", "kp", '{"stem":"题","n":[1,2]}', '{"qc_score":95.0}', 1),
        ("2", "t", "auto", "sft", None, "plain text", None, 3),
        ("3", "u", "manual", "sft", "kp", '{"a":1}', "{}", 2),
    ]
    columns = "id string, template_id string, source string, purpose string, knowledge_point string, payload string, meta string, s bigint"
    return spark.createDataFrame(rows, columns).withColumn("created_at", F.timestamp_seconds("s"))


def read_lines(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_export(spark, tmp_path):
    sinks.export_jsonl(pool(spark), str(tmp_path / "all"))
    lines = read_lines(tmp_path / "all")
    assert [list(x) for x in lines] == [list(sinks.EXPORT_KEYS)] * 3
    assert [x["payload"] for x in lines] == ["plain text", {"a": 1}, {"stem": "题", "n": [1, 2]}]
    assert lines[0]["meta"] is None and lines[0]["knowledge_point"] is None and lines[2]["meta"] == {"qc_score": 95}
    stored = "".join(part.read_text() for part in sorted((tmp_path / "all").glob("part-*")))
    assert '"payload":{"stem":"题","n":[1,2]},"meta":{"qc_score":95.0}}' in stored  # spelling and order as stored
    sinks.export_jsonl(pool(spark), str(tmp_path / "some"), {"source": "auto"}, cap=1)
    assert [x["payload"] for x in read_lines(tmp_path / "some")] == ["plain text"]


def test_export_of_odd_payloads(spark, tmp_path):
    odd = ['{"z":1e3,\n"a":"}"}', "[1.0]", "{broken", '"quoted"', "", "a\nb", "}}", "95"]
    rows = [(str(i), "t}", "s", "p", "k}", x, x, i) for i, x in enumerate(odd)]
    columns = "id string, template_id string, source string, purpose string, knowledge_point string, payload string, meta string, s bigint"
    frame = spark.createDataFrame(rows, columns).withColumn("created_at", F.timestamp_seconds(-F.col("s")))
    sinks.export_jsonl(frame.coalesce(1), str(tmp_path / "odd"))
    lines = read_lines(tmp_path / "odd")
    assert [x["payload"] for x in lines] == [{"z": 1000.0, "a": "}"}, [1.0], *odd[2:]]
    assert all(x["meta"] == x["payload"] and x["knowledge_point"] == "k}" for x in lines)


def test_chunks_and_append(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 600)], "doc_id bigint, text string")
    vectors = spark.createDataFrame([], "doc_id bigint, chunk_index int, embedding array<float>")
    rows = knowledge.index_documents(docs, vectors, source_type="book")
    sinks.write_chunks(rows, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert stored.filter("source_type = 'book'").count() == 2
    with pytest.raises(KeyError):
        tables.load(spark, str(tmp_path), "unknown")


def test_a_run_is_appended_once(spark, tmp_path):
    log = sinks.AppendLog(spark, str(tmp_path / "log"))
    assert log.read("id bigint").count() == 0
    assert [sinks.append(spark.range(3).toDF("id"), log.path, run) for run in ("2024-05-01", "a/b", "2024-05-01")] == [True, True, False]
    assert sorted(r.id for r in log.read().collect()) == [0, 0, 1, 1, 2, 2]
    assert list(log.runs()) == ["2024-05-01", "a/b"]


def test_a_run_killed_before_its_entry_leaves_nothing(spark, tmp_path, monkeypatch):
    log = sinks.AppendLog(spark, str(tmp_path / "log"))
    log.append(spark.range(2).toDF("id"), "one")
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        log.append(broken, "two")
    with monkeypatch.context() as m:  # the rows are written, the entry is not
        m.setattr(log.files, "write", lambda *_, **__: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            log.append(spark.range(5).toDF("id"), "two")
    assert log.read().count() == 2
    assert log.append(spark.range(5).toDF("id"), "two") and not log.append(spark.range(5).toDF("id"), "two")
    assert log.read().count() == 7
    assert not log.sweep(keep=["two"])
    assert len(log.sweep()) >= 1 and log.sweep() == [] and log.read().count() == 7


def test_the_second_of_two_runs_at_once_is_dropped(spark, tmp_path):
    log = sinks.AppendLog(spark, str(tmp_path / "log"))
    seen = iter([False])
    other = sinks.AppendLog(spark, log.path)
    exists = log.files.exists
    log.files.exists = lambda name: next(seen, None) if name.endswith("once.json") and not other.runs() else exists(name)

    def meanwhile(batch):
        other.append(spark.range(2).toDF("id"), "once")
        return batch

    rows = spark.range(9).toDF("id")
    write = log.files.write
    log.files.write = lambda *a, **k: (meanwhile(None), write(*a, **k))[1]
    assert not log.append(rows, "once")
    assert log.read().count() == 2 and other.sweep() == []


def test_calibrations_and_samples_append_once(spark, sf_dir, tmp_path):
    records, content, templates = derive.quality_record(spark, sf_dir), derive.content_item(spark, sf_dir), derive.quality_templates(spark, sf_dir)
    fitted = tables.as_table(calibration.calibrate(records, content, templates), "quality_calibration", "2024-05-01", ["template_id"])
    path = str(tmp_path / "quality_calibration")
    assert sinks.append(fitted, path, "day 1") and not sinks.append(fitted, path, "day 1")
    assert tables.load(spark, str(tmp_path), "quality_calibration").count() == fitted.count() > 0
    pool = sinks.AppendLog(spark, str(tmp_path / "sample_pool"))
    tasks = derive.generation_task(spark, sf_dir)
    assert [samples.sync_into(content, tasks, pool, run) for run in ("a", "a", "b")] == [True, False, True]
    rows = tables.load(spark, str(tmp_path), "sample_pool")
    wanted = content.filter(F.col("status").isin("passed", "published")).count()
    assert rows.count() == wanted == rows.select("item_id").distinct().count() > 0


def test_bucketed_tables_join_without_exchange(spark, sf_dir, tmp_path):
    docs = derive.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_name"))
    chunks = knowledge.index_documents(docs, embed=lambda texts: [[len(t), 1.0] for t in texts]).drop("embedding")
    vectors = docs.select("doc_id", F.length("text").alias("size"))
    for frame, name in ((chunks, "kb_chunks"), (vectors, "kb_sizes")):
        sinks.write_bucketed(frame, name, str(tmp_path / name), "doc_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("kb_chunks").join(spark.table("kb_sizes"), "doc_id")
        counts = joined.groupBy("doc_id").agg(F.count("*").alias("n"))
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert counts.agg(F.sum("n")).first()[0] == chunks.count()
        one = spark.table("kb_chunks").filter("doc_id = 7")
        one.collect()
        read = [f.rsplit("_", 1)[1][:5] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]]
        assert len(set(read)) == 1  # files of one bucket
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not say so
        plan = spark.table("kb_chunks").filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "SelectedBucketsCount: 1 out of 4" in plan
        sinks.write_bucketed(vectors.limit(3), "kb_sizes", str(tmp_path / "kb_sizes"), "doc_id", 4)  # a second run appends
        schema = spark.table("kb_chunks").schema
        spark.sql("DROP TABLE kb_chunks")
        again = sinks.open_bucketed(spark, "kb_again", str(tmp_path / "kb_chunks"), schema, "doc_id", 4)
        both = again.join(spark.table("kb_sizes"), "doc_id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert again.count() == chunks.count() and spark.table("kb_sizes").count() == vectors.count() + 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("kb_chunks", "kb_sizes", "kb_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
