"""Streaming jobs against their batch twins, on files read batch by batch."""

import pytest
from pyspark.sql import Window, functions as F

from loopstats.operators import cost, lifecycle
from loopstats.sources import derive as d
from loopstats.sources.sinks import Ledger, parquet_sink, replay, write_traces
from loopstats.streaming import jobs


@pytest.fixture(scope="module")
def calls_dir(spark, sf_dir, tmp_path_factory):
    """The call log in four files, in time order."""
    path = str(tmp_path_factory.mktemp("calls"))
    log = d.trace_log(spark, sf_dir).withColumn("output_data", F.lit('{"api_key":"k","x":"token=abc"}'))
    quarter = F.ntile(4).over(Window.orderBy("created_at", "id"))
    split = log.withColumn("q", quarter).persist()
    for q in range(1, 5):
        split.filter(F.col("q") == q).drop("q").coalesce(1).write.mode("append").parquet(path)
    split.unpersist()
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, mode, tmp_path, name):
    """Runs to the end of the input; the memory table holds what was emitted."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    query = writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ingest_redacts_and_prices_for_every_sink(spark, sf_dir, calls_dir, tmp_path):
    sinks = {n: parquet_sink(str(tmp_path / n)) for n in "ab"}
    prices = d.model_prices(spark, sf_dir)
    query = jobs.st_trace_ingest(stream(spark, calls_dir), prices, sinks, str(tmp_path / "ck"))
    query.awaitTermination(300)
    assert query.exception() is None
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    wanted = jobs.clean_calls(spark.read.parquet(calls_dir), prices)
    assert rows(a.select("id", "cost", "output_data")) == rows(wanted.select("id", "cost", "output_data")) == rows(b.select("id", "cost", "output_data"))
    assert a.select("output_data").first()[0] == '{"api_key":"[REDACTED]","x":"token=[REDACTED]"}'


def numbers(spark, path, first, last):
    """Files of ten rows, one for each number of the range."""
    for i in range(first, last):
        spark.range(10 * i, 10 * i + 10, numPartitions=1).write.mode("append").parquet(path)


class Sink:
    """Notes each batch it takes; refuses while it is down."""

    def __init__(self, down=()):
        self.down, self.took, self.tried = down, [], []

    def __call__(self, batch, batch_id):
        self.tried.append(batch_id)
        if self.down is True or batch_id in self.down:
            raise OSError("down")
        self.took.append((batch_id, sorted(r.id for r in batch.collect())))


def start(spark, tmp_path, sinks):
    query = write_traces(stream(spark, str(tmp_path / "in")), sinks, str(tmp_path / "ck"))
    query.awaitTermination(300)
    assert query.exception() is None


def test_a_dead_sink_stops_no_other(spark, tmp_path):
    """Three starts with one sink down and one well; then the first recovers and gets what it missed, in order."""
    well, dead, book = Sink(), Sink(down=True), Ledger(spark, str(tmp_path / "ck/sinks"))
    for k in range(3):
        numbers(spark, str(tmp_path / "in"), 2 * k, 2 * k + 2)
        start(spark, tmp_path, {"well": well, "dead": dead})
        assert [b for b, _ in well.took] == list(range(2 * k + 2)) and dead.took == []
        assert book.waiting("dead") == list(range(2 * k + 2)) and book.waiting("well") == []
    assert sorted(i for _, ids in well.took for i in ids) == list(range(60))
    assert set(dead.tried) == {0}  # later batches wait behind the first
    dead.down = (4,)
    assert replay(spark, {"dead": dead, "well": well}, book.path) == {"dead": [4, 5], "well": []}
    dead.down = ()
    numbers(spark, str(tmp_path / "in"), 6, 7)
    start(spark, tmp_path, {"well": well, "dead": dead})
    assert [b for b, _ in dead.took] == list(range(7)) == [b for b, _ in well.took]
    assert dict(dead.took) == dict(well.took) and book.waiting("dead") == []
    assert not list((tmp_path / "ck/sinks/dead_letters").rglob("*.parquet"))


def test_a_batch_that_comes_again_goes_where_it_is_missing(spark, tmp_path, monkeypatch):
    """The stream ends at the second of two sinks, as its dead letters cannot be written either."""
    numbers(spark, str(tmp_path / "in"), 0, 1)
    first, later = Sink(), Sink(down=True)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "put_aside", lambda *_: (_ for _ in ()).throw(OSError("no room")))
        with pytest.raises(Exception, match="no room"):
            start(spark, tmp_path, {"first": first, "later": later})
    later.down = ()
    start(spark, tmp_path, {"first": first, "later": later, "new": Sink()})
    assert [b for b, _ in first.took] == [0] == [b for b, _ in later.took]


def test_the_ledger_survives_odd_names_and_lost_entries(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"))
    name = "s3 / trace=log"
    for batch_id in range(4):
        assert not book.has(name, batch_id)
        if batch_id % 2:
            book.put_aside(name, batch_id, spark.range(batch_id))
        else:
            book.took(name, batch_id)
        assert book.has(name, batch_id)
    assert book.waiting(name) == [1, 3] and book.set_aside(name, 3).count() == 3
    book.files.write("state/s3%20%2F%20trace%3Dlog/9.json.draft", "{")  # a draft that was never renamed
    assert Ledger(spark, book.path).waiting(name) == [1, 3] and len(list((tmp_path / "book/state").rglob("*.json"))) == 2


def test_replayed_batch_is_not_stored_twice(spark, tmp_path):
    emit = parquet_sink(str(tmp_path / "out"))
    for _ in range(2):
        emit(spark.range(5).toDF("id"), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_cost_windows(spark, calls_dir, tmp_path):
    got = run(jobs.st_cost_windows(stream(spark, calls_dir)), "append", tmp_path, "cost_windows")
    batch = jobs.st_cost_windows(spark.read.parquet(calls_dir))
    last = batch.agg(F.max("end")).first()[0]
    # the window the watermark has not passed yet stays open
    assert rows(got) == rows(batch.filter(F.col("end") < F.lit(last)))
    sliding = jobs.st_cost_windows(stream(spark, calls_dir), "2 hours", "24 hours", "1 hour")
    assert run(sliding, "append", tmp_path, "sliding").count() > got.count() * 10


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    for hours in ([0, 50], [60], [1, 70], [200]):
        df = spark.createDataFrame([(h * 3600, "m", 1.0) for h in hours], "s bigint, model string, cost double")
        df.select(F.timestamp_seconds("s").alias("created_at"), "model", "cost").coalesce(1).write.mode("append").parquet(path)
    got = run(jobs.st_cost_windows(stream(spark, path)), "append", tmp_path, "late")
    assert [r.calls for r in got.orderBy("start").collect()] == [1, 3]


def test_event_dedup(spark, tmp_path):
    path = str(tmp_path / "in")
    for ids in ([1, 2, 2], [2, 3], [1, 4]):
        df = spark.createDataFrame([(i, i) for i in ids], "event_id bigint, s bigint")
        df.select("event_id", F.timestamp_seconds("s").alias("created_at")).coalesce(1).write.mode("append").parquet(path)
    got = run(jobs.st_event_dedup(stream(spark, path)), "append", tmp_path, "dedup")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]


def test_model_health_equals_batch(spark, calls_dir, tmp_path):
    got = run(jobs.st_model_health(stream(spark, calls_dir), watermark="0 seconds"), "append", tmp_path, "health")
    calls = spark.read.parquet(calls_dir)
    assert rows(got.filter("id is not null")) == rows(cost.model_health(calls))
    ended = got.filter("id is null")
    newest = calls.agg(F.max("created_at")).first()[0]
    wanted = rows(cost.model_recoveries(calls, newest))
    assert wanted and rows(ended.select("model", "failure_count", F.col("created_at").alias("eligible_at"))) == wanted
    assert {(r.success, r.health_status, r.cooldown_until == r.created_at) for r in ended.collect()} == {(None, "eligible", True)}


def test_cooldowns_end_without_a_call(spark, tmp_path):
    """Model a fails twice and is never called again; calls of b move the time on. c is called within its cooldown."""
    path = str(tmp_path / "in")
    batches = [
        [(1, "a", False, 0), (2, "a", False, 10), (3, "c", False, 0), (4, "c", False, 20)],
        [(5, "c", True, 50), (6, "b", True, 60)],
        [(7, "b", True, 75)],
        [(8, "b", False, 300), (9, "b", False, 301), (10, "b", False, 330), (11, "b", True, 500)],
    ]
    for batch in batches:
        frame = spark.createDataFrame(batch, "id bigint, model string, success boolean, s bigint")
        frame.withColumn("created_at", F.timestamp_seconds(F.col("s") + 1000)).drop("s").coalesce(1).write.mode("append").parquet(path)
    emitted = []
    query = (
        jobs.st_model_health(stream(spark, path), watermark="0 seconds").writeStream
        .foreachBatch(lambda df, i: emitted.extend((i, r.model, r.id, r.failure_count, r.health_status, r.created_at.timestamp() - 1000) for r in df.collect()))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(200)
    assert query.exception() is None
    ended = sorted((e for e in emitted if e[4] == "eligible"), key=lambda e: e[1])
    assert [e[1:] for e in ended] == [("a", None, 2, "eligible", 70.0), ("b", None, 3, "eligible", 390.0)]
    assert 2 <= ended[0][0] <= 3  # by the timer, when the time of b's call had passed the end
    assert len(emitted) == 11 + 2
    calls = spark.read.parquet(path)
    twin = cost.model_recoveries(calls, calls.agg(F.max("created_at")).first()[0]).collect()
    assert sorted((r.model, r.failure_count, r.eligible_at.timestamp() - 1000) for r in twin) == [("a", 2, 70.0), ("b", 3, 390.0)]


def test_budget_alert_is_the_first_crossing(spark, calls_dir, tmp_path):
    budget = 0.01
    got = run(jobs.st_budget_alert(stream(spark, calls_dir), budget), "append", tmp_path, "alerts")
    order = Window.partitionBy("task_id").orderBy("created_at", "id")
    spent = F.round(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6)
    over = spark.read.parquet(calls_dir).withColumn("spent", spent).filter(F.col("spent") >= budget)
    first = over.withColumn("n", F.row_number().over(order)).filter("n = 1")
    wanted = rows(first.select("task_id", "id", "spent", "created_at"))
    assert wanted and rows(got) == wanted


def test_budgets_by_model_go_before_the_global_one(spark, tmp_path):
    path = str(tmp_path / "calls")
    rows = [(1, "a", "m1", 0.4, 1), (2, "a", "m2", 0.4, 2), (3, "a", "m1", 0.4, 3), (4, "b", "m3", 0.9, 1), (5, "b", "m3", 0.2, 2), (6, "c", "m2", 9.0, 1), (7, None, "m1", 9.0, 1)]
    frame = spark.createDataFrame(rows, "id bigint, task_id string, model string, cost double, s bigint")
    frame.withColumn("created_at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(path)
    budgets = spark.createDataFrame([("m1", 0.5), ("m2", 100.0), ("m3", 0.0)], "model string, budget_per_task double")
    got = run(jobs.st_budget_alert(stream(spark, path), 1.0, budgets), "append", tmp_path, "model_alerts")
    assert sorted((r.task_id, r.id, r.spent) for r in got.collect()) == [("a", 3, 1.2), ("b", 5, 1.1)]


def test_state_ends(spark, tmp_path):
    """Spend is forgotten when the task has been quiet for longer than its state lives."""
    path = tmp_path / "late"
    spark.conf.set(jobs.NO_DATA_BATCHES, "false")
    for i in range(2):
        frame = spark.createDataFrame([(i, "t", "m", 0.6)], "id bigint, task_id string, model string, cost double")
        frame.withColumn("created_at", F.timestamp_seconds(F.col("id"))).coalesce(1).write.mode("append").parquet(str(path))
        for ttl, name in ((1, "short"), (10**9, "long")):
            alerts = jobs.st_budget_alert(stream(spark, str(path)), 1.0, ttl_ms=ttl)
            query = alerts.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
                "checkpointLocation", str(tmp_path / f"ck-{name}")
            ).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    schema = "task_id string, id bigint, spent double, created_at timestamp"
    count = lambda name: spark.read.schema(schema).parquet(str(tmp_path / name)).count()
    spark.conf.unset(jobs.NO_DATA_BATCHES)
    assert (count("short"), count("long")) == (0, 1)


def test_task_progress_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    moves = [
        [("t", 0, "queued", 1), ("t", 1, "queued", 1), ("u", 0, "running", 1)],
        [("t", 0, "succeeded", 2), ("u", 0, "failed", 3)],
        [("t", 1, "awaiting_review", 5), ("u", 0, "running", 2)],
        [("t", 1, "succeeded", 6), ("v", 0, "cancelled", 1)],
    ]
    for batch in moves:
        df = spark.createDataFrame(batch, "task_id string, item_index int, status string, s bigint")
        df.withColumn("updated_at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    emitted = []
    query = (
        jobs.st_task_progress(stream(spark, path)).writeStream.outputMode("update")
        .foreachBatch(lambda df, i: emitted.extend((i, *r) for r in df.collect()))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    final = {t: (p, s) for _, t, p, s in sorted(emitted)}
    everything = spark.read.parquet(path)
    latest = everything.groupBy("task_id", "item_index").agg(F.max_by("status", "updated_at").alias("status"))
    tasks = everything.select(F.col("task_id").alias("id"), F.lit("running").alias("status")).distinct()
    assert final == {r.task_id: (r.progress, r.status) for r in lifecycle.task_progress(tasks, latest).collect()}
    assert [e[1:] for e in emitted if e[1] == "t"] == [
        ("t", 0.0, "running"), ("t", 0.5, "running"), ("t", 1.0, "partially_succeeded"), ("t", 1.0, "succeeded"),
    ]
