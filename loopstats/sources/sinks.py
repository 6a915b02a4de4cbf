"""Writers: corpus export, trace fan-out, chunk store, append-only logs."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Collection, Mapping
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.listing import matching
from . import files

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]
EXPORT_KEYS = ("template_id", "source", "purpose", "knowledge_point", "payload", "meta")


def _as_json(name: str) -> Column:
    """JSON objects and arrays as they are stored, spelling and order kept; any other text as a JSON string."""
    stored = F.ltrim(name).rlike(r"^[\[{]") & F.try_parse_json(name).isNotNull()
    # line breaks of valid JSON stand between its values, never inside a string
    line = F.translate(name, "\r\n", "  ")
    field = F.to_json(F.struct(F.col(name)), {"ignoreNullFields": "false"})
    start = len(name) + 5  # behind {"name":
    value = F.substring(field, F.lit(start), F.length(field) - start)
    return F.when(stored, line).otherwise(value)


def export_rows(
    pool: DataFrame, filters: Mapping[str, object] | None = None, cap: int | None = None
) -> DataFrame:
    """The export columns, newest first: a range-partitioned sort, or a top-k under a cap."""
    rows = matching(pool, filters or {}).orderBy(F.desc("created_at"), F.desc("id"))
    if cap is not None:
        rows = rows.limit(cap)
    return rows.select(*EXPORT_KEYS)


def export_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, in the column `value`; stored payloads are spliced in unparsed."""
    head = F.to_json(F.struct(*EXPORT_KEYS[:4]), {"ignoreNullFields": "false"})
    tail = [F.concat(F.lit(f',"{name}":'), _as_json(name)) for name in EXPORT_KEYS[4:]]
    return rows.select(F.concat(F.rtrim(head, F.lit("}")), *tail, F.lit("}")).alias("value"))


def export_jsonl(
    pool: DataFrame,
    path: str,
    filters: Mapping[str, object] | None = None,
    cap: int | None = None,
) -> None:
    """One JSON object per line; part files sort by name in the row order."""
    export_lines(export_rows(pool, filters, cap)).write.mode("overwrite").text(path)


def parquet_sink(path: str, day: str | None = None) -> Sink:
    """A sink that can be replayed: each micro-batch owns one directory. `day` names a column to
    partition by, for time_range to prune on."""

    def emit(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        if day:
            writer = writer.partitionBy(day)
        writer.parquet(f"{path}/batch_id={batch_id}")

    return emit


def write_traces(
    stream: DataFrame,
    sinks: Mapping[str, Sink],
    checkpoint: str,
    available_now: bool = True,
    ledger: str | None = None,
) -> StreamingQuery:
    """Every micro-batch to every sink, each sink on its own.

    A ledger (by default below the checkpoint) says for each sink which batches it has. A sink that fails leaves the
    others alone: its batch is put into its dead-letter folder, and that and all later ones wait there until the sink
    takes them again, in order; that is tried before each batch and when the stream starts (or by `replay`). A batch
    that comes again after a restart goes only to the sinks that do not have it. Sinks must replace what they wrote for
    a batch, as `parquet_sink` does: a sink that ends between its write and its entry gets that batch once more.
    """
    book = Ledger(stream.sparkSession, ledger or f"{checkpoint}/sinks")
    replay(stream.sparkSession, sinks, book.path)

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        due = [name for name in sinks if not book.has(name, batch_id)]
        if not due:
            return
        batch.persist()
        try:
            for name in due:
                _drain(book, name, sinks[name])
                if book.waiting(name):
                    book.put_aside(name, batch_id, batch)
                elif _tried(name, sinks[name], batch, batch_id):
                    book.took(name, batch_id)
                else:
                    book.put_aside(name, batch_id, batch)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def replay(spark: SparkSession, sinks: Mapping[str, Sink], ledger: str) -> dict[str, list[int]]:
    """Offers each sink the batches that wait for it, in order up to the first it refuses; what still waits."""
    book = Ledger(spark, ledger)
    for name, emit in sinks.items():
        _drain(book, name, emit)
    return {name: book.waiting(name) for name in sinks}


def _tried(name: str, emit: Sink, batch: DataFrame, batch_id: int) -> bool:
    try:
        emit(batch, batch_id)
    except Exception:
        log.warning("sink %s failed on batch %s", name, batch_id, exc_info=True)
        return False
    return True


def _drain(book: Ledger, name: str, emit: Sink) -> None:
    for batch_id in book.waiting(name):
        if not _tried(name, emit, book.set_aside(name, batch_id), batch_id):
            return
        book.took(name, batch_id)


class Ledger:
    """Which batches each sink has, and those that wait for it; a small file a sink, written anew at each entry.

    Batches come in order, so `next` (the first batch not seen) and the list of waiting ones say all. A file is written
    under a new number and then renamed; the one with the highest number counts, so an entry is there or it is not.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = files.Folder(spark, path)

    def _read(self, sink: str) -> tuple[int, dict]:
        numbers = [int(n.removesuffix(".json")) for n in self.files.names(f"state/{quote(sink, '')}") if n.endswith(".json")]
        if not numbers:
            return 0, {"next": 0, "waiting": []}
        return max(numbers), json.loads(self.files.read(f"state/{quote(sink, '')}/{max(numbers)}.json"))

    def _write(self, sink: str, number: int, state: dict) -> None:
        folder = f"state/{quote(sink, '')}"
        self.files.write(f"{folder}/{number + 1}.json", json.dumps(state))
        self.files.remove(f"{folder}/{number - 1}.json")  # the one before stays

    def _letters(self, sink: str, batch_id: int) -> str:
        return f"{self.path}/dead_letters/{quote(sink, '')}/batch_id={batch_id}"

    def has(self, sink: str, batch_id: int) -> bool:
        """Whether the sink has the batch, or the dead-letter folder has it for the sink."""
        return batch_id < self._read(sink)[1]["next"]

    def waiting(self, sink: str) -> list[int]:
        return self._read(sink)[1]["waiting"]

    def took(self, sink: str, batch_id: int) -> None:
        number, state = self._read(sink)
        waited = batch_id in state["waiting"]
        self._write(sink, number, {"next": max(state["next"], batch_id + 1), "waiting": [b for b in state["waiting"] if b != batch_id]})
        if waited:
            self.files.remove(f"dead_letters/{quote(sink, '')}/batch_id={batch_id}")

    def put_aside(self, sink: str, batch_id: int, batch: DataFrame) -> None:
        batch.write.mode("overwrite").parquet(self._letters(sink, batch_id))
        number, state = self._read(sink)
        self._write(sink, number, {"next": batch_id + 1, "waiting": sorted({*state["waiting"], batch_id})})

    def set_aside(self, sink: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self._letters(sink, batch_id))


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk store partitioned by source type; AQE's rebalance sizes files and splits a hot type."""
    chunks.hint("rebalance", "source_type").write.mode(mode).partitionBy("source_type").parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int, mode: str = "append") -> None:
    """A table in `buckets` files by hash of `key`, each sorted by it.

    Tables with equal keys and numbers of buckets are joined and grouped by the key without an exchange, and a lookup
    of one key reads one bucket: chunks and vectors by document, calls and items by task. Rows are dealt by the key
    before they are written, so that a bucket is one file a run.
    """
    dealt = rows.repartition(buckets, key)
    dealt.write.format("parquet").mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """A bucketed table of an earlier session, entered in this session's catalog; buckets are known by the files' names."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{place}' CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS")
    return spark.table(name)


class AppendLog:
    """An append-only table in which every run's rows stand once.

    A run writes its rows into a folder of its own, under a run id that names the work (the day it covers, the version
    it calibrates), and then enters that folder in the manifest. Readers see only what the manifest lists. A run that
    ends before its entry leaves no rows; one that comes again under the same id finds its entry and writes nothing.
    Of two runs of one id at once the first to make the entry counts, and the other removes what it wrote (entries are
    made by renaming; the store's rename must not replace). Rows are never rewritten; the newest one is the effective one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, files.Folder(spark, path)

    def runs(self) -> dict[str, str]:
        """The folder of each entered run, in the order of their ids."""
        names = sorted(n for n in self.files.names("_manifest") if n.endswith(".json"))
        entries = [json.loads(self.files.read(f"_manifest/{n}")) for n in names]
        return {e["run"]: e["folder"] for e in entries}

    def append(self, rows: DataFrame, run: str) -> bool:
        """Whether this call entered the run; False where it was there already."""
        entry = f"_manifest/{quote(run, '')}.json"
        if self.files.exists(entry):
            return False
        folder = f"run={quote(run, '')}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        if self.files.write(entry, json.dumps({"run": run, "folder": folder}), replace=False):
            return True
        self.files.remove(folder)
        return False

    def read(self, schema: str | StructType | None = None) -> DataFrame:
        """The rows of all entered runs; with no run, an empty table of `schema`."""
        paths = [f"{self.path}/{folder}" for folder in self.runs().values()]
        if not paths:
            return self.spark.createDataFrame([], schema or StructType([]))
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths)

    def sweep(self, keep: Collection[str] = ()) -> list[str]:
        """Removes folders of runs that never made their entry, but for the runs in `keep` (those at work now)."""
        entered, gone = set(self.runs().values()), []
        for run in [n for n in self.files.names("") if n.startswith("run=")]:
            if unquote(run.removeprefix("run=")) in keep:
                continue
            for part in self.files.names(run):
                if f"{run}/{part}" not in entered:
                    self.files.remove(f"{run}/{part}")
                    gone.append(f"{run}/{part}")
        return gone


def append(rows: DataFrame, path: str, run: str) -> bool:
    """Appends the rows of one run to an AppendLog; a run that is there already is left as it is."""
    return AppendLog(rows.sparkSession, path).append(rows, run)
