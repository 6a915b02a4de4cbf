"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A store holds runs: tables of (hash of a line's key, documents that have it), sorted by hash, each from one batch or
from runs merged. A run is of level l if it stands for about `fan`**l batches; once a level has `fan` runs they are
merged into one of the next level, so a batch is rewritten only log(batches) times. A new batch reads each run by
merge anti-join, so that only keys which are not settled yet are kept, and adds its own run.

The hash is MD5 of the key: the line, ASCII white space stripped and A-Z in lower case. Documents are counted, not
lines: a key counts once for each document row.

Defined cases: null text is one empty line; keys without a character are never dropped; rows that repeat an id are
counted each and lose the same lines; rows without an id too; an empty table gives no row; other columns are kept, but for n_lines and n_dropped, which are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

MIN_DOCUMENTS, BATCHES, FAN = 10, 4, 4


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Lines of ASCII alone, most lines, are put in lower case by the faster function."""
    key = F.btrim(line, F.lit(C.SPACES))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(key)).otherwise(C.ascii_lower(key))


def line_hash(line: Column) -> Column:
    """In hexadecimal; null where the key has no character."""
    key = line_key(line)
    return F.when(key != "", F.md5(key))


def hashes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h): each key of a document row once."""
    keys = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_hash), lambda h: h.isNotNull()))
    # strings are made distinct by a hash set, binaries by comparing all with all
    return docs.select("doc_id", F.explode(keys).alias("h")).select("doc_id", F.unhex("h").alias("h"))


class LineRuns:
    """Levelled runs below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan, self.made, self.levels = spark, folder, fan, 0, []

    def runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{self.made}"
        self.made += 1
        rows.sortWithinPartitions("h").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h binary, n long").parquet(*paths)

    def fresh(self, hashes: DataFrame) -> DataFrame:
        """Of (doc_id, h), what no run holds yet."""
        for path in self.runs():
            hashes = hashes.join(self._read([path]).hint("merge"), "h", "left_anti")
        return hashes

    def add(self, hashes: DataFrame, settled: int | None = None) -> None:
        """Add a batch as a run, and compact levels that are full.

        Keys that some run has counted `settled` times or more are settled: the batch anti-joins them away.
        """
        counted = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        for path in self.runs() if settled else ():
            counted = counted.join(self._read([path]).where(F.col("n") >= settled).hint("merge"), "h", "left_anti")
        run = self._write(counted)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged = self._write(self.counts(self.levels[level]))
            for path in self.levels[level]:
                C.drop_folder(self.spark, path)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def counts(self, paths: list[str] | None = None) -> DataFrame:
        """(h, n) over the given runs, or all."""
        return self._read(paths or self.runs()).groupBy("h").agg(F.sum("n").alias("n"))

    def frequent(self, least: int) -> DataFrame:
        return self.counts().where(F.col("n") >= least).select("h")


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """`n` batches by ranges of the id, so that each reads its own row groups; rows without id are in the first."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    edges = [low + (high - low + 1) * i // n for i in range(n + 1)]
    first = F.col("doc_id").isNull() | (F.col("doc_id") < edges[1])
    rest = [docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(edges[1:-1], [*edges[2:-1], high + 1])]
    return [docs.where(first), *rest]


def batches_of_texts(docs: DataFrame, n: int) -> list[DataFrame]:
    """`n` batches by hash of the text, which stands for the id: equal texts are in one batch, as one document."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    return [texts.where(F.pmod("doc_id", F.lit(n)) == i) for i in range(n)]


def drop_lines(
    docs: DataFrame, folder: str, least: int = MIN_DOCUMENTS, batches: int = BATCHES, distinct_texts: bool = False
) -> DataFrame:
    """All columns of `docs`, the text without lines whose key is in `least` documents, and n_lines, n_dropped.

    With `distinct_texts` documents of equal texts count as one, so that copies do not make each other's lines frequent.
    Each document meets the hashes of its own frequent lines only: those come from a join of hashes, never of texts,
    with the frequent ones, and a text is moved once, to the list of its id.
    """
    store = LineRuns(docs.sparkSession, f"{folder}/runs")
    for batch in batches_of_texts(docs, batches) if distinct_texts else batches_of(docs, batches):
        hashes = hashes_of(batch)
        store.add(hashes.distinct() if distinct_texts else hashes, settled=least)
    frequent = C.cut(store.frequent(least), folder, "frequent")
    # rows are known by id and text, so that those without an id do not gather; rows that should share a key by chance
    # would share their frequent lines, which takes none away that is not frequent
    row = F.xxhash64("doc_id", "text")
    bad = hashes_of(docs.select(row.alias("doc_id"), "text")).join(frequent, "h", "left_semi").groupBy(F.col("doc_id").alias("__line_id")).agg(
        F.collect_set("h").alias("__line_bad")
    )
    every = lines(F.col("text"))
    kept = F.filter(every, lambda line: ~F.coalesce(F.array_contains(F.col("__line_bad"), F.unhex(line_hash(line))), F.lit(False)))
    kept = F.when(F.col("__line_bad").isNull(), every).otherwise(kept)
    n_lines = F.size(every).cast("long")
    out = docs.drop("n_lines", "n_dropped").withColumn("__line_row", row).join(bad, F.col("__line_row") == F.col("__line_id"), "left")
    out = out.select("*", n_lines.alias("n_lines"), kept.alias("__line_kept"))
    return out.withColumns(
        {"text": F.array_join("__line_kept", "\n"), "n_dropped": F.col("n_lines") - F.size("__line_kept")}
    ).drop("__line_id", "__line_row", "__line_bad", "__line_kept")
