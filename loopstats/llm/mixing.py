"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a weight; together the sources fill `share` of all words. No source gives more than `epochs` times
its own words: such a source is held at that, and what it cannot give is dealt to the others by weight, until none
is above its limit. With sources in the order of limit / weight, the common level is the largest of
(total - limits before) / (weights from here on), so one ordered pass over the rows of sources settles it.

A document is taken whole as often as the target holds its whole source, and the rest is one more, fractional
repetition: in the order of a seeded hash the documents go in whole until the rest is used up, the last with the words
that are left. Reruns agree. Prefix sums go over 65,536 hash buckets of a source and then inside a bucket, so that no
source meets in one task.

Defined cases: null text has no words and takes none; null source is a source, the last in order; an empty table gives
no row; rows that repeat an id are rows of their own with the same hash; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1"


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    """Seeded order of documents, as hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS
) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); weights repeat over the sources by code point, null last.

    The windows without key run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.select(
        "source", "source_size", place.alias("place"), F.get(cycle, place % len(weights)).alias("weight"),
        (F.col("source_size") * F.lit(float(epochs))).alias("most"),
    )
    by = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / weight)
    level = F.max("level").over(all_rows)
    return levels.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def plan(sizes: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of `sizes` (doc_id, source, size) with the target of their source and the words taken of each.

    `whole`: repetitions taken whole; `part`: words of the last, fractional one.
    """
    keyed = sizes.withColumn("key", order_key(F.col("doc_id"), seed))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 4))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("source").alias("s"), F.col("bucket").alias("k"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")
    )
    targets = targets.select(
        F.col("source").alias("t"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    ).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t")))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))).cast("long")
    return rows.withColumn("part", part).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "part",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "key",
    )


def mixture(docs: DataFrame, folder: str, seed: str = SEED, **settings) -> DataFrame:
    """The plan of all documents, from their texts: doc_id, source, size, source_size, target, whole, part, taken."""
    sizes = docs.select(F.col("doc_id"), F.col("source"), C.n_words(F.col("text")).alias("size"))
    sizes = C.cut(sizes, folder, "sizes")
    targets = C.cut(source_targets(sizes, **settings), folder, "targets")
    return plan(sizes, targets, seed)


def mixed(docs: DataFrame, folder: str, seed: str = SEED, **settings) -> DataFrame:
    """The rows of the mixture: each document as often as it is taken, all columns kept.

    Texts stay whole here: the one document of a source that is taken in part comes once more if at least half of
    it is. All documents before it in the seeded order are taken once more, so each source needs only the last such
    key, and texts are not shuffled.
    """
    rows = mixture(docs, folder, seed, **settings)
    more = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    last = rows.groupBy("source").agg(F.max(F.when(more, F.col("key"))).alias("mix_last"), F.max("whole").alias("mix_whole"))
    last = C.cut(last.withColumnRenamed("source", "mix_source"), folder, "last")
    out = docs.join(last, F.col("source").eqNullSafe(F.col("mix_source")))
    once = F.coalesce((order_key(F.col("doc_id"), seed) <= F.col("mix_last")).cast("int"), F.lit(0))
    times = (F.col("mix_whole") + once).cast("int")
    return out.withColumn("mix_turn", F.explode(F.sequence(F.lit(1), times + 1))).where(F.col("mix_turn") <= times).select(
        *(docs[c] for c in docs.columns)
    )
