"""Document fingerprints by spot signatures. DataFrame functions only.

Common words are anchors; the others are content words. Every anchor, and the beginning of the text, starts a chain of
the next content words, and anchor and chain make a signature. The set of a text's signatures is its fingerprint:
twelve hexadecimal digits of MD5 for each, sorted and joined by commas. Texts are alike as far as the Jaccard
similarity of their sets; sets whose sizes differ too much for a wanted similarity are not compared.

Words are runs of letters and digits in lower case.

Defined cases: null is the empty text; a text without content words has an empty fingerprint, and is alike (1) to another
such only; rows that repeat an id follow one another, in the order of a hash of their texts; rows without an id come before
all others; a table of one row is followed by itself; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

CHAIN = 3
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux de des du en et la le les ou par pour qui que sur un une "
    "das dem den der des die ein eine ist mit nicht sich und von zu "
    "con del el las lo los no para por se su y"
).split()
MARK = "\u0001"


def tokens(text: Column) -> Column:
    """Content words, each behind the anchors right before it and marks; the last may be anchors only."""
    words = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    marked = F.regexp_replace(words, rf"(?<=^| )({'|'.join(sorted(set(ANCHORS)))})( |$)", f"$1{MARK}")
    return F.filter(F.split(marked, " "), lambda t: t != "")


def _signatures(tokens: Column, contents: Column, chain: int) -> Column:
    def of(i: Column) -> Column:
        token = F.get(tokens, i)
        parts = F.split(token, MARK)
        anchors = F.slice(parts, 1, F.size(parts) - 1)
        anchors = F.when(i == 0, F.array_append(anchors, F.lit("^"))).otherwise(anchors)
        words = F.concat_ws(" ", F.slice(contents, i + 1, chain))
        return F.transform(anchors, lambda a: F.substring(F.md5(F.concat(a, F.lit(":"), words)), 1, 12))

    starts = F.filter(F.sequence(F.lit(0), F.size(contents) - 1), lambda i: (i == 0) | F.get(tokens, i).contains(MARK))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(starts, of))))
    return F.when(F.size(contents) > 0, found).otherwise(F.array().cast("array<string>"))


def fingerprints(df: DataFrame, texts: dict[str, str], chain: int = CHAIN) -> DataFrame:
    """`df` with an array of signatures for each text column: {new column: text column}."""
    kept = df.columns
    df = df.select(*kept, *(tokens(F.coalesce(F.col(t), F.lit(""))).alias(f"__t_{n}") for n, t in texts.items()))
    # the arrays that lambdas look into are columns: an expression in their place would be evaluated for each element
    word = lambda t: F.substring_index(t, MARK, -1)
    df = df.select("*", *(F.filter(F.transform(f"__t_{n}", word), lambda c: c != "").alias(f"__c_{n}") for n in texts))
    return df.select(*kept, *(_signatures(F.col(f"__t_{n}"), F.col(f"__c_{n}"), chain).alias(n) for n in texts))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of signatures; 0 unread where their sizes rule out `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small < least * large), F.lit(0.0))
        .otherwise(shared / (small + large - shared))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by id; after the last, the first.

    Rows are dealt into at most 65,536 blocks of consecutive ids, and a copy of each block's first row is added to
    the block before it. So texts move once, and no window runs over more than a block or over the blocks.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low = (low or 0) - 1  # the place of rows without id
    width = max(256, -(-((high or 0) - low + 1) // 65536))
    place = F.coalesce("doc_id", F.lit(low)).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    rows = rows.withColumn("block", F.floor((F.col("place") - low) / width).cast("long"))
    heads = rows.groupBy("block").agg(F.min("place").alias("head"))
    order = Window.orderBy("block")
    last = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("block").over(order), F.last("block").over(last)).alias("before"))
    guests = rows.join(F.broadcast(heads), F.col("place") == F.col("head")).select(
        "doc_id", "text", "place", F.col("before").alias("block"), F.lit(1).alias("guest")
    )
    every = rows.withColumn("guest", F.lit(0)).select("doc_id", "text", "place", "block", "guest").union(guests)
    by = Window.partitionBy("block").orderBy("guest", "place", F.xxhash64("text"))
    return every.withColumn("next_text", F.lead("text").over(by)).where("guest = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each text, its edited form (the last half from the next row's beginning), their fingerprints and likeness."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    size = F.col("n_chars").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    rows = fingerprints(rows.withColumn("edited", edited), {"s": "text", "e": "edited", "n": "next_text"}, chain)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("s", ",").alias("fingerprint"),
        F.array_join("e", ",").alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("n")).alias("near_next"),
    )
