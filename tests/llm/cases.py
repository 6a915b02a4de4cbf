"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as extra columns of a table.
CLASHES = ("h", "n", "at", "size", "key", "block", "guest", "place", "ids", "spans", "n_words", "n_lines", "line_bad", "class_id", "stratum", "target", "token", "digest")


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def edge_rows():
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000, 5000))
    base = " ".join(words(rng, 80))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, long, "en", "a"), (5, base, "fr", "b"),
        (6, base, "fr", None), (7, base + " tail", None, "b"), (7, base + " tail", None, "b"), (8, "short text", "en", "c"),
        (None, base, "en", "a"), (None, None, None, None), (9, "x" * 5000, "de", "c"), (10, "é ü ñ \U0001f600 ...\r\nA\n\nA", "es", "é"),
        (11, "!!! ??? ...", "en", "a"), (12, "!!! ??? ...", "en", "a"),
    ]
    return [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows]


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("x").alias(c) for c in CLASHES))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed, n, length=60, kinds=300):
    """Texts with exact copies, near copies, shared passages and lines."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    line = "Shared line, the same everywhere"
    rows = []
    for i in range(n):
        pick = rng.random()
        if rows and pick < 0.15:
            text = rng.choice(rows)[1]
        elif rows and pick < 0.4:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
            text = " ".join(w)
        else:
            w = words(rng, rng.randrange(3, length), kinds)
            if pick < 0.6:
                w[len(w) // 2 : len(w) // 2] = passage[: rng.randrange(8, 30)]
            text = " ".join(w)
            if pick < 0.7:
                text += "\n  " + line.upper() * (pick < 0.5) + line * (pick >= 0.5) + " \n" + " ".join(words(rng, 5))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(text)))
    return rows
