import random

import pytest

import cases
from loopstats.llm import common as C, substring_dedup as B


def brute(rows, size=13):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - size + 1):
                k = tuple(w[j : j + size])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - size + 1):
            if i is not None and least[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone)))
    return out


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


@pytest.mark.parametrize("seed,kinds,length", [(1, 300, 60), (2, 3, 80), (3, 40, 200)])
def test_against_brute_force(spark, folder, seed, kinds, length):
    rows = [(r[0], r[1]) for r in cases.corpus(seed, 250, length, kinds)]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert result(B.without_repeats(docs, folder)) == sorted(brute(rows), key=repr)


def test_one_passage_in_every_text(spark, folder):
    rng = random.Random(7)
    passage = " ".join(cases.words(rng, 20))
    rows = [(i, " ".join(cases.words(rng, 20, 9000)) + f" {passage} " + " ".join(cases.words(rng, 14, 9000))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(B.without_repeats(docs, folder)) == sorted(brute(rows), key=repr)
    nodes = B.repeats(docs.toDF("id", "words"), C.scratch(spark))
    assert nodes.count() < 300 * 9


def test_other_lengths(spark, folder):
    rows = [(r[0], r[1]) for r in cases.corpus(9, 120, 40, 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(B.without_repeats(docs, folder, size=7, core=3)) == sorted(brute(rows, 7), key=repr)


def test_prefixes_grow_where_they_are_common(spark):
    text = " ".join(["a b c d e f g h i j k l m n"] * 200)
    docs = spark.createDataFrame([(i, f"{text} z{i}") for i in range(40)], "doc_id bigint, text string")
    assert sum(map(len, B.choose_prefixes(docs, 13))) > 0
    assert sum(map(len, B.choose_prefixes(docs.limit(0), 13))) == 0


def test_awkward_rows(spark, folder):
    rows = cases.edge_rows()
    got = B.without_repeats(cases.frame(spark, rows, clashes=True), folder)
    assert result(got) == sorted(brute([r[:2] for r in rows]), key=repr)
    assert B.without_repeats(cases.empty(spark), C.scratch(spark)).count() == 0
