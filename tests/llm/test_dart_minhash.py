from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import cases
from loopstats.llm import common as C, dart_minhash as D


def grams(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([text] if text else [])


def likeness(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """Least id of each id's component of texts of similarity 0.8 or more."""
    sets, up = {i: grams(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in up}


def test_coordinates_agree_as_weighted_sets_do():
    rng = np.random.default_rng(3)
    k = 512
    for n, shared, times in ((40, 30, 1), (400, 200, 1), (60, 40, 3), (3000, 2700, 1)):
        common_part = np.repeat(rng.integers(0, 1 << 62, shared, dtype=np.uint64), times)
        a = np.append(common_part, rng.integers(0, 1 << 62, n - shared, dtype=np.uint64))
        b = np.append(common_part, rng.integers(0, 1 << 62, n - shared, dtype=np.uint64))
        rows, values = np.repeat([0, 1], [len(a), len(b)]), np.append(np.sort(a), np.sort(b))
        one, two = D.sketch(rows, values, 2, k)
        wanted = len(common_part) / (len(a) + len(b) - len(common_part))
        assert abs((one == two).mean() - wanted) < 4 * np.sqrt(wanted * (1 - wanted) / k)
        assert (one != 0).all()


def test_weight_counts():
    x = np.repeat(np.arange(1, 11, dtype=np.uint64), 1)
    rows = np.repeat([0, 1], [10, 50])
    one, two = D.sketch(rows, np.append(x, np.repeat(x, 5)), 2, 1024)
    assert abs((one == two).mean() - 0.2) < 0.06


def test_alone_or_together_alike():
    texts = ["a b c d e f g", "x y", "", "a b c d e f g h", "word " * 500]
    every = D.sketch(*D.elements(*C.text_bytes(pa.array(texts))), 5, 60)
    for i, t in enumerate(texts):
        assert (D.sketch(*D.elements(*C.text_bytes(pa.array([t]))), 1, 60)[0] == every[i]).all()


def test_against_brute_force(spark, folder):
    rows = [(r[0], r[1]) for r in cases.corpus(11, 400)]
    got = {r.doc_id: r.class_id for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), folder).collect()}
    wanted = brute(rows)
    missed = [i for i in wanted if got[i] != wanted[i]]
    assert len(missed) <= 2 and all(got[i] >= wanted[i] for i in wanted)  # a band may miss a pair, none is made up


def test_large_family_of_edited_copies(spark, folder):
    """Every member is within reach of the original; most are not of each other."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for at in rng.choice(200, rng.integers(1, 9), replace=False):
            w[at] = f"e{i}-{at}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs, folder).collect()}
    wanted = brute(rows)
    assert sum(got[i] != wanted[i] for i in wanted) <= 2
    assert spark.read.parquet(f"{folder}/rest").count() < 4000  # of 80,000 pairs


def test_awkward_rows(spark, folder):
    got = [tuple(r) for r in D.near_duplicates(cases.frame(spark, cases.edge_rows(), clashes=True), folder).collect()]
    assert sorted(got, key=repr) == sorted([*((i, i) for i in (1, 2, 3, 4, 5, 8, 9, 10, 11)), (6, 5), (7, 5), (12, 11), (None, 5), (None, None)], key=repr)


def near(text, i=0):
    """The text with one word in another form: similarity 0.88 for 80 words."""
    w = text.split(" ")
    w[i] = "other"
    return " ".join(w)


def test_ids_with_several_texts_and_rows_without_id(spark, folder):
    a, b, c = (" ".join(f"{k}{i}" for i in range(80)) for k in "abc")
    rows = [(1, b), (1, a), (2, near(a)), (3, near(b)), (None, near(b, 79)), (None, c), (None, near(c)), (4, "x y z"), (4, None), (5, "")]
    got = [tuple(r) for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), folder).collect()]
    wanted = [(1, 1), (2, 1), (3, 1), (None, 1), (None, None), (None, None), (4, 4), (5, 5)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_one_of_each(spark, folder):
    a, b, c = (" ".join(f"{k}{i}" for i in range(80)) for k in "abc")
    rows = [(7, a, "x"), (7, a, "x"), (3, near(a), "y"), (3, b, "z"), (9, near(b), "y"), (None, c, "n"), (None, c, "n"), (None, near(c), "n"), (8, None, "e"), (6, "", "e"), (None, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    kept = D.one_of_each(docs, folder)
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert [(r[0], r[2]) for r in got] in ([(3, "y"), (6, "e"), (None, "n")], [(3, "z"), (6, "e"), (None, "n")]) and len(got) == 3
    assert D.one_of_each(cases.empty(spark), C.scratch(spark)).count() == 0


def test_recall_by_similarity(spark, folder):
    """Pairs of one similarity each, 500 for each step: bands find nearly all at the limit, and no pair below it is linked."""
    rows, wanted = [], {}
    for step, edits in enumerate((1, 2, 3, 4, 6)):  # of 200 words: weighted Jaccard of about 0.95, 0.90, 0.86, 0.82, 0.74
        for i in range(500):
            base = [f"s{step}d{i}w{j}" for j in range(200)]
            other = list(base)
            for at in range(edits):
                other[20 + 30 * at] = f"e{at}"
            key = 2 * (500 * step + i)
            rows += [(key, " ".join(base)), (key + 1, " ".join(other))]
            wanted[key + 1] = step
    got = {r.doc_id: r.class_id for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), folder).collect()}
    found = [sum(got[k] == k - 1 for k, s in wanted.items() if s == step) / 500 for step in range(5)]
    print("recall at 0.95, 0.90, 0.86, 0.82, 0.74:", found)
    assert min(found[:4]) >= 0.98 and found[4] == 0
    assert likeness(grams(rows[3000][1]), grams(rows[3001][1])) > 0.8 > likeness(grams(rows[4000][1]), grams(rows[4001][1]))


def test_empty_table(spark, folder):
    assert D.near_duplicates(cases.empty(spark), folder).count() == 0


def test_words_apart_from_case_and_punctuation(spark, folder):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text), (2, text.upper().replace(" ", ", ")), (1, text[:60])], "doc_id bigint, text string")
    assert {tuple(r) for r in D.near_duplicates(docs, folder).select("doc_id", F.col("class_id")).collect()} == {(5, 2), (2, 2), (1, 1)}
