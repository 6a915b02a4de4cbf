from collections import Counter

import pytest

import cases
from loopstats.llm import common as C, line_dedup as L


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least, distinct=False):
    split = [(r[1] or "").split("\n") for r in rows]
    counted = [text.split("\n") for text in {r[1] or "" for r in rows}] if distinct else split
    times = Counter(k for lines in counted for k in {key(x) for x in lines} if k)
    return [(r[0], len(x), sum(times[key(y)] >= least for y in x), "\n".join(y for y in x if times[key(y)] < least)) for r, x in zip(rows, split)]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


@pytest.mark.parametrize("least,batches", [(10, 4), (2, 1), (5, 9)])
def test_against_brute_force(spark, folder, least, batches):
    rows = cases.corpus(21, 200)
    got = L.drop_lines(cases.frame(spark, rows), folder, least, batches)
    assert result(got) == sorted(brute(rows, least), key=repr)


@pytest.mark.parametrize("least,batches", [(3, 4), (2, 1)])
def test_copies_count_once(spark, folder, least, batches):
    rows = cases.corpus(22, 200) + [(1000 + i, "a family\nof equal texts\nwith a line\nShared line, the same everywhere", "en", "s", 0) for i in range(20)] + cases.edge_rows() * 2
    got = L.drop_lines(cases.frame(spark, rows).repartition(3), folder, least, batches, distinct_texts=True)
    wanted = brute(rows, least, True)
    assert result(got) == sorted(wanted, key=repr)
    assert all(r[3] == "a family\nof equal texts\nwith a line" for r in wanted if (r[0] or 0) >= 1000)


def test_awkward_rows(spark, folder):
    rows = cases.edge_rows() * 2
    docs = cases.frame(spark, rows, clashes=True)
    got = L.drop_lines(docs, folder, 2, 3)
    assert set(got.columns) == set(docs.columns) | {"n_lines", "n_dropped"}
    assert result(got) == sorted(brute(rows, 2), key=repr)
    assert L.drop_lines(cases.empty(spark), C.scratch(spark)).count() == 0


def test_runs_are_compacted_and_anti_joined(spark, folder):
    store = L.LineRuns(spark, folder, fan=3)
    total = Counter()
    for b in range(7):
        batch = [(i, bytes([i % (b + 2)])) for i in range(b * 10, b * 10 + 10)]
        total.update(h for _, h in batch)
        hashes = spark.createDataFrame(batch, "doc_id bigint, h binary")
        fresh = {bytes(r.h) for r in store.fresh(hashes).collect()}
        assert fresh == {h for _, h in batch} - {bytes([x]) for x in range(b + 1) if b}
        store.add(hashes)
    assert [len(x) for x in store.levels] == [1, 2]
    assert {bytes(r.h): r.n for r in store.counts().collect()} == total


def test_settled_keys_are_left_out(spark, folder):
    store = L.LineRuns(spark, folder)
    batch = spark.createDataFrame([(i, b"x") for i in range(5)] + [(9, b"y")], "doc_id bigint, h binary")
    for _ in range(2):
        store.add(batch, settled=3)
    assert {bytes(r.h): r.n for r in store.counts().collect()} == {b"x": 5, b"y": 2}
    assert [bytes(r.h) for r in store.frequent(3).collect()] == [b"x"]
