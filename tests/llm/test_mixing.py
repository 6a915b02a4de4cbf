import hashlib
import re

import pytest

import cases
from loopstats.llm import common as C, mixing as M


def fill(sizes, weights, share, epochs):
    """Water-filling by rounds: clamp, deal the rest anew."""
    left, total, out = set(sizes), share * sum(sizes.values()), {}
    while left:
        level = total / sum(weights[s] for s in left)
        full = {s for s in left if weights[s] * level > epochs * sizes[s]}
        if not full:
            return {**out, **{s: weights[s] * level for s in left}}
        for s in full:
            out[s] = epochs * sizes[s]
            total -= out[s]
        left -= full
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10, 10], [1000, 1, 1, 1, 5], [0, 7, 0], [3, 900, 20, 44, 5, 61], [5]])
def test_targets_against_rounds(spark, sizes):
    names = [None if i == 0 else f"s{i}" for i in range(len(sizes))]
    rows = [(n, x) for n, x in zip(names, sizes)]
    got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    order = sorted(n for n in names if n is not None) + [None]
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(order)}
    wanted = fill(dict(zip(names, sizes)), weights, 1.5, 2.0)
    assert got == pytest.approx(wanted)


def check(spark, rows, got):
    size = lambda t: len(re.findall(C.WORD, t or ""))
    assert len(got) == len(rows)
    totals, taken, targets = {}, {}, {}
    for _, t, _, s, _ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == totals[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    for s in totals:
        assert abs(taken[s] - targets[s]) <= 0.5
    assert sum(targets.values()) == pytest.approx(1.5 * sum(totals.values()))


def test_sources_come_to_their_targets(spark, folder):
    rows = cases.corpus(3, 300)
    got = M.mixture(cases.frame(spark, rows), folder).collect()
    check(spark, rows, got)
    again = M.mixture(cases.frame(spark, rows[::-1]).repartition(5), C.scratch(spark)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_awkward_rows(spark, folder):
    rows = cases.edge_rows()
    check(spark, rows, M.mixture(cases.frame(spark, rows, clashes=True), folder).collect())
    assert M.mixture(cases.empty(spark), C.scratch(spark)).count() == 0


def test_rows_of_the_mixture(spark, folder):
    rows = [r for r in cases.corpus(6, 300)]
    docs = cases.frame(spark, rows, clashes=True)
    plan = {r.doc_id: r for r in M.mixture(docs, folder).collect()}
    got = M.mixed(docs, C.scratch(spark))
    assert got.columns == docs.columns
    times = {}
    for r in got.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for i, p in plan.items():
        assert times.get(i, 0) == p.whole + (p.part > 0 and 2 * p.part >= p.size)
    assert M.mixed(cases.empty(spark), C.scratch(spark)).count() == 0


def test_seed_changes_the_order():
    one = sorted(range(50), key=lambda i: hashlib.sha256(f"{M.SEED}:{i}".encode()).hexdigest())
    assert one != sorted(range(50), key=lambda i: hashlib.sha256(f"other:{i}".encode()).hexdigest())
