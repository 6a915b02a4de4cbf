import hashlib

import pytest

import cases
from loopstats.llm import spot_signatures as S


def marks(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    content = [x for x in w if x not in S.ANCHORS]
    out, n = set(), 0
    starts = [("^", 0)]
    for x in w:
        if x in S.ANCHORS:
            starts.append((x, n))
        else:
            n += 1
    for a, i in starts:
        if content[i : i + S.CHAIN]:
            out.add(hashlib.md5(f"{a}:{' '.join(content[i : i + S.CHAIN])}".encode()).hexdigest()[:12])
    return out


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = marks(t), marks(edited), marks(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(sorted(a)), ",".join(sorted(b)), like(a, b), like(a, c)))
    return out


def test_against_brute_force(spark):
    rows = cases.corpus(31, 700)
    rows = [(i * 7, t.replace("w1", "the ").replace("w2", "of ").replace("w3", "und "), *r) for i, t, *r in rows]
    got = S.edited_fingerprints(cases.frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


@pytest.mark.parametrize("n", [1, 2])
def test_last_is_followed_by_the_first(spark, n):
    rows = [(i, f"text of number {i} and the end", "en", "s", 1) for i in range(n)]
    assert sorted(map(tuple, S.edited_fingerprints(cases.frame(spark, rows)).collect())) == sorted(brute(rows))


def test_awkward_rows(spark):
    rows = [r for r in cases.edge_rows() if r[0] is not None] + [(-5, "the of and", "en", "s", 1), (20, "THE end. The END", "en", "s", 1)]
    got = S.edited_fingerprints(cases.frame(spark, rows, clashes=True)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)
    nulls = cases.frame(spark, cases.edge_rows())
    assert S.edited_fingerprints(nulls).count() == len(cases.edge_rows())
    assert S.edited_fingerprints(cases.empty(spark)).count() == 0


def test_sizes_that_rule_likeness_out_are_not_compared(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.array(F.lit("a")).alias("a"), F.array(*map(F.lit, "abcdef")).alias("b"))
    assert tuple(one.select(S.likeness(F.col("a"), F.col("b"), 0.5), S.likeness(F.col("a"), F.col("b"))).first()) == (0.0, 1 / 6)
