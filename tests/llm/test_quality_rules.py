import math
import random
from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

import cases
from loopstats.llm import common as C, quality_rules as Q

SPACE = set(" \t\n\x0b\x0c\r")


def split(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(text):
    text = text or ""
    w = split(text)
    seen = [line for line in text.split("\n") if split(line)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    hit = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(seen) - len(set(seen)), len(hit), len(seen), sum("A" <= c <= "Z" for c in text))


def test_metrics_against_brute_force():
    rng = random.Random(3)
    texts = [None, "", "  \n ", "a " * 40, "x y z w v u t s\n" * 3, "é#$ ñ|\nA\nA\n\n A"]
    texts += [r[1] for r in cases.corpus(4, 80)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(30)]
    texts += ["\n".join(rng.choice(["AB c", "", " ", "é|"]) for _ in range(12)) for _ in range(30)]
    found = Q.measure(*C.text_bytes(pa.array(texts)))
    got = list(zip(*(found[m].tolist() for m in Q.METRICS)))
    assert got == [brute(t) for t in texts]


def test_binomial_tail_is_exact():
    for n, x, p in ((10, 0, 0.3), (40, 3, 0.2), (200, 5, 0.05), (500, 1, 0.01)):
        q = Fraction(p)
        wanted = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(x + 1))
        assert abs(Q.binomial_tail(n, x, p) / float(wanted) - 1) < 1e-9
    assert Q.binomial_tail(10, 5, 0.3) == 1 and Q.binomial_tail(0, 0, 0.3) == 1
    assert 0 < Q.binomial_tail(10**9, 9_900_000, 0.01) < 1e-20


def labelled(spark, good, bad, n):
    """Texts of `lang` x with a share of symbol words, all of them different; every fourth text is a bad one."""
    rows, labels, rng = [], [], random.Random(9)
    for i in range(n):
        share = rng.choice(good if i % 4 else bad)
        w = [f"%%%%%%s{j}" if j < share * 50 else f"a{i}b{j}" for j in range(50)]
        rows.append((i, " ".join(w), "x" if i % 2 else None, "s", 1))
        labels.append((i, int(i % 4 > 0)))
    assert not any(brute(r[1])[0] < 20 or 100 * brute(r[1])[4] > 30 * brute(r[1])[0] for r in rows)  # cutoffs alone decide
    return cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_cutoffs_keep_the_risk(spark, folder):
    docs, labels = labelled(spark, [0, 0, 0.02], [0.4, 0.6], 4000)
    rows = Q.screen(docs, labels, folder).join(labels, "doc_id")
    lost = rows.groupBy("lang", "quality").agg(F.avg((~F.col("kept")).cast("int")).alias("lost"), F.max("base_failed").alias("base")).collect()
    assert len(lost) == 3 and not any(r.base for r in lost)  # the bad texts are all of one stratum
    for r in lost:
        assert r.lost <= Q.RISK if r.quality else r.lost == 1
    assert {r.rejected_by for r in rows.where("quality = 0").collect()} == {"symbols"}


def test_few_labels_reject_nothing(spark, folder):
    docs, labels = labelled(spark, [0], [0.6], 60)
    assert Q.screen(docs, labels, folder).where("rejected_by is not null").count() == 0


def test_noisy_good_texts_are_kept(spark, folder):
    docs, labels = labelled(spark, [0, 0.4], [0.4, 0.9], 4000)
    noisy = sum(brute("%%%%%%s1 " * 20 + "a1b1 " * 30)[2:3]) / 420  # about 0.3 of the characters of a noisy text
    metrics = Q.with_metrics(docs, ["doc_id", "lang"])
    cut = {r.stratum: r.symbols for r in Q.choose_cutoffs(metrics, labels, folder).collect()}
    assert set(cut) == {"x", None} and all(v >= noisy for v in cut.values())
    rows = Q.screen(docs, labels, C.scratch(spark)).join(labels, "doc_id").withColumn("share", F.round(F.expr("n_symbols / 6 / 50"), 1))
    got = {(r.quality, r.share): (r.n, r.lost) for r in rows.groupBy("quality", "share").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("lost")).collect()}
    assert set(got) == {(1, 0.0), (1, 0.4), (0, 0.4), (0, 0.9)}
    for (quality, share), (n, lost) in got.items():  # noisy texts stay, good or bad; the very noisy ones go
        assert n > 400 and lost == (n if share == 0.9 else 0)


def test_awkward_rows(spark, folder):
    rows = cases.edge_rows()
    docs = cases.frame(spark, rows, clashes=True)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id bigint, quality int")
    got = Q.screen(docs, labels, folder).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = [(r[0], brute(r[1])[0], brute(r[1])[4]) for r in rows]
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(wanted, key=key)
    assert all(r.base_failed == (r.n_words < 20) and r.kept != r.base_failed for r in got)
    kept = Q.kept_documents(docs, labels, C.scratch(spark))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r[0] or 0 for r in rows if brute(r[1])[0] >= 20)


def test_empty_table(spark, folder):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Q.screen(cases.empty(spark), labels, folder).count() == 0
    assert Q.kept_documents(cases.empty(spark), labels, C.scratch(spark)).count() == 0
