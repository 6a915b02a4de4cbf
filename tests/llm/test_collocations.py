import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import cases
from loopstats.llm import blocks as B, collocations as L

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, cover=50, top=2000):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(SMALL)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        often = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        held = Counter()
        for p, c in often.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    held[part] = max(held[part], c)
        scored = []
        for p, a in often.items():
            if 100 * held[p] >= cover * a:
                continue
            cuts = [(10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    kinds = ["Alpha", "beta", "gAmma", "delta", "é", "日本", "x-y", "it's", "zz", "éa", "a"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(kinds))]
    fixed = [["new", "york", "city"], ["of", "the"], ["once", "upon", "a"], ["a", "a", "a"]]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(40)):
            w += rng.choice(fixed) if rng.random() < 0.15 else [rng.choices(kinds, weights)[0]]
        gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n "])
        rows.append((i, "".join(x + gap() for x in w), rng.choice(["en", "fr", None, "und"]), "s", 0))
    return rows


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 24), (7, 900)])
def test_against_brute_force(spark, folder, monkeypatch, shard, block):
    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "PART", 3 if block == 900 else 1 << 14)
    monkeypatch.setattr(B.cut_batch, "__defaults__", (block,))
    rows = texts(3, 500) + cases.edge_rows()
    docs = cases.frame(spark, rows, clashes=True).repartition(3)
    got = L.collocations(docs, folder)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = brute(rows)
    assert len(wanted) > 100 and {len(r[2].split(" ")) for r in wanted} == {2, 3}
    assert sorted(map(tuple, got.collect())) == wanted


def test_limits(spark, folder):
    rows = texts(4, 200)
    got = L.collocations(cases.frame(spark, rows), folder, least=3, cover=80, top=9)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 80, 9)


def test_no_rows_and_no_phrases(spark, folder):
    assert L.collocations(cases.empty(spark), folder).count() == 0
    assert L.collocations(cases.frame(spark, cases.edge_rows()[:3]), f"{folder}/x").count() == 0


@pytest.mark.parametrize("together", [1 << 18, 50])
def test_trie_accepts_its_sequences(monkeypatch, together):
    monkeypatch.setattr(L, "TOGETHER", together)
    rng = np.random.default_rng(5)
    for n_digits, most, length in ((1, 200, 2), (2, 3000, 2), (3, 1 << 20, 3), (1, 5, 3)):
        rows = np.unique(rng.integers(1, most, (4000, length)), axis=0)
        rows = rows[rng.random(len(rows)) < 0.6]
        trie = L.Trie(rows, n_digits)
        run = np.concatenate([rows[rng.permutation(len(rows))[:500]].reshape(-1), rng.integers(0, most, 3000)])
        where = {tuple(x): i for i, x in enumerate(rows.tolist())}
        wanted = [(i, where[p]) for i in range(len(run) - length + 1) if (p := tuple(run[i : i + length].tolist())) in where]
        place, which = trie.accepted(run)
        assert list(zip(place.tolist(), which.tolist())) == wanted
    empty = L.Trie(np.zeros((0, 2), np.int64), 2)
    assert len(empty.accepted(np.array([1, 2, 3]))[0]) == 0 and len(empty.accepted(np.zeros(0, np.int64))[0]) == 0


def test_products_beyond_64_bits(spark):
    got = spark.range(1).selectExpr(f"{L._score('3000000000001L', '5000000000000L', '4000000000000L')} as s").first().s
    assert got == 10**6 * 3000000000001**2 // (5 * 4 * 10**24)
