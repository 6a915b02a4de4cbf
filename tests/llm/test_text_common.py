import random
import re

import numpy as np
import pyarrow as pa
from pyspark.serializers import CloudPickleSerializer

from loopstats.llm import common as C


def test_words_of_texts():
    rng = random.Random(1)
    texts = ["", "a", " a  b\n", None, "é \tñandú", "x" * 700_000 + " y", "b", *("".join(rng.choice("ab \n\té") for _ in range(30)) for _ in range(300))]
    raw, offsets = C.text_bytes(pa.array(texts))
    found = C.Words(raw, offsets)
    own = {}
    for i, t in enumerate(texts):
        wanted = re.findall(C.WORD, t or "")
        spans = slice(found.first[i], found.first[i + 1])
        got = [bytes(raw[a:b]).decode() for a, b in zip(found.start[spans], found.end[spans])]
        assert got == wanted and found.n[i] == len(wanted)
        for w, h in zip(wanted, found.hash[spans].tolist()):
            assert own.setdefault(w, h) == h
    assert len(set(own.values())) == len(own)


def test_lower_case_words():
    raw, offsets = C.text_bytes(pa.array(["École, ÜBER-maß", "école über maß"]))
    found = C.Words(raw, offsets, C.ALNUM, lower=True)
    assert found.n.tolist() == [3, 3] and found.hash[:3].tolist() == found.hash[3:].tolist()


def test_shingles():
    texts = ["a b c d e f", "a b c", "b c d e f", "", "a b c"]
    value, row = C.shingles(C.Words(*C.text_bytes(pa.array(texts))), 5)
    by = [value[row == i].tolist() for i in range(5)]
    assert [len(b) for b in by] == [2, 1, 1, 0, 1]
    assert by[0][1] == by[2][0] and by[1] == by[4] and by[1][0] != by[0][0]


def test_chunks_cover_all():
    column = pa.array(["x" * n for n in (0, 5, 100, 3, 0, 7)] + [None])
    assert [r for a, b in C.chunks(column, 10) for r in range(a, b)] == list(range(7))
    assert list(C.chunks(pa.array([], pa.string()))) == []


def test_components(spark, folder):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = C.components(spark.createDataFrame(links, "a bigint, b bigint"), folder, "t").collect()
    linked = {x for link in links for x in link if link[0] != link[1]}
    assert {r.node: r.class_id for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    assert C.components(spark.createDataFrame([], "a bigint, b bigint"), folder, "e").count() == 0


def test_mix_has_no_fixed_small_values():
    assert len(np.unique(C.mix(np.arange(1000, dtype=np.uint64)))) == 1000


def test_word_hashing_travels_small():
    """Its tables are made in the tasks, also when the driver has hashed words itself: they were 4 MB in every function."""
    before = C.Words(*C.text_bytes(pa.array(["a b"]))).hash
    data = CloudPickleSerializer().dumps(C.Words)
    assert len(data) < 200_000
    assert (CloudPickleSerializer().loads(data)(*C.text_bytes(pa.array(["a b"]))).hash == before).all()
