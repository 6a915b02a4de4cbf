import random

import numpy as np
import pyarrow as pa
import pytest

from loopstats.llm import blocks as B


def dense(m):
    out = np.zeros((m.height, m.width), np.int64)
    out[m.rows(), m.column] = m.value
    return out


def some(rng, height, width, n):
    return B.Sparse.of_cells(rng.integers(0, height, n), rng.integers(0, width, n), rng.integers(1, 5, n), height, width)


def test_packed_numbers_come_back():
    for x in ([], [0], [5, 0, 2**40, 7], list(range(3000))):
        assert B.unpack(B.pack(np.array(x, np.int64))).tolist() == x


def test_sparse_products_are_those_of_numpy():
    rng = np.random.default_rng(1)
    for n in (0, 1, 40, 400):
        a, b = some(rng, 9, 7, n), some(rng, 7, 11, n)
        assert np.array_equal(dense(a.product(b)), dense(a) @ dense(b))
        x = rng.integers(0, 9, 7)
        assert np.array_equal(a.times(x), dense(a) @ x)
        assert np.array_equal(dense(a.turned()), dense(a).T)
        assert np.array_equal(dense(B.Sparse.unpacked(a.packed())), dense(a))


def test_segments_tile_the_texts():
    rng = random.Random(4)
    texts = ["", None, " ", "a", " a", "a  b", "a\n b", "x   y", "▁a ▁", "é é"] + ["".join(rng.choice("ab  \n▁é ") for _ in range(30)) for _ in range(50)]
    for strict in (False, True):
        s = B.Segments(pa.array(texts), strict)
        for i, t in enumerate(texts):
            mine = b"".join(s.bytes_of(np.arange(s.first[i], s.first[i + 1])))
            wanted = (t or "") if strict else (t or "").replace("▁", " ")
            assert mine == (" " + wanted if wanted else "").encode()
        key, one, which = s.distinct()
        whole = s.bytes_of(np.arange(len(s.start)))
        assert len(set(whole)) == len(key) and [whole[i] for i in one[which]] == whole


def test_equal_hashes_of_other_bytes_are_seen(monkeypatch):
    s = B.Segments(pa.array(["a b c"]))

    class Same:
        hash = np.zeros(3, np.uint64)

        def __init__(self, *_):
            pass

    monkeypatch.setattr(B.C, "Words", Same)
    with pytest.raises(ValueError):
        s.distinct()


def test_numbered_strings():
    known = B.Numbered()
    met = [known.numbers(np.array(k, np.uint64), [b"%d" % x for x in k]) for k in ([1, 3], [1, 2, 3], [], [0, 2, 9])]
    assert [(a.tolist(), b.tolist()) for a, b in met] == [([0, 1], [0, 1]), ([0, 2, 1], [1]), ([], []), ([3, 2, 4], [0, 2])]
    assert known.entries == [b"1", b"3", b"2", b"0", b"9"]
    with pytest.raises(ValueError):
        known.numbers(np.array([3], np.uint64), [b"other"])


def test_packed_strings_come_back():
    for x in ([], [b""], [b"a", b"", b"bc\n"], [b"x%d" % i for i in range(500)]):
        assert B.unpack_bytes(B.pack_bytes(x)) == x
