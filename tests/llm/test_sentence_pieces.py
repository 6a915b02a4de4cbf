import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import cases
from loopstats.llm import sentence_pieces as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pieces():
    return P.load_pieces()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def texts():
    rng = random.Random(6)
    out = ["", " ", "  ", "a", " a", "a ", "  a   b  ", "\n\t x\r\n", "日本語 漢字 \U0001f600\u0001", "<s> </s> <unk> <0x41>", "▁ ▁▁a", "x" * 3000, "ab" * 700 + " " + "é" * 300, "½ﬁ ａ", "\u2028 \u00a0 "]
    out += ["".join(rng.choice(["the ", "er", "ing", " ", "  ", "é", "\n", "12", "th", "ou", "日", "A", ".", "\u0301"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    return out


def test_ids_are_those_of_the_library(pieces, library):
    every = texts()
    got = P.encode_texts(pa.array(every), pieces).to_pylist()
    for t, g in zip(every, got):
        assert g == library.encode(t), t
    back = P.decode_ids(pa.array(got, pa.list_(pa.int32())), pieces)
    assert back == [t.replace("▁", " ") for t in every]
    same = P.round_trips(pa.array(got, pa.list_(pa.int32())), pa.array(every), pieces).tolist()
    assert same == ["▁" not in t for t in every]


def test_documents(spark, sf_dir, pieces, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = P.encoded(docs, ["doc_id", "text"], pieces).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    assert [r.ids for r in got] == library.encode([r.text for r in got])
    assert all(r.n_pieces == len(r.ids) for r in got)


def test_suffix_array_and_edges_against_search():
    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(300)) + "c" * 40
    codes = np.array([ord(c) for c in text], np.int32)
    order = P.suffix_array(codes, 16)
    cut = [text[i : i + 16] for i in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(text)))
    made = P.Pieces([(t, -float(i), True) for i, t in enumerate(["a", "b", "ab", "aba", "bb", "abab", "cccc", "zz"])] + [(f"<0x{b:02X}>", 0.0, False) for b in range(256)])
    table = P.edges(codes, made)
    for at in range(len(text)):
        for size in range(1, made.width + 1):
            known = text[at : at + size] in ["a", "b", "ab", "aba", "bb", "abab", "cccc", "zz"] and at + size <= len(text)
            assert (table[at, size] >= 0) == known


def test_long_segments_merge_alike(pieces, library, monkeypatch):
    rng = random.Random(3)
    every = ["".join(rng.choice(["th", "e", "r", "in", "g", "aa"]) for _ in range(60)) for _ in range(40)]
    monkeypatch.setattr(P, "LONG", 3)
    assert P.encode_texts(pa.array(every), pieces).to_pylist() == library.encode(every)


def test_chunks_of_segments_join(pieces, library, monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 50)
    every = texts()
    assert P.encode_texts(pa.array(every), pieces).to_pylist() == library.encode(every)


def test_pieces_over_spaces_are_refused():
    with pytest.raises(ValueError):
        P.Pieces([("a▁b", 0.0, True)])


def test_awkward_rows(spark, pieces, library):
    rows = cases.edge_rows()
    docs = cases.frame(spark, rows, clashes=True)
    got = P.encoded(docs, ["doc_id", "ids", "n_words"], pieces)
    assert got.columns == ["doc_id", "n_words", "ids", "n_pieces", "round_trip"]
    back = sorted(map(tuple, P.decoded(got, pieces).collect()), key=repr)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert all(r.round_trip for r in got.collect())
    none = cases.empty(spark)
    assert P.encoded(none, ["doc_id"], pieces).count() == 0 and P.decoded(P.encoded(none, ["doc_id"], pieces), pieces).count() == 0


LONG_TEXTS = """
import random, resource, sys
import pyarrow as pa
from loopstats.llm import sentence_pieces as P
import sentencepiece
p, rng = P.load_pieces(), random.Random(1)
if sys.argv[1] == "words":
    text = " ".join("".join(rng.choice(["th", "er", "in", "a", "st"]) for _ in range(rng.randrange(2, 6))) for _ in range(24_000_000 // 7))
else:
    text = "".join(rng.choice(["th", "er", "in", "on", "a", "e"]) for _ in range(1_800_000))[:3_000_000]
column = pa.array([text])
ids = P.encode_texts(column, p)
assert P.round_trips(ids, column, p).tolist() == [True]
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
assert ids[0].as_py() == sentencepiece.SentencePieceProcessor(model_file=P.MODEL).encode(text)
print(peak)
"""


@pytest.mark.parametrize("kind", ["words", "one word"])
def test_memory_on_very_long_texts(kind):
    done = subprocess.run([sys.executable, "-c", LONG_TEXTS, kind], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parents[2])})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 600  # MB, about 100 of which the interpreter and its libraries take


def test_long_texts_in_parts(pieces, library, monkeypatch):
    rng = random.Random(9)
    every = ["".join(rng.choice(["the", " ", "  ", "é", "\n", "12", "日", "a ", "▁"]) for _ in range(rng.randrange(90))) for _ in range(300)] + ["a " * 20, " " * 50, "b" * 60 + " ", None]
    for size in (8, 20):
        monkeypatch.setattr(P, "CHUNK", size)
        monkeypatch.setattr(P, "WINDOW", 3 * size)
        monkeypatch.setattr(P, "REMEMBERED", 40)
        assert P.encode_texts(pa.array(every), pieces).to_pylist() == [library.encode(t or "") for t in every]
