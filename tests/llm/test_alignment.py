import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import cases
from loopstats.llm import alignment as A, blocks as B, common as C

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

AWKWARD = [
    "a ", "  a   b  ", " ", "▁ ▁▁a", "a▁ b", "<|endoftext|> <s> </s>", "\n\t x\r\n", "x" * 3000, "日本語 漢字 \U0001f600\u0001", "\n b", "x\n  b  c   d",
    "it's  we'll 12 á ́", "\x85 　 e", "   \n\n  ",
]


@pytest.fixture(scope="module")
def encoders():
    return A.Encoders.load()


def brute(texts):
    """Of each text: the groups (ids of A and B by group) and its links, by plain loops over the libraries' whole-text ids."""
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}
    bytes_a = {i: bytes(byte[c] for c in w) for w, i in a.get_vocab().items() if w != "<|endoftext|>"}
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in texts:
        whole = (" " + t).encode() if t else b""
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        wa, wb = [bytes_a[i] for i in ia], [bytes_b(i) for i in ib]
        if b"".join(wa) != whole or b"".join(wb) != whole or not t:
            out.append(([], [], [], []))
            continue
        ends = lambda w: np.cumsum([len(x) for x in w]).tolist()
        ea, eb = ends(wa), ends(wb)
        common = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in common]
        for side, (ids, own) in enumerate(((ia, ea), (ib, eb))):
            for i, e in zip(ids, own):
                groups[bisect.bisect_left(common, e)][side].append(i)
        sa, sb = [e - len(w) for e, w in zip(ea, wa)], [e - len(w) for e, w in zip(eb, wb)]
        links, low = [], 0
        for i, s, e in zip(ia, sa, ea):
            while low < len(eb) and eb[low] <= s:
                low += 1
            k = low
            while k < len(sb) and sb[k] < e:
                links.append((i, ib[k]))
                k += 1
        out.append((ia, ib, groups, links))
    return out


def expected(texts):
    rows = brute(texts)
    count = Counter(p for r in rows for p in r[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for ia, ib, groups, links in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            len(ia), len(ib), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sum(count[p] == best[p[1]] for p in links),
            sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text,
        ))
    return out


COLUMNS = (*A.COUNTS, "n_best", "count_sum", "groups_sha256")


def check(rows, want):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert got == want


def test_documents(spark, sf_dir, folder, encoders):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = A.alignment(C.table(spark, sf_dir, "documents"), encoders, folder)
    wanted = expected([d.text for d in docs])
    check(got.collect(), {d.doc_id: w[:8] for d, w in zip(docs, wanted)})
    links = sum(r["count"] for r in spark.read.parquet(f"{folder}/pairs").collect())
    assert links == sum(w[3] for w in wanted)


def random_texts(n):
    rng = random.Random(12)
    parts = ["the ", "er", " ", "  ", "é", "\n", "12", "日", ".", "▁", "'s", " \t", " ", " ", "\x1c", "́", " a", "!?", "​", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_awkward_texts(spark, folder, encoders, monkeypatch):
    monkeypatch.setattr(B.cut_batch, "__defaults__", (400,))
    monkeypatch.setattr(A, "REMEMBERED", 30)
    texts = AWKWARD + random_texts(600) + [r[1] for r in cases.edge_rows()]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    docs = cases.frame(spark, rows, clashes=True).repartition(3)
    want = expected(texts)
    check(A.alignment(docs, encoders, folder, ["doc_id"]).collect(), {i: w[:8] for i, w in enumerate(want)})
    got = {r.doc_id: r for r in A.aligned_groups(docs, encoders, ["doc_id", "at", "key"]).collect()}
    assert {i: r.groups for i, r in got.items()} == {i: w[8] for i, w in enumerate(want)}
    assert all(tuple(r[c] for c in A.COUNTS) == want[i][:5] and r.key == "x" for i, r in got.items())


def test_rows_without_id_and_repeated_rows(spark, folder, encoders):
    got = A.alignment(cases.frame(spark, cases.edge_rows()), encoders, folder).collect()
    want = expected([r[1] for r in cases.edge_rows()])
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_a, r.count_sum) for r in got), key=key) == sorted(((r[0], w[0], w[6]) for r, w in zip(cases.edge_rows(), want)), key=key)


def test_empty_table_and_refused_names(spark, folder, encoders):
    assert A.alignment(cases.empty(spark), encoders, folder).count() == 0
    with pytest.raises(ValueError):
        A.alignment(cases.frame(spark, cases.edge_rows()), encoders, f"{folder}/x", ["n_a"])


def test_incidence_products():
    a, b = np.array([2, 5, 6]), np.array([1, 5, 6])
    links = A.over_bytes(a, 6).product(A.over_bytes(b, 6).turned())
    assert list(zip(links.rows().tolist(), links.column.tolist(), links.value.tolist())) == [(0, 0, 1), (0, 1, 1), (1, 1, 3), (2, 2, 1)]
    groups = A.within(np.array([0, 0, 1]), 2).product(A.within(np.array([0, 0, 1]), 2).turned())
    assert list(zip(groups.rows().tolist(), groups.column.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
