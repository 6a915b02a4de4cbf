"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all texts (from every word on) are grouped by variable-length prefixes: a prefix that holds too large a
share of the suffixes is extended by a word, up to the length that counts as a repeat, so that groups stay small; the
prefixes are chosen from a bounded sample, which moves only the borders of groups. Inside a group suffixes are sorted,
which is the order of the leaves of its subtree; an internal node of depth `size` or more is a run of suffixes that
share `size` words, and its first suffix belongs to the least document. The other documents' words under it go. A node
is known by its group (prefixes are folded into 65,536) and the 64-bit fingerprint of its `size` words; sorted groups
are read as a stream.

Only suffixes that can repeat are sent. Of the five-word runs inside a window of `size` words the one with the least
hash is its minimizer; equal windows have equal ones, so windows whose minimizer occurs in one document only are out.
Texts that are copies as a whole go at once. Inside a batch equal windows are settled before anything is sent, so a
passage that very many documents share sends one suffix for each batch.

Defined cases: null text has no words; rows without an id neither lose words nor count as earlier; rows that repeat an
id are one document with respect to order and lose the union of their windows' places; a text with fewer words than
`size` stays; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

SIZE, CORE = 13, 5
#: A prefix with a larger share of the sampled suffixes is extended; suffixes sampled at most.
SHARE, SAMPLE = 1 / 512, 20_000
MIX2 = C.PLACES[60]


def _prefixes(hashes: np.ndarray, at: np.ndarray, size: int):
    """Fingerprints of the first 1, 2 ... `size` words from the places `at`."""
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total = total + hashes[at + i] * C.PLACES[i]
        yield C.mix(total + np.uint64(i + 1))


def _windows(words: C.Words, size: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of `size` words starts, and its minimizer."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cores = np.zeros(n, np.uint64)
    for i in range(core):
        cores[: n - i] += words.hash[i:] * C.PLACES[i]
    cores = C.mix(cores)
    wide, low = size - core + 1, cores
    step = 1
    while step < wide:  # minimum over `wide` places by doubling
        move = min(step, wide - step)
        low = np.minimum(low[: len(low) - move], low[move:])
        step += move
    at = np.flatnonzero(words.first[words.row + 1] - np.arange(n) >= size)
    return at, low[at]


def _digests(words: C.Words) -> np.ndarray:
    place = (np.arange(len(words.hash)) - words.first[:-1][words.row]).astype(np.uint64)
    out = np.zeros((len(words.n), 2), np.uint64)
    for i in (0, 1):
        terms = C.mix(words.hash + place * C.PLACES[44 + i])
        total = np.add.reduceat(np.append(terms, np.uint64(0)), words.first[:-1]) if len(words.n) else np.zeros(0, np.uint64)
        out[:, i] = C.mix(np.where(words.n > 0, total, np.uint64(0)) + words.n.astype(np.uint64))
    return out


def _keys(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, k1, k2): digest of the words in order."""

    def run(batches):
        for batch in batches:
            for a, b in C.chunks(batch.column(1)):
                words = C.Words(*C.text_bytes(batch.column(1).slice(a, b - a)))
                keys = _digests(words).view(np.int64)
                columns = [pa.array(words.n, pa.int64()), *(pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_words", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, n_words long, k1 long, k2 long")


def _cores(docs: DataFrame, size: int, core: int) -> DataFrame:
    """(doc_id, cores): the distinct minimizers of each text. They are as large as a third of the text, and cheap to
    make, so they are made again where they are needed rather than stored or shuffled."""

    def run(batches):
        for batch in batches:
            for a, b in C.chunks(batch.column(1)):
                words = C.Words(*C.text_bytes(batch.column(1).slice(a, b - a)))
                at, low = _windows(words, size, core)
                rows = words.row[at]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
                rows, low = rows[new], low[new]
                order = np.lexsort((low, rows))
                rows, low = rows[order], low[order]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])
                rows, low = rows[new], low[new]
                offsets = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                cores = pa.ListArray.from_arrays(pa.array(offsets), pa.array(low.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), cores], ["doc_id", "cores"])

    return docs.mapInArrow(run, "doc_id long, cores array<long>")


def choose_prefixes(docs: DataFrame, size: int, share: float = SHARE, sample: int = SAMPLE) -> list[np.ndarray]:
    """For each length, the prefixes to be extended: those with more than `share` of at most `sample` suffixes."""

    def run(batches):
        for batch in batches:
            for a, b in C.chunks(batch.column(1)):
                words = C.Words(*C.text_bytes(batch.column(1).slice(a, b - a)))
                at = np.flatnonzero(words.first[words.row + 1] - np.arange(len(words.hash)) >= size)
                at = at[C.mix(words.hash[at] ^ (at.astype(np.uint64) * MIX2)) % np.uint64(256) == 0]
                if len(at):
                    both = np.stack(list(_prefixes(words.hash, at, size)), 1)
                    flat = pa.array(both.view(np.int64).ravel())
                    offsets = pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat)], ["p"])

    rows = docs.mapInArrow(run, "p array<long>").limit(sample).collect()
    taken = np.array([r.p for r in rows], np.int64).reshape(len(rows), size).view(np.uint64)
    out = []
    for d in range(size - 1):
        values, times = np.unique(taken[:, d], return_counts=True)
        out.append(values[times > max(1, share * len(rows))])
    return out


def _group(hashes: np.ndarray, at: np.ndarray, size: int, heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Group (of the variable-length prefix: 16 bits of its fingerprint) and node (of all `size` words) of suffixes."""
    group = np.zeros(len(at), np.uint64)
    open_ = np.ones(len(at), bool)
    for d, value in enumerate(_prefixes(hashes, at, size)):
        group[open_] = value[open_]
        if d < size - 1:
            open_ &= np.isin(value, heavy[d]) if len(heavy[d]) else False
    return group & np.uint64(0xFFFF), C.mix(value ^ MIX2)


def repeats(docs: DataFrame, folder: str, size: int = SIZE, core: int = CORE) -> DataFrame:
    """(doc_id, at, n): `n` windows from word `at` on (0-based) whose words also start in a document of lesser id.

    `docs`: (id, words): texts by id, ids not null. Runs of one document may touch or overlap.
    """
    keys = C.cut(_keys(docs), folder, "keys").where(F.col("n_words") >= size)
    firsts = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    tagged = C.cut(keys.join(firsts, ["k1", "k2"]).select("doc_id", "n_words", (F.col("doc_id") > F.col("least")).alias("copy")), folder, "tagged")
    copies = tagged.where("copy").select("doc_id", "n_words")
    gone = tagged.groupBy("doc_id").agg(F.min("copy").alias("copy")).where("copy").select("doc_id")
    # a merge join at every size; it reads the exchange that the other joins by id read
    cores = _cores(docs.join(gone.hint("merge"), docs.id == gone.doc_id, "left_anti"), size, core)
    cores = cores.select("doc_id", F.explode("cores").alias("core"))
    shared = cores.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core")
    wanted = cores.join(shared, "core").groupBy("doc_id").agg(F.collect_set("core").alias("cores"))
    whole = copies.select("doc_id", F.lit(0).alias("at"), (F.col("n_words") - size + 1).cast("int").alias("n"))
    heavy = choose_prefixes(docs, size)

    def suffixes(batches):
        for batch in batches:
            text = batch.column(1)
            for a, b in C.chunks(text):
                words = C.Words(*C.text_bytes(text.slice(a, b - a)))
                at, low = _windows(words, size, core)
                lists = batch.column(2).slice(a, b - a)
                own = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                tie = lambda value, row: C.mix(value + row.astype(np.uint64) * MIX2)
                at = at[np.isin(tie(low, words.row[at]), tie(own, np.repeat(np.arange(b - a), sizes)))]
                if not len(at):
                    continue
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                doc = ids[words.row[at]]
                group, node = _group(words.hash, at, size, heavy)
                place = at - words.first[words.row[at]]
                # the batch's own subtree: all but the least document of a node are settled here
                order = np.lexsort((place, doc, node))
                head = np.ones(len(at), bool)
                head[1:] = node[order][1:] != node[order][:-1]
                least = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
                settled = np.zeros(len(at), bool)
                settled[order] = doc[order] > least
                send = ~settled
                runs = np.flatnonzero(settled)
                if len(runs):
                    new = np.ones(len(runs), bool)
                    new[1:] = (at[runs][1:] != at[runs][:-1] + 1) | (words.row[at[runs]][1:] != words.row[at[runs]][:-1])
                    starts = np.flatnonzero(new)
                    length = np.diff(np.append(starts, len(runs)))
                    runs = runs[starts]
                else:
                    length = np.zeros(0, np.int64)
                columns = (
                    np.concatenate([group[send], C.mix(doc[runs].astype(np.uint64)) & np.uint64(0xFFFF)]).astype(np.int32),
                    np.concatenate([node[send], np.zeros(len(runs), np.uint64)]).view(np.int64),
                    np.concatenate([doc[send], doc[runs]]),
                    np.concatenate([place[send], place[runs]]).astype(np.int32),
                    np.concatenate([np.zeros(int(send.sum()), np.int64), length]).astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "node", "doc_id", "at", "n"])

    def subtrees(batches):
        group = node = least = None
        for batch in batches:
            g, k, doc, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(g):
                continue
            head = np.ones(len(g), bool)
            head[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
            head[0] = not (g[0] == group and k[0] == node)
            first = np.where(head, doc, 0)
            at_head = np.maximum.accumulate(np.where(head, np.arange(len(g)), -1))
            lowest = np.where(at_head >= 0, first[np.maximum(at_head, 0)], least if least is not None else 0)
            group, node, least = g[-1], k[-1], lowest[-1]
            take = (n > 0) | (doc > lowest)
            if take.any():
                columns = (doc[take], at[take], np.maximum(n[take], 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "at", "n"])

    rows = docs.join(wanted, docs.id == wanted.doc_id).select("id", "words", "cores")
    sent = rows.mapInArrow(suffixes, "g int, node long, doc_id long, at int, n int")
    nodes = sent.repartition("g").sortWithinPartitions("g", "node", "doc_id")
    return nodes.mapInArrow(subtrees, "doc_id long, at int, n int").union(whole)


def without_repeats(docs: DataFrame, folder: str, size: int = SIZE, core: int = CORE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space.

    Texts are dealt by id once: the columns are renamed, so that both joins read one and the same exchange.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("words"))
    named = docs.where("id is not null")
    marks = repeats(named, folder, size, core).groupBy("doc_id").agg(
        F.collect_list("at").alias("at"), F.collect_list("n").alias("n")
    )
    joined = named.join(marks, F.col("id") == F.col("doc_id"), "left").select("id", "words", "at", "n")
    none = F.lit(None).cast("array<int>")
    joined = joined.union(docs.where("id is null").select("id", "words", none, none))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, at, n in zip(*(batch.column(i) for i in range(4))):
                words = (text.as_py() or "").encode().split()
                kept = words
                if at.is_valid and len(words) >= size:
                    change = np.zeros(len(words) + 1, np.int64)
                    start, length = np.array(at.as_py()), np.array(n.as_py())
                    ok = start + length + size - 1 <= len(words)  # another row of this id may be longer
                    np.add.at(change, start[ok], 1)
                    np.add.at(change, start[ok] + length[ok] + size - 1, -1)
                    keep = np.cumsum(change)[:-1] == 0
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                out.append((doc.as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode()))
            ids, total, gone, text = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
