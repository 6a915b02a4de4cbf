"""Alignment of the tokens of two tokenizers over the bytes of each text.

A text with a space before it is cut where neither tokenizer can have a token across (before a space that follows
something else and is followed by a character that is no white space). The distinct segments of a task are encoded by
both libraries once. For them two incidence matrices tokens x bytes are built in compressed rows; the row product
A * B^T (Gustavson) has a cell for each pair of tokens that share a byte, the overlap links. Byte places where both a
token of A and one of B end close a group; the product of the incidence matrices tokens x groups gives the links within
groups. A text is the sequence of its segments: its groups are theirs, its numbers the product of the matrix
texts x segments with theirs.

How many links an id pair has corpus-wide is summed over blocks of documents; each block looks up the pairs it holds and
multiplies segments x pairs, then texts x segments, with the answers.

Defined cases: null and empty texts, and texts whose joined token bytes are not a space and the text (U+2581 becomes a
space in B), have no tokens: zeros, and '' for the groups. Special strings inside texts are ordinary text. Rows are
aligned each, also those whose id is null or repeated. Pairs with equal counts are all best ones of their B id. An empty
table gives no row. Columns of `docs` beside `carry` do not matter; those in `carry` must not be named like the columns
made (ValueError). A very long text is a block of its own: memory follows the longest text, at about thirty times its
bytes. Segments are known by 64-bit hashes within a task; their bytes are compared too, and the job fails where equal
hashes have other bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B, common as C

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
MADE = (*COUNTS, "n_best", "count_sum", "groups", "groups_sha256")
#: Segments that a task remembers with their alignment; with more it starts anew.
REMEMBERED = 1 << 19
#: Segments that the libraries encode at once.
AT_ONCE = 1 << 13


class Encoders:
    """A byte-level BPE (JSON) and a SentencePiece model, as files' contents; each worker opens them once."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b, self._open = a, b, None

    def __getstate__(self):
        return {"a": self.a, "b": self.b, "_open": None}

    @classmethod
    def load(cls, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Encoders:
        import public_tokenizers as P

        with open(P.path(a), encoding="utf-8") as fa, open(P.path(b), "rb") as fb:
            return cls(fa.read(), fb.read())

    def opened(self) -> tuple:
        """Both libraries' encoders, and the bytes of each of their ids."""
        if self._open is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            from tokenizers import Tokenizer

            a = Tokenizer.from_str(self.a)
            a.encode_special_tokens = True
            b = sentencepiece.SentencePieceProcessor(model_proto=self.b)
            self._open = a, b, _Bytes(_level_bytes(a)), _Bytes(_piece_bytes(b))
        return self._open

    def ids_a(self, segments: list[bytes]) -> list[list[int]]:
        a = self.opened()[0]
        return [x.ids for x in a.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]

    def ids_b(self, segments: list[bytes]) -> list[list[int]]:
        """The space that a segment begins with is the one that the library puts there."""
        b = self.opened()[1]
        texts = [s[1:].decode() for s in segments]
        ids = b.encode(texts, num_threads=1)
        blank = [b.piece_to_id(B.SPACE_SIGN)]
        return [x if t else blank for x, t in zip(ids, texts)]


class _Bytes:
    """The bytes of ids: `size` of each, and the bytes of a list of ids, joined."""

    def __init__(self, of: list[bytes]):
        self.size = np.array([len(x) for x in of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(of), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[B.ranges(self.start[ids], self.size[ids])]


def _level_bytes(a) -> list[bytes]:
    """Byte-level entries: printable Latin-1 signs stand for their own byte, the others for 256 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in own]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}
    out = [b""] * a.get_vocab_size()
    for entry, i in a.get_vocab().items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def _piece_bytes(b) -> list[bytes]:
    plain = lambda i: b"" if b.is_control(i) or b.is_unknown(i) else b.id_to_piece(i).replace(B.SPACE_SIGN, " ").encode()
    return [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else plain(i) for i in range(b.get_piece_size())]


class Aligned:
    """Alignment of segments: `counts` (one row for each of COUNTS), `valid`, `groups` as text, and pairs of ids by segment."""

    def __init__(self, segments: list[bytes], encoders: Encoders):
        _, _, bytes_a, bytes_b = encoders.opened()
        raw = np.frombuffer(b"".join(segments), np.uint8)
        edge = np.append(0, np.cumsum([len(s) for s in segments])).astype(np.int64)
        ids = [_flat(encoders.ids_a(segments)), _flat(encoders.ids_b(segments))]
        self.valid = np.ones(len(segments), bool)
        for (flat, first), known in zip(ids, (bytes_a, bytes_b)):
            self.valid &= _spell(flat, first, known, raw, edge)
        keep = np.flatnonzero(self.valid)
        (a, first_a), (b, first_b) = (_only(flat, first, keep) for flat, first in ids)
        end_a, end_b = np.cumsum(bytes_a.size[a]), np.cumsum(bytes_b.size[b])
        n_bytes = int(end_a[-1]) if len(end_a) else 0
        ends = np.intersect1d(end_a, end_b)
        links = over_bytes(end_a, n_bytes).product(over_bytes(end_b, n_bytes).turned())
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        shared = within(group_a, len(ends)).product(within(group_b, len(ends)).turned())
        segment_a, segment_b = np.repeat(keep, np.diff(first_a)), np.repeat(keep, np.diff(first_b))
        n = len(segments)
        of_group = segment_a[np.searchsorted(group_a, np.arange(len(ends)))]
        per = lambda owners: np.bincount(owners, minlength=n)
        owner = segment_a[links.rows()]
        self.counts = np.array([per(segment_a), per(segment_b), per(of_group), per(owner), per(segment_a[shared.rows()])], np.int64).reshape(5, n)
        self.pair = (a[links.rows()].astype(np.int64) << 32) | b[links.column]
        self.pair_first = np.append(0, np.cumsum(per(owner)))
        self.groups = _written(a, group_a, b, group_b, of_group, n)


def over_bytes(end: np.ndarray, n_bytes: int) -> B.Sparse:
    """The incidence matrix tokens x bytes of tokens that lie end to end."""
    return B.Sparse(np.append(0, end), np.arange(n_bytes), np.ones(n_bytes, np.int64), n_bytes)


def within(group: np.ndarray, n_groups: int) -> B.Sparse:
    """The incidence matrix tokens x groups."""
    return B.Sparse(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), n_groups)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
    return np.fromiter((i for x in ids for i in x), np.int64, int(first[-1])), first


def _only(flat: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[keep]
    return flat[B.ranges(first[keep], size)], np.append(0, np.cumsum(size)).astype(np.int64)


def _spell(flat: np.ndarray, first: np.ndarray, known: _Bytes, raw: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether each segment's tokens, joined, are its bytes."""
    reach = np.append(0, np.cumsum(known.size[flat]))
    start, size = reach[first[:-1]], np.diff(reach[first])
    right = size == np.diff(edge)
    mine, wanted = B.ranges(start[right], size[right]), B.ranges(edge[:-1][right], size[right])
    wrong = np.flatnonzero(known.joined(flat)[mine] != raw[wanted])
    rows = np.flatnonzero(right)
    right[rows[np.searchsorted(np.cumsum(size[right]), wrong, "right")]] = False
    return right & (np.diff(edge) > 0)


def _written(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, of_group: np.ndarray, n: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each segment, '' of one without tokens."""
    size = lambda group: np.bincount(group, minlength=len(of_group)).tolist()
    text_a, text_b, i, k, parts = list(map(str, a.tolist())), list(map(str, b.tolist())), 0, 0, []
    for x, y in zip(size(group_a), size(group_b)):
        parts.append(f"{','.join(text_a[i : i + x])}|{','.join(text_b[k : k + y])}")
        i, k = i + x, k + y
    out, low = [], 0
    for m in np.bincount(of_group, minlength=n).tolist():
        out.append(";".join(parts[low : low + m]).encode())
        low += m
    return out


class Memory:
    """Alignments of the segments a task has met."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self._clear()

    def _clear(self) -> None:
        self.known, self.groups, self.counts, self.valid = B.Numbered(), [], np.zeros((5, 0), np.int64), np.zeros(0, bool)
        self.pair, self.pair_first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def places(self, key: np.ndarray, segments: list[bytes]) -> np.ndarray:
        """Where the alignment of each distinct segment stands; those met first are aligned now."""
        if len(self.known) + len(key) > REMEMBERED:
            self._clear()
        out, fresh = self.known.numbers(key, segments)
        if len(fresh):
            made = [Aligned([segments[i] for i in fresh[a : a + AT_ONCE].tolist()], self.encoders) for a in range(0, len(fresh), AT_ONCE)]
            self.groups += [x for m in made for x in m.groups]
            self.counts = np.concatenate([self.counts, *(m.counts for m in made)], 1)
            self.valid = np.concatenate([self.valid, *(m.valid for m in made)])
            links = np.concatenate([np.diff(m.pair_first) for m in made])
            self.pair_first = np.append(self.pair_first, self.pair_first[-1] + np.cumsum(links))
            self.pair = np.concatenate([self.pair, *(m.pair for m in made)])
        return out


def _aligned_rows(part: pa.RecordBatch, memory: Memory, digest: bool):
    """Of a run of texts: counts by text, texts of groups (or their digests), matrix texts x segments, their places."""
    parts = B.Segments(part.column(0), strict=True)
    key, one, which = parts.distinct()
    place = memory.places(key, parts.bytes_of(one))
    n = len(part)
    bad = np.zeros(n, bool)
    bad[parts.row[~memory.valid[place][which]]] = True
    live = ~bad[parts.row]
    cells = B.Sparse.of_cells(parts.row[live], which[live], None, n, len(key))
    groups = np.empty(len(key), object)
    groups[:] = [memory.groups[i] for i in place.tolist()]
    written = []
    for i in range(n):
        mine = which[parts.first[i] : parts.first[i + 1]]
        text = b"" if bad[i] else b";".join(groups[mine].tolist())
        written.append((hashlib.sha256(text).hexdigest() if text else "") if digest else text.decode())
    return [cells.times(c) for c in memory.counts[:, place]], written, cells, place


def _documents(docs: DataFrame, carry: list[str]) -> DataFrame:
    if set(carry) & set(MADE):
        raise ValueError(f"columns named like {MADE} cannot be carried")
    return docs.select(F.col("text").cast("string").alias("__text"), *carry)


def aligned_groups(docs: DataFrame, encoders: Encoders, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`carry`, COUNTS and `groups`: the ids of A and B of every group, as `a1,a2|b1;a3|b2,b3`."""
    shared, fields = docs.sparkSession.sparkContext.broadcast(encoders), [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups", T.StringType())])

    def run(batches):
        memory = Memory(shared.value)
        for batch in batches:
            for part in B.cut_batch(batch):
                counts, written, _, _ = _aligned_rows(part, memory, False)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *map(pa.array, counts), pa.array(written, pa.string())], schema.names)

    return _documents(docs, list(carry)).mapInArrow(run, schema)


def aligned_blocks(docs: DataFrame, encoders: Encoders, carry: list[str]) -> DataFrame:
    """One row for each block: its documents with counts and digests, its pairs of ids (`keys`) and how many links of
    the block hold each, and the matrices texts x segments and segments x pairs."""
    docs_ = _documents(docs, carry)
    shared = docs.sparkSession.sparkContext.broadcast(encoders)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("rows", T.ArrayType(T.StructType([docs.schema[c] for c in carry] or [T.StructField("none", T.BooleanType())]))),
        *(T.StructField(c, longs) for c in COUNTS), T.StructField("groups_sha256", T.ArrayType(T.StringType())),
        T.StructField("keys", longs), T.StructField("links", longs),
        T.StructField("texts", T.BinaryType()), T.StructField("segments", T.BinaryType()),
    ])

    def run(batches):
        number, memory = B.numbering(), Memory(shared.value)
        listed = lambda x, kind=pa.int64(): pa.array([x], pa.list_(kind))
        for batch in batches:
            for part in B.cut_batch(batch):
                counts, written, texts, place = _aligned_rows(part, memory, True)
                size = np.diff(memory.pair_first)[place]
                held = memory.pair[B.ranges(memory.pair_first[place], size)]
                keys, column = np.unique(held, return_inverse=True)
                segments = B.Sparse.of_cells(np.repeat(np.arange(len(place)), size), column, None, len(place), len(keys))
                often = np.bincount(texts.column, weights=texts.value, minlength=len(place)).astype(np.int64)
                columns = [listed(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(number)], pa.int64()), B.structs(part, carry), *columns, listed(written, pa.string()),
                        listed(keys), listed(segments.turned().times(often)),
                        pa.array([texts.packed()], pa.binary()), pa.array([segments.packed()], pa.binary()),
                    ],
                    schema.names,
                )

    return docs_.mapInArrow(run, schema)


def pair_links(blocks: DataFrame) -> DataFrame:
    """(key, count): links of each id pair, `key` being the A id times 2^32 and the B id."""
    each = blocks.select(F.explode(F.arrays_zip("keys", "links")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.links").alias("n"))
    return each.where("n > 0").groupBy("key").agg(F.sum("n").alias("count"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """`pairs` with `best`: 1 where no pair of the same B id has more links. One row for each B id is broadcast: the
    model's vocabulary, of fixed size."""
    b = F.col("key").bitwiseAND(0xFFFFFFFF)
    most = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return pairs.join(F.broadcast(most), b == F.col("b")).select("key", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def alignment(docs: DataFrame, encoders: Encoders, folder: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`carry`, COUNTS, `n_best` (links whose pair is a best one of its B id), `count_sum` (their pairs' counts, over
    all links) and `groups_sha256`. Blocks and pair counts are written below `folder`."""
    carry = list(carry)
    blocks = C.cut(aligned_blocks(docs, encoders, carry), folder, "blocks")
    pairs = C.cut(pair_links(blocks), folder, "pairs")
    answered = B.look_up(blocks.drop("links"), best_pairs(pairs), ["count", "best"])
    made = (*COUNTS, "n_best", "count_sum")
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(c, T.LongType()) for c in made), T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {f.name: batch.column(k)[i] for k, f in enumerate(batch.schema)}
                texts, segments = B.Sparse.unpacked(row["texts"].as_py()), B.Sparse.unpacked(row["segments"].as_py())
                sums = [texts.times(segments.times(B.spread(row["at"], row[c], segments.width))) for c in ("best", "count")]
                own = [row["rows"].values.field(k) for k in range(len(carry))]
                columns = [*own, *(row[c].values for c in COUNTS), *map(pa.array, sums), row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return answered.drop("block").mapInArrow(run, schema)
