"""Blocks of whole documents: what a block's texts hold in common is numbered inside the block and looked up once.

A task cuts its documents into blocks of a few megabytes. Every distinct thing of a block (a segment, a word, a pair of
ids) has a number there, and the documents are kept as runs of such numbers or as a sparse matrix, packed small. Only a
block's distinct keys travel to meet the rest of the corpus, and the answers come back as one array for each block. So a
key that all documents share sends one row a block, and no row of a document waits for a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

BYTES = 1 << 22
SPACE_SIGN = "▁"


# --- numbers packed small ---------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 0 and more as eight planes of bytes, compressed: the upper planes of small numbers cost nothing."""
    planes = np.ascontiguousarray(np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    body = pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True) if len(x) else b""
    return len(x).to_bytes(8, "little") + body


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], n * 8, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


class Sparse:
    """A matrix of counts by row in compressed form: `first[i]:first[i + 1]` are row i's `column` and `value`."""

    def __init__(self, first: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.first, self.column, self.value, self.width = first, column, value, width

    @classmethod
    def of_cells(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray | None, height: int, width: int) -> Sparse:
        """Cells in any order, those of one place added up; without `value` each counts 1."""
        cell = row.astype(np.int64) * max(width, 1) + column
        if value is None:
            cell, total = np.unique(cell, return_counts=True)
        else:
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            total = np.add.reduceat(value[order], head) if len(head) else np.zeros(0, np.int64)
            cell = cell[head]
        return cls(np.searchsorted(cell, np.arange(height + 1) * max(width, 1)), cell % max(width, 1), total.astype(np.int64), width)

    @property
    def height(self) -> int:
        return len(self.first) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.first))

    def times(self, x: np.ndarray) -> np.ndarray:
        """The product with a vector."""
        sums = np.append(0, np.cumsum(self.value * x[self.column]))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def product(self, other: Sparse) -> Sparse:
        """Rows of `other` added up with the weights of each row here (Gustavson's row product)."""
        size = np.diff(other.first)[self.column]
        at = ranges(other.first[self.column], size)
        row = np.repeat(self.rows(), size)
        return Sparse.of_cells(row, other.column[at], np.repeat(self.value, size) * other.value[at], self.height, other.width)

    def turned(self) -> Sparse:
        return Sparse.of_cells(self.column, self.rows(), self.value, self.width, self.height)

    def packed(self) -> bytes:
        parts = [pack(np.diff(self.first)), pack(np.diff(self.rows() * max(self.width, 1) + self.column, prepend=0)), pack(self.value)]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts) + self.width.to_bytes(8, "little")

    @classmethod
    def unpacked(cls, raw: bytes) -> Sparse:
        parts, at = [], 0
        for _ in range(3):
            n = int.from_bytes(raw[at : at + 8], "little")
            parts.append(unpack(raw[at + 8 : at + 8 + n]))
            at += 8 + n
        width = int.from_bytes(raw[at : at + 8], "little")
        return cls(np.append(0, np.cumsum(parts[0])), np.cumsum(parts[1]) % max(width, 1), parts[2], width)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


def pack_bytes(entries: list[bytes]) -> bytes:
    """Byte strings in their order; sorted ones take the least room."""
    sizes, whole = pack(np.array([len(x) for x in entries], np.int64)), b"".join(entries)
    body = pa.Codec("zstd", compression_level=1).compress(whole, asbytes=True) if whole else b""
    return len(sizes).to_bytes(8, "little") + sizes + body


def unpack_bytes(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(unpack(raw[8 : 8 + n])).tolist()
    whole = pa.Codec("zstd").decompress(raw[8 + n :], ends[-1], asbytes=True) if ends and ends[-1] else b""
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


# --- texts cut before spaces ------------------------------------------------------------------------


class Segments:
    """Texts, each with a space before it, cut before spaces; empty texts have no segment.

    `buffer[start[i]:stop[i]]` is segment i, `first[t]:first[t + 1]` are those of text t. A cut lies before a space that
    follows something else; with `strict`, only where a character that cannot be white space follows the space, and
    U+2581 counts as an ordinary character (it is a space otherwise).
    """

    def __init__(self, column: pa.Array, strict: bool = False):
        column = column.cast(pa.large_string())
        if not strict:
            column = pc.replace_substring(column, SPACE_SIGN, " ")
        raw, offsets = C.text_bytes(column)
        sizes = np.diff(offsets)
        shift = np.cumsum(sizes > 0)
        buffer = np.full(len(raw) + (int(shift[-1]) if len(shift) else 0), 32, np.uint8)
        ends = offsets[1:] + shift if len(shift) else np.zeros(0, np.int64)
        heads = np.append(0, ends)
        body = np.ones(len(buffer), bool)
        body[heads[:-1][sizes > 0]] = False
        buffer[body] = raw
        space = buffer == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if strict and len(buffer):
            lead = np.append(buffer[1:], 32)
            cut &= _DARK[lead]
        cut[heads[:-1][sizes > 0]] = True
        self.buffer, self.start = buffer, np.flatnonzero(cut)
        self.stop = np.append(self.start[1:], len(buffer)) if len(self.start) else self.start
        self.first = np.searchsorted(self.start, heads)
        self.row = np.repeat(np.arange(len(sizes)), np.diff(self.first))
        self.heads = heads

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each distinct segment, one place of it, and the number of every segment's own; equal by bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = C.Words(self.buffer, np.append(self.start, len(self.buffer)), _EVERY).hash
        key, one, which = np.unique(value, return_index=True, return_inverse=True)
        self._same(one, which)
        return key, one, which

    def _same(self, one: np.ndarray, which: np.ndarray, run: int = 1 << 16) -> None:
        """Every segment has the bytes of the one that stands for it."""
        size = self.stop - self.start
        if not np.array_equal(size, size[one][which]):
            raise ValueError("two segments share a 64-bit hash")
        for low in range(0, len(which), run):
            mine = slice(low, low + run)
            at = ranges(self.start[one][which[mine]], size[mine])
            if not np.array_equal(self.buffer[at], self.buffer[self.start[low] : self.stop[min(low + run, len(which)) - 1]]):
                raise ValueError("two segments share a 64-bit hash")

    def bytes_of(self, i: np.ndarray) -> list[bytes]:
        raw = self.buffer.tobytes()
        return [raw[a:b] for a, b in zip(self.start[i].tolist(), self.stop[i].tolist())]


_EVERY = np.ones(256, bool)
#: First bytes of characters that are certainly no white space: ASCII signs, and leads of which no white space begins.
_DARK = np.array([33 <= b <= 126 or 0xC3 <= b <= 0xDF or 0xE4 <= b <= 0xF4 for b in range(256)])


# --- blocks -----------------------------------------------------------------------------------------


def cut_batch(batch: pa.RecordBatch, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of the first column; a longer text is a run of its own."""
    for a, b in C.chunks(batch.column(0), most):
        yield batch.slice(a, b - a)


def numbering() -> Iterator[int]:
    """Numbers for the blocks of a task, which no other task gives; a task that runs again gives the same."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    while True:
        yield number
        number += 1


class Numbered:
    """Distinct byte strings in the order a task met them, found by hash; equal hashes of other bytes are refused."""

    def __init__(self):
        self.key, self.place, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def __len__(self) -> int:
        return len(self.entries)

    def numbers(self, key: np.ndarray, entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of `entries`, whose `key` are sorted and distinct, and which of them are new."""
        at = np.searchsorted(self.key, key)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == key[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            self.place = np.insert(self.place, at[fresh], np.arange(len(self), len(self) + len(fresh)))
            self.key = np.insert(self.key, at[fresh], key[fresh])
            self.entries += [entries[i] for i in fresh.tolist()]
        out = self.place[np.searchsorted(self.key, key)]
        if [self.entries[i] for i in out.tolist()] != entries:
            raise ValueError("two byte strings share a 64-bit hash")
        return out, fresh


def structs(batch: pa.RecordBatch, names: list[str]) -> pa.ListArray:
    """Columns 1, 2, ... of a batch as one list of structs."""
    arrays = [batch.column(i + 1) for i in range(len(names))] or [pa.nulls(len(batch), pa.bool_())]
    made = pa.StructArray.from_arrays([pa.concat_arrays([a]) if a.offset else a for a in arrays], names or ["none"])
    return pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), made)


def look_up(blocks: DataFrame, found: DataFrame, values: list[str], keys: Column | str = "keys") -> DataFrame:
    """`blocks` with arrays `at` and `values`: what `found` (key, values) says of the keys that it knows.

    Entry i of `at` is the place in `keys` of the key whose values stand at i. `blocks` is a written table: its keys are
    read apart from the rest, travel to the table of values and come back to their block as one list.
    """
    asked = blocks.select("block", F.posexplode(keys).alias("at", "key"))
    back = asked.join(found.select("key", *values), "key").groupBy(F.col("block").alias("__of"))
    answers = back.agg(*(F.collect_list(c).alias(c) for c in ("at", *values)))
    rest = blocks.drop(keys) if isinstance(keys, str) else blocks
    return rest.join(answers, F.col("block") == F.col("__of"), "left").drop("__of")


def spread(at: pa.Scalar, value: pa.Scalar, size: int) -> np.ndarray:
    """The answers of one block as an array by place; 0 where none came."""
    out = np.zeros(size, np.int64)
    if at.values is not None:
        out[at.values.to_numpy()] = value.values.to_numpy()
    return out
