"""What several of the text operators share: the scratch folder, word hashing in numpy, components of a link graph.

Words are found on the UTF-8 bytes of a whole Arrow batch at once: a 256-entry table says which bytes belong to
words, and a word's 64-bit hash is a polynomial of its bytes, read off two running sums. The work is done in blocks
of bytes, so that memory follows the number of words and not eight times the bytes.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Uneven multipliers for the places of a shingle.
PLACES = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder of the cluster; one of this machine only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame written below `folder` and read back: later steps start there, also after executors are lost."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder, or one table of it, that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- numpy kernels --------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """The first BLOCK powers of a base, made where they are used: functions travel to the tasks without the 2 MB."""

    def __init__(self, base: int):
        self.base, self.made = base, None

    def __reduce__(self):
        return _Powers, (self.base,)

    def get(self) -> np.ndarray:
        if self.made is None:
            out = np.ones(BLOCK, np.uint64)
            out[1:] = np.uint64(self.base)
            self.made = np.multiply.accumulate(out)
        return self.made


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _plain_words() -> np.ndarray:
    keep = np.ones(256, bool)
    keep[[32, 9, 10, 11, 12, 13]] = False
    return keep


PLAIN = _plain_words()
#: Letters and digits of ASCII, and every byte of longer characters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """Words of many texts: `hash`, byte range [`start`, `end`), and `first[i]:first[i + 1]` are the words of text i."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray = PLAIN, lower: bool = False):
        n = len(raw)
        rows = np.unique(offsets[:-1])  # a text's first byte starts a word even without a space before it
        powers, inverses = _UP.get(), _DOWN.get()
        starts, ends, heads, tails = [], [], [], []
        carry, up, down, before, last = np.uint64(0), np.uint64(1), np.uint64(1), False, 0
        for o in range(0, n, BLOCK):
            seg = raw[o : o + BLOCK]
            m = len(seg)
            inside = keep[seg]
            if lower:
                seg = _latin_lower(raw, o, m)
            shifted = np.empty(m, bool)
            shifted[0], shifted[1:] = before, inside[:-1]
            before = bool(inside[-1])
            edge = inside != shifted
            start, end = edge & inside, edge & shifted
            cuts = rows[np.searchsorted(rows, o) : np.searchsorted(rows, o + m)] - o
            cuts = cuts[(cuts + o > 0)]
            start[cuts] = inside[cuts]
            end[cuts] = shifted[cuts]
            terms = (seg.astype(np.uint64) + np.uint64(1)) * (powers[:m] * up)
            terms[~inside] = 0
            sums = np.cumsum(terms) + carry
            exclusive = sums - terms
            s, e = np.flatnonzero(start), np.flatnonzero(end)
            starts.append(s + o)
            ends.append(e + o)
            heads.append((exclusive[s], inverses[s] * down))
            tails.append(exclusive[e])
            carry = sums[-1]
            with np.errstate(over="ignore"):
                up, down = up * powers[-1] * np.uint64(_BASE), down * inverses[-1] * np.uint64(_INVERSE)
            last = o + m
        if before:
            ends.append(np.array([last]))
            tails.append(np.array([carry], np.uint64))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.start, self.end = cat(starts, np.int64), cat(ends, np.int64)
        head, scale = cat([h for h, _ in heads], np.uint64), cat([d for _, d in heads], np.uint64)
        self.hash = mix((cat(tails, np.uint64) - head) * scale)
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.n)), self.n)


def _latin_lower(raw: np.ndarray, o: int, m: int) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case; the length in bytes stays."""
    seg = LOWER[raw[o : o + m]]
    prev = np.empty(m, np.uint8)
    prev[0], prev[1:] = raw[o - 1] if o else 0, raw[o : o + m - 1]
    here = (prev == 0xC3) & (seg >= 0x80) & (seg <= 0x9E) & (seg != 0x97)
    seg[here] += 32
    return seg


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `size` words; a text with fewer words has one run of all its words."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, n)):
        out[: n - i] += words.hash[i:] * PLACES[i]
    left = words.first[words.row + 1] - np.arange(n)
    whole = left >= size
    short = (words.n[words.row] < size) & (words.first[words.row] == np.arange(n))
    if short.any():
        place = np.arange(n) - words.first[words.row]
        terms = words.hash * PLACES[np.minimum(place, size)]
        total = np.add.reduceat(np.append(terms, np.uint64(0)), words.first[:-1])
        out[short] = (total[words.row] + words.n[words.row].astype(np.uint64))[short]
    keep = whole | short
    return mix(out[keep]), words.row[keep]


def chunks(column: pa.Array, most: int = 1 << 21):
    """Runs of rows (start, stop) with about `most` bytes of text each; a longer text is a run of its own."""
    sizes = np.cumsum(np.diff(text_bytes(column)[1])) if len(column) else np.zeros(0, np.int64)
    start, base = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield start, stop
        base, start = int(sizes[stop - 1]), stop


# --- components -----------------------------------------------------------------------------------


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, class_id): the least node that each node of `links` (a, b: long) is connected with.

    Large-star and small-star steps in turn until nothing changes: each node hands its larger neighbours, then its
    smaller ones, over to the least node it knows. The link table is written in the shared folder after each round;
    a hub's neighbours are joined with its least one, never gathered in one task. No link gives no row.
    """
    spark = links.sparkSession

    def least(df: DataFrame, by: str, other: str) -> DataFrame:
        return df.groupBy(by).agg(F.least(F.min(other), F.col(by)).alias("m"))

    def state(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        return row[0], row[1]

    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), folder, f"{name}-0")
    seen, k = state(edges), 0
    while seen[0]:
        both = edges.union(edges.select("b", "a"))
        large = both.join(least(both, "a", "b"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = least(large, "a", "b")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        new = cut(small, folder, f"{name}-{k}")
        now = state(new)
        drop_folder(spark, f"{folder}/{name}-{k - 1}")
        edges = new
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class_id")).union(edges.select("b", "b").distinct())
