"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where a space follows something else; no piece goes across such a cut, so the distinct segments
stand for the text. They are laid end to end and a suffix array of that string is built (by doubling, as deep as the
longest piece). A binary search of every piece gives its range of suffixes, i.e. all its occurrences: edges, which are
sorted by position. Then they are relaxed. The public model at hand is a BPE model, whose encoding is not the path of the
best sum of scores but what merging yields: in every segment the best ranked edge that spans two neighbouring symbols is
taken, again and again, the leftmost among equals. Characters without a piece become byte pieces. The result is that of
the SentencePiece library.

Decoding joins the pieces' bytes, and takes the one space away that encoding puts before a text.

Defined cases: null and empty texts have no pieces and decode to the empty text; text is not normalised, as the model
has the identity; U+2581 is the model's sign for a space and comes back as one; rows are encoded each; other columns are carried where `carry` names them.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B, common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Segments longer than this are merged with a queue, one by one; bytes of distinct segments in one suffix array.
LONG, AT_ONCE = 256, 1 << 19
#: Bytes of texts that are put together at once (longer texts are cut), and that share a search; segments remembered.
CHUNK, WINDOW, REMEMBERED = 1 << 20, 1 << 23, 1 << 17
NONE = np.iinfo(np.int32).max
#: Numbers in one step of a gathering.
STEP = 1 << 18


class Pieces:
    """The pieces of a model: code points padded to `width`, ids, merge ranks, and the ids of the bytes."""

    def __init__(self, pieces: list[tuple[str, float, bool]]):
        """`pieces`: text, score and whether it is an ordinary piece, by id; byte pieces are written <0xNN>."""
        plain = [(t, s, i) for i, (t, s, ok) in enumerate(pieces) if ok]
        self.width = max(len(t) for t, _, _ in plain)
        self.codes = np.zeros((len(plain), self.width), np.int32)
        for row, (t, _, _) in enumerate(plain):
            self.codes[row, : len(t)] = [ord(c) for c in t]
            if chr(SPACE) in t.lstrip(chr(SPACE)):
                raise ValueError(f"piece {t!r} goes across a space")
        self.sizes = np.array([len(t) for t, _, _ in plain], np.int32)
        self.ids = np.array([i for _, _, i in plain], np.int32)
        order = np.argsort([-s for _, s, _ in plain], kind="stable")
        scores = np.array([s for _, s, _ in plain])[order]
        level = np.cumsum(np.append(0, scores[1:] != scores[:-1]))  # equal scores rank alike
        self.rank = np.empty(len(plain), np.int32)
        self.rank[order] = level
        self.byte_ids = np.full(256, -1, np.int32)
        self.raw: list[bytes] = []
        for i, (t, _, ok) in enumerate(pieces):
            if not ok and len(t) == 6 and t.startswith("<0x"):
                self.byte_ids[int(t[3:5], 16)] = i
                self.raw.append(bytes([int(t[3:5], 16)]))
            else:
                self.raw.append(t.replace(chr(SPACE), " ").encode() if ok else b"")
        self.raw_size = np.array([*map(len, self.raw), 0], np.int32)
        self.raw_start = np.cumsum(self.raw_size, dtype=np.int32) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        if (self.byte_ids < 0).any():
            raise ValueError("the model lacks byte pieces")


def load_pieces(path: str = MODEL) -> Pieces:
    """Read on the driver; the pieces, a vocabulary of fixed size, go to the tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return Pieces([(sp.id_to_piece(i), sp.get_score(i), not special(i)) for i in range(sp.get_piece_size())])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` in the order of the `depth` (or more) code points from there on."""
    rank = text.astype(np.int32) + np.int32(1)
    order, done = np.argsort(rank), 1
    while done < depth:
        key = rank * (np.int64(rank.max(initial=0)) + 1)
        if done < len(rank):
            key[:-done] += rank[done:]
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.append(1, 1 + np.cumsum(key[1:] != key[:-1], dtype=np.int32))[: len(order)]
        done *= 2
    return order.astype(np.int32)


def edges(text: np.ndarray, p: Pieces) -> np.ndarray:
    """Row of `p` of the piece at each place and of each length, or -1: all occurrences, by position."""
    order = suffix_array(text, p.width)
    padded = np.append(text, np.zeros(p.width, np.int32)).astype(np.int32)
    n, m = len(order), len(p.sizes)
    reach = np.arange(p.width)
    inside = reach[None, :] < p.sizes[:, None]

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            here = padded[order[mid][:, None] + reach[None, :]]
            differ = (here != p.codes[open_]) & inside[open_]
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            other = differ[rows, first]
            less = np.where(other, here[rows, first] < p.codes[open_, first], after)
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    low = bound(False)
    count = bound(True) - low
    # an edge's place and size are its cell, which is a sort by counting
    table = np.full((n, p.width + 1), -1, np.int16 if m < 1 << 15 else np.int32)
    ends = np.cumsum(count)
    a = 0
    while a < m:  # so many pieces at once that their edges, or those of one, are about STEP
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        rows = np.repeat(np.arange(a, b), count[a:b])
        table[order[B.ranges(low[a:b], count[a:b])], p.sizes[rows]] = rows
        a = b
    return table


def _merge_long(start: int, stop: int, table: np.ndarray, p: Pieces) -> np.ndarray:
    """Symbol starts of one long segment, with a queue of merges: rank, place and size in one number each."""
    n = stop - start
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    alive, size = bytearray(b"\1") * n, bytearray(b"\1") * n
    bits = n.bit_length()
    two = table[start : stop - 1, 2] if p.width > 1 else np.full(n - 1, -1)
    first = np.flatnonzero(two >= 0)
    queue = np.sort(((p.rank[two[first]].astype(np.int64) << bits | first) << 8) | 2).tolist()  # a sorted list is a heap

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            total = size[i] + size[after[i]]
            row = table[start + i, total] if total <= p.width else -1
            if row >= 0:
                heapq.heappush(queue, ((int(p.rank[row]) << bits | i) << 8) | total)

    while queue:
        top = heapq.heappop(queue)
        i, total = (top >> 8) & ((1 << bits) - 1), top & 255
        if not alive[i] or after[i] >= n or size[i] + size[after[i]] != total:
            continue
        j = after[i]
        alive[j], size[i], after[i] = 0, total, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return start + np.flatnonzero(np.frombuffer(bytes(alive), np.uint8))


def merged(first: np.ndarray, table: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the symbols when no merge is left. `first`: starts of the segments, and the end; a row of
    `table` stands for each place, and one more behind each segment."""
    size = np.diff(first)
    n = int(first[-1])
    done = []
    for s in np.flatnonzero(size > LONG):  # the rows of segment s begin s rows later
        done.append(_merge_long(int(first[s] + s), int(first[s + 1] + s), table, p) - s)
    segment = np.repeat(np.arange(len(size)), size)
    symbols = np.flatnonzero(size[segment] <= LONG)
    ends = first[1:]
    while len(symbols):
        own = segment[symbols]
        nxt = np.append(symbols[1:], n)
        last = np.append(own[1:] != own[:-1], True)
        stop = np.append(nxt[1:], n)
        stop = np.where(np.append(last[1:], True), ends[own], stop)  # the neighbour is the segment's last symbol
        total = stop - symbols
        ok = ~last & (total <= p.width)
        row = np.full(len(symbols), -1, np.int32)
        row[ok] = table[symbols[ok] + own[ok], total[ok]]
        rank = np.where(row >= 0, p.rank[row], NONE)
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        best = np.minimum.reduceat(rank, head)
        number = np.cumsum(np.append(False, own[1:] != own[:-1]))
        live = best[number] != NONE
        hit = np.flatnonzero(live & (rank == best[number]))
        hit = hit[np.append(True, number[hit][1:] != number[hit][:-1])] if len(hit) else hit  # leftmost
        done.append(symbols[~live])
        keep = live.copy()
        keep[hit + 1] = False
        symbols = symbols[keep]
    starts = np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, n))


def encode_segments(text: np.ndarray, lengths: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of segments, and where each segment's begin (and the end).

    `text`: the code points of all segments, spaces as U+2581; `lengths`: how many each has.
    """
    first = np.append(0, np.cumsum(lengths))
    # one sign that no piece has stands behind every segment
    wide = np.zeros(len(text) + len(lengths), np.int32)
    inside = np.ones(len(wide), bool)
    inside[first[1:] + np.arange(len(lengths))] = False
    wide[inside] = text
    table = edges(wide, p)
    starts, sizes = merged(first, table, p)
    row = table[starts + np.searchsorted(first, starts, "right") - 1, sizes]
    code = text[starts]
    ids = np.where(row >= 0, p.ids[row], np.where(code < 128, p.byte_ids[code & 127], -1))
    longer = np.flatnonzero(ids < 0)
    raw = [list(chr(c).encode()) for c in code[longer].tolist()]
    count = np.ones(len(starts), np.int64)
    count[longer] = [len(x) for x in raw]
    out = np.repeat(ids, count).astype(np.int32)
    begin = np.append(0, np.cumsum(count))
    for i, x in zip(longer, raw):
        out[begin[i] : begin[i + 1]] = p.byte_ids[x]
    return out, begin[np.searchsorted(starts, first)]


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[start:start + size], one behind the other, written step by step."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, pool.dtype)
    a = low = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, low + STEP, "right")))
        high = int(ends[b - 1])
        out[low:high] = pool[start[a] : start[a] + size[a]] if b == a + 1 else pool[B.ranges(start[a:b], size[a:b])]
        a, low = b, high
    return out


class Encoder:
    """The ids of the segments a task has met."""

    def __init__(self, p: Pieces):
        self.p = p
        self._clear()

    def _clear(self) -> None:
        self.known, self.ids, self.size, self.first = B.Numbered(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, columns: list[pa.Array]) -> list[pa.ListArray]:
        """Ids of each text of each column; the distinct new segments of all columns share their suffix arrays."""
        if len(self.known) > REMEMBERED:
            self._clear()
        met = []
        for column in columns:
            cut = B.Segments(column)
            key, one, which = cut.distinct()
            number, _ = self.known.numbers(key, cut.bytes_of(one))
            met.append((number.astype(np.int32)[which], cut.first))
        self._learn()
        out = []
        for number, first in met:
            each = self.size[number]
            taken = _gather(self.ids, self.first[number], each)
            ends = np.append(0, np.cumsum(each))[first]
            out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(taken)))
        return out

    def _learn(self) -> None:
        new = self.known.entries[len(self.size) :]
        ends = np.cumsum([len(x) for x in new]) if new else np.zeros(0, np.int64)
        low, parts, sizes = 0, [self.ids], [self.size]
        while low < len(new):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
            own = [x.decode() for x in new[low:high]]
            text = np.frombuffer("".join(own).encode("utf-32-le"), np.int32).copy()
            text[text == 32] = SPACE
            ids, begin = encode_segments(text, np.array([len(x) for x in own]), self.p)
            parts.append(ids)
            sizes.append(np.diff(begin))
            low = high
        self.ids, self.size = np.concatenate(parts), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size


def parts_of(text: str, most: int) -> list[str]:
    """A long text as parts of about `most` bytes, each but the first without the space it began with.

    The library puts a space before a text, so the ids of the parts, one behind the other, are the text's.
    """
    raw, cuts, at = text.encode(), [], most
    while at < len(raw) - 1:
        at = raw.find(b" ", at)
        if at < 0 or at >= len(raw) - 1:
            break
        if raw[at - 1] != 32:
            cuts.append(at)
            at += most
        else:
            at += 1
    return [raw[a:b].decode() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(raw)])]


def _in_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
    """The texts with long ones cut, and how many parts each has; nothing where none is long."""
    sizes = np.diff(C.text_bytes(column)[1])
    if not len(sizes) or sizes.max() <= CHUNK:
        return column, None
    parts = [parts_of((t or "").replace(chr(SPACE), " "), CHUNK) if n > CHUNK else [t] for t, n in zip(column.to_pylist(), sizes.tolist())]
    return pa.array([x for p in parts for x in p], pa.large_string()), np.array([len(p) for p in parts])


def encode_windows(column: pa.Array, encoder: Encoder):
    """(start, stop, ids) of runs of rows: about CHUNK bytes in a run, or one long text; WINDOW bytes share a search."""
    window, held = [], 0
    for a, b in C.chunks(column, CHUNK):
        column_, n = _in_parts(column.slice(a, b - a))
        pieces = [column_] if n is None else [column_.slice(i, 1) for i in range(len(column_))]
        window.append((a, b, n, len(pieces), pieces))
        held += int(C.text_bytes(column_)[1][-1])
        if held >= WINDOW:
            yield from _encode_window(window, encoder)
            window, held = [], 0
    yield from _encode_window(window, encoder)


def _encode_window(window: list, encoder: Encoder):
    lists = iter(encoder.encode([x for w in window for x in w[4]]))
    for a, b, n, count, _ in window:
        mine = pa.concat_arrays([next(lists) for _ in range(count)])
        if n is not None:
            offsets = mine.offsets.to_numpy()[np.append(0, np.cumsum(n))]
            mine = pa.ListArray.from_arrays(pa.array(offsets), mine.values)
        yield a, b, mine


def encode_texts(column: pa.Array, p: Pieces, encoder: Encoder | None = None) -> pa.ListArray:
    """Ids of each text of a column."""
    parts = [ids for _, _, ids in encode_windows(column, encoder or Encoder(p))]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decode_bytes(ids: pa.ListArray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of lists of ids, and the offsets of the rows; ids outside the model give nothing."""
    flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    flat = np.where((flat >= 0) & (flat < len(p.raw)), flat, len(p.raw))
    size = p.raw_size[flat]
    n = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))]
    raw = _gather(p.raw_bytes, p.raw_start[flat], size)
    # the one space before each text goes
    has = np.flatnonzero(np.diff(ends) > 0)
    lead = ends[:-1][has]
    lead, has = lead[raw[lead] == 32], has[raw[lead] == 32]
    keep = np.ones(len(raw), bool)
    keep[lead] = False
    gone = np.zeros(len(n), np.int64)
    gone[has] = 1
    return raw[keep], ends - np.append(0, np.cumsum(gone))


def decode_ids(ids: pa.ListArray, p: Pieces) -> list[str]:
    """Texts of lists of ids; bytes that are no UTF-8 give the sign U+FFFD."""
    raw, ends = decode_bytes(ids, p)
    whole = raw.tobytes()
    return [whole[a:b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def round_trips(ids: pa.ListArray, text: pa.Array, p: Pieces) -> np.ndarray:
    """Whether the bytes of each text come back; null is the empty text."""
    raw, ends = decode_bytes(ids, p)
    wanted, offsets = C.text_bytes(text)
    same = np.diff(ends) == np.diff(offsets)
    if np.array_equal(ends, offsets) and np.array_equal(raw, wanted):
        return same
    return np.array([s and np.array_equal(raw[a:b], wanted[c:d]) for s, a, b, c, d in zip(same, ends, ends[1:], offsets, offsets[1:])], bool)


def encoded(docs: DataFrame, carry: list[str], pieces: Pieces, check: bool = True) -> DataFrame:
    """`carry` of `docs`, `ids`, `n_pieces` and, with `check`, `round_trip`: whether decoding gives the text again."""
    others = [c for c in carry if c not in ("ids", "n_pieces", "round_trip")]
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    fields = [docs.schema[c] for c in others] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())]
    fields += [T.StructField("round_trip", T.BooleanType())] if check else []

    def run(batches):
        p = shared.value
        encoder = Encoder(p)
        for batch in batches:
            for a, b, ids in encode_windows(batch.column(0), encoder):
                text = batch.column(0).slice(a, b - a)
                columns = [batch.column(i + 1).slice(a, b - a) for i in range(len(others))] + [ids, ids.value_lengths().cast(pa.int64())]
                if check:
                    columns.append(pa.array(round_trips(ids, text, p)))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col("text").cast("string").alias("__text"), *others).mapInArrow(run, T.StructType(fields))


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for batch in batches:
            text = pa.array(decode_ids(batch.column(1), shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())])
    )
