"""Exact nearest neighbours by cosine, pruned: the angle between vectors obeys the triangle inequality.

A bounded number of chunks serve as centres. Every chunk belongs to the cell of its nearest centre, and cells are cut into
blocks by the angle to the centre, so a block knows between which two angles its chunks lie; a run of equal angles that is
too long is dealt over several blocks. A query compares itself with the centres. That gives a first k-th best similarity,
as centres are chunks and blocks know how many chunks they hold how near at least, and for each block the best similarity
that any chunk in it can have; only blocks that can still hold one of the k nearest are visited. Blocks stand on shelves, a
query moves once for each shelf that it visits, and queries and shelves meet in groups of bounded size, which multiply the
vectors of a query and of the blocks it visits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Queries and chunks of one product.
QUERIES_PER_STEP, CHUNKS_PER_STEP = 512, 2048
#: Centres; steps of the angle; chunks or queries in a group; blocks at most, about (beyond, blocks grow instead).
CENTRES, BINS, ROWS_PER_CELL, MOST_BLOCKS = 256, 256, 50_000, 1 << 16
#: Shelves of chunks, and groups of queries for each, that a table of some size is dealt into; rows of one at least.
SHELVES, ROWS_AT_LEAST = 16, 512
#: Chunks for each centre at least, as every visit of a block sends the query there.
CELL = 512
#: Similarities are compared after rounding to six digits, and a batch's products may differ in the last bits.
SLACK = 2e-6


def _lengths(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Length of each vector; 0 for null."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).copy()


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Unit vectors of `width` numbers, one per row; a zero, missing or differently long vector, or one with a null
    in it, is NaN and never matches."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = _lengths(array) == width
    matrix = np.full((len(array), width), np.nan)
    if width and fits.any():
        flat = array.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        matrix[fits] = flat.astype(np.float64).reshape(-1, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _codes(queries: pa.Table, chunks: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A filter's values as numbers: -1 for a query without one, -2 for a chunk without one."""
    known: dict = {}
    number = lambda v, none: none if v is None else known.setdefault(v, len(known))
    return (
        np.array([number(v, -1) for v in queries[name].to_pylist()], np.int64),
        np.array([number(v, -2) for v in chunks[name].to_pylist()], np.int64),
    )


def _first(row: np.ndarray, similarity: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k first of each row by similarity, then place; by row."""
    order = np.lexsort((place, -similarity, row))
    row = row[order]
    index = np.arange(len(row))
    start = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], index, 0)) if len(row) else index
    return order[index - start < k]


class _Best:
    """The k nearest of some queries so far: similarity and place of the chunk, nearest first."""

    def __init__(self, n: int, k: int):
        self.k, self.similarity, self.place = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, sims: np.ndarray, places: np.ndarray) -> None:
        """`sims` of the queries `rows` to the chunks `places`."""
        last, at = self.similarity[rows, -1], self.place[rows, -1]
        least = last - SLACK
        hit = sims >= least[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.k)
        if len(many) and sims.shape[1] > self.k:
            own = sims[many]
            least[many] = np.maximum(least[many], np.partition(own, -self.k, axis=1)[:, -self.k] - SLACK)
            hit[many] = own >= least[many, None]
        q, c = np.nonzero(hit)
        found, place = np.round(sims[q, c], 6), places[c]
        keep = np.isfinite(found) & ((found > last[q]) | ((found == last[q]) & (place < at[q])))
        q, found, place = q[keep], found[keep], place[keep]
        if not len(q):
            return
        cut = _first(q, found, place, self.k)
        q, found, place = q[cut], found[cut], place[cut]
        changed = np.unique(q)
        old = rows[changed]
        q = np.concatenate([np.repeat(changed, self.k), q])
        found = np.concatenate([self.similarity[old].ravel(), found])
        place = np.concatenate([self.place[old].ravel(), place])
        cut = _first(q, found, place, self.k)  # k of each, as there were k before
        self.similarity[old], self.place[old] = found[cut].reshape(-1, self.k), place[cut].reshape(-1, self.k)


def _search(queries: pa.Table, chunks: pa.Table, k: int, filters: Sequence[str]) -> tuple[pa.Table, int]:
    """The k nearest of each query among the chunks of the blocks it visits; products made.

    Vectors are compared with those of their own length, block by block in tiles of bounded size; equal similarities go
    by chunk id. What is no better than a query's k-th so far is dropped at once.
    """
    by_id = np.empty(len(chunks), np.int64)  # row of each place in the order of ids
    by_id[:] = pc.sort_indices(chunks["id"]).to_numpy()
    place = np.empty(len(chunks), np.int64)
    place[by_id] = np.arange(len(chunks))
    best, products = _Best(len(queries), k), 0
    visits = queries["blocks"].combine_chunks()
    visitor = np.repeat(np.arange(len(queries)), _lengths(visits))
    visited = visits.flatten().to_numpy()
    order = np.argsort(visited, kind="stable")
    visitor, visited = visitor[order], visited[order]
    block = chunks["block"].to_numpy()
    held = np.lexsort((place, block))
    codes = [_codes(queries, chunks, f) for f in filters]
    q_lengths, c_lengths = _lengths(queries["embedding"]), _lengths(chunks["embedding"])
    for w in sorted(set(q_lengths.tolist()) & set(c_lengths.tolist()) - {0}):
        q_unit, c_unit = _matrix(queries["embedding"], w), _matrix(chunks["embedding"], w)
        for b in np.unique(block):
            rows = visitor[np.searchsorted(visited, b) : np.searchsorted(visited, b, "right")]
            rows = rows[q_lengths[rows] == w]
            here = held[np.searchsorted(block, b, sorter=held) : np.searchsorted(block, b, "right", sorter=held)]
            here = here[c_lengths[here] == w]
            products += len(rows) * len(here)
            for i in range(0, len(rows), QUERIES_PER_STEP):
                own = rows[i : i + QUERIES_PER_STEP]
                for j in range(0, len(here), CHUNKS_PER_STEP):
                    part = here[j : j + CHUNKS_PER_STEP]
                    sims = q_unit[own] @ c_unit[part].T
                    sims[np.isnan(sims)] = -np.inf
                    for wanted, have in codes:
                        sims[(wanted[own, None] != have[None, part]) & (wanted[own, None] != -1)] = -np.inf
                    best.add(own, sims, place[part])
    q, n = np.nonzero(np.isfinite(best.similarity))
    found = {
        "query_id": queries["id"].take(pa.array(q)),
        "chunk_id": chunks["id"].take(pa.array(by_id[best.place[q, n]])),
        "similarity": pa.array(best.similarity[q, n]),
    }
    return pa.table(found), products


class Cells:
    """Centres with their filter values, and the blocks that their cells are cut into.

    Cell w * CENTRES + i is that of centre i of the vectors of length w. Vectors of a length without a centre form cell
    w * CENTRES, and any query of that length visits it.
    """

    def __init__(self, centres: pa.Table):
        lengths = _lengths(centres["embedding"])
        for w in set(lengths.tolist()) - {0}:  # a vector that matches nothing is no centre
            lengths[np.isnan(_matrix(centres["embedding"], w)).any(axis=1) & (lengths == w)] = 0
        self.tables = {int(w): centres.filter(pa.array(lengths == w)) for w in sorted(set(lengths.tolist()) - {0})}
        self.units = {w: _matrix(t["embedding"], w) for w, t in self.tables.items()}
        self.blocks: dict[int, list[tuple[int, int, int, int, int]]] = {}  # cell: (first bin, past bin, block, parts, chunks)
        self.loose: dict[int, int] = {}  # length: the block of what no counted bin holds
        self.n_blocks = 0
        self.shelf = np.zeros(0, np.int64)  # of each block

    def place(self, embeddings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell (-1: the vector matches nothing), step of the angle to the centre, and products made, by row."""
        lengths = _lengths(embeddings)
        cell, step, products = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64), 0
        for w in sorted(set(lengths.tolist()) - {0}):
            rows = np.flatnonzero(lengths == w)
            unit = _matrix(embeddings.take(pa.array(rows)), w)
            good = ~np.isnan(unit).any(axis=1)
            rows, unit = rows[good], unit[good]
            cell[rows] = w * CENTRES
            if w in self.units:
                sims = unit @ self.units[w].T
                products += sims.size
                best = sims.argmax(axis=1)
                cell[rows] += best
                step[rows] = np.minimum(np.arccos(np.clip(sims[np.arange(len(rows)), best], -1, 1)) * BINS / math.pi, BINS - 1)
        return cell, step, products

    def lay_out(self, counts: list[tuple[int, int, int]], rows: int) -> None:
        """Cuts cells into blocks of `rows` chunks at most, and lays these on shelves of about `rows`; `counts`: (cell, step, chunks)."""
        rows = max(rows, sum(n for _, _, n in counts) // MOST_BLOCKS)
        for cell, step, n in sorted(counts):
            mine = self.blocks.setdefault(cell, [])
            if mine and mine[-1][4] + n <= rows:
                low, _, block, parts, held = mine[-1]
                mine[-1] = (low, step + 1, block, parts, held + n)
                continue
            parts = max(1, -(-n // rows))
            mine.append((step, step + 1, self.n_blocks, parts, n))
            self.n_blocks += parts
        shelf, filled, shelves = 0, 0, []
        for *_, parts, n in (x for own in self.blocks.values() for x in own):
            for _ in range(parts):
                if filled and filled + n / parts > rows:
                    shelf, filled = shelf + 1, 0
                shelves.append(shelf)
                filled += n / parts
        for w in sorted({cell // CENTRES for cell in self.blocks}):
            self.loose[w] = self.n_blocks
            self.n_blocks += 1
            shelves.append(shelf)
        self.shelf = np.array(shelves, np.int64)

    def block_of(self, cell: np.ndarray, step: np.ndarray, dealt: np.ndarray) -> np.ndarray:
        """Block of each chunk. A step that no count has, as products may differ in the last bits, is a loose one."""
        out = np.full(len(cell), -1)
        for c in set(cell[cell >= 0].tolist()):
            rows = np.flatnonzero(cell == c)
            out[rows] = self.loose.get(c // CENTRES, -1)
            for low, high, block, parts, _ in self.blocks.get(c, ()):
                here = rows[(step[rows] >= low) & (step[rows] < high)]
                out[here] = block + dealt[here] % parts
        return out

    def visits(self, queries: pa.Table, k: int, filters: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of queries and the blocks that may hold one of their k nearest, by row and block; products made."""
        lengths, products = _lengths(queries["embedding"]), 0
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, loose in self.loose.items():
            rows = np.flatnonzero(lengths == w)
            own = queries.take(pa.array(rows))
            unit = _matrix(own["embedding"], w)
            good = np.flatnonzero(~np.isnan(unit).any(axis=1))
            rows, unit, own = rows[good], unit[good], own.take(pa.array(good))
            at.append(rows)
            to.append(np.full(len(rows), loose))
            spans = [
                (c - w * CENTRES, low, high, b + j, 0 if j else n)  # the parts of a block share its bounds; its chunks count once
                for c, x in self.blocks.items() if c // CENTRES == w for low, high, b, parts, n in x for j in range(parts)
            ]
            centre, low, high, block, held = (np.array(x) for x in zip(*spans))
            if w not in self.units:
                at.append(np.repeat(rows, len(block)))
                to.append(np.tile(block, len(rows)))
                continue
            free = np.array([all(own[f][i].as_py() is None for f in filters) for i in range(len(own))], bool)
            low, high = low * math.pi / BINS, high * math.pi / BINS
            for a in range(0, len(rows), 64):
                sims = unit[a : a + 64] @ self.units[w].T
                products += sims.size
                angle = np.arccos(np.clip(sims, -1, 1))[:, centre]
                gap = np.maximum(np.maximum(angle - high, low - angle), 0)
                least = self._kth(sims, own.slice(a, 64), w, k, filters)
                least = np.where(free[a : a + 64], np.maximum(least, _reached(angle + high, held, k)), least)
                q, b = np.nonzero(np.cos(np.minimum(gap, math.pi)) + SLACK >= least[:, None])
                at.append(rows[a + q])
                to.append(block[b])
        row, block = np.concatenate(at), np.concatenate(to)
        order = np.lexsort((block, row))
        return row[order], block[order], products

    def _kth(self, sims: np.ndarray, queries: pa.Table, w: int, k: int, filters: Sequence[str]) -> np.ndarray:
        """The k-th best similarity among the centres that pass the filters; -1 where there are fewer."""
        sims = np.where(np.isnan(sims), -np.inf, np.round(sims, 6))
        for name in filters:
            wanted = np.asarray(queries[name].to_pylist(), object)
            have = np.asarray(self.tables[w][name].to_pylist(), object)
            sims = np.where(np.array([x is None for x in wanted])[:, None] | (wanted[:, None] == have[None, :]), sims, -np.inf)
        if sims.shape[1] < k:
            return np.full(len(sims), -1.0)
        return np.maximum(np.partition(sims, -k, axis=1)[:, -k], -1.0)


def _reached(farthest: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """The similarity that k chunks have at least, from the farthest angle of each block's chunks; -1 for fewer chunks."""
    order = np.argsort(farthest, axis=1)
    enough = np.cumsum(held[order], axis=1) >= k
    at = enough.argmax(axis=1)
    rows = np.arange(len(farthest))
    angle = np.minimum(farthest[rows, order[rows, at]], math.pi)
    return np.where(enough[rows, at], np.cos(angle) - SLACK, -1.0)


_DEALT = "_dealt"


def _map(df: DataFrame, schema, run) -> DataFrame:
    """`run` over the table of each batch, with a hash of the id as a last column."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in run(pa.Table.from_batches([batch])):
                yield from made.combine_chunks().to_batches()

    return df.withColumn(_DEALT, F.xxhash64("id")).mapInArrow(over, schema)


def _hashes(table: pa.Table) -> np.ndarray:
    return table[_DEALT].to_numpy().view(np.uint64)


def _steps(c: DataFrame, shared) -> DataFrame:
    """Chunks by cell and step of the angle."""

    def run(table):
        cell, step, _ = shared.value.place(table["embedding"].combine_chunks())
        yield pa.table({"cell": pa.array(cell[cell >= 0]), "step": pa.array(step[cell >= 0])})

    return _map(c.select("id", "embedding"), "cell long, step long", run).groupBy("cell", "step").count()


def _in_groups(table: pa.Table, rows: np.ndarray, shelf: np.ndarray, part: np.ndarray, **more: pa.Array) -> pa.Table:
    out = table.drop_columns([_DEALT]).take(pa.array(rows))
    for name, column in {"shelf": pa.array(shelf.astype(np.int32)), "part": pa.array(part.astype(np.int32)), **more}.items():
        out = out.append_column(name, column)
    return out


def _with_groups(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    whole = T.IntegerType()
    return T.StructType([*df.schema.fields, T.StructField("shelf", whole), T.StructField("part", whole), T.StructField(name, kind)])


def _by_shelf(table: pa.Table, layout, k: int, filters: Sequence[str]):
    """Runs of the table, each with the row and shelf of every visit, where its blocks begin, the blocks, and products made."""
    for a in range(0, len(table), QUERIES_PER_STEP):
        own = table.slice(a, QUERIES_PER_STEP)
        row, block, products = layout.value.visits(own, k, filters)
        order = np.lexsort((layout.value.shelf[block], row))
        row, block = row[order], block[order]
        shelf = layout.value.shelf[block]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])]) if len(row) else np.zeros(0, np.int64)
        yield own, row[new], shelf[new], np.append(new, len(row)), block, products


def _visits_by_shelf(q: DataFrame, layout, k: int, filters: Sequence[str]) -> DataFrame:
    """How many queries visit each shelf."""

    def run(table):
        for _, _, shelf, *_ in _by_shelf(table, layout, k, filters):
            yield pa.table({"shelf": pa.array(shelf)})

    return _map(q, "shelf long", run).groupBy("shelf").count()


def _queries_by_group(q: DataFrame, layout, groups, k: int, filters: Sequence[str], products: Accumulator | None) -> DataFrame:
    """A query once for each shelf with blocks it visits, in one of the shelf's groups."""

    def run(table):
        for own, row, shelf, starts, block, n in _by_shelf(table, layout, k, filters):
            if products is not None:
                products.add(n)
            parts = np.array([groups.value[x] for x in shelf.tolist()], np.uint64)
            blocks = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(block.astype(np.int32)))
            yield _in_groups(own, row, shelf, _hashes(own)[row] % parts, blocks=blocks)

    return _map(q, _with_groups(q, "blocks", T.ArrayType(T.IntegerType())), run)


def _chunks_by_group(c: DataFrame, layout, groups, products: Accumulator | None) -> DataFrame:
    """A chunk once for each group of its shelf; not at all where no query visits that."""

    def run(table):
        cell, step, n = layout.value.place(table["embedding"].combine_chunks())
        if products is not None:
            products.add(n)
        block = layout.value.block_of(cell, step, _hashes(table) >> np.uint64(1))
        known = np.flatnonzero(block >= 0)
        shelf = layout.value.shelf[block[known]]
        times = np.array([groups.value.get(x, 0) for x in shelf.tolist()], np.int64)
        at = np.repeat(np.arange(len(known)), times)
        first = np.cumsum(times) - times
        own = pa.array(block[known][at].astype(np.int32))
        yield _in_groups(table, known[at], shelf[at], np.arange(len(at)) - first[at], block=own)

    return _map(c, _with_groups(c, "block", T.IntegerType()), run)


def knn_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 3,
    filter_cols: Sequence[str] = ("knowledge_point", "tenant_id"),
    min_similarity: float | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
    centres: int | None = None,
    products: Accumulator | None = None,
) -> DataFrame:
    """Exact cosine top-k: query_id, chunk_id, similarity, rank.

    One plan at every size. The driver sees the centres (`centres` chunks, by default one in CELL, CENTRES at most), the number of chunks by cell
    and step, and, for more than `rows_per_cell` queries, the number of visits by shelf, all of bounded size. A query goes to one group for each
    shelf that it visits, with the list of blocks to search there, a chunk to each group of its shelf. Up to SHELVES times
    `rows_per_cell` rows there are about SHELVES shelves, and as many groups of each, so that what is shuffled grows with the
    rows; beyond, shelves stay at `rows_per_cell` rows and there are more of them. `products` counts the similarities that
    the search computes, those with centres included.

    A null filter value of a query means no filter. Only vectors of equal length are compared; a null, zero or empty
    vector finds nothing and is not found. Similarities are rounded to six digits and ties go by chunk id, so the result
    does not depend on the partitioning or on the centres.
    """
    spark = chunks.sparkSession
    filters = [c for c in filter_cols if c in queries.columns and c in chunks.columns]
    q, c = (side.select("id", "embedding", *filters) for side in (queries, chunks))
    n_queries, n_chunks = q.count(), c.count()
    most = lambda n: min(rows_per_cell, max(ROWS_AT_LEAST, -(-n // SHELVES)))
    centres = max(1, n_chunks // CELL) if centres is None else centres
    cells = Cells(c.filter(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(min(centres, CENTRES)).toArrow())
    cells.lay_out([tuple(r) for r in _steps(c, spark.sparkContext.broadcast(cells)).collect()], most(n_chunks))
    layout = spark.sparkContext.broadcast(cells)
    if n_queries <= rows_per_cell:  # few groups, also if every shelf has all visits
        visits = dict.fromkeys(cells.shelf.tolist(), n_queries)
    else:
        visits = dict(map(tuple, _visits_by_shelf(q, layout, k, filters).collect()))
    groups = spark.sparkContext.broadcast({shelf: -(-n // most(n_queries)) for shelf, n in visits.items()})
    kinds = {"query_id": q.schema["id"].dataType, "chunk_id": c.schema["id"].dataType, "similarity": T.DoubleType()}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found, n = _search(left, right, k, filters)
        if products is not None:
            products.add(n)
        return found

    left = _queries_by_group(q, layout, groups, k, filters, products).groupBy("shelf", "part")
    right = _chunks_by_group(c, layout, groups, products).groupBy("shelf", "part")
    partial = left.cogroup(right).applyInArrow(search, ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    hits = partial.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    if min_similarity is not None:
        hits = hits.filter(F.col("similarity") >= min_similarity)
    return hits
