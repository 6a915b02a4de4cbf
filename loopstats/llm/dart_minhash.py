"""MinHash near-duplicates by thrown darts (DartMinHash).

A text is a weighted set: its runs of five words (case and punctuation aside), each weighing as often as it occurs.
The region of an element is its weight times the rank axis; hashing throws darts into the plane, one per unit of area
on average, at places that depend on the element alone. A text sees the darts that fall into its regions up to a rank
where about k ln k + 2k have been thrown; each dart belongs to one of k coordinates, and the earliest dart of a
coordinate is its value. If a coordinate got none, the rank is doubled. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity; `bands` groups of `rows` coordinates are joined, and what meets is
checked exactly.

Defined cases: a text without words is compared as one element, its whole bytes; null and empty texts are alike
nothing and form classes of their own. A text of fewer than five words is one run. Rows that repeat an id come back as
one; their texts, if they differ, are of one class, and each of them finds its near copies. Rows without an id take part
and come back each, with the least id of their class, or null if no member has one. Ties in the choice of a
representative go by id and hash of the text. An empty table gives no row. Other columns do not matter. A very long text
is a chunk of its own: memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

SIZE, BANDS, ROWS, SIMILARITY = 5, 20, 6, 0.8
#: Ends of the rank cells below 1; above, a cell is one rank wide.
EDGES = np.array([0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0])
SALT = 1 << 9
#: Elements times cells that are worked on at once; bytes of text in a chunk.
GROUP, CHUNK = 1 << 14, 1 << 23


def _poisson_steps(width: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a cell of this area."""
    p, total, out = np.exp(-width), 0.0, []
    for i in range(1, 30):
        total += p
        out.append(total)
        p *= width / i
    return np.array(out)


STEPS = {w: _poisson_steps(w) for w in {*np.diff(EDGES), 1.0}}


def elements(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, hash) of the runs of words; a text that has bytes but no word is one element."""
    words = C.Words(raw, offsets, C.ALNUM, lower=True)
    values, rows = C.shingles(words, size)
    bare = np.flatnonzero((words.n == 0) & (np.diff(offsets) > 0))
    if len(bare):
        whole = C.Words(raw, offsets, np.ones(256, bool))
        values, rows = np.append(values, whole.hash[whole.first[bare]]), np.append(rows, bare)
    order = np.lexsort((values, rows))
    return rows[order], values[order]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sketch(rows: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """k dart values for each of n texts; rows without elements get zeros. `rows`, `values`: sorted, repeats kept."""
    start = np.ones(len(rows), bool)
    start[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
    layer = (np.arange(len(rows)) - first).astype(np.uint64)  # the second occurrence is a region of its own
    unit = C.mix(values + layer * C.PLACES[40])
    weight = np.bincount(rows, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    best = np.full(n * k, np.inf)
    dart = np.zeros(n * k, np.uint64)
    live, first_round = np.arange(len(rows)), True
    while len(live):
        # by reach, the elements that have a cell's rank within theirs are one run; those of a later round begin
        # where the round before it ended, at half their reach
        live = live[np.argsort(reach[rows[live]], kind="stable")]
        far = reach[rows[live]]
        cell = 0
        while True:
            lo = EDGES[cell] if cell < 5 else float(cell - 4)
            if lo >= far[-1]:
                break
            begin = int(np.searchsorted(far, lo, "right"))
            # where few elements are left, many cells of width 1 are taken at once
            many = max(1, GROUP // (len(far) - begin)) if cell >= 5 else 1
            hi = EDGES[cell + 1] if cell < 5 else lo + many
            stop = len(far) if first_round else int(np.searchsorted(far, 2 * hi, "left"))
            mine, cells = live[begin:stop], cell + np.arange(many)
            width, cell = (hi - lo) / many, cell + many
            if many > 1:
                mine, cells = np.repeat(mine, many), np.tile(cells, stop - begin)
            h = C.mix(unit[mine] ^ ((cells + 1).astype(np.uint64) * C.PLACES[41]))
            count = np.searchsorted(STEPS[width], _unit(h), "right")
            hit = np.flatnonzero(count)
            hit = np.repeat(hit, count[hit])
            if len(hit):
                low = lo if many == 1 else (cells[hit] - 4).astype(np.float64)
                turn = np.arange(len(hit)) - np.searchsorted(hit, hit)
                d = C.mix(h[hit] + (turn.astype(np.uint64) + np.uint64(1)) * C.PLACES[42])
                row = rows[mine[hit]]
                rank = low + width * _unit(d)
                coordinate = (C.mix(d ^ C.PLACES[43]) >> np.uint64(33)).astype(np.int64) % k
                slot = row * k + coordinate
                keep = (rank <= reach[row]) & (rank < best[slot])
                slot, rank, d = slot[keep], rank[keep], d[keep]
                order = np.lexsort((rank, slot))
                slot, rank, d = slot[order], rank[order], d[order]
                one = np.ones(len(slot), bool)
                one[1:] = slot[1:] != slot[:-1]
                best[slot[one]], dart[slot[one]] = rank[one], d[one]
        gaps = np.isinf(best.reshape(n, k)).any(1) & (weight > 0)
        reach = np.where(gaps, reach * 2, reach)
        live, first_round = live[gaps[rows[live]]], False
    return dart.reshape(n, k)


def band_keys(darts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = darts.reshape(len(darts), bands, rows)
    keys = np.zeros((len(darts), bands), np.uint64)
    for i in range(rows):
        keys = C.mix(keys * C.PLACES[1] + parts[:, :, i])
    return C.mix(keys + np.arange(bands, dtype=np.uint64) * C.PLACES[2])


def signatures(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, k1, k2, bands): a hash of the text, a digest of its words in order, and its band keys; rows without
    element have nulls in the last three."""

    def run(batches):
        for batch in batches:
            ids, text, h = batch.columns
            for a, b in C.chunks(text, CHUNK):
                raw, offsets = C.text_bytes(text.slice(a, b - a))
                row, value = elements(raw, offsets, size)
                n = b - a
                has = np.bincount(row, minlength=n) > 0
                keys = band_keys(sketch(row, value, n, bands * rows), bands, rows).view(np.int64)
                words = C.Words(raw, offsets, C.ALNUM, lower=True)
                bare = has & (words.n == 0)
                digest = _digest(words.hash, words.first)
                if bare.any():
                    whole = C.Words(raw, offsets, np.ones(256, bool))
                    digest[bare] = C.mix(whole.hash[whole.first[:-1][bare]] ^ C.PLACES[50])[:, None]
                out_bands = pa.array([list(x) if ok else None for x, ok in zip(keys.tolist(), has)], pa.list_(pa.int64()))
                pair = [pa.array(np.ascontiguousarray(digest[:, i]).view(np.int64), mask=~has) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), h.slice(a, b - a), *pair, out_bands], ["doc_id", "h", "k1", "k2", "bands"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(
        run, "doc_id long, h long, k1 long, k2 long, bands array<long>"
    )


def _digest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each text's sequence of words."""
    place = np.arange(len(values)) - np.repeat(first[:-1], np.diff(first))
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for i in (0, 1):
        terms = C.mix(values + place.astype(np.uint64) * C.PLACES[44 + i])
        total = np.add.reduceat(np.append(terms, np.uint64(0)), first[:-1])
        out[:, i] = np.where(np.diff(first) > 0, C.mix(total + np.diff(first).astype(np.uint64)), np.uint64(0))
    return out


def compared(pairs: DataFrame, texts: DataFrame, size: int = SIZE) -> DataFrame:
    """The pairs (a, b) with the weights of both texts, the weight they share, and the elements that b has beyond a's.

    A text moves once for each of its pairs; that of `a`, which may be in very many, once for some hundred of them:
    the pairs of `a` are dealt into salted groups, sorted so that its text comes first, and read as a stream.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")
    share = (F.count(F.lit(1)) / 128).cast("int")  # one salt for few partners, up to all of them for many
    many = pairs.groupBy("a").agg(F.least(F.lit(SALT), F.greatest(F.lit(1), share)).alias("salts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(salt, "salts").cast("int").alias("salt"), "b")
    members = dealt.select("a", "salt", F.col("b").alias("doc_id")).join(texts, "doc_id").select(
        "a", "salt", F.col("doc_id").alias("b"), "text"
    )
    heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "text"
    )

    def run(batches):
        head, center = None, None
        for batch in batches:
            a, b, text = batch.column(0), batch.column(2), batch.column(3)
            for x, y in C.chunks(text):
                rows, values = elements(*C.text_bytes(text.slice(x, y - x)), size)
                at = np.searchsorted(rows, np.arange(y - x + 1))
                found = []
                for i, (u, v) in enumerate(zip(a.slice(x, y - x).to_pylist(), b.slice(x, y - x).to_pylist())):
                    mine, times = np.unique(values[at[i] : at[i + 1]], return_counts=True)
                    if v is None:
                        head, center = u, (mine, times)
                    elif head == u:
                        _, p, q = np.intersect1d(center[0], mine, assume_unique=True, return_indices=True)
                        both = int(np.minimum(center[1][p], times[q]).sum())
                        more = times.copy()
                        more[q] -= np.minimum(center[1][p], times[q])
                        found.append((u, v, int(center[1].sum()), int(times.sum()), both, np.repeat(mine, more).view(np.int64)))
                if found:
                    *plain, added = zip(*found)
                    columns = [pa.array(c, pa.int64()) for c in plain] + [pa.array(added, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n_a", "n_b", "both", "added"])

    return (
        members.union(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(run, "a long, b long, n_a long, n_b long, both long, added array<long>")
    )


def alike(similarity: float, both, n_a, n_b):
    return 1000 * both >= round(1000 * similarity) * (n_a + n_b - both)


def left_over(met: DataFrame, label: DataFrame, stars: DataFrame, centers: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that can be alike at all.

    Every member was compared with its bucket's center. What it has beyond the center and no other partner of that
    center has (`own`) it shares with nobody in the bucket, so a partner must be of at most (n - own) / s - own
    elements; and two members share at most the center's elements that neither of them lacks, and what each has
    beyond it that others have too. In a family of copies edited apart, these bounds leave next to nothing.
    """
    own = (
        stars.select("a", "b", F.explode("added").alias("e")).groupBy("a", "e").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
        .where("n = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("own"))
    )
    facts = stars.join(own, ["a", "b"], "left").select(
        F.col("a").alias("center"), F.col("b").alias("rep"), F.col("n_b").alias("n"), F.coalesce("own", F.lit(0)).alias("own"),
        (F.col("n_a") - F.col("both")).alias("lacks"), "n_a",
    )
    heads = facts.groupBy("center").agg(F.max("n_a").alias("n_a")).select(
        "center", F.col("center").alias("rep"), F.col("n_a").alias("n"), F.lit(0).alias("own"), F.lit(0).alias("lacks"), "n_a"
    )
    labelled = met.join(label, met.rep == label.node, "left").select("band", "rep", F.coalesce("class_id", "rep").alias("c"))
    mixed = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    rest = labelled.join(mixed, "band").join(centers.withColumnRenamed("a", "center"), "band").join(
        facts.union(heads), ["center", "rep"]
    )
    rest = rest.withColumn("most", (F.col("n") - F.col("own")) / similarity - F.col("own"))
    least = rest.groupBy("band").agg(F.min("n").alias("least"))
    rest = rest.join(least, "band").where("most >= least")
    side = lambda x: rest.select("band", *(F.col(c).alias(c + x) for c in ("rep", "c", "n", "own", "lacks", "n_a", "most")))
    left, right = side("1").withColumnRenamed("band", "band1"), side("2")
    beyond = lambda x: F.col("n" + x) - F.col("n_a" + x) + F.col("lacks" + x) - F.col("own" + x)
    shared = F.least(
        F.col("n_a1") - F.greatest("lacks1", "lacks2") + F.least(beyond("1"), beyond("2")), F.col("n1") - F.col("own1"), F.col("n2") - F.col("own2")
    )
    return left.join(
        right,
        (F.col("band1") == F.col("band")) & (F.col("c1") < F.col("c2")) & (F.col("n1") <= F.col("most2"))
        & (F.col("n2") <= F.col("most1")) & alike(similarity, shared, F.col("n1"), F.col("n2")),
    ).select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()


#: The key of a row: its id (0 for none), whether it has none, the hash of its text.
ROW = ("__id", "__bare", "__h")


def _row_key(df: DataFrame, h) -> DataFrame:
    return df.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__bare": F.col("doc_id").isNull(), "__h": h})


def classes(
    docs: DataFrame, folder: str, similarity: float = SIMILARITY, size: int = SIZE, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """(signed, named): the digest (k1, k2) of each row, and of each digest its class `c` and the class's least id.

    Texts of one digest are one before the search, known by a number of their own and not by an id, as an id may have
    several texts or be missing. Of each bucket the member that meets most others is compared with all the rest, which
    is linear in the bucket and joins nearly everything; then only those pairs of one bucket are compared that lie in
    different components and can be alike (`left_over`). No link that a bucket holds is lost and no class is expanded
    to pairs.
    """
    signed = C.cut(signatures(docs, size, bands, rows), folder, "signatures")
    full = signed.where("k1 is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("r")
    reps = full.groupBy("k1", "k2").agg(first, F.any_value("bands").alias("bands"))
    # numbers that are written, so that they stay
    reps = C.cut(reps.select("k1", "k2", "r.doc_id", "r.h", "bands", F.monotonically_increasing_id().alias("rep")), folder, "texts")
    keyed = reps.select(F.explode("bands").alias("band"), "rep")
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = C.cut(keyed.join(shared, "band"), folder, "buckets")
    wanted = _row_key(reps.join(met.select("rep").distinct(), "rep"), F.col("h")).select(*ROW, "rep")
    # a merge join at every size: the rows grow with the table, and a plan that is tried small is the one that runs large
    text = F.col("text").cast("string")
    texts = _row_key(docs.select("doc_id", text.alias("text")), F.xxhash64("text")).drop("doc_id").join(wanted.hint("merge"), list(ROW))
    texts = C.cut(texts.groupBy(*ROW).agg(F.min("rep").alias("doc_id"), F.min("text").alias("text")).select("doc_id", "text"), folder, "candidates")

    score = met.groupBy("rep").agg(F.sum("n").alias("score"))
    best = F.max_by("rep", F.struct("score", -F.col("rep"))).alias("a")
    centers = C.cut(met.join(score, "rep").groupBy("band").agg(best), folder, "centers")
    pairs = met.join(centers, "band").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    stars = C.cut(compared(pairs, texts, size), folder, "stars")
    links = stars.where(alike(similarity, F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    label = C.components(links, folder, "classes-0")

    pairs = C.cut(left_over(met, label, stars, centers, similarity), folder, "rest")
    more = compared(pairs, texts, size).where(alike(similarity, F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    label = C.components(links.union(more).union(_texts_of_one_id(full, reps)), folder, "classes-1")
    named = reps.select("k1", "k2", "rep", "doc_id").join(label, reps.rep == label.node, "left")
    named = named.select("k1", "k2", F.coalesce("class_id", "rep").alias("c"), "doc_id")
    least = named.groupBy(F.col("c").alias("of")).agg(F.min("doc_id").alias("least"))
    return signed, named.join(least, F.col("c") == F.col("of")).select("k1", "k2", "c", "least")


def _texts_of_one_id(full: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the texts of an id that has several."""
    key = F.struct("k1", "k2")
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi")
    of_id = full.join(several.select("doc_id"), "doc_id").select("doc_id", "k1", "k2").distinct().join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    least = of_id.groupBy(F.col("doc_id").alias("of")).agg(F.min("rep").alias("a"))
    return of_id.join(least, F.col("doc_id") == F.col("of")).where("a <> rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, folder: str, **search) -> DataFrame:
    """(doc_id, class_id) for every id, and for every row without one: the least id of those it is linked with, over
    chains of near copies. `search`: similarity, size, bands, rows."""
    signed, named = classes(docs, folder, **search)
    found = signed.where("k1 is not null").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", F.col("least").alias("class_id"))
    every = found.union(signed.where("k1 is null").select("doc_id", "doc_id"))
    by_id = every.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return by_id.union(every.where("doc_id is null"))


def one_of_each(docs: DataFrame, folder: str, **search) -> DataFrame:
    """One row of each class, all columns: that of the least id (rows without one come last), then the least hash of the
    text. Null and empty texts are one class here. Of equal rows one stays."""
    signed, named = classes(docs, folder, **search)
    rows = signed.where("k1 is not null").join(named, ["k1", "k2"]).select("c", "doc_id", "h")
    rows = rows.union(signed.where("k1 is null").select(F.lit(-1).cast("long"), "doc_id", "h"))
    keep = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("r")).select("r.doc_id", "r.h")
    keep = C.cut(_row_key(keep, F.col("h")).select(*ROW), folder, "kept")
    kept = _row_key(docs, F.xxhash64(F.col("text").cast("string"))).join(keep.hint("merge"), list(ROW))
    one = F.min(F.struct(*docs.columns)).alias("r")  # rows of equal id and text meet here, without another exchange
    return kept.groupBy(*ROW).agg(one).select("r.*")
