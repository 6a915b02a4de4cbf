"""Collocations: phrases of two and three words that stand together more often than their parts would.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and into words at spaces and tabs; everything
is counted for each language apart (null is `und`). Level by level:

1. Words. Blocks of texts send each distinct word once, packed by bucket; a bucket adds up the counts of all blocks, and
   words with `least` occurrences or more get a number. Blocks become runs of these numbers, 0 for a rarer word or a
   border of pieces, and are written.
2. Pairs. A phrase cannot reach `least` unless its parts do (Apriori), so only neighbouring numbers are candidates; those
   whose block counts cannot add up to `least` are left out. Candidates are dealt into shards of bounded size, and each
   shard becomes a double-array trie over the digits of the words' numbers, which is broadcast. A task then advances the
   states of all its text positions at once, digit by digit; positions that leave the trie fall out, the others are
   counted by bincount over the accepting states, and the tasks' counts are added up.
3. Triples likewise; candidates are places where the first pair is accepted, and the second too if it is of this shard.

More shards mean more passes over the numbered blocks, each with one broadcast of the same bound.

A phrase cut after its first k words scores floor(10^6 a^2 / (l r)) in exact decimals; the lowest cut counts, the
first among equals. Pairs inside a triple that is at least half as frequent are dropped.

Defined cases: null and empty texts have no words; repeated rows count each; ids do not matter and may be null; an
empty table gives no row; ties go by count, then by the phrase's UTF-8 bytes; columns beside `text` and `lang` do not
matter. Very long texts: memory follows the longest, at about twenty times its bytes. Words are known by 64-bit hashes
inside a block, whose bytes are compared too (the job fails if they differ), and by their bytes between blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import blocks as B, common as C

#: Bytes of text in a block; the least number of buckets; candidates in a shard, about, and in one part of its counts.
BLOCK, BUCKETS, SHARD, PART = 1 << 23, 64, 1 << 20, 1 << 14
#: Text positions whose states advance together.
TOGETHER = 1 << 18
LEAST, COVER, TOP = 10, 50, 2000
BORDER = b".,;:!?\n\x0b\x0c\r"
_BORDER = np.array([x in BORDER for x in range(256)])
_WORD = ~_BORDER & np.array([x not in b" \t" for x in range(256)])
_LOW = (1 << 32) - 1


# --- numbered texts ---------------------------------------------------------------------------------


class _Block:
    """Texts of one language as runs of word numbers; 0 is a border."""

    def __init__(self):
        self.words, self.runs, self.size, self.n = B.Numbered(), [], 0, 0

    def add(self, column: pa.Array) -> None:
        raw, offsets = C.text_bytes(column)
        raw = C.LOWER[raw]
        words = C.Words(raw, offsets, _WORD)
        self.size += len(raw)
        if not len(words.hash):
            return
        key, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
        whole, start, stop = raw.tobytes(), words.start, words.end
        entries = [whole[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist())]
        _same_bytes(raw, start, stop, one, which)
        number, _ = self.words.numbers(key, entries)
        borders = np.append(0, np.cumsum(_BORDER[raw], dtype=np.int64))
        fresh = np.append(True, (words.row[1:] != words.row[:-1]) | (borders[start[1:]] != borders[stop[:-1]]))
        place = np.arange(len(which)) + np.cumsum(fresh)
        run = np.zeros(len(which) + int(fresh.sum()), np.int64)
        run[place] = number[which] + 1
        self.runs.append(run)
        self.n += len(which)

    def row(self, number: int, lang: str, n_buckets: int, names: list[str]) -> pa.RecordBatch:
        entries = self.words.entries
        bucket = np.empty(len(entries), np.int64)
        bucket[self.words.place] = (self.words.key % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        order = np.array([i for run in np.split(order, cuts) for i in sorted(run.tolist(), key=entries.__getitem__)], np.int64)
        at = np.zeros(len(entries) + 1, np.int64)
        at[order + 1] = np.arange(1, len(entries) + 1)
        run = at[np.concatenate([*self.runs, np.zeros(0, np.int64)])]
        count = np.bincount(run, minlength=len(entries) + 1)[1:]
        first = np.append(0, np.cumsum(np.bincount(bucket, minlength=n_buckets))).tolist()
        used = [b for b in range(n_buckets) if first[b] < first[b + 1]]
        words = [entries[i] for i in order.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([self.n], pa.int64()),
                pa.array([B.pack(run)], pa.binary()), pa.array([used], pa.list_(pa.int32())),
                pa.array([[B.pack_bytes(words[first[b] : first[b + 1]]) for b in used]], pa.list_(pa.binary())),
                pa.array([[B.pack(count[first[b] : first[b + 1]]) for b in used]], pa.list_(pa.binary())),
            ],
            names,
        )


def _same_bytes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, one: np.ndarray, which: np.ndarray, run: int = 1 << 16) -> None:
    """Every word has the bytes of the one that stands for it."""
    size = stop - start
    same = np.array_equal(size, size[one][which])
    for low in range(0, len(which) if same else 0, run):
        mine = slice(low, low + run)
        same = same and np.array_equal(raw[B.ranges(start[mine], size[mine])], raw[B.ranges(start[one][which[mine]], size[mine])])
    if not same:
        raise ValueError("two words share a 64-bit hash")


def word_blocks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """One row for each block: its language, words, run of numbers, and its distinct words and their counts by bucket."""
    schema = "block long, lang string, n long, run binary, buckets array<int>, words array<binary>, counts array<binary>"
    names = [x.split()[0] for x in schema.split(", ")]
    most = BLOCK

    def run(batches):
        number, open_ = B.numbering(), {}
        for batch in batches:
            for part in B.cut_batch(batch):
                langs = part.column(1)
                for lang in sorted(pc.unique(langs).to_pylist()):
                    open_.setdefault(lang, _Block()).add(part.column(0).filter(pc.equal(langs, lang)))
                if sum(x.size for x in open_.values()) >= most:
                    yield from (x.row(next(number), lang, n_buckets, names) for lang, x in open_.items())
                    open_ = {}
        yield from (x.row(next(number), lang, n_buckets, names) for lang, x in open_.items())

    return docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, schema)


def numbered_words(blocks: DataFrame, n_buckets: int, least: int) -> DataFrame:
    """The numbers of each block's words by bucket (block, bucket, numbers), and the words with a number (lang, word, id, f).

    Both kinds stand in one table, the columns of the other kind being null.
    """
    asked = blocks.select("block", "lang", F.explode(F.arrays_zip("buckets", "words", "counts")).alias("t"))
    asked = asked.select("block", "lang", F.col("t.buckets").alias("bucket"), F.col("t.words").alias("words"), F.col("t.counts").alias("counts"))
    schema = "block long, bucket int, numbers binary, lang string, word string, id long, f long"
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("f", pa.int64())])

    def run(key, group):
        total: dict[tuple[str, bytes], int] = {}
        langs = group.column("lang").to_pylist()
        for lang, words, counts in zip(langs, group.column("words"), group.column("counts")):
            for w, n in zip(B.unpack_bytes(words.as_py()), B.unpack(counts.as_py()).tolist()):
                total[lang, w] = total.get((lang, w), 0) + n
        often = sorted(x for x, n in total.items() if n >= least)
        bucket = key[0].as_py()
        number = {x: 1 + i * n_buckets + bucket for i, x in enumerate(often)}
        packed = [B.pack(np.array([number.get((lang, w), 0) for w in B.unpack_bytes(words.as_py())], np.int64)) for lang, words in zip(langs, group.column("words"))]
        m, k = len(packed), len(often)
        null = lambda n, kind: pa.nulls(n, kind)
        back = [group.column("block").combine_chunks(), group.column("bucket").combine_chunks(), pa.array(packed, pa.binary()), *(null(m, f.type) for f in list(kinds)[3:])]
        list_ = [null(k, f.type) for f in list(kinds)[:3]]
        list_ += [pa.array([x for x, _ in often], pa.string()), pa.array([w.decode() for _, w in often], pa.string())]
        list_ += [pa.array([number[x] for x in often], pa.int64()), pa.array([total[x] for x in often], pa.int64())]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=kinds) for x in (back, list_)])

    return asked.groupBy("bucket").applyInArrow(run, schema)


def numbered_runs(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(run): every block with the numbers of its frequent words, 0 for the others and for borders (one for several)."""
    parts = numbers.groupBy(F.col("block").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("bucket", "numbers"))).alias("parts"))
    joined = blocks.select("block", "run").join(parts, F.col("block") == F.col("__of")).select("run", F.col("parts.numbers").alias("parts"))

    def run(batches):
        for batch in batches:
            for raw, parts in zip(batch.column(0), batch.column(1)):
                known = np.concatenate([np.zeros(1, np.int64), *(B.unpack(x) for x in parts.as_py())])
                ids = known[B.unpack(raw.as_py())]
                ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))] if len(ids) else ids
                yield pa.RecordBatch.from_arrays([pa.array([B.pack(ids)], pa.binary())], ["run"])

    return joined.mapInArrow(run, "run binary")


# --- the trie ---------------------------------------------------------------------------------------


class Trie:
    """A double-array trie of number sequences, all of one length, over their digits of base 256.

    From state s digit d leads to t = base[s] + d if check[t] is s. The accepting states' `base` is the sequence's row.
    """

    def __init__(self, rows: np.ndarray, n_digits: int):
        """`rows`: sorted, distinct sequences of numbers below 256 ** n_digits, one a row."""
        n, self.length = rows.shape
        self.n_digits, self.rows = n_digits, rows
        shifts = np.arange(n_digits - 1, -1, -1) * 8
        depth = self.length * n_digits
        digits = ((rows[:, :, None] >> shifts) & 255).reshape(n, depth)
        new = np.ones((n, depth), bool)  # whether a row begins another node at this depth than the row before
        if n > 1:
            new[1:] = np.logical_or.accumulate(digits[1:] != digits[:-1], axis=1)
        heads = [np.flatnonzero(new[:, d]) for d in range(depth)]
        # nodes with children: the root, then those of every depth but the last
        n_inner = 1 + sum(len(h) for h in heads[:-1])
        offset = np.append([0, 1], 1 + np.cumsum([len(h) for h in heads]))
        edge_digit = np.concatenate([digits[h, d] for d, h in enumerate(heads)]) if n else np.zeros(0, np.int64)
        parent = [np.zeros(len(heads[0]), np.int64)] + [offset[d] + np.searchsorted(heads[d - 1], heads[d], "right") - 1 for d in range(1, depth)]
        edge_parent = np.concatenate(parent) if n else np.zeros(0, np.int64)
        base = _placed(edge_parent, edge_digit, n_inner)
        size = int(base.max(initial=0)) + 512
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        slot = np.zeros(n_inner + (len(heads[-1]) if n else 0), np.int64)  # of each node; the root's is 0
        slot[1 : 1 + len(edge_parent)] = base[edge_parent] + edge_digit
        self.base[slot[:n_inner]] = base
        self.check[slot[1 : 1 + len(edge_parent)]] = slot[edge_parent]
        if n:
            self.base[slot[offset[depth] :]] = np.arange(n)

    def accepted(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of `run` where a sequence begins, and which."""
        parts = [self._accepted(run[a : a + TOGETHER + self.length - 1]) for a in range(0, len(run), TOGETHER)]
        places = [p + i * TOGETHER for i, (p, _) in enumerate(parts)]
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int32), *(w for _, w in parts)])

    def _accepted(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of a stretch advance together, digit by digit; a sequence ends inside the stretch."""
        live = run != 0
        whole = live[: max(len(run) - self.length + 1, 0)].copy()
        for k in range(1, self.length):
            whole &= live[k : len(run) - self.length + 1 + k]
        place = np.flatnonzero(whole)
        state = np.zeros(len(place), np.int32)
        for k in range(self.length):
            for shift in range(self.n_digits * 8 - 8, -8, -8):
                ahead = self.base[state] + ((run[place + k] >> shift) & 255).astype(np.int32)
                on = self.check[ahead] == state
                place, state = place[on], ahead[on]
        return place, self.base[state]


def _placed(parent: np.ndarray, digit: np.ndarray, n_nodes: int) -> np.ndarray:
    """A base for every node so that the places base + digit of all edges differ, and none is 0.

    Nodes with most children go first; each round all nodes left propose a place, and those that meet no one stay. Who
    finds none gets 256 new places.
    """
    order = np.argsort(parent, kind="stable")
    digit, count = digit[order], np.bincount(parent, minlength=n_nodes)
    first = np.cumsum(count) - count
    room = max(1024, 2 * len(digit))
    taken, owner = np.zeros(room + 256, bool), np.full(room + 256, -1, np.int64)
    taken[0] = True
    base, rng, extra = np.zeros(n_nodes, np.int64), np.random.default_rng(7), room + 256
    for high, low in ((256, 33), (32, 9), (8, 3), (2, 1)):
        left = np.flatnonzero((count >= low) & (count <= high))
        for _ in range(40 if low < 33 else 4):
            if not len(left):
                break
            at = rng.integers(1, room, len(left))
            cells = np.repeat(at, count[left]) + digit[B.ranges(first[left], count[left])]
            mine = np.repeat(np.arange(len(left)), count[left])
            owner[cells] = mine
            good = ~taken[cells] & (owner[cells] == mine)
            alone = np.bincount(mine[~good], minlength=len(left)) == 0
            base[left[alone]] = at[alone]
            taken[cells[alone[mine]]] = True
            left = left[~alone]
        base[left] = extra + 256 * np.arange(len(left))
        extra += 256 * len(left)
    return base


def counted(runs: DataFrame, candidates: DataFrame, columns: list[str], length: int, n_digits: int, folder: str, then: Callable | None = None):
    """Counts of the candidate sequences in all runs: `columns` and `f`; and what `then` makes of each shard's trie.

    A sequence of numbers stands in `columns` as pairs, a * 2^32 + b, and a last single number where its length is odd.
    """
    candidates = C.cut(candidates, folder, f"candidates-{length}")
    n_shards = max(1, -(-candidates.count() // SHARD))
    shards = C.cut(candidates.withColumn("shard", F.expr(f"cast({columns[0]} % 1000003 % {n_shards} as int)")).repartition("shard"), folder, f"shards-{length}")
    out, more = [], []
    for shard in range(n_shards):
        table = shards.where(F.col("shard") == shard).select(*columns).toArrow()
        rows = np.stack([table.column(c).to_numpy() for c in columns], 1).astype(np.int64).reshape(-1, len(columns))
        rows = rows[np.lexsort(rows.T[::-1])]
        words = np.concatenate([np.stack([rows[:, 0] >> 32, rows[:, 0] & _LOW], 1), rows[:, 1:]], 1)
        shared = runs.sparkSession.sparkContext.broadcast(Trie(words, n_digits))
        out.append(_counts(runs, shared, columns))
        if then:
            more.append(then(shared, shard, n_shards))
    return C.cut(_all(out), folder, f"counts-{length}"), more


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _counts(runs: DataFrame, shared, columns: list[str]) -> DataFrame:
    """The counts of a trie's sequences: every task's vector, packed in parts of PART sequences, summed part by part."""

    def count(batches):
        trie, total = shared.value, None
        for batch in batches:
            for raw in batch.column(0):
                _, which = trie.accepted(B.unpack(raw.as_py()))
                n = np.bincount(which, minlength=len(trie.rows))
                total = n if total is None else total + n
        for a in range(0, 0 if total is None else len(total), PART):
            mine = total[a : a + PART]
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array([a // PART], pa.int32()), pa.array([B.pack(mine)], pa.binary())], ["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = shared.value, 0
        for batch in batches:
            for raw in batch.column("counts"):
                total = total + B.unpack(raw.as_py())
        hit = np.flatnonzero(total)
        rows = trie.rows[hit + key[0].as_py() * PART]
        parts = [(rows[:, 0] << 32) | rows[:, 1], *(rows[:, k] for k in range(2, trie.length))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, parts), pa.array(total[hit])], [*columns, "f"])

    return runs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, ", ".join(f"{c} long" for c in (*columns, "f")))


# --- candidates -------------------------------------------------------------------------------------


def _summed(rows: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Sequences whose block counts add up to `least`. Rows are distinct in a block, so they are not combined before."""
    return rows.repartition(*columns).groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*columns)


def pair_candidates(runs: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                ids = B.unpack(raw.as_py())
                both = (ids[1:] != 0) & (ids[:-1] != 0)
                key, n = np.unique((ids[:-1][both] << 32) | ids[1:][both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["ab", "n"])

    return _summed(runs.mapInArrow(run, "ab long, n long"), ["ab"], least)


def triple_rows(runs: DataFrame, shared, shard: int, n_shards: int) -> DataFrame:
    """(ab, c, n) of every block: places where the pair ab is accepted by this shard's trie of frequent pairs and so is
    the next pair, if it is of this shard."""

    def run(batches):
        trie = shared.value
        for batch in batches:
            for raw in batch.column(0):
                ids = B.unpack(raw.as_py())
                place, which = trie.accepted(ids)
                pair = np.zeros(len(ids) + 1, bool)
                pair[place] = True
                inner = place + 2 < len(ids)
                place, which = place[inner], which[inner]
                second = (ids[place + 1] << 32) | ids[place + 2]
                good = (ids[place + 2] != 0) & (pair[place + 1] | (second % 1000003 % n_shards != shard))
                which, c = which[good], ids[place + 2][good]
                key, n = np.unique((which.astype(np.int64) << 32) | c, return_counts=True)
                rows = trie.rows[key >> 32]
                yield pa.RecordBatch.from_arrays([pa.array((rows[:, 0] << 32) | rows[:, 1]), pa.array(key & _LOW), pa.array(n)], ["ab", "c", "n"])

    return runs.mapInArrow(run, "ab long, c long, n long")


# --- scores -----------------------------------------------------------------------------------------


def _score(a: str, l: str, r: str) -> str:
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    return f"cast(floor(cast(1000000 * {exact(a)} * {exact(a)} as decimal(38, 0)) div cast({exact(l)} * {exact(r)} as decimal(38, 0))) as long)"


def phrases(docs: DataFrame, folder: str, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples): frequent words (lang, word, id, f) and sequences (ab, f), (ab, c, f); written below `folder`."""
    n_buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = C.cut(word_blocks(docs, n_buckets), folder, "blocks")
    both = C.cut(numbered_words(blocks, n_buckets, least), folder, "numbers")
    words = both.where("id is not null").select("lang", "word", "id", "f")
    runs = C.cut(numbered_runs(blocks, both.where("block is not null").select("block", "bucket", "numbers")), folder, "runs")
    last = words.agg(F.max("id")).first()[0] or 0
    if last > _LOW >> 1:
        raise ValueError("more than 2^31 frequent words")
    n_digits = max(1, (last.bit_length() + 7) // 8)
    pairs, rows = counted(runs, pair_candidates(runs, least), ["ab"], 2, n_digits, folder, lambda *shard: triple_rows(runs, *shard))
    triples, _ = counted(runs, _summed(_all(rows), ["ab", "c"], least), ["ab", "c"], 3, n_digits, folder)
    return words, pairs, triples


def collocations(docs: DataFrame, folder: str, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """`lang`, `rank`, `phrase`, `a` (its count), `l`, `r` (the counts of the parts it is cut into), `n` (words of the
    language), `score`: the `top` phrases of each language that no longer one with `cover` % of their count holds."""
    words, pairs, triples = phrases(docs, folder, least)
    first = words.select(F.col("id").alias("a_id"), "lang", F.col("word").alias("a_word"), F.col("f").alias("f_a"))
    named = lambda x: words.select(F.col("id").alias(f"{x}_id"), F.col("word").alias(f"{x}_word"), F.col("f").alias(f"f_{x}"))
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(_LOW))
    ab = pairs.select(F.col("ab").alias("ab"), F.col("f").alias("f_ab"))
    three = triples.select("ab", high("ab").alias("a_id"), low("ab").alias("b_id"), F.col("c").alias("c_id"), F.col("f").alias("a"))
    three = three.withColumn("bc", F.expr("shiftleft(b_id, 32) | c_id"))
    inside = three.select("ab", "a").union(three.select("bc", "a")).groupBy("ab").agg(F.max("a").alias("held"))
    two = ab.join(inside, "ab", "left").where(f"held is null or 100 * held < {cover} * f_ab")
    two = two.select(F.col("f_ab").alias("a"), high("ab").alias("a_id"), low("ab").alias("b_id")).join(first, "a_id").join(named("b"), "b_id")
    two = two.select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), "a", F.col("f_a").alias("l"), F.col("f_b").alias("r"))
    two = two.withColumn("score", F.expr(_score("a", "l", "r")))
    three = three.join(ab, "ab").join(pairs.select(F.col("ab").alias("bc"), F.col("f").alias("f_bc")), "bc")
    three = three.join(first, "a_id").join(named("b"), "b_id").join(named("c"), "c_id")
    three = three.withColumns({"one": F.expr(_score("a", "f_a", "f_bc")), "two": F.expr(_score("a", "f_ab", "f_c"))})
    three = three.select(
        "lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), "a",
        F.expr("if(one <= two, f_a, f_ab)").alias("l"), F.expr("if(one <= two, f_bc, f_c)").alias("r"), F.least("one", "two").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.union(three.select(*two.columns)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    blocks = docs.sparkSession.read.parquet(f"{folder}/blocks")
    n = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
