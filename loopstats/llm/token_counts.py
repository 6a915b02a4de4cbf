"""Token counts of texts without their ids.

A SentencePiece model whose pieces never hold a space behind something else encodes the runs between such places (the
pre-tokens) each for itself. So a text's count is the sum, over its distinct pre-tokens, of how often it has them times
how many pieces they have.

Documents are taken in blocks. A block's distinct pre-tokens are dealt into buckets by hash and packed, one row for each
bucket; its documents' frequencies are a sparse matrix over them. A bucket's rows of all blocks meet in one group: there
every distinct pre-token is encoded once, and each block's row goes back with the numbers of pieces. Blocks join their
answers and multiply. So a pre-token travels once a block, in a few bytes, whatever the number of its documents.

Defined cases: null and empty texts have no tokens; U+2581 is a space to the model; special strings inside texts are
ordinary text; rows are counted each, also those whose id is null or repeated; an empty table gives no row; columns of
`docs` beside `carry` do not matter, and those in `carry` must not be named like the columns made (ValueError). A text
longer than a block is a block of its own: memory follows the longest text, at about twenty times its bytes. A bucket
is dealt again as the session's number of shuffle partitions grows, so its size follows that setting. Within a block
pre-tokens are known by 64-bit hashes; their bytes are compared too, and the job fails where equal hashes have other
bytes. Between blocks they are known by their bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B, common as C

MADE = ("n_bytes", "n_tokens", "over_limit")
#: Bytes of text in a block; the least number of buckets.
BLOCK, BUCKETS = 1 << 25, 64


def load_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The model file, of fixed size, read on the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def check_model(model: bytes) -> None:
    """Refuses a model whose pieces go across the places where texts are cut."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if B.SPACE_SIGN in piece.lstrip(B.SPACE_SIGN):
            raise ValueError(f"piece {piece!r} goes across a space")


class _Block:
    """Documents of a block, their pre-tokens, and how often they have which."""

    def __init__(self):
        self.tokens, self.size, self.height, self.parts, self.batches = B.Numbered(), 0, 0, [], []

    def add(self, part: pa.RecordBatch) -> None:
        cut = B.Segments(part.column(0))
        key, one, which = cut.distinct()
        number, _ = self.tokens.numbers(key, cut.bytes_of(one))
        cells = B.Sparse.of_cells(cut.row, which, None, len(part), len(key))
        self.parts.append((cells.rows() + self.height, number[cells.column], cells.value))
        self.batches.append(part)
        self.height += len(part)
        self.size += len(cut.buffer)

    def row(self, number: int, carry: list[str], n_buckets: int, names: list[str]) -> pa.RecordBatch:
        """Pre-tokens are numbered by bucket and, inside, by their bytes."""
        entries = self.tokens.entries
        bucket = np.empty(len(entries), np.int64)
        bucket[self.tokens.place] = (self.tokens.key % np.uint64(n_buckets)).astype(np.int64)
        order = _by_bucket(bucket, entries)
        at = np.empty(len(entries), np.int64)
        at[order] = np.arange(len(entries))
        row, column, value = (np.concatenate(x) for x in zip(*self.parts))
        cells = B.Sparse.of_cells(row, at[column], value, self.height, len(entries))
        first = np.append(0, np.cumsum(np.bincount(bucket, minlength=n_buckets))).tolist()
        words = [entries[i] for i in order]
        used = [b for b in range(n_buckets) if first[b] < first[b + 1]]
        docs = pa.Table.from_batches(self.batches).combine_chunks().to_batches()[0]
        n_bytes = np.diff(C.text_bytes(docs.column(0))[1])
        lists = [
            pa.array([number], pa.int64()), B.structs(docs, carry), pa.array([n_bytes], pa.list_(pa.int64())),
            pa.array([cells.packed()], pa.binary()), pa.array([used], pa.list_(pa.int32())),
            pa.array([[B.pack_bytes(words[first[b] : first[b + 1]]) for b in used]], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(lists, names)


def _by_bucket(bucket: np.ndarray, entries: list[bytes]) -> list[int]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [i for run in np.split(order, cuts) for i in sorted(run.tolist(), key=entries.__getitem__)]


def frequencies(docs: DataFrame, carry: list[str], n_buckets: int) -> DataFrame:
    """One row for each block: its documents' `carry` and bytes, its matrix of frequencies, its packed pre-tokens by bucket."""
    fields = [docs.schema[c] for c in carry] or [T.StructField("none", T.BooleanType())]
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(fields))),
        T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("cells", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.BinaryType())),
    ])
    most = BLOCK

    def run(batches):
        number, block = B.numbering(), _Block()
        for batch in batches:
            for part in B.cut_batch(batch):
                block.add(part)
                if block.size >= most:
                    yield block.row(next(number), carry, n_buckets, schema.names)
                    block = _Block()
        if block.height:
            yield block.row(next(number), carry, n_buckets, schema.names)

    return docs.select(F.col("text").cast("string").alias("__text"), *carry).mapInArrow(run, schema)


def pieces_of(tokens: DataFrame, model: bytes) -> DataFrame:
    """(block, bucket, pieces) of (block, bucket, tokens): each distinct pre-token of a bucket is encoded once.

    The space that a pre-token begins with is the one that the library puts there.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(group: pa.Table) -> pa.Table:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        known = {b" ": 3 if sp.is_unknown(sp.piece_to_id(B.SPACE_SIGN)) else 1}
        out = []
        for packed in group.column("tokens"):
            words = B.unpack_bytes(packed.as_py())
            new = [w for w in words if w not in known]
            known.update(zip(new, map(len, sp.encode([w[1:].decode() for w in new], num_threads=1))))
            out.append(B.pack(np.array([known[w] for w in words], np.int64)))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "pieces": pa.array(out, pa.binary())})

    return tokens.groupBy("bucket").applyInArrow(run, "block long, bucket int, pieces binary")


def token_counts(docs: DataFrame, model: bytes, folder: str, carry: Sequence[str] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """`carry` of each document with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens).

    The blocks are written below `folder`; pre-tokens and frequencies are read from there apart from each other.
    """
    carry = list(carry)
    if set(carry) & set(MADE):
        raise ValueError(f"columns named like {MADE} cannot be carried")
    check_model(model)
    n_buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = C.cut(frequencies(docs, carry, n_buckets), folder, "blocks")
    asked = blocks.select("block", F.explode(F.arrays_zip("buckets", "tokens")).alias("t")).select("block", F.col("t.buckets").alias("bucket"), F.col("t.tokens").alias("tokens"))
    answers = pieces_of(asked, model).groupBy(F.col("block").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("bucket", "pieces"))).alias("answers"))
    answered = blocks.select("block", "rows", "n_bytes", "cells").join(answers, F.col("block") == F.col("__of"), "left")
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows, size, cells, parts = (batch.column(k)[i] for k in range(4))
                cells = B.Sparse.unpacked(cells.as_py())
                pieces = [B.unpack(x) for x in parts.as_py() or []]
                total = cells.times(np.concatenate([*pieces, np.zeros(0, np.int64)]))
                columns = [rows.values.field(k) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*columns, size.values, pa.array(total, pa.int64()), pa.array(total > limit)], schema.names)

    return answered.select("rows", "n_bytes", "cells", F.col("answers.pieces").alias("pieces")).mapInArrow(run, schema)
