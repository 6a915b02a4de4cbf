"""Overlap chunking of long texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

TEXTS_AT_ONCE = 64


def split_text(text: str, max_chars: int, overlap: int, mode: str) -> list[str]:
    """Windows of `max_chars`, cut at the last newline inside when there is one.

    mode="reference" steps back `overlap` after every cut, so a newline within reach of the
    step is found again and again. mode="progressive" takes only cuts that end beyond the
    previous chunk.
    """
    text = text.strip()
    if len(text) <= max_chars:
        return [text] if text else []
    pieces, start, done = [], 0, 0
    while True:
        end = start + max_chars
        last = end >= len(text)
        if not last:
            floor = start if mode == "reference" else max(start, done)
            cut = text.rfind("\n", start, end)
            end = cut if cut > floor else end
        piece = text[start:end].strip()
        if piece:
            pieces.append(piece)
        if last:
            return pieces
        start, done = max(end - overlap, start + 1), end


def chunks_of(texts: pa.Array, max_chars: int, overlap: int, mode: str) -> pa.Array:
    """The chunks of each text; of a batch, only TEXTS_AT_ONCE texts are Python strings at a time."""
    made = [pa.array([], pa.list_(pa.string()))]
    for start in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts.slice(start, TEXTS_AT_ONCE).to_pylist()
        made.append(pa.array([[] if t is None else split_text(t, max_chars, overlap, mode) for t in some], pa.list_(pa.string())))
    return pa.concat_arrays(made)


def chunk_array(c: Column, max_chars: int = 500, overlap: int = 50, mode: str = "progressive") -> Column:
    """array<string> of chunks; each step depends on the last, so an Arrow batch function."""
    if mode not in ("progressive", "reference"):
        raise ValueError(f"unknown mode {mode}")

    @F.arrow_udf("array<string>")
    def chunks(texts: pa.Array) -> pa.Array:
        return chunks_of(texts, max_chars, overlap, mode)

    return chunks(c)
