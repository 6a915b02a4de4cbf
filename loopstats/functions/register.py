"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from .chunking import split_text


class _Chunks:
    def eval(self, text: str, max_chars: int, overlap: int):
        if text is not None:
            yield from enumerate(split_text(text, max_chars, overlap, "progressive"))


def register(spark: SparkSession) -> None:
    """chunks(text, max_chars, overlap) as a table function, for use with LATERAL."""
    table = F.udtf(_Chunks, returnType="chunk_index int, content string")
    spark.udtf.register("chunks", table)
