"""Document files: guards, decoding, and rejects as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Accepted plain-text extensions and the upload limit. Office and PDF files are
# accepted by name but need parsers that are not part of this library.
TEXT_EXTENSIONS = (".txt", ".md")
PARSER_EXTENSIONS = (".docx", ".pdf")
MAX_BYTES = 10 * 1024 * 1024


@F.pandas_udf(T.StringType())
def _decode_fallback(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else bytes(b).decode("gb18030", errors="replace"))


def _reject_reason(extension: Column, length: Column, max_bytes: int) -> Column:
    return (
        F.when(length == 0, "empty")
        .when(length > max_bytes, "too_large")
        .when(extension.isin(*PARSER_EXTENSIONS), "no_parser")
        .when(~extension.isin(*TEXT_EXTENSIONS), "unsupported_extension")
    )


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected) of all files under a folder.

    The size guard is pushed into the file source, so oversized files and the contents of rejects
    are never read. Spark's file sources skip hidden names and files of no bytes themselves;
    those give no row at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return screen_documents(files, max_bytes)


def screen_documents(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected) of a table of files (path, length, content). Only bytes that are not UTF-8
    go through Python."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<!^)\.[^.]*$", "")
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    named = files.select(
        "path",
        "length",
        "content",
        F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))).alias("source_name"),
        extension.alias("extension"),
    )
    reason = _reject_reason(F.col("extension"), F.col("length"), max_bytes)
    rejected = named.select("path", "source_name", "length", reason.alias("reason")).filter(
        "reason is not null"
    )
    readable = named.filter(
        (F.col("length") > 0)
        & (F.col("length") <= max_bytes)
        & F.col("extension").isin(*TEXT_EXTENSIONS)
    )
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    ok = readable.select(
        "path",
        "source_name",
        "length",
        F.when(utf8, F.col("content").cast("string")).alias("_utf8"),
        F.when(~utf8, F.col("content")).alias("_other"),
    ).select(
        "path",
        "source_name",
        "length",
        F.coalesce("_utf8", _decode_fallback("_other")).alias("text"),
    )
    return ok, rejected
