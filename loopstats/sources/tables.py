"""Typed scans of the analytic tables kept as parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import TABLES
from .files import Folder
from .sinks import AppendLog


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One analytic table; a fixed schema, so no inference pass, and missing columns read as null.

    Of a table kept as an AppendLog only the entered runs are read.
    """
    path, schema = f"{directory}/{name}", TABLES[name]
    if Folder(spark, path).exists("_manifest"):
        return AppendLog(spark, path).read(schema)
    return spark.read.schema(schema).parquet(path)


def as_table(rows: DataFrame, name: str, as_of=None, key: Sequence[str] = (), **fixed) -> DataFrame:
    """`rows` in the columns of a table, ready to be appended to it.

    `as_of` becomes created_at where the rows have none. Without an id a row gets the digest of its `key` columns and
    `as_of`, so a second run of the same job makes the same ids. Columns that neither the rows nor `fixed` give are null.
    """
    have = dict(zip(rows.columns, rows.columns))
    made = {c: F.lit(v) for c, v in fixed.items()}
    if as_of is not None and "created_at" not in have:
        made["created_at"] = F.lit(as_of).cast("timestamp")
    if key and "id" not in have:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
        made["id"] = F.sha2(F.concat_ws(":", F.lit(name), *parts, F.lit(str(as_of))), 256)
    value = lambda c: F.col(c) if c in have else made.get(c, F.lit(None))
    return rows.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(TABLES[name]).fields))
