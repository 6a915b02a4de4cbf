"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing, encoding; each stage over all that is left.

Every stage takes and returns the columns of `documents`; the last returns the encoded rows. `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loopstats.llm import common, dart_minhash, line_dedup, mixing, quality_rules, sentence_pieces

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed limits nor a cutoff rejects."""
    return quality_rules.kept_documents(docs.select(*DOCUMENTS), common.table(spark, sf_dir, "labels"), common.scratch(spark))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without lines that ten different texts or more have.

    Equal texts count as one here: copies, of which the next stage leaves one, would else empty each other.
    """
    rows = line_dedup.drop_lines(docs.select(*DOCUMENTS), common.scratch(spark), distinct_texts=True)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the least id. Null and empty texts are one class; of equal rows one stays."""
    return dart_minhash.one_of_each(docs.select(*DOCUMENTS), common.scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed(docs.select(*DOCUMENTS), common.scratch(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces, round_trip of every row."""
    return sentence_pieces.encoded(docs, ["doc_id", "source"], sentence_pieces.load_pieces())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("sentence_pieces", encode),
]
#: Signatures, exact tests of a binomial and merging of pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read by the next."""
    docs, folder = common.table(spark, sf_dir, "documents"), common.scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
