"""The registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment, collocations, common as C, dart_minhash, licenses, line_dedup, mixing, quality_rules, sentence_pieces, spot_signatures,
    substring_dedup, token_counts, url_rules, weak_pii,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_dart_minhash(spark, sf_dir):
    return dart_minhash.near_duplicates(C.table(spark, sf_dir, "documents"), C.scratch(spark))


@query
def op2_license_digest(spark, sf_dir):
    return licenses.scan(C.table(spark, sf_dir, "documents"), licenses.known_table(spark), C.scratch(spark))


@query
def op3_quality_rules(spark, sf_dir):
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    return quality_rules.screen(docs, labels, C.scratch(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


@query
def op4_weak_pii(spark, sf_dir):
    return weak_pii.report(weak_pii.found_spans(C.table(spark, sf_dir, "documents"), C.scratch(spark)))


@query
def op5_water_filling(spark, sf_dir):
    rows = mixing.mixture(C.table(spark, sf_dir, "documents"), C.scratch(spark))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_spot_signatures(spark, sf_dir):
    return spot_signatures.edited_fingerprints(C.table(spark, sf_dir, "documents"))


@query
def op7_sentence_pieces(spark, sf_dir):
    return sentence_pieces.encoded(C.table(spark, sf_dir, "documents"), ["doc_id"], sentence_pieces.load_pieces())


@query
def op8_suffix_trees(spark, sf_dir):
    rows = substring_dedup.without_repeats(C.table(spark, sf_dir, "documents"), C.scratch(spark))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_line_runs(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.drop_lines(docs, C.scratch(spark))
    return rows.select("doc_id", "n_lines", F.col("n_dropped").cast("long"), F.sha2("text", 256).alias("kept_sha256"))


@query
def op10_url_rules(spark, sf_dir):
    return url_rules.judge_urls(C.table(spark, sf_dir, "pages"), url_rules.rule_table(spark), C.scratch(spark))


@query
def op11_token_counts(spark, sf_dir):
    return token_counts.token_counts(C.table(spark, sf_dir, "documents"), token_counts.load_model(), C.scratch(spark))


@query
def op12_token_alignment(spark, sf_dir):
    return alignment.alignment(C.table(spark, sf_dir, "documents"), alignment.Encoders.load(), C.scratch(spark))


@query
def op13_collocations(spark, sf_dir):
    return collocations.collocations(C.table(spark, sf_dir, "documents"), C.scratch(spark))
