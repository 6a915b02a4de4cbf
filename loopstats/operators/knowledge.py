"""Corpus jobs: chunking, indexing, prompt context."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.chunking import chunk_array


def chunk_text(
    docs: DataFrame,
    text: str = "text",
    max_chars: int = 500,
    overlap: int = 50,
    mode: str = "progressive",
) -> DataFrame:
    """One row per chunk with its position. Runs inside the scan's partitions, which are cut by
    bytes, so long documents do not pile up in one task and nothing is shuffled."""
    others = [c for c in docs.columns if c != text]
    chunks = chunk_array(F.col(text), max_chars, overlap, mode)
    return docs.select(*others, F.posexplode(chunks).alias("chunk_index", "content"))


Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def embed_contents(
    contents: DataFrame, embed: Embed, content: str = "content", known: DataFrame | None = None, batch: int = 256
) -> DataFrame:
    """(digest, embedding) of each distinct text, by a function that takes up to `batch` texts and gives as many vectors.

    A text is sent once, however many rows hold it, and not at all if `known` (digest, embedding) has its digest; null
    texts are left out. Texts meet by digest before the function sees them, so which task they are in, or that a task
    runs again, does not matter as long as the function gives equal vectors for equal texts. A batch without a vector
    for each of its texts fails.
    """
    digest = F.sha2(content, 256)
    new = contents.filter(F.col(content).isNotNull()).groupBy(digest.alias("digest")).agg(F.any_value(content).alias("content"))
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.slice(start, batch)
                made = embed(part.column(1).to_pylist())
                if len(made) != len(part):
                    raise ValueError(f"{len(made)} vectors for {len(part)} texts")
                column = pa.array([[float(x) for x in v] for v in made], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], ["digest", "embedding"])

    made = new.mapInArrow(vectors, "digest string, embedding array<float>")
    return made if known is None else made.unionByName(known.select("digest", F.col("embedding").cast("array<float>").alias("embedding")))


def index_documents(
    docs: DataFrame,
    vectors: DataFrame | None = None,
    doc_key: str = "doc_id",
    source_type: str = "document",
    embed: Embed | None = None,
    known: DataFrame | None = None,
    **chunking,
) -> DataFrame:
    """Chunk rows ready for the chunk store, with their vectors and the document's tenant.

    Vectors come from `vectors` (doc_key, chunk_index, embedding), or from the batch function `embed`, which sees each
    distinct content once (see embed_contents; `known` are vectors made before).
    """
    chunks = chunk_text(docs, **chunking)
    if (vectors is None) == (embed is None):
        raise ValueError("give either vectors or embed")
    if embed is not None:
        made = embed_contents(chunks, embed, known=known).withColumnRenamed("digest", "_digest")
        joined = chunks.join(made, F.sha2("content", 256) == F.col("_digest"), "left").drop("_digest")
    else:
        joined = chunks.join(vectors.select(doc_key, "chunk_index", "embedding"), [doc_key, "chunk_index"], "left")
    optional = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    return joined.select(
        F.sha2(F.concat_ws(":", F.col(doc_key).cast("string"), F.col("chunk_index").cast("string")), 256)
        .alias("id"),
        doc_key,
        "chunk_index",
        F.lit(source_type).alias("source_type"),
        (F.col("source_name") if "source_name" in docs.columns else F.col(doc_key)).cast("string").alias("source_name"),
        optional("knowledge_point"),
        optional("tenant_id"),
        "content",
        "embedding",
    )


def chunk_counts(chunks: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(doc_key).agg(F.count("*").alias("chunks"))


def with_content(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their text; hits without text go, after the limit as in retrieval."""
    texts = chunks.select(F.col("id").alias("chunk_id"), "content")
    return hits.join(texts, "chunk_id").filter(F.coalesce(F.col("content"), F.lit("")) != "")


def rag_context(hits: DataFrame) -> DataFrame:
    """Snippets of a query in rank order, parted by a blank line; a query has at most k."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "content")))
    joined = F.array_join(F.transform(ranked, lambda h: h["content"]), "\n\n")
    return hits.groupBy("query_id").agg(joined.alias("context"))


# Fixed value: the heading between the prompt and its reference material.
CONTEXT_HEADING = "\n\n参考资料（务必参考以增强内容的事实依据）：\n"


def render_prompts(
    rows: DataFrame, template: str, variables: Sequence[str], context: DataFrame | None = None
) -> DataFrame:
    """Adds `prompt`: the template with every {{variable}} filled; null values leave the
    placeholder. `context` (query_id, context) is joined on the rows' id and appended."""
    prompt = F.lit(template)
    for name in variables:
        mark = F.lit("{{" + name + "}}")
        prompt = F.when(
            F.col(name).isNotNull(), F.replace(prompt, mark, F.col(name).cast("string"))
        ).otherwise(prompt)
    out = rows.withColumn("prompt", prompt)
    if context is None:
        return out
    found = context.select(F.col("query_id").alias("id"), F.col("context").alias("_context"))
    appended = F.concat("prompt", F.lit(CONTEXT_HEADING), "_context")
    has_context = F.coalesce(F.col("_context"), F.lit("")) != ""
    return (
        out.join(found, "id", "left")
        .withColumn("prompt", F.when(has_context, appended).otherwise(F.col("prompt")))
        .drop("_context")
    )
