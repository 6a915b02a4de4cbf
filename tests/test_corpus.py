"""Chunking, retrieval, prompts and the sample pool."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loopstats.functions.chunking import chunks_of, split_text
from loopstats.functions.vectors import cosine_distance
from loopstats.operators import knowledge, nearest, samples
from loopstats.session import BATCH_BYTES


def test_short_and_blank_texts():
    assert split_text("hello world", 500, 50, "progressive") == ["hello world"]
    assert split_text("   \n　", 500, 50, "progressive") == []


def test_hard_cuts_overlap():
    chunks = split_text("a" * 300, 100, 10, "progressive")
    assert [len(c) for c in chunks] == [100, 100, 100, 30]


def test_paragraphs_stay_whole():
    text = "\n".join(c * 80 for c in "xyz")
    for mode in ("progressive", "reference"):
        assert split_text(text, 100, 0, mode) == ["x" * 80, "y" * 80, "z" * 80]


def test_newline_near_the_step_back():
    text = "x" * 95 + "\n" + "y" * 150
    creeping = split_text(text, 100, 10, "reference")
    moving = split_text(text, 100, 10, "progressive")
    assert len(creeping) > len(moving)
    assert moving == ["x" * 95, "x" * 10 + "\n" + "y" * 89, "y" * 71]


@pytest.mark.parametrize("mode", ["progressive", "reference"])
def test_chunks_cover_the_text(mode):
    rng = np.random.default_rng(7)
    for _ in range(30):
        text = "".join(rng.choice(list("ab \n"), rng.integers(1, 900), p=[0.5, 0.4, 0.06, 0.04])).strip()
        chunks = split_text(text, 60, 12, mode)
        at = 0
        for chunk in chunks:
            assert len(chunk) <= 60
            found = text.find(chunk, max(0, at - 60))
            assert found >= 0 and not text[at:found].strip()
            at = max(at, found + len(chunk))
        assert not text[at:].strip()


def test_index_carries_tenant_and_vector(spark):
    docs = spark.createDataFrame([(1, "short", "t1"), (2, "b" * 700, "t2")], "doc_id bigint, text string, tenant_id string")
    vectors = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [2.0])], "doc_id bigint, chunk_index int, embedding array<float>")
    rows = knowledge.index_documents(docs, vectors).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.tenant_id, r.embedding) for r in rows] == [
        (1, 0, "t1", [1.0]), (2, 0, "t2", None), (2, 1, "t2", [2.0]),
    ]


def test_each_content_is_embedded_once(spark):
    seen, batches = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        batches.add(1)
        return [[len(t), t.count("a")] for t in texts]

    rows = [(i, ["same text", "other aa", None, "", "x" * 120][i % 5]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = knowledge.index_documents(docs, embed=embed, max_chars=50, overlap=0).select("doc_id", "chunk_index", "content", "embedding").collect()
    assert len(got) == 40 * (1 + 1 + 3) and seen.value == 4  # the two halves of 50 x are one text
    assert all(list(r.embedding) == [len(r.content), r.content.count("a")] for r in got)
    chunks = knowledge.chunk_text(docs, max_chars=50, overlap=0)
    first = knowledge.embed_contents(chunks.filter("length(content) < 10"), embed, batch=1).collect()
    assert sorted(list(r.embedding) for r in first) == [[8.0, 2.0], [9.0, 1.0]] and batches.value >= 3
    known, before = spark.createDataFrame(first, "digest string, embedding array<float>"), seen.value
    every = knowledge.embed_contents(chunks, embed, known=known).collect()
    assert len({r.digest for r in every}) == len(every) == 4 and seen.value == before + 2
    # a task that runs again, in other partitions, gives the same rows
    again = knowledge.embed_contents(chunks.repartition(3), embed, batch=3).collect()
    assert {r.digest: list(r.embedding) for r in again} == {r.digest: list(r.embedding) for r in every}


def test_a_batch_without_all_vectors_fails(spark):
    texts = spark.range(1000).selectExpr("concat('text ', id) content")
    with pytest.raises(Exception, match="1 vectors for"):
        knowledge.embed_contents(texts, lambda texts: [[1.0]]).collect()
    with pytest.raises(ValueError):
        knowledge.index_documents(texts.withColumnRenamed("content", "text"))


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(cosine_distance(F.col("a"), F.col("b")), 9)).collect()]
    assert got == [1.0, 0.0, None]


def brute(queries, chunks, k, filters):
    """Plain Python: rounded similarity, ties by id."""
    out = []
    for q in queries:
        found = []
        for c in chunks:
            if any(q[f] is not None and q[f] != c[f] for f in filters):
                continue
            a, b = np.array(q["embedding"], float), np.array(c["embedding"], float)
            if np.linalg.norm(a) and np.linalg.norm(b):
                found.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), c["id"]))
        out += [(q["id"], cid, -s, i + 1) for i, (s, cid) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("filters", [[], ["knowledge_point"], ["knowledge_point", "tenant_id"]])
@pytest.mark.parametrize("rows", [50_000, 9])
def test_knn_equals_brute_force(spark, filters, rows):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.integers(-2, 3, 5)]  # many ties, some zero vectors
    point = lambda: "hot" if rng.random() < 0.5 else str(rng.integers(3))
    chunks = [dict(id=i, embedding=vec(), knowledge_point=point(), tenant_id=str(rng.integers(2))) for i in range(300)]
    queries = [
        dict(id=f"q{i}", embedding=vec(), knowledge_point=None if i % 4 == 0 else point(), tenant_id=str(rng.integers(2)))
        for i in range(40)
    ]
    schema = "embedding array<float>, knowledge_point string, tenant_id string"
    q, c = spark.createDataFrame(queries, "id string, " + schema), spark.createDataFrame(chunks, "id bigint, " + schema)
    hits = nearest.knn_topk(q, c.repartition(5), 3, filters, rows_per_cell=rows, centres=12)
    got = sorted((r.query_id, r.chunk_id, r.similarity, r.rank) for r in hits.collect())
    assert got == brute(queries, chunks, 3, filters)


def test_knn_threshold_and_empty_sides(spark):
    schema = "id bigint, embedding array<float>, content string"
    c = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [0.0, 1.0], ""), (3, [-1.0, 0.0], "x")], schema)
    hits = nearest.knn_topk(c.limit(1), c, 3, min_similarity=0.0)
    assert {(r.chunk_id, r.similarity) for r in hits.collect()} == {(1, 1.0), (2, 0.0)}
    assert [r.content for r in knowledge.with_content(hits, c).collect()] == ["one"]
    assert nearest.knn_topk(c.limit(0), c).count() == 0
    assert nearest.knn_topk(c, c.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_knn_prunes_and_stays_exact(spark, kind):
    """4,000 vectors of 24 numbers, each a query and a chunk, against one product of matrices."""
    rng = np.random.default_rng(8)
    n = 4000
    vectors = rng.normal(size=(n, 24))
    if kind != "random":
        vectors = 8 * rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + vectors
    if kind == "copies":  # a third of all rows is one vector
        vectors[: n // 3] = vectors[0]
    frame = spark.createDataFrame(pd.DataFrame({"id": range(n), "embedding": list(vectors)}), "id long, embedding array<double>").repartition(4)
    counter = spark.sparkContext.accumulator(0)
    hits = nearest.knn_topk(frame, frame, 4, (), rows_per_cell=300, centres=100, products=counter).toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    order = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), -sims), axis=1)[:, :4]
    wanted = np.take_along_axis(sims, order, axis=1)
    hits = hits.sort_values(["query_id", "rank"])
    assert np.abs(hits.similarity.to_numpy().reshape(n, 4) - wanted).max() < 2e-6
    same = hits.chunk_id.to_numpy().reshape(n, 4) == order
    assert same.mean() > 0.999  # the sixth digit of a product may fall either way
    assert 0 < counter.value < (0.2 if kind == "clustered" else 1.1) * n * n


def test_a_block_is_bounded(spark):
    cells = nearest.Cells(pa.table({"id": [1], "embedding": pa.array([[1.0, 0.0]])}))
    first = 2 * nearest.CENTRES
    cells.lay_out([(first, 0, 3), (first, 1, 4), (first, 5, 25), (first, 9, 1)], 10)
    assert cells.blocks[first] == [(0, 2, 0, 1, 7), (5, 6, 1, 3, 25), (9, 10, 4, 1, 1)] and cells.loose == {2: 5}
    got = cells.block_of(np.array([first] * 6 + [-1]), np.array([0, 1, 5, 5, 5, 7, 0]), np.array([0, 1, 3, 4, 5, 0, 0], np.uint64))
    assert got.tolist() == [0, 0, 1, 2, 3, 5, -1]


def test_prompt(spark):
    rows = spark.createDataFrame([(1, "greeting", None), (2, "a{{level}}", "2"), (3, "x", "3")], "id bigint, topic string, level string")
    context = spark.createDataFrame([(1, "facts"), (3, "")], "query_id bigint, context string")
    out = knowledge.render_prompts(rows, "{{topic}}/{{level}}/{{other}}", ["topic", "level"], context)
    got = {r.id: r.prompt for r in out.collect()}
    assert got[1] == "greeting/{{level}}/{{other}}" + knowledge.CONTEXT_HEADING + "facts"
    assert got[2] == "a2/2/{{other}}" and got[3] == "x/3/{{other}}"


def test_sync_is_idempotent(spark):
    content = spark.createDataFrame(
        [("a", "k1", "t", "{}", 95.0, "passed"), ("b", "k2", "t", "{}", 92.0, "published"), ("c", "k1", "t", "{}", 80.0, "pending_qc"), ("d", "k9", "t", "{}", None, "passed")],
        "id string, task_id string, template_id string, payload string, qc_score double, status string",
    )
    tasks = spark.createDataFrame([("k1", '{"knowledge_point":"greet"}'), ("k2", '{"knowledge_point":""}')], "id string, params string")
    pool = spark.createDataFrame([], "item_id string")
    fresh = samples.sample_sync(content, tasks, pool)
    got = {r.item_id: (r.knowledge_point, r.source, r.purpose, r.meta) for r in fresh.collect()}
    assert got == {
        "a": ("greet", "auto", "sft", '{"qc_score":95.0,"status":"passed"}'),
        "b": (None, "auto", "sft", '{"qc_score":92.0,"status":"published"}'),
        "d": (None, "auto", "sft", '{"qc_score":null,"status":"passed"}'),
    }
    assert samples.sample_sync(content, tasks, fresh.select("item_id")).count() == 0
    assert tuple(samples.sync_counts(content, fresh, pool).first()) == (3, 3)


def test_chunks_in_sql(spark):
    from loopstats.functions.register import register

    register(spark)
    rows = spark.sql("SELECT d.id, c.* FROM VALUES (1, repeat('a', 25)), (2, null) d(id, t), LATERAL chunks(d.t, 10, 2) c")
    assert sorted((r.id, r.chunk_index, len(r.content)) for r in rows.collect()) == [(1, 0, 10), (1, 1, 10), (1, 2, 9)]


@pytest.mark.parametrize("centres", [0, 1, 256])
def test_vectors_of_other_lengths_or_none_never_match(spark, centres):
    schema = "id bigint, embedding array<float>"
    q = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 0.0]), (4, [0.0, 1.0, 5.0]), (5, [0.0, 0.0])], schema).coalesce(1)
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 5.0]), (3, [2.0]), (4, None), (5, [3.0, 4.0]), (6, [None, 1.0])], schema).coalesce(1)
    got = nearest.knn_topk(q, c, 3, (), centres=centres)
    assert sorted((r.query_id, r.chunk_id, r.similarity) for r in got.collect()) == [(3, 1, 1.0), (3, 5, 0.6), (4, 2, 1.0)]


def test_a_query_moves_once_for_a_shelf_however_many_blocks_it_visits(spark):
    """Nothing can be pruned here: 3,000 random vectors in 100 cells, each query visits them all. They moved 100 times."""
    vectors = np.random.default_rng(4).normal(size=(3000, 24))
    frame = spark.createDataFrame(pd.DataFrame({"id": range(3000), "embedding": list(vectors)}), "id long, embedding array<double>")
    cells = nearest.Cells(frame.limit(100).toArrow())
    cells.lay_out([tuple(r) for r in nearest._steps(frame, spark.sparkContext.broadcast(cells)).collect()], 600)
    layout = spark.sparkContext.broadcast(cells)
    groups = spark.sparkContext.broadcast(dict.fromkeys(cells.shelf.tolist(), 2))
    moved = nearest._queries_by_group(frame, layout, groups, 3, (), None)
    n, blocks = moved.selectExpr("count(*)", "sum(size(blocks))").first()
    assert n <= 3000 * len(set(cells.shelf.tolist())) <= 3000 * 7 and blocks > 3000 * 60
    moved = nearest._chunks_by_group(frame, layout, groups, None)
    assert moved.count() == 6000 and moved.groupBy("shelf", "part").count().agg({"count": "max"}).first()[0] <= 700


def test_batches_are_bounded_by_bytes(spark):
    """10,000 texts of 2 KB were one batch of 20 MB."""
    from loopstats.plans.registry import QUERIES

    spark.conf.unset(BATCH_BYTES[0])
    QUERIES["chunk_text"](spark, "/root/testdata/sf0.001")
    rows = spark.range(10_000, numPartitions=1).selectExpr("repeat('ab c', 500) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 6_000_000
    assert knowledge.chunk_text(rows).count() == 10_000 * len(split_text("ab c" * 500, 500, 50, "progressive"))


def test_chunks_of_many_texts():
    texts = [None, "", *("a\nb " * n for n in range(300))]
    got = chunks_of(pa.array(texts), 40, 5, "progressive").to_pylist()
    assert got == [split_text(t or "", 40, 5, "progressive") for t in texts]
    assert chunks_of(pa.array([], pa.string()), 40, 5, "reference").to_pylist() == []
