"""What only larger or other tables than the given ones show."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight import catalogue as own
from quarrylight import session
from quarrylight.operators import clustering, memory, search, vectors
from quarrylight.queries import NOW
from quarrylight.sources import files


def same_as_sql(spark, folder, name):
    """Whether a query and its SQL give the same rows over the tables written to a folder."""
    c = pytest.importorskip("duckdb").connect()
    for t in os.listdir(folder):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{folder}/{t}/*.parquet')")
    found = c.sql(own.SQL[name])
    theirs = sorted(str(tuple(r)) for r in found.fetchall())
    ours = sorted(str(tuple(r)) for r in own.QUERIES[name](spark, str(folder)).select(*found.columns).collect())
    return ours == theirs and len(ours) > 0


def embeddings(spark, folder, ids):
    e = ids.select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(F.col("id") * 7 + k * k).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    e.write.parquet(f"{folder}/embeddings.parquet")


def test_memory_delete_knows_no_highest_number(spark, tmp_path):
    embeddings(spark, tmp_path, spark.range(99_990, 100_030))
    assert same_as_sql(spark, tmp_path, "memory_delete")


@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
def test_the_same_tokens_score_the_same_in_any_order(spark, ids):
    """Sums of these weights differ in their last bit with their order."""
    found = [(t, d) for d, order in zip(ids, (("aa", "bb", "cc"), ("cc", "bb", "aa")), strict=True) for t in order]
    post = spark.createDataFrame(found, "token string, doc int").coalesce(1)
    scores = search.lexical_scores(post, 7, "aa bb bb cc cc cc")
    assert len({r.score for r in scores.collect()}) == 1
    assert [r.doc for r in search.ranked(scores, F.desc("score"), F.col("doc"), top_k=2).collect()] == [1, 2]


@pytest.mark.parametrize("name", ["code_imports", "tool_dependency_loops"])
@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 4], [0, 1, 2], [3, 1], [2, 7]])
def test_a_table_may_end_within_a_block_of_four(spark, tmp_path, name, ids):
    rows = [(i, f"text {i}", "en", "web") for i in ids]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    if name == "tool_dependency_loops" and ids == [2, 7]:
        assert own.QUERIES[name](spark, str(tmp_path)).count() == 0
    else:
        assert same_as_sql(spark, tmp_path, name)


def test_an_index_leaves_no_better_document_out(spark):
    """The best one by both scores isn't among the nearest by the vector alone."""
    class Index:
        def search(self, query, top_k):
            return docs.where("path like 'near%'").select(F.col("path").alias("key"))

    rows = [(f"near{k}", "", [], "nothing", [1.0, 0.01 * k]) for k in range(3)] + [("word", "", [], "red apple", [1.0, 0.2]), ("far", "", [], "red apple", [-1.0, 0.0]), ("none", "", [], "red apple", None)]
    docs = spark.createDataFrame(rows, "path string, header string, symbols array<string>, content string, vec array<double>")
    for k in (1, 2, 3, 5):
        exact, found = ([tuple(r) for r in search.hybrid_search(docs, "red apple", [1.0, 0.0], index=x, top_k=k).select("path", "combined").collect()] for x in (None, Index()))
        assert found == exact and exact[0][0] == "word"


def test_a_code_search_reads_whole_texts(spark, tmp_path):
    rows = [(i, "x " * 3000 + ("The trash Released the end" if i == 3 else "end"), "en", "web") for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    embeddings(spark, tmp_path, spark.range(12))
    found = own.QUERIES["tool_semantic_code_search"](spark, str(tmp_path)).collect()
    assert next(r.keyword for r in found if r.path == "web/en/3.md") == 0.8
    assert same_as_sql(spark, tmp_path, "tool_semantic_code_search")


def test_code_is_searched_beyond_its_beginning(spark):
    content = spark.createDataFrame([("a.py", "#" * 600 + " pelican")], "path string, content string")
    symbols = spark.createDataFrame([], "path string, name string, kind string, line int, end_line int, signature string, parent_name string")
    assert files.search_documents(content, symbols).first().content.endswith("pelican")


def test_no_task_holds_a_group_s_whole_matrix(spark, tmp_path):
    embeddings(spark, tmp_path, spark.range(600))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = [r.n for r in own.QUERIES["affinities"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(shares) == 600 * 600 and len(shares) > 1


def test_matrices_by_blocks_are_the_whole_ones(spark):
    v = np.random.default_rng(1).normal(size=(23, 5)).round(3)
    v[7] = 0
    links = [(0, 3), (3, 0), (4, 4), (5, 99), (20, 1), (20, 2)]
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key int, vec array<double>")
    found = clustering.matrices(items, spark.createDataFrame(links, "src int, dst int"), block=4).collect()
    mixed = clustering.blended(v, [(a, b) for a, b in links if b < 23])
    assert len({(r.a, r.b) for r in found}) == len(found) == 23 * 23
    for name, whole in (("affinity", clustering.affinity(v)), ("blended", mixed), ("laplacian", clustering.laplacian(mixed))):
        out = np.zeros((23, 23))
        for r in found:
            out[r.a, r.b] = r[name]
        assert np.allclose(out, whole, atol=1e-12)


def notes_of(spark, folder, n, of):
    """n vectors of which each is one of a few, events from the first number on, and one document."""
    e = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.sin((F.col("id") % of) * 7 + k * k) + 0.9).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    e.write.parquet(f"{folder}/embeddings.parquet")
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_millis(NOW - F.col("id") * 3_600_000).alias("ts")).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(1, "text", "en", "web")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")


def written(spark):
    """Bytes of all shuffles and checkpoints so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    folder = session.shared_folder(spark).removeprefix("file:")
    files = [os.path.join(d, x) for d, _, names in os.walk(folder) for x in names]
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) + sum(os.path.getsize(x) for x in files)


GRAPH_QUERIES = ["mem_search", "mem_traverse", "tool_create_relation", "memory_neighbours"]


@pytest.mark.parametrize("name", GRAPH_QUERIES)
def test_near_pairs_are_not_stored(spark, tmp_path, name):
    """867,600 pairs are near."""
    notes_of(spark, tmp_path, 1500, 1500)
    before = written(spark)
    assert own.QUERIES[name](spark, str(tmp_path)).groupBy().count().first()[0] > 0
    assert written(spark) - before < 6_000_000


@pytest.mark.parametrize("name", GRAPH_QUERIES)
def test_graphs_of_copies_equal_their_sql(spark, tmp_path, name):
    notes_of(spark, tmp_path, 120, 9)
    assert same_as_sql(spark, tmp_path, name)


def test_a_traversal_may_have_no_cap(spark):
    nodes = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("note").alias("node_type"), F.lit("l").alias("label"), F.lit(False).alias("needs_rebuild"))
    edges = spark.range(1, 300).select(F.col("id").cast("string").alias("id"), F.lit("0").alias("source"), F.col("id").cast("string").alias("target"), F.lit("r").alias("relation"), F.lit(1.0).alias("weight"), F.lit(0).alias("created_at"))
    found = memory.traverse(nodes, edges, "0", 0, max_nodes=None).collect()
    assert len(found) == 300 and not found[0].truncated and memory.traverse(nodes, edges, "0", 0).count() == 200


def test_only_links_of_the_new_nodes_are_asked_for(spark):
    edges = spark.createDataFrame([("ab", "a", "b", "r", 0.5, 0, {}), ("bc", "b", "c", "r", 0.5, 0, {}), ("cd", "c", "d", "r", 0.5, 0, {})], memory.EDGES)
    nodes = spark.createDataFrame([(x, "note", x, "", [1.0], 0, 0, 1, {}, [], False) for x in "abcd"], memory.NODES)
    asked = []

    def at(ids):
        asked.append(sorted(r.node for r in ids.select("node").collect()))
        return memory.both_ends(edges).join(ids.select("node"), "node", "left_semi")

    def whole():
        raise AssertionError("all edges were listed")

    links = memory.Links(whole, at)
    found = memory.traverse(nodes, links, "a", 0).collect()
    assert [(r.id, r.depth) for r in found] == [("a", 0), ("b", 1), ("c", 2)] and asked == [["a"], ["b"]]
    new = spark.createDataFrame([("a", "b", "r", 0.9, {"k": "v"}), ("d", "a", "r", None, {})], "source string, target string, relation string, weight double, metadata map<string,string>")
    after = memory.relate(links, nodes, new, 7)
    assert sorted((r.other, round(r.weight, 1), r.created_at) for r in after.at(spark.createDataFrame([("a",)], "node string")).collect()) == [("b", 0.9, 0), ("d", 1.0, 7)]


def test_blocks_of_vectors_give_all_near_pairs(spark):
    v = np.random.default_rng(2).normal(size=(90, 6)).astype(np.float32)
    store = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, [1.0, 2.0])], "key int, vec array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = {(i, j) for i in range(90) for j in range(90) if u[i] @ u[j] >= 0.2}
    assert sorted((r.a, r.b) for r in vectors.near_pairs(store, 0.2, block=7).collect()) == sorted((i, j) for i, j in near if i < j)
    left = store.where("key < 11 or key = 90")
    assert sorted((r.a, r.b) for r in vectors.near_between(left, store, 0.2, block=7).collect()) == sorted([(i, j) for i, j in near if i < 11] + [(90, 90)])
