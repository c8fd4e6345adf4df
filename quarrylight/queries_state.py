"""Queries over state: caches, refs, merges, streams, indexes, and the parts of search and clustering that have none of their own elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import clustering, graph, labels, memory, search
from quarrylight.operators import vectors as vector_ops
from quarrylight.plans import incremental
from quarrylight.queries import ID_QUERY, NOW, REFS, SQL_DECAY, SQL_EDGES, SQL_IDENTIFIERS, SQL_LINES, SQL_Q, SQL_REFS, SQL_WORDS, VECTOR_ID, cos, identifiers, line_rows, memory_graph, paths, query, query_vector, r6, table, tok
from quarrylight.session import checkpoint, ship
from quarrylight.sources import embedding, git

# -- search


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vec"))


SQL_VECTORS = "ev AS (SELECT CAST(vec_id AS VARCHAR) AS path, embedding AS vec FROM embeddings)"
SQL_ID_TOKENS = tok("' ' || name || ' type '")


@query(f"""WITH {SQL_Q}, {SQL_VECTORS}, i AS ({SQL_IDENTIFIERS}), s AS (SELECT id, CASE WHEN vec IS NULL THEN 0 ELSE {cos('vec', 'qv')} END AS semantic, len(list_intersect({tok("'" + ID_QUERY + "'")}, {SQL_ID_TOKENS})) / 3.0 AS keyword FROM i LEFT JOIN ev USING (path), q)
SELECT id, round(semantic, 6) AS semantic, round(least(1.0, 0.78 * greatest(semantic, 0) + 0.22 * keyword), 6) AS score FROM s ORDER BY 0.78 * greatest(semantic, 0) + 0.22 * keyword DESC, id LIMIT 50""")
def identifier_search(spark, sf):
    """Identifiers left-joined with their vectors, the document's of their number where there is one."""
    rows = identifiers(spark, sf).withColumn("token_set", F.array_distinct(T.tokens(T.identifier_text("name", "kind", F.lit(None), F.lit(None), F.lit(None), F.lit(None)))))
    found = search.identifier_scores(rows.join(document_vectors(spark, sf), "path", "left"), ID_QUERY, query_vector(spark, sf), top_k=50)
    return found.select("id", r6(F.col("semantic"), "semantic"), r6(F.col("score"), "score"))


@query(f"WITH i AS ({SQL_IDENTIFIERS}) SELECT id, round(0.22 * len(list_intersect({tok(chr(39) + ID_QUERY + chr(39))}, {SQL_ID_TOKENS})) / 3.0, 6) AS score FROM i WHERE line % 2 = 0 ORDER BY score DESC, id LIMIT 20")
def identifier_kinds(spark, sf):
    """Only the kinds asked for, in any case, take part; without vectors the words decide."""
    rows = identifiers(spark, sf).withColumn("kind", F.when(F.col("line") % 2 == 0, "Type").otherwise("Other"))
    rows = rows.withColumn("token_set", F.array_distinct(T.tokens(F.concat_ws(" ", "name", F.lit("type")))))
    return search.identifier_scores(rows, ID_QUERY, None, kinds=[" tYPE "], top_k=20).select("id", r6(F.col("score"), "score"))


SQL_USES = f"""l AS ({SQL_LINES}), i AS ({SQL_IDENTIFIERS}), w AS ({SQL_WORDS}),
u AS (SELECT i.id, w.path, w.line, len(list_intersect({tok("'license version'")}, {tok("l.path || ' ' || l.text")})) / 2.0 AS keyword FROM i JOIN w ON w.token = i.name JOIN l ON l.path = w.path AND l.line = w.line WHERE NOT (w.path = i.path AND w.line = i.line)),
first AS (SELECT *, count(*) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY keyword DESC, path, line) AS k FROM u)"""


@query(f"""WITH {SQL_Q}, {SQL_VECTORS}, {SQL_USES}, s AS (SELECT id, path, line, total, least(1.0, 0.82 * greatest(CASE WHEN vec IS NULL THEN 0 ELSE {cos('vec', 'qv')} END, 0) + 0.18 * keyword) AS score FROM first LEFT JOIN ev USING (path), q WHERE k <= 30)
SELECT id, CAST(rank AS INTEGER) AS rank, path, line, round(score, 6) AS score, total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, path, line) AS rank FROM s) WHERE rank <= 3""")
def call_sites_topn(spark, sf):
    """Two stages: thirty uses of an identifier by words, and the three best of them by the blend with their vectors."""
    vectors = line_rows(spark, sf).select("path", "line").join(document_vectors(spark, sf), "path")
    found = search.call_sites(line_rows(spark, sf), identifiers(spark, sf), "license version", limit=3, words=F.regexp_extract_all("text", F.lit("[A-Za-z_0-9]+"), F.lit(0)), vector=query_vector(spark, sf), line_vectors=vectors)
    return found.select("id", "rank", "path", "line", r6(F.col("score"), "score"), "total")


@query(f"SELECT vec_id, round({cos('embedding', 'qv')}, 6) AS similarity FROM embeddings, (SELECT embedding AS qv FROM embeddings WHERE vec_id = {VECTOR_ID}) ORDER BY {cos('embedding', 'qv')} DESC, vec_id LIMIT 10")
def nearest_of_mixed_dims(spark, sf):
    """Vectors of other dimensions are in the store, and don't take part."""
    odd = spark.createDataFrame([(-1, [1.0] * 7), (-2, []), (-3, [2.0] * 65)], "vec_id bigint, embedding array<float>")
    store = table(spark, sf, "embeddings").select("vec_id", "embedding").unionByName(odd)
    return vector_ops.nearest(store, query_vector(spark, sf), 10, key="vec_id", vec="embedding").select(F.col("key").alias("vec_id"), r6(F.col("similarity"), "similarity"))


RECALL_QUERIES = 20


@query(f"""WITH n AS (SELECT a.vec_id AS q, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS r FROM (SELECT * FROM embeddings WHERE vec_id < {RECALL_QUERIES}) a, embeddings b)
SELECT count(*) AS asked, TRUE AS at_least_nine_tenths FROM n WHERE r <= 10""")
def index_recall(spark, sf):
    """The index's ten nearest of twenty vectors against the exact ones, by default probes."""
    ship(spark)
    store = table(spark, sf, "embeddings")
    index = vector_ops.CentroidIndex(store, key="vec_id", vec="embedding")
    met = asked = 0
    for r in store.where(F.col("vec_id") < RECALL_QUERIES).select("vec_id", "embedding").collect():
        exact = {x.key for x in vector_ops.nearest(store, list(r.embedding), 10, key="vec_id", vec="embedding").collect()}
        met += len(exact & {x.key for x in index.search(list(r.embedding), 10).collect()})
        asked += len(exact)
    return spark.createDataFrame([(asked, met >= 0.9 * asked)], "asked bigint, at_least_nine_tenths boolean")


# -- graphs

SQL_IMPORTS = "g AS (SELECT doc_id AS i, doc_id // 2 AS j FROM documents WHERE doc_id > 0 UNION SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id > 0)"


def halving_imports(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf, "documents").where(i > 0).select(i.cast("string").alias("src"), F.explode(F.array(F.floor(i / 2).cast("string"), F.floor(i / 3).cast("string"))).alias("dst"))
    return d.distinct()


@query(f"WITH RECURSIVE {SQL_IMPORTS}, r AS (SELECT CAST(5 AS BIGINT) AS n, 0 AS hop UNION SELECT i, hop + 1 FROM r JOIN g ON j = n WHERE hop < 3) SELECT CAST(n AS VARCHAR) AS path, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY n HAVING min(hop) > 0")
def dependents(spark, sf):
    """Files that import one, along reversed edges."""
    return graph.dependents(halving_imports(spark, sf), spark.createDataFrame([("5",)], "path string"), max_hops=3, max_files=None)


@query(f"WITH RECURSIVE {SQL_IMPORTS}, r AS (SELECT CAST(5 AS BIGINT) AS n, 0 AS hop UNION SELECT i, hop + 1 FROM r JOIN g ON j = n WHERE hop < 3) SELECT * FROM (SELECT CAST(n AS VARCHAR) AS path, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY n HAVING min(hop) > 0) ORDER BY hop, path LIMIT 7")
def dependents_capped(spark, sf):
    return graph.dependents(halving_imports(spark, sf), spark.createDataFrame([("5",)], "path string"), max_hops=3, max_files=7)


@query(f"WITH RECURSIVE {SQL_IMPORTS}, r AS (SELECT CAST(0 AS BIGINT) AS n, 0 AS hop UNION SELECT i, hop + 1 FROM r JOIN g ON j = n WHERE hop < 2) SELECT * FROM (SELECT CAST(n AS VARCHAR) AS node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY n) ORDER BY hop, node LIMIT 9")
def search_capped(spark, sf):
    g = halving_imports(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.bounded_bfs(g, spark.createDataFrame([("0",)], "node string"), max_hops=2, max_nodes=9)


@query("""WITH RECURSIVE g AS (SELECT doc_id AS sha, doc_id // 2 AS parent FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id > 0 AND doc_id % 5 = 0), r AS (SELECT max(doc_id) AS sha, 0 AS hop FROM documents UNION SELECT parent, hop + 1 FROM r JOIN g USING (sha))
SELECT CAST(sha AS VARCHAR) AS sha, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY sha""")
def commit_ancestors(spark, sf):
    """Commits of one parent, and every fifth of two."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    parents = F.when(i % 5 == 0, F.array(F.floor(i / 2).cast("string"), F.floor(i / 3).cast("string"))).otherwise(F.array(F.floor(i / 2).cast("string")))
    history = d.where(i > 0).select(i.cast("string").alias("sha"), F.explode(parents).alias("parent"))
    return git.ancestors(history, d.agg(F.max(i).cast("string").alias("sha")))


# -- memory graph

def note_nodes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").select(i.cast("string").alias("id"), F.lit("note").alias("node_type"), F.concat(F.lit("n"), i.cast("string")).alias("label"), F.col("label").cast("string").alias("content"), "embedding", F.lit(0).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("last_accessed"), (i % 3).cast("int").alias("access_count"), F.create_map().cast("map<string,string>").alias("metadata"), F.array(F.concat(F.lit("h"), (i % 10).cast("string"))).alias("references_chunk_hashes"), (i % 13 == 0).alias("needs_rebuild"))


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """Each note linked to the next, and to the one of half its number."""
    i = F.col("vec_id")
    e = table(spark, sf, "embeddings").select("vec_id")
    links = e.select(i.cast("string").alias("source"), (i + 1).cast("string").alias("target"), F.lit("next").alias("relation"), (0.5 + i % 2 / 4).alias("weight")).unionByName(e.where("vec_id > 1").select(i.cast("string"), F.floor(i / 2).cast("string"), F.lit("half"), F.lit(0.9)).toDF("source", "target", "relation", "weight"))
    return links.select(F.concat_ws("-", "source", "relation").alias("id"), "source", "target", "relation", F.col("weight").cast("float").alias("weight"), F.lit(NOW).cast("bigint").alias("created_at"), F.create_map().cast("map<string,string>").alias("metadata"))


SQL_RING = "ring AS (SELECT vec_id AS a, vec_id + 1 AS b, 'next' AS rel, 0.5 + (vec_id % 2) / 4.0 AS w FROM embeddings UNION ALL SELECT vec_id, vec_id // 2, 'half', CAST(CAST(0.9 AS FLOAT) AS DOUBLE) FROM embeddings WHERE vec_id > 1)"


@query(f"WITH {SQL_RING} SELECT a || '-' || rel AS id FROM ring WHERE b IN (SELECT vec_id FROM embeddings)")
def edges_with_both_ends(spark, sf):
    """The last link leads nowhere, and is left out."""
    nodes = note_nodes(spark, sf)
    none = spark.createDataFrame([], memory.EDGES)
    related = memory.relate(none, nodes, ring(spark, sf).select("source", "target", "relation", "weight", "metadata"), NOW)
    return related.select(F.concat_ws("-", "source", "relation").alias("id"))


@query(f"""WITH {SQL_RING}, both_ways AS (SELECT a AS n, b AS o, rel, w, a || '-' || rel AS id FROM ring UNION ALL SELECT b, a, rel, w, a || '-' || rel FROM ring), ok AS (SELECT vec_id FROM embeddings WHERE vec_id % 13 <> 0),
d1 AS (SELECT o, arg_min({{'n': n, 'rel': rel, 'w': w}}, {{'d': -w, 'id': id}}) AS x FROM both_ways WHERE n = {VECTOR_ID} AND o IN (SELECT vec_id FROM ok) AND o <> {VECTOR_ID} GROUP BY o),
p1 AS (SELECT o, 'n{VECTOR_ID} --[' || x.rel || ']--> n' || o AS path, x.w AS w FROM d1),
d2 AS (SELECT e.o, arg_min({{'path': p1.path, 'rel': e.rel, 'w': e.w}}, {{'d': -e.w, 'id': e.id}}) AS x FROM both_ways e JOIN p1 ON p1.o = e.n WHERE e.o IN (SELECT vec_id FROM ok) AND e.o <> {VECTOR_ID} AND e.o NOT IN (SELECT o FROM p1) GROUP BY e.o)
SELECT CAST(o AS VARCHAR) AS id, 1 AS depth, path, round(w / 1.3 * 100, 1) AS score FROM p1 UNION ALL SELECT CAST(o AS VARCHAR), 2, x.path || ' --[' || x.rel || ']--> n' || o, round(x.w / 1.6 * 100, 1) FROM d2 UNION ALL SELECT '{VECTOR_ID}', 0, 'n{VECTOR_ID}', 100.0""")
def memory_paths(spark, sf):
    """How each note is reached, past those that wait for a rebuild."""
    return memory.traverse(note_nodes(spark, sf), ring(spark, sf), str(VECTOR_ID), NOW, max_nodes=1000).select("id", "depth", "path", "score")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 5 = 0 THEN {NOW} ELSE 0 END AS last_accessed FROM embeddings")
def memory_touch(spark, sf):
    nodes = note_nodes(spark, sf)
    return memory.touch(nodes, nodes.where("cast(id as bigint) % 5 = 0").select("id"), NOW).select("id", "last_accessed")


@query(f"WITH {SQL_RING} SELECT 'edge' AS what, a || '-' || rel AS id FROM ring WHERE a % 6 <> 0 AND b % 6 <> 0 UNION ALL SELECT 'node', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 6 <> 0")
def memory_delete(spark, sf):
    """With the last link's missing end, which isn't among the deleted where its number isn't."""
    nodes, edges = note_nodes(spark, sf), ring(spark, sf)
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    gone = nodes.select("id").unionByName(ends).where("cast(id as bigint) % 6 = 0")
    left, kept = memory.delete_nodes(nodes, edges, gone)
    return kept.select(F.lit("edge").alias("what"), "id").unionByName(left.select(F.lit("node").alias("what"), "id"))


@query(f"WITH {SQL_RING} SELECT CAST(a AS VARCHAR) AS node, CAST(b AS VARCHAR) AS other, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY CAST(w AS FLOAT) DESC, CAST(b AS VARCHAR)) AS k FROM (SELECT a, b, w FROM ring UNION ALL SELECT b, a, w FROM ring)) WHERE k <= 2")
def strongest_links(spark, sf):
    return memory.top_per_node(ring(spark, sf), 2, NOW).select("node", "other", "rank")


@query(f"""WITH {SQL_RING}, o AS (SELECT vec_id AS i, CASE WHEN vec_id % 4 = 0 THEN 'clean' WHEN vec_id % 4 = 1 THEN 'conflict' ELSE 'identical' END AS class FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 4 = 1),
n AS (SELECT vec_id, vec_id % 13 = 0 OR coalesce(class = 'conflict', FALSE) AS flag, CAST(CASE WHEN class = 'identical' THEN greatest(vec_id % 3, 9) WHEN class = 'clean' THEN 9 ELSE vec_id % 3 END AS INTEGER) AS hits, CASE WHEN class = 'identical' THEN 'h' || vec_id % 10 || ' own' WHEN class = 'clean' THEN 'own' ELSE 'h' || vec_id % 10 END AS refs FROM embeddings LEFT JOIN o ON i = vec_id)
SELECT CAST(vec_id AS VARCHAR) AS id, flag, hits, refs, (SELECT count(*) FROM ring WHERE a = vec_id AND (b IN (SELECT vec_id FROM embeddings)) AND a % 2 = 0) AS links FROM n""")
def memory_merge(spark, sf):
    """Each rung: clean nodes are added, conflicting ones flagged, identical ones joined; edges of the overlay need both ends."""
    i = F.col("id").cast("bigint")
    every = note_nodes(spark, sf)
    primary = every.where(i % 4 != 0)
    overlay = every.where((i % 2 == 0) | (i % 4 == 1)).withColumns({"content": F.when(i % 4 == 1, "changed").otherwise(F.col("content")), "access_count": F.lit(9), "references_chunk_hashes": F.array(F.lit("own"))})
    edges = ring(spark, sf)
    ends = every.select("id")
    whole = edges.join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    none = whole.where("cast(source as bigint) % 2 = 0").limit(0).select(*edges.columns)
    nodes, links = memory.merge(overlay, edges.where("cast(source as bigint) % 2 = 0"), primary, none)
    counted = links.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links"))
    return nodes.join(counted, "id", "left").select("id", F.col("needs_rebuild").alias("flag"), F.col("access_count").alias("hits"), F.array_join("references_chunk_hashes", " ").alias("refs"), F.coalesce("links", F.lit(0)).alias("links"))


@query(f"WITH {SQL_RING}, gone AS (SELECT vec_id FROM embeddings WHERE vec_id % 13 = 0 AND vec_id % 26 <> 0) SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 26 = 0 THEN 'again' ELSE CAST(label AS VARCHAR) END AS content, FALSE AS needs_rebuild, (SELECT count(*) FROM ring WHERE a = e.vec_id AND b NOT IN (SELECT vec_id FROM gone)) AS links FROM embeddings e WHERE vec_id NOT IN (SELECT vec_id FROM gone)")
def memory_rebuild(spark, sf):
    """Flagged notes are embedded anew where their content is there, and else go with their links."""
    nodes = note_nodes(spark, sf)
    fresh = nodes.where("cast(id as bigint) % 26 = 0").select("id", F.lit("again").alias("content"), "embedding")
    after, edges = memory.rebuilt(nodes, ring(spark, sf), fresh)
    counted = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links"))
    return after.join(counted, "id", "left").select("id", "content", "needs_rebuild", F.coalesce("links", F.lit(0)).alias("links"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 4 = 0 THEN 'overlay' ELSE CAST(label AS VARCHAR) END AS content FROM embeddings")
def memory_read_through(spark, sf):
    nodes = note_nodes(spark, sf)
    return memory.read_through(nodes.where("cast(id as bigint) % 4 = 0").withColumn("content", F.lit("overlay")), nodes).select("id", "content")


@query(f"WITH {SQL_RING} SELECT 'edge' AS what, rel AS name, count(*) AS n FROM ring WHERE b IN (SELECT vec_id FROM embeddings) GROUP BY rel UNION ALL SELECT 'node', 'note', count(*) FROM embeddings")
def memory_files(spark, sf):
    """Written as JSON and read again; the link without an end is left out."""
    folder = f"{shared(spark)}/memory-{uuid.uuid4().hex}"
    memory.write_graph(note_nodes(spark, sf), ring(spark, sf), folder)
    return memory.stats(*memory.read_graph(spark, folder))


def shared(spark: SparkSession) -> str:
    checkpoint(spark.range(1), eager=False)  # names the shared folder where it is unset
    return spark.sparkContext.getCheckpointDir()


@query(f"WITH e AS ({SQL_EDGES}) SELECT CAST(b AS VARCHAR) AS id, round({SQL_DECAY}, 6) AS decayed FROM e WHERE a = {VECTOR_ID} UNION ALL SELECT CAST(a AS VARCHAR), round({SQL_DECAY}, 6) FROM e WHERE b = {VECTOR_ID}")
def memory_neighbours(spark, sf):
    """Both directions of a note's links."""
    from quarrylight.functions import scoring as S

    found = memory_graph(spark, sf)[1].at(spark.range(1).select(F.lit(str(VECTOR_ID)).alias("node")))
    return found.select(F.col("other").alias("id"), r6(S.decay(F.col("weight"), F.col("created_at"), NOW), "decayed"))


# -- caches, refs, blobs

@query("SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || text), 1, 15) AS BIGINT)) AS digest FROM documents")
def fingerprint(spark, sf):
    """Whatever the order and the partitions."""
    return incremental.fingerprint(table(spark, sf, "documents").repartition(5), "doc_id", "text")


@query("""WITH f AS (SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 50 <> 0) AS old, bit_xor(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || text), 1, 15) AS BIGINT)) AS d, bit_xor(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || text), 1, 15) AS BIGINT)) FILTER (doc_id % 50 <> 0) AS od FROM documents GROUP BY lang)
SELECT lang, CASE WHEN lang = 'en' OR (n = old AND d = od) THEN 'same' WHEN n - old <= least(round_even(0.05 * old, 0), 200) THEN 'stale' ELSE 'rebuild' END AS action FROM f""")
def index_validity(spark, sf):
    """What an index of each language does after new documents; one of an equal generation isn't looked at."""
    d = table(spark, sf, "documents")
    out = []
    for r in d.select("lang").distinct().orderBy("lang").collect():
        own = d.where(F.col("lang").eqNullSafe(r.lang))
        new, old = (incremental.fingerprint(x, "doc_id", "text").first() for x in (own, own.where("doc_id % 50 <> 0")))
        out.append((r.lang, incremental.index_action({"generation": 1, "n": old.n, "digest": old.digest}, {"generation": 1 if r.lang == "en" else 2, "n": new.n, "digest": new.digest})))
    return spark.createDataFrame(out, "lang string, action string")


@query(f"WITH RECURSIVE {SQL_REFS}, c AS (SELECT ref, ref AS ancestor, 0 AS depth FROM refs UNION ALL SELECT c.ref, refs.parent, depth + 1 FROM c JOIN refs ON refs.ref = c.ancestor WHERE refs.parent IS NOT NULL) SELECT ref, ancestor, CAST(depth AS INTEGER) AS depth FROM c UNION ALL SELECT 'leaf', ancestor, CAST(depth + 1 AS INTEGER) FROM c WHERE ref = 'feature' UNION ALL SELECT 'leaf', 'leaf', 0")
def ref_chains(spark, sf):
    """A fork of a fork sees its whole chain."""
    return incremental.chains(incremental.fork(spark.createDataFrame(REFS, "ref string, parent string"), "leaf", "feature"))


def chunk_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(refs, manifests, blobs, chunks): dev inherits main's chunks; every seventh text has changed, every eleventh is new."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk"), F.sha2("text", 256).alias("hash"), "doc_id")
    stored = d.where("doc_id % 11 <> 0")
    manifests = stored.select(F.lit("main").alias("ref"), "path", "chunk_idx", "hash")
    blobs = stored.select("hash").distinct().select("hash", F.array(F.lit(1.0).cast("float")).alias("vec"))
    now = d.withColumn("chunk", F.when(F.col("doc_id") % 7 == 0, F.concat("chunk", F.lit("!"))).otherwise(F.col("chunk"))).withColumn("hash", F.sha2("chunk", 256))
    return spark.createDataFrame([("main", None), ("dev", "main")], "ref string, parent string"), manifests, blobs, now.select("path", "chunk_idx", "chunk", "hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS hit FROM documents")
def chunk_changes(spark, sf):
    refs, manifests, _, chunks = chunk_state(spark, sf)
    return incremental.changes(refs, manifests, chunks, "dev").select("path", "hit")


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS now FROM documents), s AS (SELECT DISTINCT sha256(text) AS h FROM d WHERE doc_id % 11 <> 0)
SELECT 'manifest' AS what, CAST(doc_id AS VARCHAR) AS key, sha256(now) AS hash FROM d WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 UNION ALL SELECT 'blob', '', h FROM (SELECT h FROM s UNION SELECT sha256(now) FROM d WHERE doc_id % 11 = 0 OR doc_id % 7 = 0)""")
def indexed_changes(spark, sf):
    """Only what changed enters the ref's manifest, and only texts without a blob are embedded."""
    manifests, blobs = incremental.indexed(*chunk_state(spark, sf)[:3], chunk_state(spark, sf)[3], "dev", embedding.HashingEmbedder(4))
    return manifests.where("ref = 'dev'").select(F.lit("manifest").alias("what"), F.col("path").alias("key"), "hash").unionByName(blobs.select(F.lit("blob").alias("what"), F.lit("").alias("key"), "hash"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash, 1 AS dims FROM documents WHERE doc_id % 11 <> 0")
def fetched_vectors(spark, sf):
    refs, manifests, blobs, _ = chunk_state(spark, sf)
    found = incremental.lookup(refs, manifests).where("ref = 'dev'")
    return incremental.vectors_of(found, blobs).select("path", "hash", F.size("vec").alias("dims"))


@query("SELECT 'a/' || lang || '/' || vec_id || '.ts' AS key FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 9 <> 0 AND vec_id % 8 <> 0 AND vec_id % 7 <> 0")
def swept_cache(spark, sf):
    """Vectors of ignored paths, and of other dimensions, go."""
    i = F.col("vec_id")
    rows = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"))
    folder = F.when(i % 9 == 0, "a/node_modules/").when(i % 8 == 0, "a/.hidden/").otherwise("a/")
    vec = F.when(i % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return incremental.swept(rows.select(F.concat(folder, "lang", F.lit("/"), i.cast("string"), F.lit(".ts")).alias("key"), vec.alias("vec")), 64).select("key")


@query("WITH k AS (SELECT 'q' || user_id AS key, max(epoch_us(ts) // 1000) AS used FROM events GROUP BY 1) SELECT key, used FROM k ORDER BY used DESC, key LIMIT 40")
def newest_queries(spark, sf):
    """The query vectors that were used last stay."""
    rows = table(spark, sf, "events").groupBy(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("key")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("used"))
    return incremental.newest(rows, 40, order="used", key="key")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN 'model' WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS label, CASE WHEN doc_id % 3 = 0 THEN 'llm' ELSE 'heuristic' END AS quality FROM documents")
def label_cache(spark, sf):
    """Labels in the old form and the new one; a model's label isn't overwritten by a derived one."""
    i = F.col("doc_id")
    value = F.when(i % 3 == 0, F.lit('{"label":"model","quality":"llm"}')).otherwise(F.col("lang"))
    raw = table(spark, sf, "documents").select(F.to_json(F.map_from_arrays(F.array(i.cast("string")), F.array(value))).alias("json"))
    new = table(spark, sf, "documents").where(i % 2 == 0).select(i.cast("string").alias("key"), F.lit("new").alias("label"), F.lit("heuristic").alias("quality"))
    return labels.merged_label_cache(labels.read_label_cache(raw), new)


class Shouting:
    """A labeler for tests: what it is told, in capitals; nothing for one that begins with a vowel."""

    def label(self, descriptions: list[str]) -> list[str | None]:
        return [None if x[:1] in "aeiou" else x.upper() for x in descriptions]


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 5 = 0 THEN 'kept' WHEN substr(lang, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'derived' ELSE upper(lang) END AS label FROM documents")
def healed_labels(spark, sf):
    """A labeler is asked, in batches, for what has no label of its own; where it has no answer the derived one stays."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    cache = d.select(i.cast("string").alias("key"), F.when(i % 5 == 0, "kept").otherwise("derived").alias("label"), F.when(i % 5 == 0, "llm").otherwise("heuristic").alias("quality"))
    return labels.healed(cache, d.select(i.cast("string").alias("key"), F.col("lang").alias("description")), Shouting()).select("key", "label")


@query("""WITH RECURSIVE c AS (SELECT doc_id, 0 AS idx, CAST('' AS VARCHAR) AS chunk, text AS rest FROM documents UNION ALL
SELECT doc_id, idx + 1, substr(rest, 1, k), substr(rest, k + 1) FROM (SELECT doc_id, idx, rest, CAST(list_max(list_filter(range(greatest(0, 2 * length(substr(rest, 1, 2000)) - strlen(substr(rest, 1, 2000)) - 1), 2001), lambda k: strlen(substr(rest, 1, CAST(k AS INTEGER))) <= 2000)) AS INTEGER) AS k FROM c WHERE rest <> ''))
SELECT doc_id AS key, CAST(idx - 1 AS INTEGER) AS chunk_idx, sha256(chunk) AS hash FROM c WHERE idx > 0""")
def chunk_split(spark, sf):
    """Chunks of at most so many bytes, cut between characters, and their hashes."""
    d = table(spark, sf, "documents").select("doc_id", "text").where("text <> ''")
    return embedding.chunks(d, key="doc_id", text="text").select("key", "chunk_idx", "hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, least(1, CASE WHEN text = '' THEN 0 ELSE 1 END) AS one FROM documents WHERE text <> ''")
def embedded_texts(spark, sf):
    """Chunked and merged by the bytes of their chunks: a vector a text, of unit length at most."""
    ship(spark)
    d = table(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    out = embedding.embedded_long(d, embedding.PatientEmbedder(embedding.HashingEmbedder(16)))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("key", F.when(length <= 1.000001, 1).otherwise(2).alias("one"))


# -- streams

@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN md5(text || '2') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 <> 0")
def change_stream(spark, sf):
    """Two batches of changes into the index: some files change, some go, and what comes again unchanged is nothing."""
    from quarrylight.streaming import increment

    i = F.col("doc_id")
    folder = f"{shared(spark)}/changes-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select(i.cast("string").alias("path"), F.lit(1).cast("bigint").alias("mtime"), F.length("text").cast("bigint").alias("size"), F.md5("text").alias("hash"), F.substring("text", 1, 200).alias("content"), F.lit(False).alias("deleted"), "doc_id", "text")
    put = lambda x: x.select("path", "mtime", "size", "hash", "content", "deleted").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run = lambda: increment.start(increment.effective(increment.change_stream(spark, f"{folder}/in")), increment.index_sink(spark, f"{folder}/cache", embedding.HashingEmbedder(4)), f"{folder}/state").awaitTermination()
    put(d)
    run()
    put(d.where(i % 3 == 0).withColumns({"mtime": F.lit(2).cast("bigint"), "hash": F.md5(F.concat("text", F.lit("2")))}).unionByName(d.where(i % 3 == 1)))
    put(d.where(i % 10 == 0).withColumns({"mtime": F.lit(3).cast("bigint"), "deleted": F.lit(True)}))
    run()
    return incremental.load_cache(spark, f"{folder}/cache").select("key", "hash")


@query("WITH RECURSIVE r AS (SELECT 90 AS sha UNION SELECT sha // 2 FROM r WHERE sha > 0) SELECT 'ref' || doc_id % 20 AS ref, CAST(doc_id AS VARCHAR) AS sha FROM documents WHERE doc_id < 20 AND doc_id IN (SELECT sha FROM r)")
def head_events(spark, sf):
    """Refs whose last commit the main line's head now holds; a commit follows the one of half its number."""
    from quarrylight.streaming import increment

    i = F.col("doc_id")
    d = table(spark, sf, "documents").where("doc_id < 100")
    history = checkpoint(d.select(i.cast("string").alias("sha"), F.when(i > 0, F.floor(i / 2)).cast("string").alias("parent")))
    folder = f"{shared(spark)}/heads-{uuid.uuid4().hex}"
    d.select(F.concat(F.lit("ref"), (i % 20).cast("string")).alias("ref"), i.cast("string").alias("sha"), F.lit("90").alias("head"), (-i).alias("at")).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ref string, sha string, head string, at bigint").parquet(f"{folder}/in")
    sink = increment.head_sink(lambda: history, lambda x, k: x.write.mode("overwrite").parquet(f"{folder}/out/{k}"))
    increment.start(stream, sink, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out/0").select("ref", "sha")


# -- clusters

SQL_MEMBERS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label = 0)"


@query(f"""WITH {SQL_MEMBERS}, w AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE greatest(0, {cos('a.e', 'b.e')}) END AS w FROM v a, v b),
j AS (SELECT *, 0.9 * w + CASE WHEN abs(a - b) = 10 THEN 0.1 ELSE 0 END AS m FROM w), d AS (SELECT a, sum(m) AS deg FROM j GROUP BY a)
SELECT CAST(j.a AS VARCHAR) AS a, CAST(j.b AS VARCHAR) AS b, round(w, 6) AS affinity, round(m, 6) AS blended, round(CASE WHEN j.a = j.b THEN 1 ELSE -m / sqrt(x.deg * y.deg) END, 6) AS laplacian FROM j JOIN d x ON x.a = j.a JOIN d y ON y.a = j.b""")
def affinities(spark, sf):
    """A group's matrices, entry by entry: affinity, with import links blended in, and the Laplacian of that."""
    ship(spark)
    rows = table(spark, sf, "embeddings").where("label = 0").select("vec_id", F.col("embedding").alias("vec"))
    links = rows.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 10).alias("dst"))
    out = clustering.matrices(rows, links, key="vec_id")
    return out.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), *(r6(F.col(c), c) for c in ("affinity", "blended", "laplacian")))


@query("""WITH p AS (SELECT doc_id, lang, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM p)
SELECT path FROM r WHERE n <= 40 OR i = CAST(ceil((i * 40 // n) * n / 40.0) AS BIGINT)""")
def even_sample(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"))
    return clustering.sampled(rows, "lang", 40).select("path")


@query("SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(1) ORDER BY CAST(doc_id AS VARCHAR))) AS key FROM documents GROUP BY source")
def cluster_keys(spark, sf):
    """With the separator replaced, as a zero byte can't be in the SQL's text."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.collect_list(F.col("doc_id").cast("string")).alias("paths"))
    return d.select("source", clustering.cluster_key("paths", "\x01").alias("key"))


@query("""WITH p AS (SELECT source || '/' || lang AS g, source || '/' || lang || '/b' || doc_id % 4 || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.test.ts' WHEN doc_id % 3 = 1 THEN '.sql' ELSE '.go' END AS path, doc_id FROM documents)
SELECT g AS "group", CASE WHEN count(DISTINCT doc_id % 4) = 1 THEN g || '/b' || min(doc_id % 4) ELSE g END || '/*' || CASE WHEN count(DISTINCT doc_id % 3) = 1 THEN CASE min(doc_id % 3) WHEN 0 THEN '.test.ts' WHEN 1 THEN '.sql' ELSE '.go' END ELSE '' END AS pattern FROM p GROUP BY g""")
def path_patterns(spark, sf):
    return labels.path_pattern(paths(spark, sf).select(F.concat_ws("/", "source", "lang").alias("group"), "path"), "group")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def latest_and_votes(spark, sf):
    found = labels.vote(table(spark, sf, "documents"), "source", "lang").select("source", "lang", "n")
    return incremental.latest_per_key(found.unionByName(found.withColumn("n", F.lit(0).cast("bigint"))), "source", "n")


@query("SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS so_far FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1)")
def events_per_day(spark, sf):
    """The windowed counts of a stream on a batch, and their running sum over the few days."""
    from quarrylight.streaming import increment

    rows = increment.windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("one", F.lit(1)), by="one", width="1 day")
    return rows.select(F.col("start").alias("day"), "n", F.sum("n").over(Window.orderBy("start")).alias("so_far"))
