"""A knowledge graph that decays: mem_nodes and mem_edges, with upserts, search, traversal, pruning and merges.

Nodes: id, node_type, label, content, embedding, created_at, last_accessed, access_count, metadata,
references_chunk_hashes, needs_rebuild. Edges: id, source, target, relation, weight, created_at, metadata. Times are
epoch milliseconds, and the present is always a parameter. Every operator returns new frames.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import scoring as S
from quarrylight.functions import vectors as V
from quarrylight.operators.vectors import near_between, near_pairs
from quarrylight.session import checkpoint

NODES = "id string, node_type string, label string, content string, embedding array<float>, created_at bigint, last_accessed bigint, access_count int, metadata map<string,string>, references_chunk_hashes array<string>, needs_rebuild boolean"
EDGES = "id string, source string, target string, relation string, weight float, created_at bigint, metadata map<string,string>"
LINK_AT, STALE_BELOW, ORPHAN_DAYS, MAX_NODES, EXISTING = 0.72, 0.15, 7, 200, 200
MOST_BROADCAST = 100_000


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def overlaid(old: Column, new: Column) -> Column:
    """Both maps, the new one's values first."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))), F.coalesce(F.map_entries(new), F.expr("cast(array() as array<struct<key:string,value:string>>)"))))


def upsert_nodes(nodes: DataFrame, items: DataFrame, now_ms: int) -> DataFrame:
    """nodes after items(node_type, label, content, embedding, metadata): equal (label, type) updates, else creates.

    Of items equal in both the one of the greatest content counts.
    """
    one = items.groupBy("node_type", "label").agg(F.max_by(F.struct("content", "embedding", "metadata"), F.struct("content", F.to_json("metadata"))).alias("i"))
    new = one.select("node_type", "label", "i.*").select(F.col("node_type").alias("t"), F.col("label").alias("l"), F.col("content").alias("c"), F.col("embedding").alias("e"), F.col("metadata").alias("m"))
    j = nodes.join(new, (F.col("label") == F.col("l")) & (F.col("node_type") == F.col("t")), "full")
    created, given = F.col("id").isNull(), F.col("l").isNotNull()
    return j.select(
        F.coalesce("id", F.sha2(F.concat_ws("\0", "t", "l"), 256)).alias("id"), F.coalesce("node_type", "t").alias("node_type"), F.coalesce("label", "l").alias("label"), F.when(given, F.col("c")).otherwise(F.col("content")).alias("content"), F.when(given, F.col("e")).otherwise(F.col("embedding")).alias("embedding"),
        F.coalesce("created_at", F.lit(now_ms)).alias("created_at"), F.when(given, F.lit(now_ms)).otherwise(F.col("last_accessed")).alias("last_accessed"), F.when(created, 1).when(given, F.col("access_count") + 1).otherwise(F.col("access_count")).alias("access_count"),
        F.when(given, overlaid(F.col("metadata"), F.col("m"))).otherwise(F.col("metadata")).alias("metadata"), F.coalesce("references_chunk_hashes", F.expr("cast(array() as array<string>)")).alias("references_chunk_hashes"), F.coalesce("needs_rebuild", F.lit(False)).alias("needs_rebuild"),
    )


class Links:
    """Edges that can be asked for those at given nodes alone, so that costly ones need not be listed, and are never stored.

    ``whole`` gives all edges, ``at`` those with an end among ids(node), as (node, other) with the edge's columns, once for each
    such end. A plain frame of edges is searched for them.
    """

    def __init__(self, whole: Callable[[], DataFrame], at: Callable[[DataFrame], DataFrame] | None = None):
        self._whole, self._at = whole, at

    @classmethod
    def of(cls, edges: DataFrame | Links) -> Links:
        return edges if isinstance(edges, Links) else cls(lambda: edges)

    @cached_property
    def whole(self) -> DataFrame:
        return self._whole()

    def at(self, ids: DataFrame) -> DataFrame:
        return self._at(ids) if self._at else both_ends(self.whole).join(ids.select("node"), "node", "left_semi")


def relate(edges: DataFrame | Links, nodes: DataFrame, items: DataFrame, now_ms: int) -> DataFrame | Links:
    """edges after items(source, target, relation, weight or null, metadata); items with a missing end are left out.

    The edges are passed through and not shuffled, unless there are more items than can be broadcast.
    """
    ids = nodes.select("id")
    new = items.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    new = small(checkpoint(new.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("relation").alias("r"), F.col("weight").cast("float").alias("w"), F.col("metadata").alias("m"))))
    links, equal = Links.of(edges), (F.col("source") == F.col("s")) & (F.col("target") == F.col("t")) & (F.col("relation") == F.col("r"))
    one = F.lit(1.0).cast("float")

    def updated(rows: DataFrame) -> DataFrame:
        j = rows.join(new, equal, "left").withColumns({"weight": F.coalesce("w", "weight", one).cast("float"), "metadata": F.when(F.col("s").isNotNull(), overlaid(F.col("metadata"), F.col("m"))).otherwise(F.col("metadata"))})
        return j.select(*rows.columns)

    if new.isEmpty():
        made = new
    else:
        there = links.at(new.select(F.col("s").alias("node"))).where("node = source").join(new, equal, "left_semi").select("source", "target", "relation")
        made = new.join(there.distinct(), equal, "left_anti")
    made = checkpoint(made.select(F.sha2(F.concat_ws("\0", "s", "t", "r"), 256).alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), F.col("r").alias("relation"), F.coalesce("w", one).alias("weight"), F.lit(now_ms).cast("bigint").alias("created_at"), overlaid(F.lit(None).cast("map<string,string>"), F.col("m")).alias("metadata")))
    after = Links(lambda: updated(links.whole).unionByName(made), lambda x: updated(links.at(x)).unionByName(Links.of(made).at(x)))
    return after if isinstance(edges, Links) else after.whole


def both_ends(edges: DataFrame) -> DataFrame:
    """(node, other) with the edge's columns, once from each end; the edges are read once."""
    ways = F.array(*(F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("source", "target"), ("target", "source"))))
    return edges.select("*", F.inline(ways)).select("node", "other", *edges.columns)


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions: (node, other, relation, weight, created_at, id)."""
    return both_ends(edges).select("node", "other", "relation", "weight", "created_at", "id")


def _expand(nodes: DataFrame, edges: DataFrame | Links, start: DataFrame, max_depth: int, relations: list[str] | None, now_ms: int) -> DataFrame:
    """(node, depth, path, weight, decayed) by least depth from start(node, path); ties take the strongest, then least edge.

    Only the edges at each depth's new nodes are asked for; each task first keeps the best one to a node.
    """
    links = Links.of(edges)
    usable = nodes.where(~F.coalesce("needs_rebuild", F.lit(False))).groupBy(F.col("id").alias("node")).agg(F.min("label").alias("label"))
    seen = checkpoint(start.select("node", F.lit(0).alias("depth"), "path", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("decayed")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        around = links.at(frontier.select("node"))
        around = around.where(F.col("relation").isin(*relations)) if relations else around
        around = around.withColumn("decayed", S.decay(F.col("weight").cast("double"), F.col("created_at"), now_ms))
        best = around.groupBy("other").agg(F.min_by(F.struct("node", "relation", F.col("weight").cast("double").alias("weight"), "decayed"), F.struct((-F.col("decayed")).alias("d"), "id")).alias("b"))
        found = best.select(F.col("other").alias("node"), F.col("b.node").alias("before"), "b.relation", "b.weight", "b.decayed").join(seen, "node", "left_anti").join(usable, "node")
        path = F.concat("path", F.array(F.concat(F.lit("--["), F.col("relation"), F.lit("]--> "), F.col("label"))))
        before = frontier.groupBy(F.col("node").alias("before")).agg(F.min("path").alias("path"))
        frontier = checkpoint(found.join(before, "before").select("node", F.lit(depth).alias("depth"), path.alias("path"), "weight", "decayed"))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen


def search(nodes: DataFrame, edges: DataFrame | Links, query: list[float], now_ms: int, *, top_k: int = 5, max_depth: int = 1, relations: list[str] | None = None) -> DataFrame:
    """(id, depth, relevance, path): the top_k nodes by cosine, then up to twice as many neighbours by relevance.

    Equal cosines go to the shortest and then least id, so that numbers are in their order.
    """
    scored = nodes.where(~F.coalesce("needs_rebuild", F.lit(False))).withColumn("cos", V.cosine(F.col("embedding"), V.literal(query)))
    top = checkpoint(scored.orderBy(F.desc("cos"), F.length("id"), "id").limit(top_k).select(F.col("id").alias("node"), "cos", F.array("label").alias("path")))
    direct = top.select(F.col("node").alias("id"), F.lit(0).alias("depth"), F.round(F.col("cos") * 100, 1).alias("relevance"), F.array_join("path", " ").alias("path"))
    reached = _expand(nodes, edges, top, max_depth, relations, now_ms).where("depth > 0")
    own = scored.select(F.col("id").alias("node"), "cos")
    near = reached.join(own, "node").withColumn("relevance", F.round(S.relevance(F.col("cos"), F.col("decayed"), F.col("weight")) * 100, 1))
    near = near.orderBy(F.desc("relevance"), "node").limit(2 * top_k).select(F.col("node").alias("id"), "depth", "relevance", F.array_join("path", " ").alias("path"))
    return direct.unionByName(near)


def traverse(nodes: DataFrame, edges: DataFrame | Links, start: str, now_ms: int, *, max_depth: int = 2, max_nodes: int | None = MAX_NODES, relations: list[str] | None = None) -> DataFrame:
    """(id, depth, score, path, truncated): the start at 100, others by decay and depth, the nearest max_nodes or, by None, all."""
    first = nodes.where(F.col("id") == start).select(F.col("id").alias("node"), F.array("label").alias("path"))
    found = _expand(nodes, edges, first, max_depth, relations, now_ms)
    score = F.when(F.col("depth") == 0, 100.0).otherwise(F.round(F.col("decayed") * S.depth_penalty(F.col("depth")) * 100, 1))
    out = found.orderBy("depth", F.desc("decayed"), "node")
    truncated = max_nodes is not None and found.count() > max_nodes
    out = out if max_nodes is None else out.limit(max_nodes)
    return out.select(F.col("node").alias("id"), "depth", score.alias("score"), F.array_join("path", " ").alias("path"), F.lit(truncated).alias("truncated"))


def prune(nodes: DataFrame, edges: DataFrame, now_ms: int, threshold: float = STALE_BELOW) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without decayed edges, and then without idle nodes that have no edge left."""
    kept = edges.where(S.decay(F.col("weight").cast("double"), F.col("created_at"), now_ms) >= threshold)
    linked = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    idle = (F.col("access_count") <= 1) & (F.lit(now_ms) - F.col("last_accessed") > ORPHAN_DAYS * S.DAY_MS)
    return nodes.where(~idle).unionByName(nodes.where(idle).join(linked, "id", "left_semi")), kept


def auto_links(nodes: DataFrame, now_ms: int, threshold: float = LINK_AT) -> DataFrame:
    """similar_to edges of all node pairs whose cosine reaches the threshold, weighted by it."""
    pairs = near_pairs(nodes, threshold, key="id", vec="embedding")
    return pairs.select(F.sha2(F.concat_ws("\0", "a", "b"), 256).alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), F.lit("similar_to").alias("relation"), F.col("similarity").cast("float").alias("weight"), F.lit(now_ms).alias("created_at"), F.create_map().cast("map<string,string>").alias("metadata"))


def add_context(nodes: DataFrame, edges: DataFrame | Links, items: DataFrame, now_ms: int, *, auto_link: bool = True, threshold: float = LINK_AT, existing: int | None = EXISTING) -> tuple[DataFrame, DataFrame | Links]:
    """Upsert items, then link the near ones among them, and each to the near ones of the first ``existing`` other nodes by id.

    The product is of the items with these, never of all nodes with all.
    """
    after = checkpoint(upsert_nodes(nodes, items, now_ms))
    if not auto_link:
        return after, edges
    fresh = checkpoint(after.join(items.select("label", "node_type").distinct(), ["label", "node_type"], "left_semi").select("id", "embedding"))
    rest = after.join(fresh.select("id"), "id", "left_anti").select("id", "embedding")
    rest = rest if existing is None else checkpoint(rest.orderBy("id").limit(existing))
    found = near_pairs(fresh, threshold, key="id", vec="embedding").unionByName(near_between(fresh, rest, threshold, key="id", vec="embedding"))
    links = found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("similar_to").alias("relation"), F.col("similarity").alias("weight"), F.create_map().cast("map<string,string>").alias("metadata"))
    return after, relate(edges, after, links, now_ms)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id").distinct()
    return nodes.join(ids, "id", "left_anti"), edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)


def touch(nodes: DataFrame, used: DataFrame, now_ms: int) -> DataFrame:
    mark = used.select("id").distinct().withColumn("hit", F.lit(True))
    return nodes.join(mark, "id", "left").withColumn("last_accessed", F.when(F.col("hit"), F.lit(now_ms)).otherwise(F.col("last_accessed"))).select(*nodes.columns)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n)."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n")))


def body(label: str = "label", content: str = "content") -> Column:
    return F.sha2(F.concat_ws("\0", F.coalesce(label, F.lit("")), F.coalesce(content, F.lit(""))), 256)


def classify(overlay: DataFrame, primary: DataFrame) -> DataFrame:
    """(id, class): clean (not there), identical (same body), conflict."""
    mine, theirs = overlay.select("id", body().alias("m")), primary.select("id", body().alias("t"))
    kind = F.when(F.col("t").isNull(), "clean").when(F.col("m") == F.col("t"), "identical").otherwise("conflict")
    return mine.join(theirs, "id", "left").select("id", kind.alias("class"))


def merge(overlay: DataFrame, overlay_edges: DataFrame, primary: DataFrame, primary_edges: DataFrame, *, draining: bool = False) -> tuple[DataFrame, DataFrame]:
    """primary after the overlay: clean nodes are added, conflicting ones flagged for a rebuild, identical ones joined in
    their counters and references; edges are added where both ends exist. Nothing happens while draining."""
    if draining:
        return primary, primary_edges
    found = checkpoint(classify(overlay, primary))
    clean = overlay.join(found.where("class = 'clean'"), "id", "left_semi")
    other = overlay.join(found.where("class <> 'clean'"), "id").select("id", "class", F.col("access_count").alias("oc"), F.col("last_accessed").alias("ol"), F.col("references_chunk_hashes").alias("orefs"))
    same = F.col("class") == "identical"
    joined = primary.join(other, "id", "left")
    kept = joined.withColumns({"needs_rebuild": F.coalesce(F.col("needs_rebuild"), F.lit(False)) | F.coalesce(F.col("class") == "conflict", F.lit(False)), "access_count": F.when(same, F.greatest("access_count", "oc")).otherwise(F.col("access_count")), "last_accessed": F.when(same, F.greatest("last_accessed", "ol")).otherwise(F.col("last_accessed")), "references_chunk_hashes": F.when(same, F.array_union("references_chunk_hashes", "orefs")).otherwise(F.col("references_chunk_hashes"))})
    nodes = checkpoint(kept.select(*primary.columns).unionByName(clean.select(*primary.columns)))
    ids = nodes.select("id")
    new = overlay_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(primary_edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    return nodes, primary_edges.unionByName(new.select(*primary_edges.columns))


def read_through(overlay: DataFrame, primary: DataFrame) -> DataFrame:
    """Each node of the overlay, and of primary those that the overlay lacks."""
    return overlay.unionByName(primary.join(overlay.select("id"), "id", "left_anti").select(*overlay.columns))


def flagged_by_chunks(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """nodes with needs_rebuild set where a referenced chunk is among changed(hash)."""
    hit = nodes.select("id", F.explode("references_chunk_hashes").alias("hash")).join(changed.select("hash").distinct(), "hash", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return nodes.join(hit, "id", "left").withColumn("needs_rebuild", F.coalesce("needs_rebuild", F.lit(False)) | F.coalesce("hit", F.lit(False))).select(*nodes.columns)


def rebuilt(nodes: DataFrame, edges: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flagged nodes take content and embedding of fresh(id, content, embedding); without those they go, with their edges."""
    new = fresh.select("id", F.col("content").alias("nc"), F.col("embedding").alias("ne"))
    joined = nodes.join(new, "id", "left")
    gone = joined.where(F.col("needs_rebuild") & F.col("ne").isNull()).select("id")
    after = joined.withColumns({"content": F.when(F.col("needs_rebuild"), F.col("nc")).otherwise(F.col("content")), "embedding": F.when(F.col("needs_rebuild"), F.col("ne")).otherwise(F.col("embedding")), "needs_rebuild": F.lit(False)}).select(*nodes.columns)
    return delete_nodes(after, edges, gone)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder with nodes and edges as JSON lines: malformed rows and dangling edges are left out."""
    nodes = spark.read.schema(NODES).json(f"{path}/nodes").where("id is not null")
    edges = spark.read.schema(EDGES).json(f"{path}/edges").where("id is not null")
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*[x.split()[0] for x in re.split(r",\s(?=\w+ )", EDGES)])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def top_per_node(edges: DataFrame, k: int, now_ms: int) -> DataFrame:
    """Each node's k strongest links after decay."""
    rows = neighbours(edges).withColumn("decayed", S.decay(F.col("weight").cast("double"), F.col("created_at"), now_ms))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("decayed"), "other"))).where(F.col("rank") <= k)
