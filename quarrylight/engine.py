"""One entry per tool of the query surface, over a corpus of files or over given frames.

``Corpus`` holds the relations (files, content, symbols, imports, documents, identifiers, vectors, memory graph) as lazy
frames; every tool returns a frame, and ``report`` gives its answer as text. Tools that would change state return the
new frames.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import render
from quarrylight.functions import text as T
from quarrylight.operators import clustering, graph, labels, lines, memory, search, tree, vectors
from quarrylight.plans import incremental
from quarrylight.session import checkpoint
from quarrylight.sources import diffs, files, hubs
from quarrylight.sources import symbols as symbol_source
from quarrylight.sources.embedding import Embedder, HashingEmbedder, RememberingEmbedder, embedded, embedded_long

# The tools' names.
TOOLS = ["get_context_tree", "get_file_skeleton", "get_blast_radius", "semantic_code_search", "semantic_identifier_search", "semantic_navigate", "get_feature_hub", "run_static_analysis", "attach_worktree", "detach_worktree", "list_worktrees", "propose_commit", "list_restore_points", "undo_change", "upsert_memory_node", "create_relation", "search_memory_graph", "prune_stale_links", "add_interlinked_context", "retrieve_with_traversal", "delete_memory_node", "find_dead_code", "review_pr_diff", "detect_dependency_loops", "check_embedding_quality", "lexical_search"]


def argument(args: dict, name: str, default=None):
    """A tool's argument, in snake_case or camelCase."""
    camel = re.sub(r"_([a-z])", lambda m: m[1].upper(), name)
    return args.get(name, args.get(camel, default))


#: Vectors from which a search asks an index first; fewer are scanned.
INDEXED = 2000
#: Seconds that answers derived from the files are kept, unless refresh() comes first.
KEPT_S = 300.0
#: What warm() prepares: nothing, the vectors of files, or those of identifiers and the index too.
WARM = ("off", "shallow", "full")


class Corpus:
    def __init__(self, spark: SparkSession, content: DataFrame, *, embedder: Embedder | None = None, vectors: DataFrame | None = None, identifier_vectors: DataFrame | None = None, label_cache: DataFrame | None = None, backups: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | memory.Links | None = None, refs: DataFrame | None = None, points: DataFrame | None = None, budget_s: float | None = None):
        """content(path, content); the rest is derived or empty where it isn't given.

        vectors(key, vec) are of files, identifier_vectors(text, vec) of identifiers' texts, label_cache(key, label, quality) of
        navigation steps, backups(point, path, content) of restore points. A budget bounds a task's embedding.
        """
        self.spark, self.content, self.embedder, self._vectors = spark, content, RememberingEmbedder(embedder or HashingEmbedder()), vectors
        self._identifier_vectors, self.label_cache, self.budget_s, self.timed = identifier_vectors, label_cache, budget_s, incremental.Timed(KEPT_S)
        self.backups = backups if backups is not None else spark.createDataFrame([], "point string, path string, content string")
        self.nodes = nodes if nodes is not None else spark.createDataFrame([], memory.NODES)
        self.edges = edges if edges is not None else spark.createDataFrame([], memory.EDGES)
        self.refs = refs if refs is not None else spark.createDataFrame([], "ref string, parent string")
        self.points = points if points is not None else spark.createDataFrame([], "id string, timestamp bigint, files array<string>, description string")

    @classmethod
    def from_files(cls, spark: SparkSession, root: str, **options) -> "Corpus":
        return cls(spark, files.contents(files.scan(spark, root, **options)))

    @property
    def edges(self) -> DataFrame:
        return self.links.whole

    @edges.setter
    def edges(self, edges: DataFrame | memory.Links) -> None:
        self.links = memory.Links.of(edges)

    @cached_property
    def symbols(self) -> DataFrame:
        return symbol_source.symbols(self.content)

    @cached_property
    def imports(self) -> DataFrame:
        return symbol_source.resolved(symbol_source.imports(self.content), self.content)

    @cached_property
    def lines(self) -> DataFrame:
        return files.file_lines(self.content)

    @cached_property
    def vectors(self) -> DataFrame:
        """(key, vec) of whole files."""
        return self._vectors if self._vectors is not None else embedded_long(self.content, self.embedder.inner, budget_s=self.budget_s)

    @property
    def index(self) -> vectors.CentroidIndex | None:
        """An index over the files' vectors, if there are enough; kept for a while."""

        def build() -> vectors.CentroidIndex | None:
            stored = checkpoint(self.vectors.where("vec is not null"))
            return vectors.CentroidIndex(stored) if stored.count() >= INDEXED else None

        return self.timed.get("index", build)

    def refresh(self) -> None:
        """Forget what was derived from the files."""
        self.timed.refresh()
        for x in ("symbols", "imports", "lines", "vectors", "documents", "identifiers", "identifier_vectors", "tokens"):
            self.__dict__.pop(x, None)

    def warm(self, mode: str = "shallow") -> None:
        """Compute and store ahead what queries need."""
        if mode not in WARM:
            raise ValueError(f"no such mode: {mode}")
        if mode != "off":
            self.vectors = checkpoint(self.vectors)
        if mode == "full":
            self.identifier_vectors = checkpoint(self.identifier_vectors)
            self.symbols = checkpoint(self.symbols)
            _ = self.index

    @cached_property
    def documents(self) -> DataFrame:
        return files.search_documents(self.content, self.symbols).join(self.vectors.withColumnRenamed("key", "path"), "path", "left")

    @cached_property
    def identifiers(self) -> DataFrame:
        header = self.content.select(F.col("path").alias("p"), T.code_header("content").alias("header"))
        rows = self.symbols.join(header, F.col("path") == F.col("p")).drop("p").withColumn("id", F.concat_ws(":", "path", "name", "line"))
        return rows.withColumn("text", T.identifier_text("name", "kind", "signature", "path", "header", "parent_name")).withColumn("token_set", F.array_distinct(T.tokens("text")))

    @cached_property
    def identifier_vectors(self) -> DataFrame:
        """(text, vec): each distinct text of an identifier is embedded once."""
        return self._identifier_vectors if self._identifier_vectors is not None else embedded(self.identifiers.select("text").distinct(), self.embedder.inner, text="text", budget_s=self.budget_s)

    @cached_property
    def tokens(self) -> DataFrame:
        return self.content.select("path", F.explode(F.array_distinct(T.code_tokens("content"))).alias("token"))

    def vector_of(self, query: str) -> list[float]:
        return self.embedder.embed([T.sanitised(query)])[0]

    def call(self, tool: str, **args) -> DataFrame | tuple[DataFrame, DataFrame]:
        if tool not in TOOLS:
            raise ValueError(f"no such tool: {tool}")
        return getattr(self, tool)(lambda name, default=None: argument(args, name, default))

    def report(self, tool: str, **args) -> str:
        """A tool's answer as text."""
        out = self.call(tool, **args)
        get = lambda name, default=None: argument(args, name, default)
        if isinstance(out, tuple):
            return "\n".join(f"{x.count()} {name}" for x, name in zip(out, ("node(s)", "edge(s)"), strict=True))
        plain = {"find_dead_code": render.dead_symbols, "detect_dependency_loops": render.cycles, "review_pr_diff": render.review, "semantic_navigate": render.navigation, "get_context_tree": render.text, "get_file_skeleton": render.text}
        if tool in plain:
            return plain[tool](out)
        if tool == "semantic_code_search":
            return render.search(out, get("query"))
        if tool == "semantic_identifier_search":
            return render.identifiers(out, get("query"))
        if tool == "get_blast_radius":
            return render.blast_radius(out, get("symbol_name"))
        if tool == "check_embedding_quality":
            return render.quality(out, self.vectors.count(), get("expected_dim") or vectors.inferred_dim(self.vectors))
        if tool in ("search_memory_graph", "retrieve_with_traversal"):
            return render.memories(out, self.nodes)
        return render.text(out.select(F.concat_ws("  ", *(F.col(c).cast("string") for c in out.columns)).alias("text")))

    def get_context_tree(self, arg) -> DataFrame:
        rows = self.content.select("path", T.code_header("content").alias("header"), F.lit(0).alias("depth"))
        if target := arg("target_path"):
            rows = files.rebased(rows, target)
        symbols = self.symbols if arg("include_symbols", True) and not target else None
        return tree.context_tree(rows, symbols, max_tokens=arg("max_tokens", tree.MAX_TOKENS), max_depth=arg("depth_limit"))

    def get_file_skeleton(self, arg) -> DataFrame:
        return tree.skeleton(self.content, self.symbols, arg("file_path"))

    def get_blast_radius(self, arg) -> DataFrame:
        return lines.blast_radius(self.lines, arg("symbol_name"), file_context=arg("file_context"))

    def semantic_code_search(self, arg) -> DataFrame:
        names = ("top_k", "semantic_weight", "keyword_weight", "min_semantic", "min_keyword", "min_combined")
        options = {k: arg(f"{k}_score") if k.startswith("min") and arg(f"{k}_score") is not None else arg(k) for k in names}
        return search.hybrid_search(self.documents, arg("query"), self.vector_of(arg("query")), index=self.index, **options, require_semantic=arg("require_semantic_match", False), require_keyword=arg("require_keyword_match", False), include=arg("include_globs"), exclude=arg("exclude_globs"))

    def semantic_identifier_search(self, arg) -> DataFrame:
        vector = self.vector_of(arg("query"))
        rows = self.identifiers.join(self.identifier_vectors, "text", "left")
        found = checkpoint(search.identifier_scores(rows, arg("query"), vector, semantic_weight=arg("semantic_weight"), keyword_weight=arg("keyword_weight"), kinds=arg("include_kinds"), top_k=arg("top_k")))
        calls = search.call_sites(self.lines, found, arg("query"), limit=arg("top_calls_per_identifier", 10), vector=vector, line_vectors=arg("line_vectors"))
        sites = calls.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "line", "text", "score"))).alias("calls"), F.first("total").alias("total"))
        return found.select("id", "name", "kind", "path", "line", "end_line", "signature", "parent_name", "score", "semantic", "keyword").join(sites, "id", "left").orderBy(F.desc("score"), "id")

    def semantic_navigate(self, arg) -> DataFrame:
        """(path, cluster_path, labels): files embedded by path, header and start, clustered, each step named."""
        rows = self.content.where(T.extension("path").isin(*T.NAVIGATE_EXTENSIONS)).withColumn("header", T.code_header("content"))
        if self._vectors is not None:
            items = rows.join(self._vectors.withColumnRenamed("key", "path"), "path")
        else:
            items = embedded(rows.withColumn("text", T.navigate_text("path", "header", "content")), self.embedder.inner, text="text", budget_s=self.budget_s)
        items, mode = checkpoint(items.where("vec is not null").select("path", "header", "vec")), arg("mode", "hybrid")
        if items.count() <= clustering.LEAF:
            return items.select("path", F.expr("cast(array() as array<string>)").alias("cluster_path"), F.array(labels.file_label("header", "path")).alias("labels"))
        found = clustering.navigate(items, mode=mode, max_depth=arg("max_depth", 3), max_clusters=arg("max_clusters", 20), min_clusters=arg("min_clusters", 2), imports=self.imports if mode == "imports" else None)
        return labels.navigation(found.join(items.select("path", "header"), "path"), header="header", cached=self.label_cache)

    def get_feature_hub(self, arg) -> DataFrame:
        found = hubs.hubs(self.content)
        links = hubs.links(found)
        if arg("show_orphans", False):
            return hubs.orphans(self.content, links)
        if arg("hub_path"):
            found = found.where(F.col("hub") == arg("hub_path"))
        elif arg("feature_name"):
            found = hubs.find_hub(found, arg("feature_name"))
        return hubs.resolved(links.join(found.select("hub", "title"), "hub"), self.content)

    def run_static_analysis(self, arg) -> DataFrame:
        """Diagnostics are given as lines(run, line, text); running the linters is the caller's."""
        return lines.kept_diagnostics(arg("diagnostics"))

    def attach_worktree(self, arg) -> DataFrame:
        self.refs = incremental.fork(self.refs, arg("path"), arg("parent"))
        return self.refs

    def detach_worktree(self, arg) -> DataFrame:
        self.refs = self.refs.where(F.col("ref") != arg("path"))
        return self.refs

    def list_worktrees(self, arg) -> DataFrame:
        return self.refs.orderBy("ref")

    def propose_commit(self, arg) -> DataFrame:
        """The rules a new content breaks. With a point the old content is kept under its id, and the new one takes its place, unless
        there are too many comments; writing the file is the caller's."""
        new = self.spark.createDataFrame([(arg("file_path"), arg("new_content"))], "path string, content string")
        broken = lines.lint(new)
        if (point := arg("point_id")) and broken.where("rule = 'comments'").isEmpty():
            self.backups = checkpoint(self.backups.unionByName(incremental.restore_point(self.content, new, point)))
            self.points = self.points.unionByName(self.spark.createDataFrame([(point, arg("now_ms", 0), [arg("file_path")], arg("description", ""))], "id string, timestamp bigint, files array<string>, description string"))
            self.content = checkpoint(self.content.select("path", "content").join(new.select("path"), "path", "left_anti").unionByName(new))
            self.refresh()
        return broken

    def list_restore_points(self, arg) -> DataFrame:
        return incremental.restore_points(self.points)

    def undo_change(self, arg) -> DataFrame:
        """The content as it was at a restore point; writing the files back is the caller's."""
        self.content = incremental.undone(self.content, self.backups, arg("point_id"))
        self.refresh()
        return self.content

    def upsert_memory_node(self, arg) -> DataFrame:
        item = [(arg("type", "concept"), arg("label"), arg("content"), self.vector_of(arg("content")), arg("metadata") or {})]
        self.nodes = memory.upsert_nodes(self.nodes, self.spark.createDataFrame(item, "node_type string, label string, content string, embedding array<float>, metadata map<string,string>"), arg("now_ms"))
        return self.nodes

    def node_id(self, arg, end: str) -> str:
        """An end of a relation: its id, or that of the node with its label and type."""
        if arg(f"{end}_id"):
            return arg(f"{end}_id")
        row = self.nodes.where((F.col("label") == arg(f"{end}_label")) & (F.col("node_type") == arg(f"{end}_type", "concept"))).select(F.min("id")).first()
        if row[0] is None:
            raise ValueError(f"no such node: {arg(f'{end}_label')}")
        return row[0]

    def create_relation(self, arg) -> DataFrame:
        item = [(self.node_id(arg, "source"), self.node_id(arg, "target"), arg("relation", "relates_to"), arg("weight"), arg("metadata") or {})]
        self.edges = memory.relate(self.links, self.nodes, self.spark.createDataFrame(item, "source string, target string, relation string, weight double, metadata map<string,string>"), arg("now_ms"))
        return self.edges

    def search_memory_graph(self, arg) -> DataFrame:
        found = memory.search(self.nodes, self.links, self.vector_of(arg("query")), arg("now_ms"), top_k=arg("top_k", 5), max_depth=arg("max_depth", 1), relations=arg("edge_filter"))
        self.nodes = memory.touch(self.nodes, found, arg("now_ms"))
        return found

    def prune_stale_links(self, arg) -> tuple[DataFrame, DataFrame]:
        self.nodes, self.edges = memory.prune(self.nodes, self.edges, arg("now_ms"), arg("threshold", memory.STALE_BELOW))
        return self.nodes, self.edges

    def add_interlinked_context(self, arg) -> tuple[DataFrame, DataFrame]:
        items = [(x.get("type", "concept"), x["label"], x["content"], self.vector_of(x["content"]), x.get("metadata") or {}) for x in arg("items")]
        rows = self.spark.createDataFrame(items, "node_type string, label string, content string, embedding array<float>, metadata map<string,string>")
        self.nodes, self.edges = memory.add_context(self.nodes, self.links, rows, arg("now_ms"), auto_link=arg("auto_link", True))
        return self.nodes, self.edges

    def retrieve_with_traversal(self, arg) -> DataFrame:
        return memory.traverse(self.nodes, self.links, arg("start_node_id"), arg("now_ms"), max_depth=arg("max_depth", 2), max_nodes=arg("max_nodes", memory.MAX_NODES), relations=arg("edge_filter"))

    def delete_memory_node(self, arg) -> tuple[DataFrame, DataFrame]:
        self.nodes, self.edges = memory.delete_nodes(self.nodes, self.edges, self.spark.createDataFrame([(arg("node_id"),)], "id string"))
        return self.nodes, self.edges

    def find_dead_code(self, arg) -> DataFrame:
        return lines.dead_symbols(self.symbols, self.tokens, ignore_kinds=arg("ignore_kinds"), ignore_names=arg("ignore_names"), max_results=arg("max_results", 200) or 200)

    def review_pr_diff(self, arg) -> DataFrame:
        return graph.review(diffs.hunks(self.spark, arg("diff")), self.symbols, self.imports, max_hops=arg("max_hops", 2), max_files=arg("max_files", 500))

    def detect_dependency_loops(self, arg) -> DataFrame:
        return graph.cycles(self.imports)

    def check_embedding_quality(self, arg) -> DataFrame:
        return vectors.quality(self.vectors, arg("expected_dim") or vectors.inferred_dim(self.vectors))

    def lexical_search(self, arg) -> DataFrame:
        return search.lexical_search(self.content, arg("query"), arg("top_k", 10) or 10, id_col="path", text="content")
