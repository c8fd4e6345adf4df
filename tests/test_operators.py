"""Search, lines, graphs, memory, clusters, labels, trees, sources, increments and streams on small fixtures."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.engine import TOOLS, Corpus
from quarrylight.operators import clustering, graph, labels, lines, memory, search, tree, vectors
from quarrylight.plans import incremental
from quarrylight.sources import diffs, embedding, files, hubs, symbols
from quarrylight.streaming import increment

DAY = 86_400_000
FILES = {
    "src/main.ts": "// Entry point\n// FEATURE: start\nimport { open } from './lib/store';\nimport type { T } from './types';\nexport function run(x: number) {\n  return open(x);\n}\n",
    "src/lib/store.ts": "// Store\nimport { run } from '../main';\nexport const open = (x) => x;\nclass Box {\n  lid() {\n    return run(1);\n  }\n}\nfunction unusedThing() {\n  return 2;\n}\n",
    "src/types.ts": "export interface T { x: number }\n",
    "py/app.py": "# App\nfrom py.helpers import go\n\nclass App:\n    def start(self):\n        return go()\n",
    "py/helpers.py": "def go():\n    return 1\n",
    "rust/lib.rs": "pub struct Point { x: i32 }\nimpl Point {\n    pub fn norm(&self) -> i32 {\n        self.x\n    }\n}\n",
    "docs/hub.md": "# Payments\nsee [[src/main.ts|the entry]] and [[gone.ts]] [[src/main.ts]]\n@linked-to [[docs/other.md]]\n",
    "docs/other.md": "no links here\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for p, t in FILES.items():
        os.makedirs(base / os.path.dirname(p), exist_ok=True)
        (base / p).write_text(t)
    (base / "bin.ts").write_bytes(b"\xff\xfe\xfa")
    os.makedirs(base / "node_modules/x")
    (base / "node_modules/x/a.js").write_text("x")
    (base / "big.ts").write_text("a" * 60_000)
    (base / "skip.log.ts").write_text("x")
    return str(base)


@pytest.fixture(scope="module")
def corpus(spark, root):
    return Corpus.from_files(spark, root, ignore_rules="*.log.ts\n", max_bytes=files.MAX_EMBED_BYTES)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# -- sources

def test_a_tree_s_own_ignore_files_hold(spark, tmp_path):
    for p, t in {".gitignore": "*.log\nout/\n!keep.log\n", "a/.gitignore": "/x.ts\n", "a/x.ts": "1", "a/b/x.ts": "1", "x.ts": "1", "z.log": "1", "keep.log": "1", "out/keep.log": "1", ".git/info/exclude": "secret*\n", "secret.ts": "1"}.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(t)
    assert [r[0] for r in rows(files.scan(spark, str(tmp_path)), "path")] == ["a/b/x.ts", "keep.log", "x.ts"]
    assert files.scan(spark, str(tmp_path), own_rules=False).count() == 7


class Strict:
    """An embedder that takes one text of at most so many characters at a time."""

    dims, most = 1, 10

    def embed(self, texts):
        if len(texts) > 1 or len(texts[0]) > self.most:
            raise embedding.ContextLengthError(len(texts))
        return [[float(len(texts[0]))]]


def test_embedders_are_asked_patiently_and_within_a_budget(spark):
    asked = embedding.PatientEmbedder(Strict())
    assert asked.embed(["abc", "x" * 40, "yy"]) == [[3.0], [9.0], [2.0]]
    with pytest.raises(embedding.ContextLengthError):
        embedding.PatientEmbedder(Strict(), retries=1).embed(["x" * 40])
    with pytest.raises(TimeoutError):
        embedding.PatientEmbedder(Strict(), deadline_s=-1).embed(["abc"])
    kept = embedding.RememberingEmbedder(Strict(), most=1)
    assert [kept.embed([x])[0] for x in ("a", "bb", "a")] == [[1.0], [2.0], [1.0]] and list(kept.known) == ["a"]
    d = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    assert embedding.embedded(d, embedding.HashingEmbedder(2), text="content", budget_s=-1).where("vec is null").count() == 2


def test_values_are_kept_for_a_while():
    now = [0.0]
    timed = incremental.Timed(300, lambda: now[0])
    seen = []
    get = lambda mark=None: timed.get("k", lambda: seen.append(0) or len(seen), mark)
    assert (get(), get()) == (1, 1)
    now[0] = 301
    assert (get(), get("more files"), get("more files")) == (2, 3, 3)
    timed.refresh()
    assert get("more files") == 4
    assert incremental.index_action({"generation": 1, "n": 9, "digest": 1}, {"generation": 1, "n": 99, "digest": 2}) == "same"


def test_reports(spark, corpus):
    said = Corpus(spark, corpus.content)
    assert said.report("get_blast_radius", symbol_name="unusedThing").startswith('Blast radius for "unusedThing": 1 usages in 1 files') and "LOW USAGE" in said.report("get_blast_radius", symbol_name="unusedThing")
    assert said.report("find_dead_code").startswith("Found ") and said.report("detect_dependency_loops").startswith("Cycle 1 (2 files in SCC):\n")
    assert "1 changed file(s), 1 dependent file(s)" in said.report("review_pr_diff", diff="+++ b/py/helpers.py\n@@ -1 +1 @@\n")
    assert said.report("semantic_identifier_search", query="run").startswith('Top 5 identifier matches for: "run"')
    assert "No issues found" in said.report("check_embedding_quality")
    tree_of = spark.createDataFrame([(f"f{i:02}.ts", ["a", "b" if i % 2 else "3 files"]) for i in range(24)], "path string, labels array<string>")
    from quarrylight import render

    shown = render.navigation(tree_of).split("\n")
    assert shown[0] == "[a] (24 files)" and "  [3 files]" in shown and "  [b] (12 files)" in shown and shown.count("    (+2 more files)") == 2


def test_scan_honours_rules_sizes_and_encodings(spark, root, corpus):
    assert [r[0] for r in rows(corpus.content, "path")] == sorted(FILES)
    found = files.scan(spark, root, sub_path="src", max_depth=1)
    assert [r[0] for r in rows(found, "path")] == ["src/main.ts", "src/types.ts"]
    assert rows(files.directories(corpus.content.withColumn("path", F.regexp_replace("path", "^docs/", "")))) == [(".", 2), ("py", 2), ("rust", 1), ("src", 2), ("src/lib", 1)]
    assert rows(files.heads(spark.createDataFrame([("a", "éé")], "path string, content string"), 3), "content") == [("é",)]


def test_gitignore_negation_and_directories(spark, root):
    found = files.scan(spark, root, ignore_rules="src/\n*.md\n!hub.md\n", max_bytes=1000)
    assert [r[0] for r in rows(found.where("content is not null"), "path")] == ["docs/hub.md", "py/app.py", "py/helpers.py", "rust/lib.rs", "skip.log.ts"]


def test_safe_paths(root):
    assert files.safe_path(root, "a/../b") == os.path.join(root, "b")
    for bad in ("/etc/passwd", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            files.safe_path(root, bad)


def test_symbols_and_nesting(corpus):
    found = rows(corpus.symbols, "path", "name", "kind", "line", "end_line", "parent_name")
    assert [x[1:] for x in found if x[0] == "src/lib/store.ts"] == [("Box", "class", 4, 8, None), ("lid", "method", 5, 7, "Box"), ("open", "const", 3, 3, None), ("unusedThing", "function", 9, 11, None)]
    assert [x[1:] for x in found if x[0] == "py/app.py"] == [("App", "class", 4, 6, None), ("start", "function", 5, 6, "App")]
    assert [x[1:] for x in found if x[0] == "rust/lib.rs"] == [("Point", "impl", 2, 6, None), ("Point", "struct", 1, 1, None), ("norm", "function", 3, 5, "Point")]


@pytest.mark.parametrize(("language", "text", "expected"), [("go", "func (b *Box) Open(x int) error {\n}\nfunc New() {\n}\ntype Box struct {\n}\n", [("Open", "method", 1, 2), ("New", "function", 3, 4), ("Box", "type", 5, 6)]), ("java", "public class A {\n  public int get(int x) {\n    return x;\n  }\n}\n", [("A", "class", 1, 5), ("get", "method", 2, 4)]), ("c", "struct p {\n int x;\n};\nint add(int a, int b) {\n  return a;\n}\n", [("p", "struct", 1, 3), ("add", "function", 4, 6)]), ("bash", "go() {\n echo 1\n}\n", [("go", "function", 1, 3)]), ("ruby", "class A\n  def b\n    1\n  end\nend\n", [("A", "class", 1, 5), ("b", "function", 2, 4)]), ("css", ".a b {\n color: red;\n}\n", [(".a b", "rule", 1, 3)]), ("php", "class A {\n  public function b() {\n  }\n}\n", [("A", "class", 1, 4), ("b", "function", 2, 3)]), ("kotlin", "class A {\n  fun b() {\n  }\n}\n", [("A", "class", 1, 4), ("b", "function", 2, 3)]), ("csharp", "public class A {\n  public int B(int x) {\n  }\n}\n", [("A", "class", 1, 4), ("B", "method", 2, 3)]), (None, "pub fn x() {\n}\nenum E {\n}\n", [("x", "function", 1, 2), ("E", "enum", 3, 4)])])
def test_symbols_of_languages(language, text, expected):
    assert [x[:4] for x in symbols.symbols_of(text, language)] == expected


def test_imports_skip_types_and_normalise(corpus):
    assert rows(corpus.imports) == [("py/app.py", "py/helpers.py"), ("src/lib/store.ts", "src/main.ts"), ("src/main.ts", "src/lib/store.ts")]


def test_diffs(spark):
    text = '--- a/x\n+++ b/src/a.ts\n@@ -1,2 +5,3 @@ f\n+x\n@@ -9 +20 @@\n@@ -9,4 +30,0 @@\n--- a/y\n+++ "b/caf\\303\\251.ts"\n@@ -1 +1,2 @@\n+++ /dev/null\n@@ -1 +1 @@\n'
    assert rows(diffs.hunks(spark, text)) == [("café.ts", 1, 2), ("src/a.ts", 5, 7), ("src/a.ts", 20, 20), ("src/a.ts", 30, 30)]


def test_hubs(corpus):
    found = hubs.hubs(corpus.content)
    assert rows(found, "hub", "title") == [("docs/hub.md", "Payments")]
    links = hubs.links(found)
    assert rows(hubs.resolved(links, corpus.content), "target", "description", "exists") == [("gone.ts", None, False), ("src/main.ts", "the entry", True)]
    assert ("src/main.ts",) not in rows(hubs.orphans(corpus.content, links), "path") and ("src/types.ts",) in rows(hubs.orphans(corpus.content, links), "path")
    assert rows(hubs.cross_links(corpus.content)) == [("docs/hub.md", "docs/other.md")]
    assert rows(hubs.feature_tags(corpus.content)) == [("src/main.ts", "start")]
    assert hubs.find_hub(found, "pay").count() == 1


def test_chunks_and_embeddings(spark):
    text = "é" * 1500
    cut = embedding.chunks_of(text, 1001)
    assert "".join(cut) == text and all(len(c.encode()) <= 1001 for c in cut) and embedding.chunks_of("") == [""]
    d = spark.createDataFrame([("a", "alpha beta " * 300), ("b", "alpha beta")], "path string, content string")
    out = {r.key: np.array(r.vec) for r in embedding.embedded_long(d, embedding.HashingEmbedder(16)).collect()}
    assert np.allclose(out["a"], out["b"], atol=0.05)


# -- vectors

def test_quality_kinds(spark):
    data = [("z", [0.0, 0.0]), ("n", [float("nan"), 1.0]), ("d", [1.0]), ("a", [1.0, 0.0]), ("b", [2.0, -0.0]), ("c", [0.0, 1.0])]
    store = spark.createDataFrame(data, "key string, vec array<float>")
    assert rows(vectors.quality(store, 2)) == [("a", "duplicate"), ("b", "duplicate"), ("d", "dim_mismatch"), ("n", "non_finite"), ("z", "zero")]
    assert vectors.inferred_dim(store) == 2


def test_centroid_index_recall_and_near_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 12))
    data = [(i, (centre[i % 8] + 0.2 * rng.normal(size=12)).tolist()) for i in range(600)]
    store = spark.createDataFrame(data, "key int, vec array<float>")
    index = vectors.CentroidIndex(store, lists=8)
    hits = total = 0
    for q in range(0, 600, 60):
        exact = {r.key for r in vectors.nearest(store, data[q][1], 10).collect()}
        hits += len(exact & {r.key for r in index.search(data[q][1], 10, probes=3).collect()})
        total += 10
    assert hits / total >= 0.9
    m = np.array([v for _, v in data], np.float32).astype(float)
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    i, j = np.nonzero(np.triu(m @ m.T >= 0.97, 1))
    assert rows(vectors.near_pairs(store, 0.97, block=128), "a", "b") == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_kernel_equals_expression(spark):
    store = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(9)], "key int, vec array<float>")
    a, b = (vectors.nearest(store, [1.0, 2.0, 3.0], 5, kernel=k).collect() for k in (False, True))
    assert [r.key for r in a] == [r.key for r in b] and np.allclose([r.similarity for r in a], [r.similarity for r in b])


# -- search

def test_duplicate_query_tokens_count_twice_in_lexical_search(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "doc_id int, text string")
    once = {r.doc: r.score for r in search.lexical_search(d, "alpha beta").collect()}
    twice = {r.doc: r.score for r in search.lexical_search(d, "alpha alpha beta").collect()}
    idf = np.log(4 / 2) + 1
    assert once[1] == pytest.approx(idf + np.log(4 / 3) + 1) and twice[1] - once[1] == pytest.approx(idf) and 3 not in once
    assert search.lexical_search(d, "!!").count() == 0


def test_hybrid_ranks_symbols_and_guards_missing_vectors(corpus):
    found = search.hybrid_search(corpus.documents.withColumn("vec", F.lit(None).cast("array<float>")), "unusedThing", None, top_k=3, min_combined=0)
    assert found.first().path == "src/lib/store.ts" and found.count() == 1


def test_call_sites_are_ranked_per_identifier(corpus):
    got = search.call_sites(corpus.lines, corpus.identifiers.where("name in ('run', 'go')"), "return go", limit=1)
    assert rows(got, "id", "path", "line", "total") == [("py/helpers.py:go:1", "py/app.py", 6, 1), ("src/main.ts:run:5", "src/lib/store.ts", 6, 1)]


# -- lines

def test_blast_radius_excludes_definitions_in_context(corpus):
    assert rows(lines.blast_radius(corpus.lines, "run"), "path", "line") == [("src/lib/store.ts", 2), ("src/lib/store.ts", 6), ("src/main.ts", 5)]
    assert rows(lines.blast_radius(corpus.lines, "run", file_context="src/main.ts"), "path", "line") == [("src/lib/store.ts", 2), ("src/lib/store.ts", 6)]
    assert rows(lines.usage_summary(lines.blast_radius(corpus.lines, "unusedThing")), "path", "usages", "low_usage") == [("src/lib/store.ts", 1, True)]


def test_dead_symbols(corpus):
    names = {r.name for r in lines.dead_symbols(corpus.symbols, corpus.tokens).collect()}
    assert {"unusedThing", "Box", "App", "norm"} <= names and not {"run", "open", "go"} & names


def test_lint_and_diagnostics(spark):
    deep = "// a\n// FEATURE: x\n" + "if (x) {" * 8 + "}" * 8 + ' s = "{{{{{{{{{{";\n'
    d = spark.createDataFrame([("ok.ts", "// a\n// FEATURE: x\nlet a = 1;\n"), ("deep.ts", deep), ("bare.ts", "x\n" * 1200)], "path string, content string")
    assert rows(lines.lint(d), "path", "rule") == [("bare.ts", "feature-tag"), ("bare.ts", "header"), ("bare.ts", "length"), ("deep.ts", "nesting")]
    out = spark.createDataFrame([(1, i, t) for i, t in enumerate(["src/a.ts: bad", "  more", "node_modules/x: bad", "  hidden", "src/b.ts: bad"])], "run int, line int, text string")
    assert [r[0] for r in rows(lines.kept_diagnostics(out), "line")] == [0, 1, 4]


# -- graphs

def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize(("pairs", "expected"), [([("a", "b"), ("b", "c")], []), ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], [["c"], ["a", "b"]]), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a")], [["d", "e"], ["a", "b", "c"]])])
def test_cycles(spark, pairs, expected):
    assert [r.files for r in graph.cycles(edges(spark, pairs)).collect()] == expected


def test_components_are_mutual_reachability(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 25, (36, 2))]
    reach = np.eye(25, dtype=bool)
    for a, b in pairs:
        reach[a, b] = True
    for k in range(25):
        reach |= reach[:, [k]] & reach[[k]]
    both = reach & reach.T
    expected = sorted((n, int(np.flatnonzero(both[n])[0])) for n in range(25) if both[n].sum() > 1 or (n, n) in pairs)
    assert rows(graph.strong_components(spark.createDataFrame(pairs, "src int, dst int"))) == expected


def test_search_takes_fewest_hops_and_caps_nearest_first(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")])
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bounded_bfs(e, seed, max_hops=2)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.bounded_bfs(e, seed, max_hops=2, max_nodes=2)) == [("a", 0), ("b", 1)]


def test_review_ranks_changed_files_and_dependents(spark, corpus):
    hunks = diffs.hunks(spark, "+++ b/py/helpers.py\n@@ -1 +1,2 @@\n")
    got = graph.review(hunks, corpus.symbols, corpus.imports).collect()
    assert [(r.path, r.status, r.score) for r in got] == [("py/helpers.py", "changed", 2 + 5 + 3), ("py/app.py", "dependent(1)", 0)]
    assert got[0].reasons == ["2 changed lines", "1 touched symbols", "1 dependents within 2 hops"]


# -- memory

NOW = 100 * DAY


@pytest.fixture(scope="module")
def memo(spark):
    node = lambda i, **x: (i, "note", f"L{i}", f"c{i}", x.get("v", [1.0, 0.0]), 0, x.get("seen", 0), x.get("n", 1), {}, x.get("refs", []), x.get("flag", False))
    nodes = spark.createDataFrame([node("a"), node("b", v=[0.9, 0.1]), node("c", v=[0.0, 1.0]), node("d", v=[0.5, 0.5]), node("e", flag=True), node("lonely"), node("used", n=5), node("new", seen=NOW - DAY, refs=["h1"])], memory.NODES)
    edge = lambda a, b, w, age, r="relates_to": (f"{a}{b}", a, b, r, w, NOW - age * DAY, {})
    return nodes, spark.createDataFrame([edge("a", "b", 1.0, 0), edge("b", "c", 1.0, 10), edge("c", "d", 1.0, 60), edge("a", "e", 1.0, 0), edge("d", "a", 0.5, 10, "depends_on")], memory.EDGES)


def test_traversal_decays_skips_flagged_and_caps(memo):
    got = {r.id: (r.depth, r.score) for r in memory.traverse(*memo, "a", NOW).collect()}
    assert got == {"a": (0, 100.0), "b": (1, round(100 / 1.3, 1)), "d": (1, round(50 * np.exp(-0.5) / 1.3, 1)), "c": (2, round(100 * np.exp(-0.5) / 1.6, 1))}
    capped = memory.traverse(*memo, "a", NOW, max_nodes=2).collect()
    assert [r.id for r in capped] == ["a", "b"] and capped[0].truncated
    assert {r.id for r in memory.traverse(*memo, "a", NOW, relations=["depends_on"]).collect()} == {"a", "d"}
    assert next(r.path for r in memory.traverse(*memo, "a", NOW).collect() if r.id == "c") == "La --[relates_to]--> Lb --[relates_to]--> Lc"


def test_memory_search_expands(memo):
    got = [(r.id, r.depth) for r in memory.search(*memo, [1.0, 0.0], NOW, top_k=1).collect()]
    assert got == [("a", 0), ("b", 1), ("d", 1)]


def test_prune_drops_stale_edges_then_idle_orphans(memo):
    nodes, kept = memory.prune(*memo, NOW)
    assert rows(kept, "id") == [("ab",), ("ae",), ("bc",), ("da",)]
    assert {r.id for r in nodes.collect()} == {"a", "b", "c", "d", "e", "used", "new"}


def test_upsert_relate_delete_touch(spark, memo):
    item = spark.createDataFrame([("note", "La", "again", [0.0, 1.0], {"k": "v"}), ("concept", "La", "x", [0.0, 1.0], {})], "node_type string, label string, content string, embedding array<float>, metadata map<string,string>")
    after = memory.upsert_nodes(memo[0], item, NOW)
    a = after.where("id = 'a'").first()
    assert after.count() == 9 and (a.content, a.access_count, a.metadata, a.last_accessed) == ("again", 2, {"k": "v"}, NOW)
    links = spark.createDataFrame([("a", "b", "relates_to", None, {"m": "1"}), ("a", "c", "relates_to", 0.5, {}), ("a", "nobody", "relates_to", 1.0, {})], "source string, target string, relation string, weight double, metadata map<string,string>")
    related = memory.relate(memo[1], memo[0], links, NOW)
    assert related.count() == 6 and related.where("id = 'ab'").first().weight == 1.0 and related.where("source = 'a' and target = 'c'").first().weight == 0.5
    nodes, left = memory.delete_nodes(*memo, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert nodes.count() == 7 and rows(left, "id") == [("bc",), ("cd",)]
    assert memory.touch(memo[0], spark.createDataFrame([("b",)], "id string"), NOW).where(f"last_accessed = {NOW}").count() == 1


def test_auto_links_reach_the_threshold(spark, memo):
    new = spark.createDataFrame([("note", "fresh", "f", [1.0, 0.05], {})], "node_type string, label string, content string, embedding array<float>, metadata map<string,string>")
    nodes, linked = memory.add_context(*memo, new, NOW)
    fresh = nodes.where("label = 'fresh'").first().id
    ends = {r.source if r.target == fresh else r.target for r in linked.where("relation = 'similar_to'").collect()}
    assert ends == {"a", "b", "d", "e", "lonely", "used", "new"}


def test_merge_ladder_is_idempotent(spark, memo):
    nodes, links = memo
    overlay = nodes.where("id in ('a', 'b')").withColumn("content", F.when(F.col("id") == "b", "changed").otherwise(F.col("content"))).unionByName(nodes.where("id = 'c'").withColumn("id", F.lit("fresh")))
    more = spark.createDataFrame([("x", "a", "fresh", "relates_to", 1.0, 0, {}), ("y", "a", "ghost", "relates_to", 1.0, 0, {})], memory.EDGES)
    assert rows(memory.classify(overlay, nodes)) == [("a", "identical"), ("b", "conflict"), ("fresh", "clean")]
    merged, all_links = memory.merge(overlay, more, nodes, links)
    assert merged.count() == 9 and merged.where("id = 'b'").first().needs_rebuild and all_links.count() == 6
    again, same = memory.merge(overlay, more, merged, all_links)
    assert again.count() == 9 and same.count() == 6
    assert memory.merge(overlay, more, nodes, links, draining=True)[0].count() == 8
    assert memory.read_through(overlay, nodes).count() == 9


def test_flags_and_rebuilds(spark, memo):
    flagged = memory.flagged_by_chunks(memo[0], spark.createDataFrame([("h1",)], "hash string"))
    assert rows(flagged.where("needs_rebuild"), "id") == [("e",), ("new",)]
    nodes, left = memory.rebuilt(flagged, memo[1], spark.createDataFrame([("new", "fresh", [1.0, 1.0])], "id string, content string, embedding array<float>"))
    assert nodes.where("id = 'new'").first().content == "fresh" and nodes.where("id = 'e'").count() == 0 and left.where("id = 'ae'").count() == 0


def test_graph_files_round_trip(spark, memo, tmp_path):
    memory.write_graph(*memo, str(tmp_path))
    nodes, links = memory.read_graph(spark, str(tmp_path))
    assert nodes.count() == 8 and links.count() == 5 and rows(memory.stats(nodes, links)) == [("edge", "depends_on", 1), ("edge", "relates_to", 4), ("node", "note", 8)]


# -- clusters, labels, trees

def test_spectral_clusters_find_groups_whatever_the_partitions(spark):
    rng = np.random.default_rng(2)
    data = [("g", f"p{i:03}", (np.eye(4)[i % 3] + 0.05 * rng.random(4)).tolist()) for i in range(90)]
    d = spark.createDataFrame(data, "group string, path string, vec array<float>")
    a = {r.path: r.cluster for r in clustering.spectral_clusters(d.repartition(7), max_clusters=20).collect()}
    b = {r.path: r.cluster for r in clustering.spectral_clusters(d.repartition(2), max_clusters=20).collect()}
    assert a == b and len(set(a.values())) == 3 and all(a[f"p{i:03}"] == i % 3 for i in range(90))
    few = clustering.spectral_clusters(d.limit(12))
    assert few.select("cluster").distinct().count() == 12


def test_spectral_clusters_give_every_row_of_a_large_group_a_cluster(spark):
    rng = np.random.default_rng(8)
    n, kinds = clustering.MAX_ITEMS + 400, 3
    means = np.eye(kinds, 8) * 10
    rows = [(g, f"p{i:05d}", (means[i % kinds] + rng.normal(0, 0.3, 8)).tolist()) for g, size in (("big", n), (None, n), ("small", 30)) for i in range(size)]
    d = spark.createDataFrame(rows, "group string, path string, vec array<double>")
    out = clustering.spectral_clusters(d).collect()
    assert len(out) == len(rows) == len({(r.group, r.path) for r in out})
    for g in ("big", None):
        assert len({(int(r.path[1:]) % kinds, r.cluster) for r in out if r.group == g}) == kinds
    links = spark.createDataFrame([("p00000", "p00003"), ("p00001", "p00004")], "src string, dst string")
    linked = clustering.spectral_clusters(d.where("group = 'small'"), imports=links, most=12, max_clusters=5).collect()
    assert len(linked) == 30
    tree = clustering.navigate(d.where("group = 'big'").select("path", "vec"), mode="semantic", max_depth=1).collect()
    assert sum(len(r.cluster_path) for r in tree) == clustering.MAX_ITEMS and len(tree) == n


def test_clustering_parts():
    w = np.array([[0, 1, 0.0], [1, 0, 0], [0, 0, 0]])
    assert np.allclose(clustering.laplacian(w), [[1, -1, 0], [-1, 1, 0], [0, 0, 1]])
    assert clustering.eigengap(np.array([0, 0.01, 0.02, 0.9, 1.0]), 4) == 3
    assert clustering.kmeans(np.array([[0.0], [10.0], [0.1], [9.9]]), 2).tolist() == [0, 1, 0, 1]
    blended = clustering.blended(np.array([[1.0, 0], [0, 1.0]]), [(0, 1)])
    assert np.allclose(blended, [[0, 0.1], [0.1, 0]])


def test_navigation_modes(spark):
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(f"src/{'ab'[i % 2]}/f{i}.ts", (np.eye(3)[i % 3] + 0.05 * rng.random(3)).tolist()) for i in range(60)], "path string, vec array<float>")
    hybrid = {r.path: r.cluster_path for r in clustering.navigate(d, max_clusters=5).collect()}
    assert {x[0] for x in hybrid.values()} == {"src/a", "src/b"} and all(len(x) >= 2 for x in hybrid.values()) and len(hybrid) == 60
    assert clustering.navigate(d, mode="semantic", max_depth=1, max_clusters=5).select("cluster_path").distinct().count() == 3
    links = spark.createDataFrame([("src/a/f0.ts", "src/b/f1.ts")], "src string, dst string")
    assert clustering.navigate(d, mode="imports", max_clusters=5, imports=links).count() == 60


def test_labels(spark):
    d = spark.createDataFrame([(1, f"src/auth/f{i}.ts", "fn" if i else "cls") for i in range(3)] + [(2, "a/x.go", "fn"), (2, "b/y.rs", "cls")] + [(3, f"x/tests/t{i}.ts", "fn") for i in range(3)], "g int, path string, kind string")
    assert rows(labels.vote(d, "g", "kind"), "g", "kind") == [(1, "fn"), (2, "cls"), (3, "fn")]
    assert rows(labels.heuristic(d, "g", "kind")) == [(1, "src/auth (fn)"), (2, "(mixed) cls"), (3, "x/tests (fn)")]
    assert rows(labels.path_pattern(d, "g")) == [(1, "src/auth/*.ts"), (2, None), (3, "x/tests/*.ts")]
    assert rows(labels.derived(d, "g")) == [(1, "src/auth"), (2, "a"), (3, "tests")]
    assert rows(labels.described(d, "g"))[0] == (1, "f0 + f1 + f2")
    files = spark.createDataFrame([(1, "p/red/a.ts"), (2, "p/blue/b.ts"), (3, "p/x.json"), (4, "p/x.json")], "group int, path string")
    same = spark.createDataFrame([(0, 1, "x"), (0, 2, "X"), (0, 3, "y"), (0, 4, "y")], "parent int, group int, label string")
    assert rows(labels.told_apart(files, same), "group", "label") == [(1, "x (red)"), (2, "X (blue)"), (3, "y"), (4, "y #2")]
    cache = lambda *x: spark.createDataFrame(list(x), "key string, label string, quality string")
    merged = labels.merged_label_cache(cache(("a", "old", "llm"), ("b", "old", "heuristic")), cache(("a", "new", "heuristic"), ("b", "new", "heuristic")))
    assert rows(merged) == [("a", "old", "llm"), ("b", "new", "heuristic")]


def test_context_tree_degrades_to_the_budget(corpus):
    content = corpus.content.select("path", F.lit("").alias("header"))
    assert {r.level for r in tree.context_tree(content, corpus.symbols).collect()} == {"symbols"}
    assert {r.level for r in tree.context_tree(content, corpus.symbols, max_tokens=70).collect()} <= {"headers", "names"}
    small = tree.context_tree(content, max_tokens=12).collect()
    assert {r.level for r in small} == {"depth 0"} and [r.text for r in small] == ["docs/", "py/", "rust/", "src/"]
    assert len(tree.context_tree(content, max_tokens=4).collect()) == 2
    assert rows(tree.descendants(content)) == [("docs", 2), ("py", 2), ("rust", 1), ("src", 3), ("src/lib", 1)]
    assert tree.skeleton(corpus.content, corpus.symbols, "py/app.py").count() == 2
    assert tree.rendered(tree.skeleton(corpus.content, corpus.symbols, "docs/other.md")) == "no links here"


# -- increments and streams

def test_caches_merge_by_key_and_version(spark, tmp_path):
    path = str(tmp_path / "cache")
    v = lambda *x: spark.createDataFrame([(k, h, [float(n)]) for k, h, n in x], "key string, hash string, vec array<float>")
    assert incremental.load_cache(spark, path) is None
    incremental.save_cache(spark, path, v(("a", "1", 1), ("b", "1", 1)), dims=1)
    incremental.save_cache(spark, path, v(("b", "2", 2), ("c", "1", 1)), spark.createDataFrame([("a",)], "key string"), dims=1)
    assert rows(incremental.load_cache(spark, path), "key", "hash") == [("b", "2"), ("c", "1")]
    assert incremental.swept(v((".git/x", "1", 1), ("ok.ts", "1", 1)), 1).count() == 1
    assert (incremental.still_valid((100, 1), (100, 1)), incremental.still_valid((100, 1), (104, 2)), incremental.still_valid((100, 1), (120, 2))) == ("same", "stale", "rebuild")


def test_fingerprints_ignore_order(spark):
    d = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    f = lambda x: tuple(incremental.fingerprint(x, "a", "b").first())
    assert f(d) == f(d.orderBy(F.desc("a")).repartition(5)) != f(d.limit(49))


def test_chains_and_diff_only_indexing(spark):
    refs = spark.createDataFrame([("main", None), ("dev", "main"), ("leaf", "dev")], "ref string, parent string")
    manifests = spark.createDataFrame([("main", "f", 0, "h1"), ("main", "g", 0, "h2"), ("dev", "f", 0, "h3")], "ref string, path string, chunk_idx int, hash string")
    assert rows(incremental.lookup(refs, manifests).where("ref = 'leaf'"), "path", "hash", "depth") == [("f", "h3", 1), ("g", "h2", 2)]
    blobs = spark.createDataFrame([("h1", [1.0]), ("h2", [1.0]), ("h3", [1.0])], "hash string, vec array<float>")
    chunks = spark.createDataFrame([("f", 0, "text f", "h3"), ("g", 0, "new g", "h9"), ("x", 0, "same as f", "h1")], "path string, chunk_idx int, chunk string, hash string")
    assert rows(incremental.changes(refs, manifests, chunks, "leaf"), "path", "hit") == [("f", True), ("g", False), ("x", False)]
    after, more = incremental.indexed(refs, manifests, blobs, chunks, "leaf", embedding.HashingEmbedder(1))
    assert rows(after.where("ref = 'leaf'"), "path", "hash") == [("g", "h9"), ("x", "h1")] and more.count() == 4
    with pytest.raises(Exception, match="no blob"):
        incremental.vectors_of(incremental.lookup(refs, manifests), blobs.where("hash = 'h1'")).collect()


def test_change_stream_keeps_the_index(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    put = lambda *x: spark.createDataFrame(list(x), increment.CHANGES).coalesce(1).write.mode("append").parquet(source)
    run = lambda: increment.start(increment.effective(increment.change_stream(spark, source)), increment.index_sink(spark, cache, embedding.HashingEmbedder(4)), str(tmp_path / "cp")).awaitTermination()
    put(("a", 1, 1, "h1", "alpha", False), ("b", 1, 1, "h2", "beta", False))
    run()
    put(("a", 2, 1, "h3", "alpha two", False), ("b", 3, 0, None, None, True), ("c", 1, 1, "h4", "gamma", None))
    run()
    assert rows(incremental.load_cache(spark, cache), "key", "hash") == [("a", "h3"), ("c", "h4")]


# -- the tool surface

def test_every_tool_answers(spark, corpus):
    assert len(TOOLS) == 26
    point = spark.createDataFrame([("rp-1", 1, ["a.ts"], "x")], "id string, timestamp bigint, files array<string>, description string")
    c = Corpus(spark, corpus.content, points=point)
    c.call("upsert_memory_node", label="pay", content="payments flow", now_ms=NOW)
    c.call("upsert_memory_node", label="bill", content="billing flow", now_ms=NOW)
    ids = sorted(r.id for r in c.nodes.collect())
    args = {
        "get_context_tree": {}, "get_file_skeleton": {"filePath": "py/app.py"}, "get_blast_radius": {"symbolName": "run"}, "semantic_code_search": {"query": "store box", "topK": 2},
        "semantic_identifier_search": {"query": "run"}, "semantic_navigate": {"mode": "semantic"}, "get_feature_hub": {"feature_name": "payments"},
        "run_static_analysis": {"diagnostics": spark.createDataFrame([(1, 1, "src/a: x")], "run int, line int, text string")}, "attach_worktree": {"path": "dev", "parent": "main"}, "list_worktrees": {},
        "propose_commit": {"file_path": "a.ts", "new_content": "x"}, "list_restore_points": {}, "undo_change": {"point_id": "rp-1"}, "create_relation": {"source_id": ids[0], "target_id": ids[1], "now_ms": NOW},
        "search_memory_graph": {"query": "payments", "now_ms": NOW}, "retrieve_with_traversal": {"start_node_id": ids[0], "now_ms": NOW}, "find_dead_code": {}, "review_pr_diff": {"diff": "+++ b/py/helpers.py\n@@ -1 +1 @@\n"},
        "detect_dependency_loops": {}, "check_embedding_quality": {}, "lexical_search": {"query": "store"},
    }
    for tool, a in args.items():
        assert c.call(tool, **a).count() >= (0 if tool == "check_embedding_quality" else 1), tool
    c.call("add_interlinked_context", items=[{"label": "x", "content": "payments flow"}], now_ms=NOW)
    c.call("prune_stale_links", now_ms=NOW)
    c.call("delete_memory_node", node_id=ids[0])
    c.call("detach_worktree", path="dev")
    assert c.nodes.count() == 2 and c.refs.count() == 0
    assert json.dumps(sorted({"upsert_memory_node", "add_interlinked_context", "prune_stale_links", "delete_memory_node", "detach_worktree", *args})) == json.dumps(sorted(TOOLS))
