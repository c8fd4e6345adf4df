"""Graph operators over edges(src, dst): bounded search, strongly connected components, pull-request review.

Loops are driven from the driver by counts alone; every frontier stays a DataFrame, checkpointed in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import scoring as S
from quarrylight.session import checkpoint


def bounded_bfs(edges: DataFrame, seeds: DataFrame, *, max_hops: int = 2, max_nodes: int | None = 500) -> DataFrame:
    """(node, hop): the least number of hops from any of seeds(node) along src -> dst, up to max_hops; seeds are hop 0.

    The cap on nodes, a limit of the report, takes the nearest first, then by node.
    """
    seen = frontier = checkpoint(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, min(max_hops, 10) + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # each hop is stored once
    return seen if max_nodes is None else seen.orderBy("hop", "node").limit(min(max_nodes, 2000))


def dependents(imports: DataFrame, changed: DataFrame, *, max_hops: int = 2, max_files: int | None = 500) -> DataFrame:
    """Files that import changed(path), by hops, without the changed ones."""
    reverse = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    found = bounded_bfs(reverse, changed.select(F.col("path").alias("node")), max_hops=max_hops, max_nodes=None)
    found = found.where("hop > 0").select(F.col("node").alias("path"), "hop")
    return found if max_files is None else found.orderBy("hop", "path").limit(min(max_files, 2000))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out, again and again: only these can be on a cycle."""
    n = edges.count()
    while n:
        edges = checkpoint(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if (now := edges.count()) == n:
            break
        n = now
    return edges


def _reached(edges: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """(node, root) reachable from each root inside the same group, roots included."""
    seen = checkpoint(roots.select("node", "root"))
    frontier = seen
    while True:
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").where(F.col(group) == F.col("root")).select(F.col("dst").alias("node"), "root").distinct()
        frontier = checkpoint(step.join(seen, ["node", "root"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = checkpoint(seen.unionByName(frontier))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): scc is the component's least node; only nodes on a cycle (a component of two or more, or a self edge).

    Forward colouring: each node takes the least label that reaches it; inside a colour, what reaches its
    root backwards is one component. Found components leave, and the rest is coloured again. No pairs are closed.
    """
    own = checkpoint(edges.select("src", "dst").distinct())
    loops = own.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("scc", F.col("node"))
    rest = _trimmed(checkpoint(own.where("src <> dst")))
    out = None
    while not rest.isEmpty():
        colour = checkpoint(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")))
        while True:
            sent = rest.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("sent"))
            new = checkpoint(colour.join(sent, "node", "left").select("node", F.least("root", "sent").alias("root"), (F.col("sent") < F.col("root")).alias("moved")))
            moved = new.where("moved").isEmpty()
            colour = new.select("node", "root")
            if moved:
                break
        coloured = rest.join(colour.select(F.col("node").alias("src"), F.col("root").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("root").alias("c2")), "dst").where("c1 = c2")
        back = checkpoint(coloured.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("c1").alias("g")))
        found = _reached(back, colour.where("node = root"), "g")
        out = found if out is None else out.unionByName(found)
        rest = _trimmed(checkpoint(rest.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")))
    if out is None:
        return loops
    sized = out.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("scc")).where("n > 1")
    large = out.join(sized, "root").select("node", "scc")
    return large.unionByName(loops.join(large, "node", "left_anti"))


def cycles(edges: DataFrame) -> DataFrame:
    """(scc, size, files): the smallest first, files in order."""
    return strong_components(edges).groupBy("scc").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("files")).orderBy("size", "files")


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, kind, line, end_line) of symbols whose lines meet a hunk of their file."""
    h = hunks.select(F.col("path").alias("p"), "start", "end")
    meet = (h["p"] == symbols["path"]) & (F.greatest(h["start"], symbols["line"]) <= F.least(h["end"], symbols["end_line"]))
    return symbols.join(h, meet).select("path", "name", "kind", "line", "end_line").distinct()


def risk_ranked(files: DataFrame, *, hops: int = 2) -> DataFrame:
    """files(path, changed_lines, touched, dependents) with score and reasons, riskiest first."""
    parts = [F.col(c) for c in ("changed_lines", "touched", "dependents")]
    return files.withColumn("score", S.risk(*parts)).withColumn("reasons", S.risk_reasons(*parts, hops)).orderBy(F.desc("score"), "path")


def review(hunks: DataFrame, symbols: DataFrame, imports: DataFrame, *, max_hops: int = 2, max_files: int = 500) -> DataFrame:
    """The files a change surfaces: the changed ones and their dependents, ranked by risk.

    A changed file's dependents count as the mean over the changed files, at least 1 if there are any.
    """
    changed = hunks.select("path").distinct()
    reached = checkpoint(dependents(imports, changed, max_hops=max_hops, max_files=max_files))
    n_changed, n_reached = changed.count(), reached.count()
    share = max(1, -(-n_reached // max(1, n_changed))) if n_reached else 0
    sizes = hunks.groupBy("path").agg(F.sum(F.col("end") - F.col("start") + 1).alias("changed_lines"))
    touched = changed_symbols(hunks, symbols).groupBy("path").agg(F.count("*").alias("touched"))
    rows = changed.withColumn("hop", F.lit(0)).unionByName(reached).join(sizes, "path", "left").join(touched, "path", "left")
    rows = rows.select("path", "hop", F.when(F.col("hop") == 0, "changed").otherwise(F.concat(F.lit("dependent("), F.col("hop").cast("string"), F.lit(")"))).alias("status"), F.coalesce("changed_lines", F.lit(0)).alias("changed_lines"), F.coalesce("touched", F.lit(0)).alias("touched"), F.when(F.col("hop") == 0, share).otherwise(0).alias("dependents"))
    return risk_ranked(rows, hops=max_hops)
