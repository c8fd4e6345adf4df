"""Context trees within a token budget, and skeletons of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

MAX_TOKENS = 20_000


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def _names(files: DataFrame) -> DataFrame:
    """A row per file and per directory above: (path, depth, is_dir, n_files)."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.select("path", F.explode(folders).alias("node")).groupBy("node").agg(F.count_if(F.col("node") != F.col("path")).alias("n_files"))
    return rows.select(F.col("node").alias("path"), (F.size(F.split("node", "/")) - 1).alias("depth"), (F.col("n_files") > 0).alias("is_dir"), "n_files")


def descendants(files: DataFrame) -> DataFrame:
    """(dir, n_files) below each directory, at any depth."""
    return _names(files).where("is_dir").select(F.col("path").alias("dir"), "n_files")


def context_tree(files: DataFrame, symbols: DataFrame | None = None, *, max_tokens: int = MAX_TOKENS, max_depth: int | None = None) -> DataFrame:
    """(path, depth, text, level): the tree's lines at the first level of detail that fits the budget.

    Levels: symbols, headers, names, then names up to ever smaller depths. Sizes of all levels are sums of one pass;
    the last level's lines are cut, in order, where the budget ends.
    """
    nodes = _names(files)
    nodes = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    heads = files.select("path", *(["header"] if "header" in files.columns else [F.lit("").alias("header")]))
    own = nodes.join(heads, "path", "left")
    pad = F.repeat(F.lit("  "), F.col("depth"))
    name = F.concat(pad, F.regexp_extract("path", "([^/]*)$", 1), F.when(F.col("is_dir"), "/").otherwise(""))
    plain = own.select("path", "depth", F.lit(0).alias("line"), name.alias("name"), F.concat(name, F.when(F.coalesce(F.col("header"), F.lit("")) != "", F.concat(F.lit("  | "), F.col("header"))).otherwise("")).alias("full"))
    size = lambda c: F.sum(estimated_tokens(F.concat(c, F.lit("\n"))))
    by_depth = {r.depth: r.n for r in plain.groupBy("depth").agg(size("name").alias("n")).collect()}
    with_heads = plain.agg(size("full")).first()[0] or 0
    lines = None
    if symbols is not None:
        lines = symbols.join(plain.select("path", F.col("depth").alias("d")), "path").select("path", F.col("d").alias("depth"), "line", F.concat(F.repeat(F.lit("  "), F.col("d") + 1), F.lit("L"), F.col("line").cast("string"), F.lit(" "), F.coalesce("signature", "name")).alias("text"))
        extra = lines.agg(size("text")).first()[0] or 0
        if with_heads + extra <= max_tokens:
            return plain.select("path", "depth", "line", F.col("full").alias("text")).unionByName(lines).withColumn("level", F.lit("symbols")).orderBy("path", "line")
    if with_heads <= max_tokens:
        return plain.select("path", "depth", "line", F.col("full").alias("text"), F.lit("headers").alias("level")).orderBy("path")
    deepest = max(by_depth, default=0)
    while deepest > 0 and sum(n for d, n in by_depth.items() if d <= deepest) > max_tokens:
        deepest -= 1
    cut = plain.where(F.col("depth") <= deepest).select("path", "depth", "line", F.col("name").alias("text"), F.lit("names" if deepest == max(by_depth, default=0) else f"depth {deepest}").alias("level"))
    if sum(n for d, n in by_depth.items() if d <= deepest) > max_tokens:
        # a line takes a token at least, so no more lines than tokens can fit
        from pyspark.sql import Window

        top = cut.orderBy("path").limit(max_tokens)
        return top.withColumn("used", F.sum(estimated_tokens(F.concat("text", F.lit("\n")))).over(Window.orderBy("path"))).where(F.col("used") <= max_tokens).drop("used")
    return cut.orderBy("path")


def skeleton(content: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """(line, text) of a file: its signatures, else its first lines (20 where the language is unknown, 30 where it has none)."""
    found = symbols.where(F.col("path") == path).select("line", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("signature", "name"), F.lit("  L"), F.col("line").cast("string"), F.lit("-L"), F.col("end_line").cast("string")).alias("text"))
    if not found.isEmpty():
        return found.orderBy("line")
    rows = content.where(F.col("path") == path).select(F.posexplode(T.lines("content")).alias("i", "text"), T.language("path").alias("lang"))
    return rows.where(F.col("i") < F.when(F.col("lang").isNull(), 20).otherwise(30)).select((F.col("i") + 1).alias("line"), "text").orderBy("line")


def rendered(rows: DataFrame, column: str = "text", most: int = 10_000) -> str:
    """The lines as one text, on the driver; a report, so of bounded size, and it says what it leaves out."""
    from quarrylight.render import text

    return text(rows, column, most)
