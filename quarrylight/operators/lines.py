"""Operators over lines(path, line, text): symbol usage, dead symbols, lint rules, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

# Fixed values.
IGNORED_KINDS = ["mod", "module", "impl", "trait", "test", "element", "style", "script"]
IGNORED_NAMES = ["main", "default", "new", "drop", "clone", "fmt", "from", "into"]


def blast_radius(lines: DataFrame, symbol: str, *, file_context: str | None = None, pattern: str | None = None) -> DataFrame:
    """(path, line, context): every line that uses the symbol; in file_context, lines that define it don't count.

    A plain containment test comes before the pattern.
    """
    found = lines.where(F.col("text").contains(symbol)).where(F.col("text").rlike(pattern or T.usage_regex(symbol)))
    if file_context:
        found = found.where(~((F.col("path") == file_context) & F.col("text").rlike(T.definition_regex(symbol))))
    return found.select("path", "line", F.substring(F.trim("text"), 1, 120).alias("context"))


def usage_summary(usages: DataFrame) -> DataFrame:
    """(path, usages, lines, low_usage): low_usage where all files together have one usage at most."""
    per_file = usages.groupBy("path").agg(F.count("*").alias("usages"), F.array_sort(F.collect_list("line")).alias("lines"))
    total = usages.agg(F.count("*").alias("total"))
    return per_file.crossJoin(F.broadcast(total)).select("path", "usages", "lines", (F.col("total") <= 1).alias("low_usage"))  # one row


def dead_symbols(symbols: DataFrame, tokens: DataFrame, *, ignore_kinds: list[str] | None = None, ignore_names: list[str] | None = None, max_results: int | None = 200) -> DataFrame:
    """Symbols (path, name, kind, line) whose name is a token of no other file; tokens(path, token)."""
    kinds, names = ([x.lower() for x in (a if a is not None else b)] for a, b in ((ignore_kinds, IGNORED_KINDS), (ignore_names, IGNORED_NAMES)))
    own = symbols.where(~F.lower("kind").isin(*kinds) & ~F.lower("name").isin(*names))
    spread = tokens.groupBy("token").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    joined = own.join(spread, own["name"] == spread["token"], "left")
    dead = joined.where("first is null or (first = last and first = path)").select("path", "name", "kind", "line")
    return dead.orderBy("path", "line", "name").limit(max_results or 200) if max_results is not None else dead


def kept_diagnostics(lines: DataFrame, *, key: str = "run", drop: str = "node_modules/") -> DataFrame:
    """Diagnostics without the blocks whose header, a line that isn't indented, names a dropped path."""
    header = F.when(~F.col("text").rlike(r"^\s"), F.col("text").contains(drop))
    carried = F.last(header, True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("dropped", F.coalesce(carried, F.lit(False))).where("not dropped").drop("dropped")


def bare_depth(text: Column) -> Column:
    """Greatest depth of braces outside of strings and comments."""
    bare = F.regexp_replace(text, r"""(?s)/\*.*?\*/|//[^\n]*+|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`""", "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    run = F.aggregate(braces, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, c: F.struct((a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c == "{", 1).otherwise(0)).alias("m")))
    return run["m"]


def lint(content: DataFrame, *, max_depth: int = 6, max_lines: int = 1000, max_comments: int = 5) -> DataFrame:
    """(path, rule, line, message): header, feature tag, comments, nesting and length of content(path, content)."""
    all_lines = T.lines("content")
    trimmed = F.transform(all_lines, lambda x: F.trim(x))
    comment = r"^(//|#(?!!)|/\*|\*|--|<!--)"
    head = F.filter(F.slice(trimmed, 1, 2), lambda x: x.rlike(comment))
    inside = F.filter(F.transform(trimmed, lambda x, i: F.when((i >= 10) & x.rlike(comment), i + 1)), lambda i: i.isNotNull())
    depth = bare_depth(F.col("content"))
    rules = [
        ("header", F.size(head) < 2, F.lit(1), F.lit("the first two lines should be comments")),
        ("feature-tag", ~F.col("content").contains("FEATURE:"), F.lit(1), F.lit("no FEATURE: tag")),
        ("comments", F.size(inside) > max_comments, F.try_element_at(inside, F.lit(1)), F.concat(F.size(inside).cast("string"), F.lit(" comment lines below the header"))),
        ("nesting", depth > max_depth, F.lit(1), F.concat(F.lit("blocks nest "), depth.cast("string"), F.lit(" deep"))),
        ("length", F.size(all_lines) > max_lines, F.lit(max_lines + 1), F.concat(F.size(all_lines).cast("string"), F.lit(" lines"))),
    ]
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(name).alias("rule"), line.cast("int").alias("line"), message.alias("message"))) for name, bad, line, message in rules)), lambda x: x.isNotNull())
    return content.select("path", F.explode(found).alias("r")).select("path", "r.rule", "r.line", "r.message")
