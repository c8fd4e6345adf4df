"""Corpora of files as relations: scans with ignore rules, content, search documents."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T

MAX_EMBED_BYTES = 51_200


def gitignore_regexes(rules: str, folder: str = "") -> list[tuple[bool, str]]:
    """(ignored, regex over relative paths) of each rule of a file in folder, in order; the last one that matches decides."""
    out, above = [], re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    for raw in rules.splitlines():
        rule = raw.rstrip()
        if not rule or rule.startswith("#"):
            continue
        ignored = not rule.startswith("!")
        rule = rule.lstrip("!")
        inside = rule.endswith("/")
        anchored = "/" in rule.rstrip("/")
        body = "".join(".*" if x.startswith("**") else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*/?|\*|\?|[^*?]+", rule.strip("/")))
        out.append((ignored, f"^{above}" + ("" if anchored else "(?:|.*/)") + body + ("/.*$" if inside else "(?:/.*)?$")))
    return out


def ignored_by(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the rules leave a path out. A later exception takes a file back in, but not from within a directory that is out."""
    out = F.lit(False)
    for k, (ignored, regex) in enumerate(rules):
        if not ignored:
            continue
        body = regex.removesuffix("(?:/.*)?$").removesuffix("/.*$")
        back = [x.removesuffix("(?:/.*)?$").removesuffix("/.*$") for other, x in rules[k + 1 :] if not other]
        inside, itself = path.rlike(f"{body}/.*$"), path.rlike(f"{body}$") if regex.endswith("(?:/.*)?$") else F.lit(False)
        for x in back:
            inside &= ~path.rlike(f"{x}/.*$")
            itself &= ~path.rlike(f"{x}$")
        out = out | inside | itself
    return out


def tree_rules(spark: SparkSession, root: str, depth: int = 16) -> list[tuple[bool, str]]:
    """The rules of the tree's own ignore files, the deeper after the higher, and before them those of its repository's exclude file.

    Spark's scans pass over names that begin with a dot, so the store is asked for these files themselves, down to a depth;
    they are small, and the driver compiles them.
    """
    jvm, base = spark.sparkContext._jvm, root.rstrip("/")
    top = jvm.org.apache.hadoop.fs.Path(base)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    above = len(store.makeQualified(top).toString()) + 1

    def read(pattern: str) -> list[tuple[str, str]]:
        out = []
        for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{pattern}")) or []:
            stream = store.open(status.getPath())
            try:
                out.append((status.getPath().toString()[above:], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    out = [x for _, rules in read(".git/info/exclude") for x in gitignore_regexes(rules)]
    for k in range(depth):
        for path, rules in sorted(read("*/" * k + ".gitignore")):
            folder = path.rpartition("/")[0]
            if not set(folder.split("/")) & set(T.IGNORED_DIRS):
                out += gitignore_regexes(rules, folder)
    return out


def _read(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, content) with paths relative to root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    return raw.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", ""))


def scan(spark: SparkSession, root: str, *, ignore_rules: str = "", own_rules: bool = True, sub_path: str = "", max_depth: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """files(path, depth, size, modified_ms, content): content is NULL where a file isn't UTF-8.

    The tree's own ignore files hold, and after them the rules given. Filters on names come before the content is read,
    and the size is pushed to the source.
    """
    files = _read(spark, root).where(T.tracked("path"))
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    rules = [*(tree_rules(spark, root) if own_rules else []), *gitignore_regexes(ignore_rules)]
    files = files.where(~ignored_by(F.col("path"), rules))
    if sub_path:
        files = files.where(F.col("path").startswith(sub_path.strip("/") + "/"))
    files = files.withColumn("depth", F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))
    if max_depth is not None:
        files = files.where(F.col("depth") <= max_depth)
    return files.select("path", "depth", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), F.try_validate_utf8("content").alias("content"))


def contents(files: DataFrame) -> DataFrame:
    return files.where("content is not null").select("path", "content")


def heads(files: DataFrame, n_bytes: int) -> DataFrame:
    """The first bytes of each file, on a character border."""
    raw = F.encode("content", "UTF-8")
    cut = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, max(0, n_bytes - k)).cast("string")) for k in range(4)))
    return files.where("content is not null").withColumn("content", cut)


def file_lines(content: DataFrame) -> DataFrame:
    """lines(path, line, text), from 1."""
    return content.select("path", F.posexplode(T.lines("content")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def rebased(entries: DataFrame, target: str) -> DataFrame:
    """Entries below target, with paths relative to it and depths counted anew."""
    prefix = target.strip("/") + "/"
    rows = entries.where(F.col("path").startswith(prefix)).withColumn("path", F.substr("path", F.lit(len(prefix) + 1)))
    return rows.withColumn("depth", F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))


def directories(files: DataFrame) -> DataFrame:
    """(dir, n_files): "." is the root."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy(F.when(folder == "", ".").otherwise(folder).alias("dir")).agg(F.count("*").alias("n_files"))


def search_documents(content: DataFrame, symbols: DataFrame) -> DataFrame:
    """docs(path, header, symbols, entries, content): one builder for code and text files.

    Both take their whole content; text files a plain header, code its top-level symbols and a comment header.
    """
    is_text = F.lit(False)
    for x in T.TEXT_EXTENSIONS:
        is_text |= F.lower("path").endswith(x)
    lang = T.language("path")
    rows = content.where(is_text | lang.isNotNull())
    entry = F.struct("name", "kind", "line", "end_line", "signature")
    tops = symbols.where("parent_name is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", entry.alias("e")))).alias("s"))
    joined = rows.join(tops.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left").withColumn("text", is_text)
    entries = F.when(F.col("text") | F.col("s").isNull(), F.expr("cast(array() as array<struct<name:string,kind:string,line:int,end_line:int,signature:string>>)")).otherwise(F.transform("s", lambda x: x["e"]))
    return joined.select(
        "path", F.when(F.col("text"), T.plain_header("content")).otherwise(T.code_header("content")).alias("header"), F.transform(entries, lambda e: e["name"]).alias("symbols"), entries.alias("entries"),
        F.when(F.col("text"), F.col("content")).otherwise(F.concat_ws(" ", lang, "content")).alias("content"),
    )


def safe_path(root: str, user_path: str) -> str:
    """The absolute path below root; an absolute or escaping one is an error."""
    if os.path.isabs(user_path) or "\0" in user_path:
        raise ValueError(f"not a relative path: {user_path}")
    out = os.path.normpath(os.path.join(root, user_path))
    if out != os.path.normpath(root) and not out.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"outside of the root: {user_path}")
    return out


def foreign_roots_rewritten(df: DataFrame, column: str, root: str, foreign: list[str]) -> DataFrame:
    out = F.col(column)
    for x in sorted(foreign, key=len, reverse=True):
        out = F.replace(out, F.lit(x.rstrip("/") + "/"), F.lit(root.rstrip("/") + "/"))
    return df.withColumn(column, out)


def matches_any(path: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatch(path, p) for p in patterns)
