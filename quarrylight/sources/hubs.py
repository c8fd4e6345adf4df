"""Hub notes: markdown files with [[links]], their titles, links, cross links, and the files no hub names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The notes' syntax.
_CROSS = r"@linked-to\s+\[\[[^\]]*\]\]"
_CROSS_TARGET = r"@linked-to\s+\[\[([^\]]+)\]\]"
_LINK = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"
_TITLE = r"(?m)^#\s+(.+)$"
_FEATURE = r"(?m)FEATURE:\s*(.+?)\s*$"
HEAD_BYTES = 8192


def hubs(content: DataFrame) -> DataFrame:
    """hubs(hub, title, content)."""
    rows = content.where(F.lower("path").endswith(".md") & F.substring("content", 1, HEAD_BYTES).rlike(_LINK))
    title = F.trim(F.regexp_extract("content", _TITLE, 1))
    return rows.select(F.col("path").alias("hub"), F.when(title != "", title).alias("title"), "content")


def links(hub_rows: DataFrame, *, key: str = "hub", content: str = "content") -> DataFrame:
    """hub_links(hub, pos, target, description): the first link to each target; cross links don't count."""
    plain = F.regexp_replace(content, _CROSS, "")
    pairs = F.arrays_zip(F.regexp_extract_all(plain, F.lit(_LINK), F.lit(1)).alias("t"), F.regexp_extract_all(plain, F.lit(_LINK), F.lit(2)).alias("d"))
    rows = hub_rows.select(F.col(key).alias("hub"), F.posexplode(pairs).alias("pos", "x")).select("hub", "pos", F.trim("x.t").alias("target"), F.trim("x.d").alias("d"))
    first = rows.where("target <> ''").groupBy("hub", "target").agg(F.min(F.struct("pos", "d")).alias("f"))
    return first.select("hub", F.col("f.pos").alias("pos"), "target", F.when(F.col("f.d") != "", F.col("f.d")).alias("description"))


def cross_links(content: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("content", F.lit(_CROSS_TARGET), F.lit(1))
    return content.select(F.col("path").alias("source"), F.explode(F.transform(found, lambda x: F.trim(x))).alias("target"))


def feature_tags(content: DataFrame) -> DataFrame:
    tag = F.trim(F.regexp_extract("content", _FEATURE, 1))
    return content.select("path", tag.alias("feature")).where("feature <> ''")


def resolved(link_rows: DataFrame, files: DataFrame) -> DataFrame:
    """link_rows with exists."""
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("found")).distinct()
    return link_rows.join(known, "target", "left").withColumn("exists", F.coalesce("found", F.lit(False))).drop("found")


def orphans(files: DataFrame, link_rows: DataFrame) -> DataFrame:
    """Files, other than notes, that no hub links."""
    linked = link_rows.select(F.col("target").alias("path")).distinct()
    return files.where(~F.lower("path").endswith(".md")).select("path").join(linked, "path", "left_anti")


def find_hub(hub_rows: DataFrame, name: str) -> DataFrame:
    """The hub of that title or file name, else those that contain it."""
    base = F.lower(F.regexp_replace(F.regexp_extract("hub", "([^/]*)$", 1), r"\.md$", ""))
    q = name.strip().lower()
    rank = F.when((F.lower("title") == q) | (base == q), 0).when(F.lower("title").contains(q) | base.contains(q), 1)
    rows = hub_rows.withColumn("rank", rank).where("rank is not null")
    return rows.orderBy("rank", "hub").limit(1)
