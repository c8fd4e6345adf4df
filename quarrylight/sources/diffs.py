"""Unified diffs as hunks(path, start, end): the new side's changed lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ESCAPES = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, '"': 34}


def unquoted(path: str) -> str:
    """A path as git quotes it: octal and C escapes inside double quotes."""
    if not (len(path) > 1 and path[0] == path[-1] == '"'):
        return path
    out, body, i = bytearray(), path[1:-1], 0
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode()
            i += 1
        elif m := re.match(r"[0-7]{1,3}", body[i + 1 :]):
            out.append(int(m[0], 8) & 0xFF)
            i += 1 + len(m[0])
        else:
            out.append(_ESCAPES.get(body[i + 1 : i + 2], ord(body[i + 1 : i + 2] or "\\")))
            i += 2
    return out.decode("utf-8", "replace")


def hunks_of(lines: DataFrame, *, diff: str = "diff", line: str = "line", text: str = "text") -> DataFrame:
    """hunks of diffs given as lines(diff, line, text): a header's path is carried forward to its hunks."""
    quoted = F.udf(unquoted, "string")
    raw = F.regexp_extract(text, r"^\+\+\+ ([^\t]+)", 1)
    path = F.when(F.col(text).startswith("+++ "), F.when(raw.startswith('"'), quoted(raw)).otherwise(raw))
    carried = F.last(path, True).over(Window.partitionBy(diff).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.withColumn("file", carried).where(F.col(text).rlike(pattern)).where("file <> '/dev/null'")
    start = F.regexp_extract(text, pattern, 1).cast("int")
    count = F.when(F.regexp_extract(text, pattern, 2) == "", 1).otherwise(F.greatest(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(1)))
    return rows.select(F.col(diff).alias("diff"), F.regexp_replace("file", "^b/", "").alias("path"), start.alias("start"), (start + count - 1).alias("end"))


def hunks(spark: SparkSession, diff: str) -> DataFrame:
    rows = [(0, i, x) for i, x in enumerate(diff.splitlines())]
    return hunks_of(spark.createDataFrame(rows, "diff int, line int, text string")).drop("diff")
