"""What a git repository says about changes: the driver asks git, and the answers are relations."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What each hook compares.
HOOKS = {
    "post-commit": ["diff-tree", "--no-commit-id", "--name-only", "-r", "--root", "HEAD"],
    "post-merge": ["diff", "--name-only", "ORIG_HEAD", "HEAD"],
    "post-checkout": ["diff", "--name-only", "HEAD@{1}", "HEAD"],
}
TIMEOUT_S = 60


def git(root: str, *args: str) -> str | None:
    """git's answer, or None where it fails, isn't there, or says what isn't UTF-8."""
    try:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=TIMEOUT_S)
        return out.stdout.decode() if out.returncode == 0 else None
    except (OSError, UnicodeDecodeError, subprocess.TimeoutExpired):
        return None


def changed_paths(spark: SparkSession, root: str, hook: str) -> DataFrame:
    """(path) that a hook's event changed; no row for another hook, or where git has no answer."""
    said = git(root, *HOOKS[hook]) if hook in HOOKS else None
    return spark.createDataFrame([(x.replace("\\", "/"),) for x in (said or "").splitlines() if x.strip()], "path string").distinct()


def head(root: str) -> str | None:
    said = git(root, "rev-parse", "HEAD")
    return said.strip() if said else None


def commits(spark: SparkSession, root: str, *revisions: str) -> DataFrame:
    """(sha, parent): a row per parent of each commit, a null one for the first."""
    said = git(root, "log", "--format=%H %P", *(revisions or ("HEAD",))) or ""
    rows = [(x.split()[0], p) for x in said.splitlines() for p in (x.split()[1:] or [None])]
    return spark.createDataFrame(rows, "sha string, parent string")


def ancestors(history: DataFrame, of: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(sha, hop): the commits of(sha) and everything they follow, by least distance."""
    from quarrylight.session import checkpoint

    edges = checkpoint(history.where("parent is not null").select(F.col("sha").alias("src"), F.col("parent").alias("dst")).distinct())
    seen = frontier = checkpoint(of.select("sha").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = edges.join(frontier.select(F.col("sha").alias("src")), "src").select(F.col("dst").alias("sha")).distinct()
        frontier = checkpoint(step.join(seen, "sha", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def is_ancestor(history: DataFrame, older: str, newer: str) -> bool:
    """Whether newer follows older; a commit follows itself."""
    start = history.sparkSession.createDataFrame([(newer,)], "sha string")
    return not ancestors(history, start).where(F.col("sha") == older).isEmpty()
