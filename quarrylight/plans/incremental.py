"""Incremental state: staleness, merged caches, content-addressed blobs with copy-on-write refs.

Tables: vectors(key, hash, vec); blobs(hash, vec); manifests(ref, path, chunk_idx, hash); refs(ref, parent).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import IGNORED_DIRS, tracked

MAX_CHAIN = 128


def staleness(current: DataFrame, stored: DataFrame, *, key: str = "key") -> DataFrame:
    """(key, state) of current(key, hash) against stored(key, hash): fresh, changed, new, and deleted."""
    a, b = current.select(F.col(key).alias("key"), F.col("hash").alias("now")), stored.select(F.col(key).alias("key"), F.col("hash").alias("then"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "fresh").otherwise("changed")
    return a.join(b, "key", "full").select("key", state.alias("state"))


def merged_cache(disk: DataFrame, incoming: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """vectors of both, the incoming ones by key, without deletions."""
    i = incoming.select("key", F.col("hash").alias("ih"), F.col("vec").alias("iv"))
    out = disk.join(i, "key", "full").select("key", F.coalesce("ih", "hash").alias("hash"), F.when(F.col("ih").isNotNull(), F.col("iv")).otherwise(F.col("vec")).alias("vec"))
    return out if deletions is None else out.join(deletions.select("key"), "key", "left_anti")


def save_cache(spark: SparkSession, path: str, incoming: DataFrame, deletions: DataFrame | None = None, dims: int | None = None, keep: int = 2) -> None:
    """Merge into the Parquet table at path: a new version is written beside it, and becomes current by one more small file.

    Nothing current is overwritten, so a reader finds the old version or the new one; versions before the last ``keep`` go.
    A table of other dimensions is replaced.
    """
    disk = load_cache(spark, path)
    if disk is not None and dims is not None:
        row = disk.select(F.size("vec").alias("n")).first()
        disk = None if row is not None and row.n != dims else disk
    out = incoming if disk is None else merged_cache(disk, incoming)
    out = out if deletions is None else out.join(deletions.select("key"), "key", "left_anti")
    versions = _versions(spark, path)
    number, version = (versions[-1].number + 1 if versions else 0), uuid.uuid4().hex
    out.write.parquet(f"{path}/{version}")
    spark.createDataFrame([(number, version)], "number bigint, version string").coalesce(1).write.mode("append").parquet(f"{path}/current")
    for old in versions[: max(0, len(versions) + 1 - keep)]:
        where, files = _folder(spark, f"{path}/{old.version}")
        files.delete(where, True)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list:
    where, files = _folder(spark, f"{path}/current")
    return sorted(spark.read.parquet(f"{path}/current").collect()) if files.exists(where) else []


def load_cache(spark: SparkSession, path: str) -> DataFrame | None:
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1].version}") if versions else None


def swept(vectors: DataFrame, dims: int, ignored: list[str] = IGNORED_DIRS) -> DataFrame:
    """vectors of tracked keys and right dimensions."""
    return vectors.where(tracked("key", ignored) & (F.size("vec") == dims))


def newest(rows: DataFrame, most: int, *, order: str, key: str) -> DataFrame:
    """The newest rows by order: a bounded top-k, e.g. of query vectors or restore points."""
    return rows.orderBy(F.desc(order), key).limit(most)


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n, digest) that doesn't depend on the order of rows: 60 bits of each row's MD5, joined by exclusive or."""
    own = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in columns))), 1, 15), 16, 10).cast("bigint")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(own), F.lit(0)).alias("digest"))


def still_valid(old: tuple[int, int], new: tuple[int, int]) -> str:
    """What a changed corpus means for an index: same, served stale while it is rebuilt, or rebuilt first."""
    if old == new:
        return "same"
    return "stale" if abs(new[0] - old[0]) <= min(round(0.05 * old[0]), 200) else "rebuild"


def index_action(old: dict, new: dict) -> str:
    """What a request does with an index of {generation, n, digest}: use it as it is, use it while it is rebuilt, or rebuild it first.

    An equal generation needs no look at the corpus; an equal fingerprint only a new generation.
    """
    if old["generation"] == new["generation"]:
        return "same"
    return still_valid((old["n"], old["digest"]), (new["n"], new["digest"]))


class Timed:
    """Values kept for a while: get() computes one that is missing, too old, or of another mark (e.g. a number of files)."""

    def __init__(self, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: Hashable, compute: Callable[[], Any], mark: Any = None) -> Any:
        found = self.held.get(key)
        if found is None or found[1] != mark or self.clock() - found[0] >= self.seconds:
            found = self.held[key] = (self.clock(), mark, compute())
        return found[2]

    def refresh(self, key: Hashable | None = None) -> None:
        self.held = {} if key is None else {k: v for k, v in self.held.items() if k != key}


def chains(refs: DataFrame) -> DataFrame:
    """(ref, ancestor, depth) of every ref along its parents, itself at 0. Doubling: the rounds are the log of the depth."""
    from quarrylight.session import checkpoint

    out = checkpoint(refs.select("ref", F.col("ref").alias("ancestor"), F.lit(0).alias("depth")).unionByName(refs.where("parent is not null").select("ref", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))))
    n = out.count()
    while True:
        far = out.join(out.select(F.col("ref").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("depth").alias("d2")), "ancestor").select("ref", F.col("a2").alias("ancestor"), (F.col("depth") + F.col("d2")).alias("depth"))
        out = checkpoint(far.groupBy("ref", "ancestor").agg(F.min("depth").alias("depth")).where(F.col("depth") <= MAX_CHAIN))
        if (now := out.count()) == n:
            return out
        n = now


def lookup(refs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(ref, path, chunk_idx, hash, depth): each ref's chunks, the nearest ancestor's hash."""
    rows = chains(refs).join(manifests.withColumnRenamed("ref", "ancestor"), "ancestor")
    best = rows.groupBy("ref", "path", "chunk_idx").agg(F.min_by(F.struct("hash", "depth"), "depth").alias("b"))
    return best.select("ref", "path", "chunk_idx", "b.hash", "b.depth")


def vectors_of(found: DataFrame, blobs: DataFrame, *, strict: bool = True) -> DataFrame:
    """found with vec; with strict a hash without a blob is an error when the row is computed."""
    out = found.join(blobs, "hash", "left")
    return out.withColumn("vec", F.coalesce("vec", F.raise_error(F.concat(F.lit("no blob for "), F.col("hash"))).cast("array<float>"))) if strict else out


def fork(refs: DataFrame, ref: str, parent: str) -> DataFrame:
    return refs.unionByName(refs.sparkSession.createDataFrame([(ref, parent)], "ref string, parent string"))


def changes(refs: DataFrame, manifests: DataFrame, chunks: DataFrame, ref: str) -> DataFrame:
    """chunks(path, chunk_idx, hash, ...) of a ref with hit: its own or an inherited manifest has that hash already."""
    own = lookup(refs, manifests).where(F.col("ref") == ref).select(F.col("path").alias("p"), F.col("chunk_idx").alias("k"), F.col("hash").alias("h"))
    return chunks.join(own, (F.col("path") == F.col("p")) & (F.col("chunk_idx") == F.col("k")), "left").withColumn("hit", F.coalesce(F.col("h") == F.col("hash"), F.lit(False))).drop("p", "k", "h")


def indexed(refs: DataFrame, manifests: DataFrame, blobs: DataFrame, chunks: DataFrame, ref: str, embedder) -> tuple[DataFrame, DataFrame]:
    """(manifests, blobs) after a ref's chunks(path, chunk_idx, chunk, hash): only what changed is embedded, and of that
    only texts without a blob."""
    from quarrylight.session import checkpoint
    from quarrylight.sources.embedding import embedded

    missed = checkpoint(changes(refs, manifests, chunks, ref).where("not hit"))
    new = missed.select("hash", "chunk").dropDuplicates(["hash"]).join(blobs.select("hash"), "hash", "left_anti")
    more = embedded(new, embedder, text="chunk").select("hash", "vec")
    delta = missed.select(F.lit(ref).alias("ref"), "path", "chunk_idx", "hash")
    rest = manifests.join(delta.select("ref", "path", "chunk_idx"), ["ref", "path", "chunk_idx"], "left_anti")
    return rest.select("ref", "path", "chunk_idx", "hash").unionByName(delta), blobs.unionByName(more)


def restore_points(points: DataFrame, most: int = 100) -> DataFrame:
    return newest(points, most, order="timestamp", key="id")


def restore_point(content: DataFrame, paths: DataFrame, point: str) -> DataFrame:
    """backups(point, path, content) of what paths(path) hold now, before they change; null for one that isn't there yet."""
    return paths.select("path").distinct().join(content.select("path", "content"), "path", "left").select(F.lit(point).alias("point"), "path", "content")


def undone(content: DataFrame, backups: DataFrame, point: str) -> DataFrame:
    """content(path, content) as at a restore point: its files have their old content back, and what was new since is gone."""
    old = backups.where(F.col("point") == point).select("path", "content")
    return content.select("path", "content").join(old.select("path"), "path", "left_anti").unionByName(old.where("content is not null"))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
