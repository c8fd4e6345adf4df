"""Change streams: micro-batches of changed files merged into the index, with no-op suppression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "path string, mtime bigint, size bigint, hash string, content string, deleted boolean"


def change_stream(spark: SparkSession, folder: str, schema: str = CHANGES, *, files_per_trigger: int = 8) -> DataFrame:
    """A stream of change rows from Parquet files as they arrive, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def effective(changes: DataFrame, *, event_time: str | None = None, horizon: str = "1 day") -> DataFrame:
    """changes without those whose (path, mtime, size) came before; with an event time the state is bounded by it."""
    keys = ["path", "mtime", "size"]
    if event_time:
        return changes.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)
    return changes.dropDuplicates(keys)


#: Milliseconds between micro-batches: changes that come meanwhile are one batch.
DEBOUNCE_MS, LEAST_MS, HEAD_MS = 700, 100, 300


def debounced(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, every_ms: int = DEBOUNCE_MS) -> StreamingQuery:
    """start() with a batch every so often. State and progress persist with each batch, so nothing else needs a delayed save."""
    return start(changes, apply, checkpoint, every=f"{max(LEAST_MS, every_ms)} milliseconds")


def head_sink(history: Callable[[], DataFrame], published: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function over heads(ref, sha, head): when the main line's head moves on, the refs whose work it now holds go to published.

    A batch's rows are the refs with their last own commit and the head that was seen; published gets (ref, sha, head).
    """
    from quarrylight.sources.git import ancestors

    def apply(batch: DataFrame, generation: int) -> None:
        last = batch.groupBy("ref").agg(F.max_by(F.struct("sha", "head"), "at").alias("x")).select("ref", "x.*")
        held = ancestors(history(), last.select(F.col("head").alias("sha")).distinct()).select("sha")
        published(last.join(held, "sha", "left_semi"), generation)

    return apply


def start(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Run apply(batch, generation) on each micro-batch. Without a period, all that is there is taken and it ends."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def index_sink(spark: SparkSession, path: str, embedder) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the vector cache at path up to date: the last change of a path counts, deletions go."""
    from quarrylight.plans.incremental import save_cache
    from quarrylight.sources.embedding import embedded

    def apply(batch: DataFrame, generation: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("hash", "content", "deleted"), F.struct("mtime", "hash")).alias("c")).select(F.col("path").alias("key"), "c.hash", "c.content", F.coalesce("c.deleted", F.lit(False)).alias("deleted"))
        fresh = embedded(last.where("not deleted").select("key", "hash", "content"), embedder, text="content").select("key", "hash", "vec")
        save_cache(spark, path, fresh, last.where("deleted").select("key"))

    return apply


def windowed_counts(events: DataFrame, *, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window with a watermark; the same plan runs on a batch."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
